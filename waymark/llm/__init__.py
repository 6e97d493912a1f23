"""Training-data operators: decontamination, token files, toxicity, licences, near duplicates,
nearest neighbours, sub-word segmentation, URL filters, secrets and language-model scores.

Nothing outside this subpackage imports it.
"""
