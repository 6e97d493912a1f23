"""Vector-tile and model-file scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """Signed number of a zigzag-coded one."""
    return F.shiftright(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))


def filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def composite_id(raw: Column, layer: Column, kind: Column, detail: Column) -> Column:
    """id:layer, then the kind and its detail where known; an unknown kind before a detail stays empty."""
    tail = F.when(detail.isNotNull(), F.concat(F.lit(":"), F.coalesce(kind, F.lit("")), F.lit(":"), detail)).when(kind.isNotNull(), F.concat(F.lit(":"), kind)).otherwise("")
    return F.concat(raw.cast("string"), F.lit(":"), layer, tail)


def metres(text: Column) -> Column:
    """A number that may end in m or M."""
    return F.regexp_replace(F.trim(text), r"\s*[mM]$", "").try_cast("double")


def tensor_layer(name: Column) -> Column:
    """-1 for the token embedding, N for block N, 99 for the output norm, else 999."""
    block = F.regexp_extract(name, r"^blk\.(\d+)\.", 1).try_cast("int")
    return F.when(F.startswith(name, F.lit("token_embd")), -1).when(block.isNotNull(), block).when(F.startswith(name, F.lit("output_norm")), 99).otherwise(999)


def dims(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long"))


def entity_number(qid: Column) -> Column:
    """42 of "Q42"; null if what follows the first character is no number."""
    return F.substring(qid, 2, 20).try_cast("long")
