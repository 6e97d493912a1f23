import bz2
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import inference, ingest, maps, semantic
from waymark.sources import lines, model_file, raster, samples, tile_archive, vector_tiles
from waymark.sources.html import page_sections


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"x\ny"))
    (tmp_path / "b.txt.bz2").write_bytes(bz2.compress(b"z"))
    assert {r.value for r in lines.lines(spark, str(tmp_path)).collect()} == {"x", "y", "z"}


def test_article_archive(spark, tmp_path):
    page = "<h1>T</h1><p>one<p>two<sup>9</sup><ul><li>three<p>four</p></li></ul><h2>Empty</h2><h3>S</h3><p>five</p>"
    rows = [{"identifier": 1, "name": "A", "main_entity": {"identifier": "Q7"}, "article_body": {"html": page}}, {"identifier": 2, "name": "B", "main_entity": {"identifier": "x"}, "article_body": {"html": "<p>x</p>"}}, {"identifier": 3, "name": "C", "main_entity": {"identifier": "Q8"}, "article_body": {"html": ""}}]
    (tmp_path / "a.tar.gz").write_bytes(samples.archive([json.dumps(r) for r in rows]))
    got = ingest.articles(lines.archive_lines(spark, str(tmp_path / "a.tar.gz")))
    assert [r.entity_id for r in got.collect()] == [7]
    s = ingest.sections(got).orderBy("pow").collect()
    assert [(r.title, r.content, r.pow) for r in s] == [("T", "one\n\ntwo\n\nthreefour", 1), ("S", "five", 3)]
    assert s[0].id != s[1].id


def test_page_sections():
    assert page_sections("<p>lead</p><script>var t='</p>';</script><h2>A</h2>") == [{"title": "", "content": "lead", "pow": 0}]
    assert page_sections(None) == [] and page_sections("") == []


def test_vector_tile():
    raw = samples.tile([(5, 3, [[(0, 0), (10, 0), (10, 10)]], {"a": "x", "b": 2.5, "c": -3, "d": True}), (6, 2, [[(0, 0), (4096, 4096)]], {})])
    got = vector_tiles.decode(raw, 1, 1, 0)
    assert got[0]["props"] == {"a": "x", "b": "2.5", "c": "-3", "d": "true"} and got[0]["kind"] == "Polygon"
    assert len(got[0]["geometry"][0]) == 4 and got[0]["geometry"][0][0] == got[0]["geometry"][0][-1]
    assert got[1]["geometry"][0][-1] == {"lon": 180.0, "lat": 0.0}


def test_tile_archive(spark, tmp_path):
    blob, other = samples.tile([(1, 1, [[(1, 1)]], {})]), b"other"
    path = str(tmp_path / "a.pmtiles")
    (tmp_path / "a.pmtiles").write_bytes(samples.tile_archive([(0, 1, other), (1, 2, blob)], [(5, 3, blob), (9, 1, b"third")], {"name": "demo", "n": 3}))
    e = tile_archive.entries(spark, path)
    assert {(r.tile_id, r.run_length) for r in e.collect()} == {(0, 1), (1, 2), (5, 3), (9, 1)}
    assert maps.run_count(e, 7).first()[0] == 1 + 2 + 2
    shallow, data = tile_archive.tiles(spark, path)
    assert shallow.count() == 7 and data.count() == 3
    t = maps.tiles_view(shallow, data)
    assert {bytes(r.tile_data) for r in maps.fetch(t, 0, 0, 0).collect()} == {other}
    assert tile_archive.tiles(spark, path, 3)[0].count() == 3
    assert json.loads(tile_archive.metadata((tmp_path / "a.pmtiles").read_bytes()))["name"] == "demo"
    with pytest.raises(ValueError):
        tile_archive.header(b"x" * 127)


@pytest.mark.parametrize("kind,compression,predictor,tiled", [(np.int16, 1, 1, False), (np.int16, 8, 2, True), (np.float32, 32946, 3, False), (np.float32, 8, 3, True), (np.float32, 1, 1, True)])
def test_raster(spark, tmp_path, kind, compression, predictor, tiled):
    v = np.random.default_rng(2).integers(-5000, 8000, (20, 36)).astype(kind)
    (tmp_path / "a.tif").write_bytes(samples.tiff(v, compression, predictor, tiled))
    got = raster.grid(spark, str(tmp_path / "a.tif")).toPandas()
    back = np.zeros((20, 36))
    back[got.gy, got.gx] = got.value
    assert len(got) == 720 and np.array_equal(back, v.astype(float))


def test_bad_samples_are_zero():
    v = np.array([[np.nan, np.inf, -20000, 9500, 12.5]], np.float32)
    assert next(raster.samples(samples.tiff(v)))[2].tolist() == [[0, 0, 0, 0, 12.5]]


def test_elevation_tiles(spark):
    df = spark.createDataFrame([(1, 0, 1, x, y, 0.0) for x in range(4) for y in range(4)], "zoom int, x int, y int, px int, py int, elevation double")
    r = raster.elevation_tiles(df, 4).first()
    assert (r.col, r.row) == (0, 0) and bytes(r.tile_data)[:8] == b"\x89PNG\r\n\x1a\n"


def _model() -> bytes:
    rng = np.random.default_rng(3)
    d, heads, kv, size, ff, words = 8, 2, 1, 4, 12, 20
    meta = {"general.architecture": "qwen3", "qwen3.block_count": 2, "qwen3.attention.head_count": heads, "qwen3.attention.head_count_kv": kv, "qwen3.rope.freq_base": 1e4}
    shapes = {"token_embd.weight": (words, d), "output_norm.weight": (d,), "output.weight": (words, d)}
    for i in range(2):
        shapes |= {f"blk.{i}.{n}": s for n, s in {"attn_norm.weight": (d,), "ffn_norm.weight": (d,), "attn_q.weight": (heads * size, d), "attn_k.weight": (kv * size, d), "attn_v.weight": (kv * size, d), "attn_output.weight": (d, heads * size), "attn_q_norm.weight": (size,), "attn_k_norm.weight": (size,), "ffn_gate.weight": (ff, d), "ffn_up.weight": (ff, d), "ffn_down.weight": (d, ff)}.items()}
    tensors = {n: (model_file.F32, list(s[::-1]), rng.normal(size=s).astype("<f4").tobytes()) for n, s in shapes.items()}
    return samples.model(meta, tensors)


def test_model_file(spark, tmp_path):
    (tmp_path / "m.gguf").write_bytes(_model())
    t = model_file.tensors(spark, str(tmp_path / "m.gguf"))
    layers = {r.name: r.layer for r in t.select("name", "layer").collect()}
    assert layers["token_embd.weight"] == -1 and layers["blk.1.ffn_up.weight"] == 1 and layers["output_norm.weight"] == 99 and "output.weight" not in layers
    assert len(model_file.dequantized(t.where("name = 'token_embd.weight'")).first()["values"]) == 160
    assert model_file.metadata(spark, str(tmp_path / "m.gguf")).where("key = 'qwen3.block_count'").first()["value"] == "2"


def test_dequantize():
    x = np.arange(-16, 16, dtype=np.float32)
    assert np.array_equal(model_file.dequantize((x.view(np.uint32) >> 16).astype("<u2").tobytes(), model_file.BF16), x)
    assert np.array_equal(model_file.dequantize(x.astype("<f2").tobytes(), model_file.F16), x)


def test_transformer():
    m = inference.Model.load(_model())
    v = m.embed([1, 5, 3])
    assert abs(np.linalg.norm(v) - 1) < 1e-9
    # causal: what follows doesn't change a prefix, and positions count
    assert not np.allclose(v, m.embed([5, 1, 3]))
    q = np.random.default_rng(0).normal(size=(5, 2, 4))
    a = inference.attention(q, q[:, :1], q[:, :1])
    assert np.allclose(a[:3], inference.attention(q[:3], q[:3, :1], q[:3, :1]))
    r = inference.rotate(q, 1e4)
    assert np.allclose((r**2).sum(-1), (q**2).sum(-1)) and np.allclose(r[0], q[0])
    with pytest.raises(ValueError):
        inference.Model.load(samples.model({"general.architecture": "other"}, {}))


def test_embedder(spark):
    raw = _model()
    df = spark.createDataFrame([(1, "abc"), (2, "d")], "id long, input string")
    got = semantic.embed(df, inference.embedder(lambda: raw, lambda t: [ord(c) % 20 for c in t])).collect()
    assert all(len(r.embedding) == 8 for r in got)


def test_byte_pairs():
    letters = list(model_file.byte_letters().values())
    assert len(set(letters)) == 256
    vocabulary = {w: i for i, w in enumerate([*letters, "ab", "abc", "<e>"])}
    c = model_file.BytePairs(vocabulary, ["a b", "ab c"], ("<e>",), 258)
    assert c.encode("abcab<e>") == [257, 256, 258, 258]


def test_compress(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.lit("x"))
    lines.compress(df, f"{tmp_path}/z")
    lines.decompress(spark, f"{tmp_path}/z", f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").exceptAll(df).count() == 0
    assert any("zstd" in p.name for p in (tmp_path / "z").iterdir())
    assert lines.table_or_empty(spark, "no_such_table", "a int").count() == 0


def test_byte_pairs_of_whole_sections(spark):
    """All of every section is encoded, and cutting texts where no merge crosses changes no id."""
    from waymark.plans import registry

    folder = "/root/testdata/sf0.001"
    letters = list(model_file.byte_letters().values())
    merges = ["t h", "th e", "a n", "an d"]
    vocabulary = {w: i for i, w in enumerate([*letters, *(m.replace(" ", "") for m in merges), "<end>"])}
    back = {i: w for w, i in vocabulary.items()}
    byte = {x: b for b, x in model_file.byte_letters().items()}
    text = lambda ids: bytes(byte[x] for i in ids[:-1] for x in back[i]).decode()
    got = {r.id: r for r in registry.queries()["bpe_encode"](spark, folder).collect()}
    want = registry.Tables(spark, folder).sections.collect()
    assert len(got) == len(want) and max(len(r.content) for r in want) > 40
    for r in want:
        assert text(got[r.id].title_ids) == r.title and text(got[r.id].ids) == r.content
    c = model_file.BytePairs(vocabulary | {x: 300 + i for i, x in enumerate(("aa", "aaa", "a]", "a]-"))}, [*merges, "a a", "aa a", "a ]", "a] -"])
    for w in ("the and then", "aaaaaaa]-^thea", "thand é\n the", "", *(r.content[:3000] for r in want[:20])):
        assert c.word(w) == c.merged("".join(c.letters[b] for b in w.encode()))
