"""Imports, large files by offset, HTTP sources and providers, the command line."""

import bz2
import gzip
import json
import re
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import __main__ as cli
from waymark.engine import Engine
from waymark.functions import vector
from waymark.operators import inference, semantic
from waymark.sources import lines, model_file, ranges, raster, samples, tile_archive


def claim(n, prop, value, label, text=""):
    return json.dumps({"id": f"Q{n}", "claims": {prop: [{"mainsnak": {"datavalue": {"value": value}}}]}, "labels": {"en": {"value": label}}, "descriptions": {"en": {"value": text}}}, separators=(",", ":")) + ","


DUMP = "\n".join([
    "[",
    claim(1, "P569", {"time": "+1879-03-14T00:00:00Z"}, "One", "first"),
    claim(2, "P625", {"latitude": 10.5, "longitude": -20.25, "precision": 0.1, "globe": "http://www.wikidata.org/entity/Q2"}, "Two"),
    claim(2, "P625", {"latitude": 10.5, "longitude": -20.25, "precision": 0.2}, "Two"),
    claim(3, "P19", {"id": "Q2"}, "Three"),
    claim(4, "P625", {"latitude": 95.0, "longitude": 0.0}, "Too far north"),
    claim(5, "P625", {"latitude": 1.0, "longitude": 0.0, "globe": "http://www.wikidata.org/entity/Q111"}, "Elsewhere"),
    claim(6, "P569", {"time": "+0000-00-00T00:00:00Z"}, "Year zero"),
    "]",
])


class Server(BaseHTTPRequestHandler):
    def do_GET(self):
        raw = DUMP.encode()
        packed = {"tar.gz": lambda: samples.archive(["a", "b"]), ".gz": lambda: gzip.compress(raw), ".bz2": lambda: bz2.compress(raw)}
        body = next((f() for end, f in packed.items() if self.path.endswith(end)), raw)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        data = [{"index": i, "embedding": [float(len(t)), float(asked["model"] == "m"), float(self.headers["Authorization"] == "Bearer k")]} for i, t in enumerate(asked["input"])]
        body = json.dumps({"data": data[::-1]} if self.path == "/ok" else {"data": [], "error": {"message": "no such model"}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_lines(spark, url):
    want = DUMP.split("\n")
    for name in ("a.json", "a.json.gz", "a.json.bz2"):
        assert [r.value for r in lines.lines(spark, f"{url}/{name}").collect()] == want
    assert sorted(r.value for r in lines.archive_lines(spark, f"{url}/x.tar.gz").collect()) == ["a", "b"]


def test_http_embedder(spark, url):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)] + [(99, None)], "id long, input string")
    got = {r.id: list(r.embedding) for r in semantic.embed(df, semantic.http_embedder(f"{url}/ok", "m", "k")).collect()}
    assert got == {i: [float(i), 1.0, 1.0] for i in range(70)} | {99: [0.0, 1.0, 1.0]}
    with pytest.raises(Exception, match="no such model"):
        semantic.embed(df, semantic.http_embedder(f"{url}/bad", "m")).collect()


def test_import_entities(spark, tmp_path):
    (tmp_path / "d.json").write_text(DUMP)
    e = Engine.open(spark, str(tmp_path / "t"))
    for _ in range(2):  # the second import changes nothing
        e.import_entities(str(tmp_path / "d.json"), str(tmp_path / "t"))
        assert {r.id: r.title for r in e.entities.collect()} == {1: "One", 2: "Two", 3: "Three", 4: "Too far north", 6: "Year zero"}
        assert {(r.entity_id, r.year) for r in e.entity_times.collect()} == {(1, 1879), (6, 0)}
        got = sorted((r.entity_id, r.prop_code, r.latitude, r.precision) for r in e.entity_places.collect())
        assert got == [(2, 625, 10.5, 0.1), (2, 625, 10.5, 0.2), (3, 19, 10.5, 0.1), (3, 19, 10.5, 0.2)]
    assert Engine.open(spark, str(tmp_path / "t")).entities.count() == 5


def test_import_articles_and_store(spark, tmp_path):
    page = "<h1>T</h1><p>one</p><h2>S</h2><p>two</p>"
    rows = [{"identifier": 10 + i, "name": f"A{i}", "main_entity": {"identifier": f"Q{q}"}, "article_body": {"html": page}} for i, q in enumerate((7, 8, 7))]
    (tmp_path / "a.tar.gz").write_bytes(samples.archive([json.dumps(r) for r in rows]))
    e = Engine.open(spark, str(tmp_path / "none"))
    e.import_articles(str(tmp_path / "a.tar.gz"))
    assert sorted((r.id, r.article_id, r.title) for r in e.entities.collect()) == [(7, 12, "A2"), (8, 11, "A1")]
    assert e.sections.count() == 4
    blob = lambda *x: bytearray(np.array(x, "<f4").tobytes())
    store = {
        "articles": spark.createDataFrame([(1, "New", "Q7"), (2, "None", "P1")], "id long, title string, entity string"),
        "sections": spark.createDataFrame([(5, 1, "s", "text"), (6, 2, "s", "text")], "id long, article_id long, title string, content string"),
        "setup": spark.createDataFrame([("model", "x"), ("secret", "y")], "key string, value string"),
        "vectors": spark.createDataFrame([(5, blob(1, 2)), (6, blob(3, 4))], "id long, embedding binary"),
    }
    e.import_store(store)
    assert {r.id: (r.article_id, r.title) for r in e.entities.collect()} == {7: (1, "New"), 8: (11, "A1")}
    assert e.sections.where("id = 5 and pow = 0 and entity_id = 7").count() == 1 and e.sections.count() == 5
    assert [r.key for r in e.settings.collect()] == ["model"] and {r.id: list(r.embedding) for r in e.vectors.collect()} == {5: [1.0, 2.0], 6: [3.0, 4.0]}


def test_float_blobs(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, None), (3, [])], "id int, v array<float>").withColumn("b", vector.blob(F.col("v")))
    rows = df.withColumn("w", vector.floats(F.col("b"))).orderBy("id").collect()
    assert bytes(rows[0].b) == struct.pack("<2f", 0.5, -2.0) and [r.w for r in rows] == [[0.5, -2.0], None, []]


def test_files_over_two_gigabytes(spark, tmp_path):
    """A sparse tile archive whose leaf directory and last tile stand behind 3 GB, and a sparse model file."""
    raw = samples.tile_archive([(0, 1, b"near")], [(5, 3, b"far")], {"name": "demo"})
    h = tile_archive.header(raw)
    gap = 3 << 30
    moved = list(tile_archive.HEADER.unpack_from(raw))
    moved[2 + 6] += gap  # the tiles' offset
    path = tmp_path / "big.pmtiles"
    with open(path, "wb") as f:
        f.write(tile_archive.HEADER.pack(*moved) + raw[tile_archive.HEADER.size : h["data_offset"]])
        f.seek(h["data_offset"] + gap)
        f.write(raw[h["data_offset"] :])
    assert path.stat().st_size > 2 << 30
    e = tile_archive.entries(spark, str(path))
    assert "content" not in e._jdf.queryExecution().toString()
    assert {(r.tile_id, r.run_length) for r in e.collect()} == {(0, 1), (5, 3)}
    assert {bytes(r.tile_data) for r in tile_archive.tiles(spark, str(path))[1].collect()} == {b"near", b"far"}
    assert json.loads(tile_archive.metadata_of(spark, str(path)).first().json)["name"] == "demo"


def test_long_runs_are_cut(spark):
    n = 3 * tile_archive.PIECE + 7
    e = spark.createDataFrame([("p", 0, n, 0, 1), ("p", n, 1, 1, 1)], "path string, tile_id long, run_length long, offset long, length long")
    assert tile_archive.coordinates(e).count() == n + 1
    assert tile_archive.coordinates(e, 10).count() == 10


def test_window_reads_blocks():
    raw, asked = bytes(range(256)) * 40, []
    w = ranges.Window(lambda at, n: asked.append((at, n)) or raw[at : at + n], 100, 3)
    rng = np.random.default_rng(1)
    for _ in range(300):
        at, n = int(rng.integers(0, len(raw))), int(rng.integers(0, 250))
        assert w.bytes(at, n) == raw[at : at + n]
    assert len(w.held) <= 3


def unpng(raw):
    w, h = struct.unpack(">II", raw[16:24])
    data = b"".join(m for m in re.findall(rb"IDAT(.*)\x00\x00\x00\x00IEND", raw, re.DOTALL))
    return np.frombuffer(zlib.decompress(data[:-4]), np.uint8).reshape(h, 1 + w * 3)[:, 1:].reshape(h, w, 3)


@pytest.mark.parametrize("tiled", [False, True])
def test_elevation_pyramid(spark, tmp_path, tiled):
    v = np.random.default_rng(2).integers(-5000, 8000, (48, 96)).astype(np.float32)
    (tmp_path / "a.tif").write_bytes(samples.tiff(v, 8, 1, tiled))
    got = {(r.zoom, r.col, r.row): unpng(bytes(r.tile_data)).astype(float) for r in raster.pyramid(spark, str(tmp_path / "a.tif"), 2, 16).collect()}
    assert len(got) == 1 + 4 + 16
    for (z, col, row), rgb in got.items():
        world, y0 = 16 << z, ((1 << z) - 1 - row) * 16
        for py, px in ((0, 0), (7, 15), (15, 3), (15, 15)):
            fx, at = (col * 16 + px) / world * 96, (y0 + py) / world
            fy = min(47.0, max(0.0, (90 - np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * at))))) / 180 * 48))
            x, y = int(fx), int(fy)
            cells = [(y, x, (1 - fy + y) * (1 - fx + x)), (y, (x + 1) % 96, (1 - fy + y) * (fx - x)), (min(47, y + 1), x, (fy - y) * (1 - fx + x)), (min(47, y + 1), (x + 1) % 96, (fy - y) * (fx - x))]
            want = sum(float(v[a, b]) * w for a, b, w in cells)
            r, g, b = rgb[py, px]
            assert abs(r * 256 + g + b / 256 - 32768 - want) < 0.01


def test_tokenizer_from_metadata(spark, tmp_path):
    words = [*model_file.byte_letters().values(), "th", "the", "<|end|>", "<|im|>"]
    meta = {model_file.TOKENS: words, model_file.MERGES: ["t h", "th e"], model_file.KINDS: [1] * (len(words) - 2) + [3, 3], model_file.END_KEY: len(words) - 2}
    t = model_file.tokenizer(meta)
    assert t.encode("the<|im|>th") == [257, 259, 256, 258]
    assert model_file.tokenizer({k: v for k, v in meta.items() if k in (model_file.TOKENS, model_file.MERGES)}).end == model_file.END
    with pytest.raises(ValueError):
        model_file.tokenizer({})


def test_quantized_product():
    rng = np.random.default_rng(5)
    rows, columns = 70, 64
    d, q = rng.normal(size=(rows, columns // 32)).astype("<f2"), rng.integers(-128, 128, (rows, columns // 32, 32)).astype("i1")
    raw = b"".join(d[i, j].tobytes() + q[i, j].tobytes() for i in range(rows) for j in range(columns // 32))
    whole = model_file.dequantize(raw, model_file.Q8_0).reshape(rows, columns)
    w = inference.Quantized(raw, rows, columns)
    w.ROWS = 32
    x = rng.normal(size=(3, columns))
    assert np.allclose(w.product(x), x @ whole.T) and np.array_equal(w.rows([4, 2]), whole[[4, 2]])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text(DUMP)
    t = str(tmp_path / "t")
    cli.run(spark, ["--tables", t, "--import-entities", str(tmp_path / "d.json"), "--sql", "select count(*) as n from entities"])
    assert "|5  |" in capsys.readouterr().out
    cli.run(spark, ["--tables", t, "--search", "--latitude", "10", "--longitude", "-20", "--radius", "500"])
    assert "Two" in capsys.readouterr().out
    cli.run(spark, ["--tables", t, "--search", "three", "--mode", "entity", "--compress", str(tmp_path / "z")])
    assert "Three" in capsys.readouterr().out and Engine.open(spark, str(tmp_path / "z")).entities.count() == 5
    with pytest.raises(SystemExit):
        cli.run(spark, ["--nothing"])
