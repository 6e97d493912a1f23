import math

import numpy as np
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import geo, text, vector
from waymark.functions import time as tm
from waymark.operators import events as ev
from waymark.operators import hybrid, lexical, merge, semantic


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_known_answers(spark):
    jd = lambda y, m, d: tm.julian_day(F.lit(y), F.lit(m), F.lit(d))
    assert one(spark, jd(2000, 1, 1), jd(2000, 0, 0), jd(-4713, 11, 24)) == (2451545, 2451545, 0)
    assert abs(one(spark, geo.haversine_km(0, 0, 0, 180))[0] - math.pi * 6371) < 1e-6
    assert one(spark, *geo.tile_xy(0, 0, 1)) == (1, 1)
    assert one(spark, *geo.terrarium(F.lit(0.0))) == (128, 0, 0)
    assert abs(sum(one(spark, vector.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0))))[0]) - 1) < 1e-9


@limits(max_examples=200, deadline=None)
@given(st.integers(-4799, 3000), st.integers(1, 12), st.integers(1, 28))
def test_days_follow(y, m, d):
    assert ev.When._jd(y, m, d + 1 if d < 28 else d) - ev.When._jd(y, m, d) == (1 if d < 28 else 0)
    assert ev.When._jd(y, 12, 31) - ev.When._jd(y, 1, 1) == (365 if ev.When._days(y, 2) == 29 else 364)


def test_python_and_column_days_agree(spark):
    rows = [(y, m, d) for y in range(-9000, 3000, 487) for m in (0, 1, 2, 7, 12) for d in (0, 1, 28)]
    df = spark.createDataFrame(rows, "y int, m int, d int").withColumn("jd", tm.julian_day(F.col("y"), F.col("m"), F.col("d")))
    assert all(r.jd == ev.When._jd(r.y, r.m or 1, r.d or 1) for r in df.collect())


def test_tiles_go_round(spark):
    rows = [(float(a), float(b)) for a in range(-84, 85, 13) for b in range(-179, 180, 31)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), 9)
    df = df.select(x.alias("x"), y.alias("y"))
    lat, lon = geo.tile_point(9, F.col("x"), F.col("y"), 2048, 2048, 4096)
    x2, y2 = geo.tile_xy(lat, lon, 9)
    assert df.where((x2 != F.col("x")) | (y2 != F.col("y"))).count() == 0


def test_hilbert_is_a_bijection(spark):
    df = spark.range(0, 1 + 4 + 16 + 64).select(geo.hilbert_zxy(F.col("id")).alias("p")).select("p.*")
    assert {tuple(r) for r in df.collect()} == {(z, x, y) for z in range(4) for x in range(2**z) for y in range(2**z)}


def test_radius_join_is_the_cross_join(spark):
    rng = np.random.default_rng(4)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.append(rng.uniform(-90, 90, 300), [90, -90, 89.9, 0, 0]), np.append(rng.uniform(-180, 180, 300), [0, 50, -179.9, 180, -180]), strict=True))]
    places = spark.createDataFrame(p, "id long, latitude double, longitude double")
    centres = places.select(F.col("id").alias("centre_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    for km in (150.0, 1200.0, 9000.0):
        got = {(r.centre_id, r.place_id) for r in ev.radius_join(centres, places, km).collect()}
        want = {(r.centre_id, r.id) for r in centres.crossJoin(places).where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")) <= km).collect()}
        assert got == want


def test_whole_table_joins_have_all_centres(spark):
    from waymark.plans import registry

    folder = "/root/testdata/sf0.001"
    p = registry.Tables(spark, folder).entity_places.select("id", "latitude", "longitude").toPandas()
    lat, lon = np.radians(p["latitude"].to_numpy()), np.radians(p["longitude"].to_numpy())
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    i, j = np.nonzero(2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1))) <= 500)
    ids = p["id"].to_numpy()
    got = [(r.centre_id, r.place_id) for r in registry.queries()["radius_join"](spark, folder).collect()]
    assert sorted(got) == sorted(zip(ids[i].tolist(), ids[j].tolist(), strict=True)) and {c for c, _ in got} == set(ids.tolist())

    keys = [r.c_custkey for r in spark.read.parquet(f"{folder}/customer.parquet").collect()]
    want = []
    for k in keys:
        a, b = np.radians((k * 7919) % 12001 / 100 - 60), (k * 104729) % 30001 / 100 - 150
        d = 200 / geo.EARTH_KM
        s = np.degrees(np.arcsin(np.sin(d) / np.cos(a)))
        x0, x1 = (int((v + 180) / 360 * 64) for v in (b - s, b + s))
        y0, y1 = (int((1 - np.log(np.tan(v) + 1 / np.cos(v)) / np.pi) / 2 * 64) for v in (a + d, a - d))
        want += [(k, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    assert sorted((r.centre_id, r.x, r.y) for r in registry.queries()["tile_cover"](spark, folder).collect()) == sorted(want)


def test_circle_lies_in_its_box(spark):
    lat, lon = F.col("p.lat"), F.col("p.lon")
    for a, b in ((10.0, 20.0), (-60.0, 100.0)):
        box = geo.bounding_box(a, b, 700.0)
        df = spark.range(1).select(F.explode(geo.circle(a, b, 699.9)).alias("p"))
        assert df.where(~geo.in_box(lat, lon, box)).count() == 0


def test_phrases_and_snippets(spark):
    assert text.query_phrases('foo-bar "q" --') == [["foo", "bar"], ["q"]]
    assert lexical.bm25(None, "  ") is None
    docs = spark.createDataFrame([(1, "foo bar baz"), (2, "bar foo"), (3, "foo x bar"), (4, None), (5, "")], "id long, t string")
    index = lexical.build(docs, "id", [F.col("t")])
    assert {r.doc for r in lexical.bm25(index, "foo-bar").collect()} == {1}
    assert {r.doc for r in lexical.bm25(index, "foo bar").collect()} == {1, 2, 3}
    assert one(spark, text.snippet(F.lit("a b c d e f"), ["d"], 2))[0] == "...<mark>d</mark> e..."


def test_index_search_is_exact_with_all_probes(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 200)], "id long, embedding array<float>")
    c = semantic.fit(v, 8, 20)
    q = semantic.query_vector([float(x) for x in rng.normal(size=8)], 8)
    got = semantic.search(semantic.assign(semantic.prepared(v, 8), c), q, c, 10, len(c)).collect()
    want = semantic.exact(v, q, 8).orderBy(F.desc("cosine"), "id").limit(10).collect()
    assert [r.id for r in got] == [r.id for r in want]
    assert len(semantic.fit(v.limit(0), 8)) == 0


def test_fusion_does_not_depend_on_row_order(spark):
    rows = [(0, 1, 5, "a", 0, "x", 0, "T"), (1, 1, 6, "b", 7, "<mark>y</mark>", 1, "L"), (1, 2, 5, "c", 9, "longer", 1, "L")]
    names = "list int, rank int, entity_id long, title string, article_id long, snippet string, code int, type string"
    a, b = (hybrid.fuse([spark.createDataFrame(r, names)]).collect() for r in (rows, rows[::-1]))
    assert a == b and a[0].entity_id == 5 and a[0].type == "H" and a[0].snippet == "longer" and a[0].article_id == 9


def test_anti_and_semi_are_all(spark):
    s = spark.range(20).select("id", F.col("id").alias("entity_id"))
    v = spark.range(0, 20, 3)
    assert semantic.pending(s, v).count() + s.join(v, "id", "left_semi").count() == 20


def test_missing_setting_raises(spark):
    import pytest

    s = spark.createDataFrame([("a", "1")], "key string, value string")
    assert merge.get_setting(s, "a").first()[0] == "1"
    with pytest.raises(Exception, match="no setting b"):
        merge.get_setting(s, "b").collect()


def test_scan_and_index_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["foo", "bar", "baz", "Qux-foo"], rng.integers(0, 12))), None if i % 5 == 0 else "foo bar") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    cols = [F.col("a"), F.col("b")]
    for q in ("foo", "foo-bar baz", "qux-foo-bar", "none"):
        one, two = ({r.doc: round(r.score, 9) for r in lexical.bm25(x, q).collect()} for x in (lexical.build(docs, "id", cols), lexical.scan(docs, "id", cols)))
        assert one == two
