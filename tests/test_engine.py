import numpy as np
import pytest

from waymark.engine import Engine
from waymark.plans.fixtures import Tables
from waymark.sources import samples
from waymark.streaming import sync

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    t = Tables(spark, FOLDER)
    tiles = spark.createDataFrame([(14, 8760, 2**14 - 1 - 6089, samples.tile([(7, 1, [[(10, 10)]], {"kind": "park"})]))], "zoom int, col int, row int, tile_data binary")
    names = ("entities", "sections", "entity_times", "entity_places", "vectors", "settings")
    return Engine(spark, {n: getattr(t, n) for n in names} | {"tiles": tiles}, embed=lambda text: np.ones(64))


def test_dispatch(engine):
    assert engine.search() is None
    assert engine.search(entity_id=7).first().entity_id == 7
    assert engine.search(article_id=500001).first().id == 500001
    near = engine.search(latitude=41.9, longitude=12.5, radius=2500).collect()
    assert near and all(r.type == "E" for r in near)
    assert engine.search(year=1998, limit=3).count() == 3
    assert engine.search(month=13) is None
    assert engine.search_events(latitude=41.9, longitude=12.5, radius=20000.0, year=1998, limit=5).count() == 5
    assert engine.get_article(10**9).count() == 0


def test_modes(engine):
    for mode, kind in (("lexical", "L"), ("entity", "T"), ("semantic", "S")):
        rows = engine.search("the" if mode != "entity" else "customer", mode=mode, limit=5).collect()
        assert len(rows) == 5 and all(r.type == kind for r in rows)
        assert len({r.entity_id for r in rows}) == 5
    h = engine.search("the", limit=5).collect()
    assert len(h) == 5 and all(0 < r.power <= 100 for r in h)
    assert engine.search_knowledge("the", "lexical", 50, year=1998).count() <= 50
    top = [r.entity_id for r in engine.search_lexical("the", 8).collect()]
    assert [r.entity_id for r in engine.search_lexical("the", 4).collect()] == top[:4]


def test_no_embedder(spark, engine):
    e = Engine(spark, engine.tables)
    assert e.search("the", limit=3).count() == 3
    with pytest.raises(ValueError):
        e.search_semantic("the")
    assert not e.has_model()


def test_written_indexes(spark, engine, tmp_path):
    e = Engine(spark, engine.tables, embed=lambda text: np.ones(64))
    e.index(str(tmp_path / "i"))
    e.rebuild_ann(str(tmp_path / "a"), per_cluster=100)
    assert [r.entity_id for r in e.search_lexical("the with").collect()] == [r.entity_id for r in engine.search_lexical("the with").collect()]
    assert e.search_semantic("x", 5).count() == 5


def test_maps_and_sql(engine):
    assert engine.get_map_config().first().maxzoom == 14
    assert engine.get_map_centroids(41.9028, 12.4964, 5000).first().id == "7:places:park"
    assert engine.get_map_feature(41.9028, 12.4964, 7, 5000).count() == 1
    assert engine.tile(14, 8760, 6089).count() == 1 and engine.elevation(0, 0, 0).count() == 0
    got = engine.sql("select julian_day(2000,1,1) a, round(haversine_km(0,0,0,180)) b, tile_x(0,1) c, tile_y(0,1) d").first()
    assert tuple(got) == (2451545, 20015.0, 1, 1)
    assert engine.sql("select count(*) from (select id from entities intersect select entity_id from sections)").first()[0] > 0
    assert engine.get_markdown(7).first().markdown.startswith("# ")
    assert engine.entity_info().count() > 0
    with pytest.raises(AttributeError):
        engine.nothing


def test_streams(spark, engine, tmp_path):
    claim = '{{"id":"Q{0}","claims":{{"{1}":[{{"mainsnak":{{"datavalue":{{"value":{2}}}}}}}]}},"labels":{{"en":{{"value":"{3}"}}}},"descriptions":{{}}}},'
    lines = [
        "[",
        claim.format(1, "P569", '{"time":"+1879-03-14T00:00:00Z"}', "First"),
        claim.format(2, "P571", '{"time":"-0044-03-15T00:00:00Z"}', "Second"),
        claim.format(3, "P625", '{"latitude":1.0,"longitude":2.0,"globe":"http://www.wikidata.org/entity/Q111"}', "Elsewhere"),
        claim.format(1, "P569", '{"time":"+1879-03-14T00:00:00Z"}', "Again"),
        claim.format(4, "P31", '{"id":"Q5"}', "Irrelevant"),
        claim.format(5, "P569", '{"time":"unknown"}', "No date"),
        "]",
    ]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((lines[:4], lines[4:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(part))
        q = sync.ingest_entities(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination()
        assert q.exception() is None
    assert sorted((r.id, r.title) for r in spark.read.parquet(f"{tmp_path}/out/v=1").collect()) == [(1, "First"), (2, "Second")]
    s = engine.sections
    for k in (0, 1):
        s.where(f"id % 2 = {k}" if k == 0 else "true").limit(50).write.mode("append").parquet(f"{tmp_path}/s")
        sync.embed_sections(spark, f"{tmp_path}/s", "id long, entity_id long, title string, content string, pow int", engine.entities, f"{tmp_path}/v", f"{tmp_path}/cp2").awaitTermination()
    ids = [r.id for k in (0, 1) for r in spark.read.parquet(f"{tmp_path}/v/batch={k}").collect()]
    assert len(ids) == len(set(ids)) > 50
    t = Tables(spark, FOLDER).events
    t.limit(200).write.parquet(f"{tmp_path}/e")
    stream = sync.windowed_counts(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/e"))
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, sync.windowed_counts(spark.read.parquet(f"{tmp_path}/e")).collect()))
