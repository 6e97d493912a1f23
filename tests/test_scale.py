"""What keeps steps in proportion to their input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


def test_index_is_made_without_a_shuffle(spark):
    """Tokens are grouped where they are cut, and only those of repeated ids (null among them) are put together."""
    from waymark.operators import lexical

    rows = [(1, "a b a", "c a"), (2, "", None), (3, "b", "b-B x")]
    for more in ([], [(3, "a", "b"), (None, "a b", ""), (None, "a", "a")]):
        docs = spark.createDataFrame(rows + more, "id long, t string, u string")
        index = lexical.build(docs, "id", [F.col("t"), F.col("u")])
        want = defaultdict(list)
        for i, *texts in rows + more:
            for k, t in enumerate(texts):
                for at, w in enumerate((t or "").lower().replace("-", " ").split()):
                    want[w, i].append(at + k * 1_000_000)
        got = {(r.term, r.doc): (r.tf, r.positions) for r in index.postings.collect()}
        assert got == {k: (len(v), sorted(v)) for k, v in want.items()}
        assert Counter((r.doc, r.len) for r in index.lengths.collect()) == Counter((i, len(f"{t} {u or ''}".replace("-", " ").split())) for i, t, u in rows + more)
        assert more or "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_query_blocks_are_not_broadcast(spark):
    """Blocks of queries routed to shards grow with the input, whatever size Spark expects of them."""
    from waymark.llm import multi_index

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = multi_index.neighbours(v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1  # the cells' places, 65,536 at most
    assert "SortMergeJoin [shard" in plan


def _query(spark, name):
    from waymark.plans import registry

    return registry.queries()[name](spark, "/root/testdata/sf0.001")


def test_byte_pairs_come_in_small_batches(spark):
    """Whole texts otherwise come in batches of 64 MB, held as lists of numbers by each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    _query(spark, "bpe_encode")
    assert int(spark.conf.get(key)) == 4 << 20


def test_circles_are_dealt_out(spark):
    """A file of few bytes makes 65 rows of each of its own."""
    df = _query(spark, "circle_polygon")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["import_entities", "import_places"])
def test_dumps_are_parsed_once(spark, name):
    """Claims are stored, not parsed again for each table made of them."""
    assert "StructField(claims" not in _query(spark, name)._jdf.queryExecution().optimizedPlan().toString()


def test_dump_is_dealt_out(spark):
    assert _query(spark, "label_pick").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_counts_train_no_model(spark, monkeypatch):
    """base_word_counts returns nothing of the model's."""
    from waymark.llm import logbilinear
    from waymark.llm import registry as llm

    monkeypatch.setattr(logbilinear, "train", lambda *a: pytest.fail("trained"))
    df = llm.queries()["base_word_counts"](spark, "/root/testdata/sf0.001")
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_radius_join_is_not_broadcast(spark):
    """A centre's cells and the places meet by a shuffle, whatever size Spark expects of them."""
    plan = _query(spark, "radius_join")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [band" in plan and "Broadcast" not in plan
