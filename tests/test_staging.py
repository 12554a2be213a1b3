"""Places and positions of written rows."""

import random

from pyspark.sql import functions as F

from recordwarden.sources.staging import PLACE, numbered, with_places


def test_positions_follow_the_order_without_gaps(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), f"t{rnd.randrange(5)}", i) for i in range(3000)]
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "a int, b string, c int").repartition(parts)
        found = numbered(df, [F.desc("a"), F.asc("b"), F.asc("c")], "numbered").orderBy("position").collect()
        assert [(r.a, r.b, r.c) for r in found] == want
        assert [r.position for r in found] == list(range(1, 3001))


def test_positions_use_many_tasks(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered(df, [F.asc("h")], "numbered")
        assert found.agg(F.max("position"), F.countDistinct("position")).first()[:] == (200_000, 200_000)
        assert found.where("position > 1").count() == 199_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    found = numbered(spark.range(0), [F.asc("id")], "numbered")
    assert found.columns == ["position", "id"] and found.isEmpty()


def test_equal_rows_have_different_places_in_every_read(spark):
    rows = with_places(spark.createDataFrame([(1, "a")] * 500, "i int, s string").repartition(4), "placed")
    first, again = ([r[PLACE] for r in rows.select(PLACE).collect()] for _ in range(2))
    assert sorted(first) == sorted(again) and len(set(first)) == 500


def test_offsets_are_sent_to_the_rows(spark):
    """The rows are not shuffled once more for the few offsets of their files, whatever Spark takes their size to be."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = numbered(spark.range(100), [F.desc("id")], "numbered")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r.id for r in found.orderBy("position").collect()] == list(range(99, -1, -1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
