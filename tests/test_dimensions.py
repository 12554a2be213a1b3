"""Policy maps of any size: the join follows their bytes, the rows do not change."""

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from recordwarden.operators.corrections import with_canonical_country
from recordwarden.operators.owners import routing_coverage
from recordwarden.plans.audit import run_checks
from recordwarden.sources import staging
from recordwarden.sources.atlas import dimension
from recordwarden import make_config

from .helpers import company, contact, crm

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_limit(spark):
    spark.conf.set(LIMIT, "2000b")
    yield
    spark.conf.unset(LIMIT)


def test_a_map_above_and_below_the_limit(spark, small_limit):
    data = spark.range(300).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    small = {f"k{i}": f"v{i % 3}" for i in range(0, 60, 2)}
    large = small | {f"x{i}": "unused" for i in range(500)}
    below = data.join(dimension(spark, small, "k", "v"), "k", "left")
    above = data.join(dimension(spark, large, "k", "v"), "k", "left")
    assert "BroadcastHashJoin" in plan(below) and "SortMergeJoin" not in plan(below)
    assert "SortMergeJoin" in plan(above) and "BroadcastHashJoin" not in plan(above)
    assert sorted(map(tuple, below.collect()), key=str) == sorted(map(tuple, above.collect()), key=str)


def test_few_entries_of_long_texts_are_not_small(spark, small_limit):
    data = spark.range(5).select(F.lit("a").alias("k"))
    joined = data.join(dimension(spark, {"a": "v" * 5000}, "k", "v"), "k")
    assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 5


def test_an_empty_map(spark):
    joined = spark.range(3).select(F.lit("a").alias("k")).join(dimension(spark, {}, "k", "v"), "k", "left")
    assert [r.v for r in joined.collect()] == [None] * 3


def test_routing_and_countries_with_large_maps(spark):
    owners = {f"Owner {i}": ("EMEA", "APAC", "LATAM")[i % 3] for i in range(400)}
    countries = ["France", "Japan", "Brasil", "Nowhere", None]
    tables = crm(
        spark,
        contacts=[contact(i, Contact_owner=f"owner  {i % 7}", **{"Country/Region": countries[i % 5]}) for i in range(90)],
        companies=[company(i, Company_owner=f"Owner {i}", **{"Country/Region": "japan "}) for i in range(9)],
    )

    def results():
        found = run_checks(tables, make_config(owner_regions=owners), ["routing_contacts", "routing_companies"])
        names = with_canonical_country(tables.contacts.select("record_id", "country"), "country")
        coverage = routing_coverage(tables.contacts.select("owner").distinct(), owners)
        frames = (found.select("check_id", "record_id", "message"), names, coverage)
        return [sorted(map(tuple, f.collect()), key=str) for f in frames], plan(frames[0])

    below, plan_below = results()
    spark.conf.set(LIMIT, "1000b")
    try:
        above, plan_above = results()
    finally:
        spark.conf.unset(LIMIT)
    assert below == above and below[0]
    assert "BroadcastHashJoin" in plan_below and "BroadcastHashJoin" not in plan_above


def test_staging_needs_a_shared_folder_outside_local_mode():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {"spark.sql.warehouse.dir": "/warehouse"}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_root(Session)
    Context.master = "local[2]"
    assert staging.staging_root(Session) == "/warehouse/staging"


def test_a_broken_import_of_the_training_operators_shows(monkeypatch):
    import __spark_entry__ as entry

    if not entry.llm:
        pytest.skip("the training operators are not installed")
    monkeypatch.setitem(sys.modules, "recordwarden.llm.queries", None)
    monkeypatch.delattr(sys.modules["recordwarden.llm"], "queries")
    with pytest.raises(ImportError):
        importlib.reload(entry)
    monkeypatch.undo()
    assert importlib.reload(entry).llm
