import math
import random
from collections import defaultdict

import pytest

from recordwarden import CostAssumptions
from recordwarden.model import COMPANIES, CONTACTS, DEALS, OBJECT_TYPES
from recordwarden.operators import scoring
from pyspark.sql import functions as F

from .helpers import crm, deal, findings


def counts(spark, **totals):
    rows = [(o, totals.get(o, 0)) for o in OBJECT_TYPES]
    return spark.createDataFrame(rows, "object_type string, total long")


def scores(spark, rows, **totals):
    table = scoring.health_score(scoring.score_totals(findings(spark, rows), counts(spark, **totals)))
    return {r.object_type: r for r in table.collect()}


def test_clean_and_empty_tables_score_100(spark):
    got = scores(spark, [], contacts=10)
    assert all(r.score == 100.0 and r.grade == "A" for r in got.values())
    assert scores(spark, [])["overall"].clean_rate == 1.0


def test_penalty_is_capped_per_record(spark):
    many = [("a", CONTACTS, "1", 3)] * 5
    assert scores(spark, many, contacts=2)["overall"].score == 50.0
    two = [("a", CONTACTS, "1", 3), ("b", CONTACTS, "1", 3)]
    assert scores(spark, two, contacts=2)["overall"].score == 50.0
    assert scores(spark, two[:1], contacts=2)["overall"].score == 75.0


def test_score_does_not_depend_on_size(spark):
    small = scores(spark, [("a", CONTACTS, str(i), 2) for i in range(3)], contacts=10)
    large = scores(spark, [("a", CONTACTS, str(i), 2) for i in range(30)], contacts=100)
    assert small["overall"].score == large["overall"].score == 90.0


def test_same_id_in_two_tables_is_two_records(spark):
    got = scores(spark, [("a", CONTACTS, "1", 3), ("b", DEALS, "1", 1)], contacts=4, deals=2)
    assert (got["overall"].affected_records, got["overall"].clean_records) == (2, 4)
    assert (got[CONTACTS].score, got[DEALS].score, got[COMPANIES].score) == (87.5, 91.7, 100.0)


@pytest.mark.parametrize("score,letter", [
    (90.0, "A"), (89.9, "B"), (80.0, "B"), (79.9, "C"), (70.0, "C"), (60.0, "D"), (59.9, "F"), (0.0, "F"),
])
def test_grades(spark, score, letter):
    assert spark.range(1).select(scoring.grade(F.lit(score)).alias("g")).first().g == letter


def test_risk_bands(spark):
    days = [None, 0, 29, 30, 59, 60, 89, 90, 400]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d int")
    got = [r.f for r in df.select("i", scoring.risk_factor(F.col("d"), CostAssumptions().risk_bands).alias("f")).orderBy("i").collect()]
    assert got == [0.0, 0.0, 0.0, 0.25, 0.25, 0.5, 0.5, 0.75, 0.75]


def priced(spark, rows, **changes):
    return scoring.price_findings(findings(spark, rows), CostAssumptions(**changes)).collect()


def test_work_is_priced_per_check_and_severity(spark):
    rows = [("duplicate_contacts", CONTACTS, "1", 3), ("missing_fields_contacts", CONTACTS, "1", 2),
            ("missing_fields_contacts", CONTACTS, "1", 1), ("own_check", CONTACTS, "1", 3)]
    got = {(r.check_id, r.severity_rank): (r.remediation_minutes, r.revenue_impact_usd) for r in priced(spark, rows)}
    assert got == {("duplicate_contacts", 3): (15.0, 18.75), ("missing_fields_contacts", 2): (4.0, 5.0),
                   ("missing_fields_contacts", 1): (5.0, 6.25), ("own_check", 3): (5.0, 6.25)}
    (one,) = priced(spark, rows[:1], hourly_cost=91.3)
    assert one.revenue_impact_usd == round(15.0 / 60.0 * 91.3, 2)


def test_a_deal_is_at_risk_once(spark):
    rows = [
        ("stale_deals", DEALS, "1", 3, 95, None, 1000.0), ("past_close_date", DEALS, "1", 3, None, 40, 1000.0),
        ("stale_deals", DEALS, "2", 3, 40, None, 1000.0), ("past_close_date", DEALS, "2", 3, None, 40, 1000.0),
        ("stale_deals", DEALS, "3", 3, 200, None, None), ("stale_deals", DEALS, "4", 3, 10, None, 1000.0),
        ("decayed_contacts", CONTACTS, "5", 2, 200, None, 1000.0), ("missing_fields_deals", DEALS, "1", 3),
    ]
    got = {(r.check_id, r.record_id): r.at_risk_usd for r in priced(spark, rows)}
    at_risk = {k: v for k, v in got.items() if v}
    # Ties go to the check that sorts first.
    assert at_risk == {("stale_deals", "1"): 750.0, ("past_close_date", "2"): 250.0}
    assert len(got) == len(rows)


def test_repeated_and_blank_deal_ids_are_at_risk_once(spark):
    rows = [("stale_deals", DEALS, "", 3, 95, None, 100.0 * (i % 7)) for i in range(5000)]
    rows += [("stale_deals", DEALS, "9", 3, 95, None, 80.0)] * 3
    got = scoring.price_findings(findings(spark, rows).repartition(16)).collect()
    assert len(got) == len(rows)
    for record, amount in (("", 450.0), ("9", 60.0)):
        assert [r.at_risk_usd for r in got if r.record_id == record and r.at_risk_usd] == [amount]


def test_totals(spark):
    tables = crm(spark, deals=[deal(1, Amount="100"), deal(2, Amount="50", Deal_Stage="closedwon"), deal(3, Amount=None)])
    rows = [("stale_deals", DEALS, "1", 3, 95, None, 100.0), ("duplicate_contacts", CONTACTS, "1", 3)]
    got = scoring.cost_summary(scoring.price_findings(findings(spark, rows)), tables.deals).first()
    assert scoring.cost_of_findings(findings(spark, rows), tables.deals).first() == got
    assert (got.remediation_hours, got.direct_cost_usd, got.at_risk_pipeline_usd, got.total_open_pipeline_usd) == (
        0.5, 37.5, 75.0, 100.0)
    assert (got.at_risk_share, got.value_at_stake_usd) == (0.75, 112.5)
    empty = scoring.cost_summary(scoring.price_findings(findings(spark, [])), crm(spark).deals).first()
    assert set(empty.asDict().values()) == {0.0}
    assert scoring.open_deal_value(tables.deals.drop("deal_stage")).first().open_usd == 0.0


def test_hours_round_exact_ties_to_even(spark):
    rows = [("duplicate_contacts", CONTACTS, str(i), 3) for i in range(33)]
    (item,) = scoring.remediation_items(scoring.summary_rows(findings(spark, rows)), ["duplicate_contacts"]).collect()
    assert (item.records, item.hours_to_fix, item.cost_usd) == (33, 8.2, 618.75)


def score_of(rows, total):
    points = defaultdict(int)
    for _, obj, record, rank in rows:
        points[obj, record] += rank
    lost = float(sum(min(p, 6) for p in points.values()))
    return round(100.0 * (total - lost / 6.0) / total, 1)


def test_gains_equal_rescoring_without_the_check(spark):
    checks = ["a", "b", "c", "d"]
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(rnd.choice(checks[:3]), rnd.choice(OBJECT_TYPES), str(rnd.randrange(60)), rnd.choice([1, 2, 3]))
                for _ in range(300)]
        totals = scoring.score_totals(findings(spark, rows), counts(spark, contacts=70, companies=60, deals=61), checks)
        got = {r.check_id: r.score_gain for r in scoring.score_gains(totals).collect()}
        now = score_of(rows, 191)
        assert got == {c: round(score_of([r for r in rows if r[0] != c], 191) - now, 1) for c in checks}


def test_list_order_and_example(spark):
    rows = [
        ("stale_deals", DEALS, "1", 3, 95, None, 1000.0), ("duplicate_contacts", CONTACTS, "2", 3),
        ("missing_fields_contacts", CONTACTS, "10", 2), ("missing_fields_contacts", CONTACTS, "9", 3),
        ("missing_fields_contacts", CONTACTS, "8", 3), ("own_check", CONTACTS, "5", 1),
    ]
    found = findings(spark, rows)
    names = {"stale_deals": "Stale Deals", "own_check": "Mine"}
    totals = scoring.score_totals(found, counts(spark, contacts=20, deals=1), sorted({r[0] for r in rows}))
    items = scoring.punch_list(scoring.summary_rows(found), totals, names).collect()
    assert [i.priority_check for i in items] == ["stale_deals", "missing_fields_contacts", "duplicate_contacts", "own_check"]
    assert items[1].issue == "Missing Fields Contacts" and items[3].issue == "Mine"
    assert (items[1].records, items[1].severity, items[1].example) == (3, "High", "missing_fields_contacts 8")


def test_exposure_owner_does_not_depend_on_partitions(spark):
    rows = [("stale_deals", "deals", "7", 3, 95, None, 1000.0), ("stale_deals", "deals", "7", 3, 96, None, 1000.0)]
    rows += [("stale_deals", "deals", "", 3, 90 + i, None, 500.0) for i in range(40)]
    made = findings(spark, rows)
    owners = {
        tuple(sorted((r.record_id, r.meta.days_inactive) for r in scoring.price_findings(made.repartition(n)).collect() if r.at_risk_usd))
        for n in (1, 3, 7, 13)
    }
    assert len(owners) == 1 and len(owners.pop()) == 2


def test_exposure_rank_orders_like_the_numbers(spark):
    rnd = random.Random(5)
    values = [rnd.choice([0.25, 0.5, 0.75]) * rnd.choice([rnd.random(), rnd.uniform(1, 1e9), 2.0 ** rnd.randrange(-60, 60)]) for _ in range(2000)]
    values += [b for k in range(-20, 60) for b in (2.0**k, math.nextafter(2.0**k, 0), math.nextafter(2.0**k, math.inf))]
    rows = findings(spark, [("stale_deals", DEALS, "1", 3, 95, None, 1.0)]).crossJoin(
        spark.createDataFrame([(v,) for v in values], "v double"))
    got = rows.select("v", scoring._exposure_rank(F.col("v"), CostAssumptions()).alias("r")).collect()
    ranks = dict((r.v, r.r) for r in got)
    ordered = sorted(ranks)
    assert all(ranks[a] < ranks[b] for a, b in zip(ordered, ordered[1:]))


def test_pricing_has_no_window_and_combines_in_hash_maps(spark):
    rows = [("stale_deals", DEALS, str(i % 9), 3, 95, None, 10.0 * i) for i in range(50)]
    plan = scoring.price_findings(findings(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan
