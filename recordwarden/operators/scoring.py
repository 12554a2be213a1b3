"""Pricing, health score and the ranked remediation list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CostAssumptions
from ..functions import text
from ..functions.values import round_exact
from ..model import DEALS, severity_label
from ..sources.staging import PLACE, with_places

# Fixed value: a record cannot lose more than this.
MAX_PENALTY = 6.0
OVERALL = "overall"

# --- pricing -----------------------------------------------------------------

def risk_factor(days: Column, bands: Sequence[tuple[int, float]]) -> Column:
    """Share of a deal's amount at risk after `days` of neglect; 0 when unknown."""
    factor = F.lit(0.0)
    for threshold, share in reversed(list(bands)):
        factor = F.when(days >= threshold, F.lit(float(share))).otherwise(factor)
    return factor


def neglect_days() -> Column:
    return F.coalesce("meta.days_inactive", "meta.days_overdue")


def exposure(bands: Sequence[tuple[int, float]]) -> Column:
    """What a deal finding puts at risk, null where it is nothing."""
    amount, factor = F.col("meta.amount"), risk_factor(neglect_days(), bands)
    return F.when((F.col("object_type") == DEALS) & amount.isNotNull() & (factor > 0), amount * factor)


def _exposure_rank(value: Column, assumptions: CostAssumptions) -> Column:
    """A number that orders findings of one deal by exposure, then check, then content.

    It has the 63 bits of the positive double above 63 bits for ties, so the worst finding is the
    maximum of a number and Spark combines it in a hash map, before and after the shuffle. Checks
    come in alphabetical order, those without a rate last.
    """
    near = F.floor(F.log2(value))  # next to a power of two it can be off by one
    two = F.lit(2.0)
    exact = near + F.when(value < F.pow(two, near), -1).when(value >= F.pow(two, near + 1), 1).otherwise(0)
    exponent = F.greatest(exact, F.lit(-1022))
    mantissa = value / F.pow(two, exponent) - 1
    bits = (exponent + 1023) * F.lit(1 << 52) + (mantissa * float(1 << 52)).cast("long")
    checks = sorted({check for check, _ in assumptions.remediation_minutes})
    order = F.lit(len(checks))
    for i, check in enumerate(checks):
        order = F.when(F.col("check_id") == check, F.lit(i)).otherwise(order)
    content = F.xxhash64("check_id", "message", "severity_rank", "field", "emit_order", "meta")
    tie = (F.lit(127) - F.least(order, F.lit(127))).cast("long") * F.lit(1 << 56) + F.shiftrightunsigned(content, 8)
    return bits.cast("decimal(19,0)") * F.expr(f"{1 << 63}BD") + tie.cast("decimal(19,0)")


def _with_deal_exposure(findings: DataFrame, assumptions: CostAssumptions) -> DataFrame:
    """`at_risk_usd` on the worst finding of each deal, 0 on its other findings.

    Only ids, ranks and places of exposed findings are shuffled, one per deal and task; the chosen
    place is joined back. Equal findings of one id have different places, so exactly one is chosen,
    however many rows share a blank or repeated id, and no task holds all of them. `findings` must
    come from `with_places`.
    """
    exposed = findings.withColumn("_exposure", exposure(assumptions.risk_bands)).where(F.col("_exposure").isNotNull())
    ranked = exposed.select("record_id", PLACE, _exposure_rank(F.col("_exposure"), assumptions).alias("rank"))
    owners = ranked.groupBy(F.col("record_id").alias("_id")).agg(F.max_by(PLACE, "rank").alias("_owner"))
    same = F.col("_id").eqNullSafe(F.col("record_id")) & (F.col("_owner") == F.col(PLACE))
    owned = exposed.join(owners, same, "left").withColumn(
        "at_risk_usd", F.when(F.col("_owner").isNotNull(), round_exact(F.col("_exposure"), 2)).otherwise(F.lit(0.0))
    ).drop("_exposure", "_id", "_owner")
    others = findings.where(exposure(assumptions.risk_bands).isNull()).withColumn("at_risk_usd", F.lit(0.0))
    return others.unionByName(owned)


def with_rates(findings: DataFrame, assumptions: CostAssumptions) -> DataFrame:
    """Adds `_minutes` and `_cost` of the work on each finding."""
    rates = findings.sparkSession.createDataFrame(
        [
            (check, severity, float(minutes), assumptions.cost_of(minutes))
            for (check, severity), minutes in assumptions.remediation_minutes.items()
        ],
        T.StructType([
            T.StructField("check_id", T.StringType()),
            T.StructField("severity_rank", T.IntegerType()),
            T.StructField("_minutes", T.DoubleType()),
            T.StructField("_cost", T.DoubleType()),
        ]),
    )
    fallback = float(assumptions.fallback_minutes)
    # The rate table comes from the assumptions: one row per check and severity.
    return findings.join(F.broadcast(rates), ["check_id", "severity_rank"], "left").withColumns({
        "_minutes": F.coalesce("_minutes", F.lit(fallback)),
        "_cost": F.coalesce("_cost", F.lit(assumptions.cost_of(fallback))),
    })


def price_findings(findings: DataFrame, assumptions: CostAssumptions | None = None) -> DataFrame:
    """Adds minutes of work, their cost, and the pipeline at risk to every finding.

    Findings that are not from `with_places` yet are written to the shared staging folder first.
    """
    assumptions = assumptions or CostAssumptions()
    placed = findings if PLACE in findings.columns else with_places(findings, "findings")
    columns = [c for c in placed.columns if c not in ("revenue_impact_usd", PLACE)]
    return with_rates(_with_deal_exposure(placed, assumptions), assumptions).select(
        *columns,
        F.col("_cost").alias("revenue_impact_usd"),
        F.col("_minutes").alias("remediation_minutes"),
        "at_risk_usd",
    )


def open_deal_value(deals: DataFrame, stage: str = "deal_stage", amount: str = "amount") -> DataFrame:
    """One row: the amount of all open deals."""
    if stage not in deals.columns:
        deals = deals.limit(0).withColumn(stage, F.lit(None).cast("string"))
    return deals.where(text.stage_is_open(F.col(stage))).agg(
        F.coalesce(F.sum(F.coalesce(F.col(amount), F.lit(0.0))), F.lit(0.0)).alias("open_usd")
    )


def cost_summary(priced: DataFrame, deals: DataFrame) -> DataFrame:
    """One row of totals of priced findings."""
    return _cost_columns(priced.agg(
        F.sum("remediation_minutes").alias("minutes"),
        F.sum("revenue_impact_usd").alias("direct"),
        F.sum("at_risk_usd").alias("at_risk"),
    ), deals)


def cost_of_findings(findings: DataFrame, deals: DataFrame, assumptions: CostAssumptions | None = None) -> DataFrame:
    """The same totals from findings without prices: one aggregation per record.

    Which finding carries a deal's exposure does not matter for a total, only the largest one does.
    """
    assumptions = assumptions or CostAssumptions()
    rated = with_rates(
        findings.select("check_id", "severity_rank", "object_type", "record_id", _kept_exposure(findings, assumptions)), assumptions
    )
    per_record = rated.groupBy("object_type", "record_id").agg(
        F.sum("_minutes").alias("minutes"), F.sum("_cost").alias("direct"), F.max("exposure").alias("exposure"),
    )
    return _cost_columns(per_record.agg(
        F.sum("minutes").alias("minutes"), F.sum("direct").alias("direct"),
        F.sum(round_exact(F.col("exposure"), 2)).alias("at_risk"),
    ), deals)


def _kept_exposure(findings: DataFrame, assumptions: CostAssumptions) -> Column:
    kept = F.col("exposure") if "exposure" in findings.columns else exposure(assumptions.risk_bands)
    return kept.alias("exposure")


def _cost_columns(work: DataFrame, deals: DataFrame) -> DataFrame:
    # Both sides are single rows; the union and the maximum put them side by side.
    totals = work.unionByName(open_deal_value(deals), allowMissingColumns=True).agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("minutes", "direct", "at_risk", "open_usd")]
    )
    totals = totals.select(
        round_exact(F.col("minutes") / 60.0, 1).alias("remediation_hours"),
        round_exact(F.col("direct"), 2).alias("direct_cost_usd"),
        round_exact(F.col("at_risk"), 2).alias("at_risk_pipeline_usd"),
        round_exact(F.col("open_usd"), 2).alias("total_open_pipeline_usd"),
    )
    at_risk, open_usd = F.col("at_risk_pipeline_usd"), F.col("total_open_pipeline_usd")
    return totals.withColumn(
        "at_risk_share", F.when(open_usd == 0, F.lit(0.0)).otherwise(at_risk / open_usd)
    ).withColumn("value_at_stake_usd", F.col("direct_cost_usd") + at_risk)


# --- score -------------------------------------------------------------------

def record_penalties(findings: DataFrame) -> DataFrame:
    return findings.groupBy("object_type", "record_id").agg(
        F.least(F.sum("severity_rank"), F.lit(int(MAX_PENALTY))).alias("penalty")
    )


def score_totals(findings: DataFrame, counts: DataFrame, check_ids: Sequence[str] = ()) -> DataFrame:
    """Records, affected records and lost points per table and overall (object_type null).

    `saved` holds, per check id, the points that would not be lost without that
    check: per record the capped penalty minus the capped penalty of the rest.
    That is the whole effect of leaving the check out, so nothing is rescored.
    """
    cap = F.lit(int(MAX_PENALTY))
    shares = [f"w{i}" for i in range(len(check_ids))]
    per_record = findings.groupBy("object_type", "record_id").agg(
        F.sum("severity_rank").alias("raw"),
        *[
            F.sum(F.when(F.col("check_id") == c, F.col("severity_rank")).otherwise(0)).alias(w)
            for c, w in zip(check_ids, shares)
        ],
    )
    per_object = per_record.groupBy("object_type").agg(
        F.sum(F.least("raw", cap)).alias("lost"),
        F.count(F.lit(1)).alias("affected"),
        *[
            F.sum(F.least("raw", cap) - F.least(F.col("raw") - F.col(w), cap)).alias(w)
            for w in shares
        ],
    )
    measures = ["total", "lost", "affected", *shares]
    # At most one row per table from here on.
    return (
        counts.join(per_object, "object_type", "full")
        .rollup("object_type")
        .agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
        .select(
            "object_type", "total", "lost", "affected",
            F.array(*[
                F.struct(F.lit(c).alias("check_id"), F.col(w).alias("points"))
                for c, w in zip(check_ids, shares)
            ]).alias("saved"),
        )
    )


def _score(total: Column, lost: Column) -> Column:
    raw = F.lit(100.0) * (total - lost / F.lit(MAX_PENALTY)) / F.nullif(total, F.lit(0))
    return F.coalesce(round_exact(raw, 1), F.lit(100.0))


def grade(score: Column) -> Column:
    # Lowest score of each grade.
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
        .when(score >= 60, "D").otherwise("F")
    )


def health_score(totals: DataFrame) -> DataFrame:
    """Score, grade and record counts per table and for `overall`."""
    scored = totals.select(
        F.coalesce("object_type", F.lit(OVERALL)).alias("object_type"),
        _score(F.col("total"), F.col("lost")).alias("score"),
        (F.col("total") - F.col("affected")).alias("clean_records"),
        F.col("affected").alias("affected_records"),
        F.col("total").alias("total_records"),
    )
    return scored.withColumn("grade", grade(F.col("score"))).withColumn(
        "clean_rate",
        F.when(F.col("total_records") == 0, F.lit(1.0))
        .otherwise(F.col("clean_records") / F.col("total_records")),
    )


def score_gains(totals: DataFrame) -> DataFrame:
    """Points of overall score that fixing everything of one check would recover."""
    overall = totals.where(F.col("object_type").isNull()).select(
        "total", "lost", F.inline("saved")
    )
    now = _score(F.col("total"), F.col("lost"))
    then = _score(F.col("total"), F.col("lost") - F.col("points"))
    return overall.select("check_id", now.alias("now"), then.alias("then")).select(
        "check_id", round_exact(F.col("then") - F.col("now"), 1).alias("score_gain")
    )


# --- remediation list --------------------------------------------------------

#: What the report's numbers need of a finding.
SUMMARY_COLUMNS = ("check_id", "object_type", "record_id", "severity_rank", "severity", "emit_order", "message")


def summary_rows(findings: DataFrame, assumptions: CostAssumptions | None = None) -> DataFrame:
    """The findings with their exposure and without all that no number of the report needs."""
    assumptions = assumptions or CostAssumptions()
    return findings.select(*SUMMARY_COLUMNS, _kept_exposure(findings, assumptions))


def at_risk_by_check(rows: DataFrame, check_ids: Sequence[str]) -> DataFrame:
    """(check_id, at_risk): every deal's largest exposure counts for the check it came from, ties for the first name.

    One aggregation per deal over numbers; `rows` come from `summary_rows`.
    """
    checks = sorted(check_ids)
    largest = [f"e{i}" for i in range(len(checks))]
    per_deal = rows.where(F.col("exposure").isNotNull()).groupBy("record_id").agg(
        *[F.max(F.when(F.col("check_id") == c, F.col("exposure"))).alias(e) for c, e in zip(checks, largest)]
    )
    best = F.greatest(*largest, F.lit(0.0))
    owner = F.coalesce(*[F.when(F.col(e) == best, F.lit(c)) for c, e in zip(checks, largest)])
    return per_deal.select(owner.alias("check_id"), round_exact(best, 2).alias("best")).groupBy("check_id").agg(
        F.sum("best").alias("at_risk")
    )


def remediation_items(rows: DataFrame, check_ids: Sequence[str], assumptions: CostAssumptions | None = None) -> DataFrame:
    """Count, cost and worst example per check; `rows` come from `summary_rows`.

    The set of severities (at most three values) also makes Spark aggregate in a
    hash map of checks; with the text example alone it would sort all findings.
    """
    worst = F.min(F.struct(
        (-F.col("severity_rank")).alias("rank"), (-F.col("_cost")).alias("cost"),
        "record_id", "emit_order", "object_type", "message",
    ))
    work = (
        with_rates(rows, assumptions or CostAssumptions())
        .groupBy("check_id")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.array_max(F.collect_set("severity_rank")).alias("severity_rank"),
            F.sum("_minutes").alias("minutes"),
            F.sum("_cost").alias("cost"),
            worst.alias("worst"),
        )
    )
    return work.join(at_risk_by_check(rows, check_ids), "check_id", "left").select(
        "check_id",
        F.col("worst.object_type").alias("object_type"),
        "records",
        "severity_rank",
        round_exact(F.col("minutes") / 60.0, 1).alias("hours_to_fix"),
        round_exact(F.col("cost"), 2).alias("cost_usd"),
        round_exact(F.coalesce("at_risk", F.lit(0.0)), 2).alias("at_risk_usd"),
        F.col("worst.message").alias("example"),
    )


def punch_list(
    rows: DataFrame, totals: DataFrame, names: Mapping[str, str], assumptions: CostAssumptions | None = None
) -> DataFrame:
    """Remediation items with their score gain, most valuable first; `rows` come from `summary_rows`."""
    shown = F.initcap(F.replace("check_id", F.lit("_"), F.lit(" ")))
    for check_id, name in names.items():
        shown = F.when(F.col("check_id") == check_id, F.lit(name)).otherwise(shown)
    return (
        remediation_items(rows, list(names), assumptions)
        .join(score_gains(totals), "check_id", "left")
        .orderBy(
            F.desc(F.col("at_risk_usd") + F.col("cost_usd")), F.desc("score_gain"),
            F.desc("records"), F.desc("severity_rank"), F.asc("check_id"),
        )
        .select(
            F.col("check_id").alias("priority_check"),
            shown.alias("issue"),
            F.col("object_type").alias("object"),
            "records",
            severity_label(F.col("severity_rank")).alias("severity"),
            "hours_to_fix",
            "cost_usd",
            "at_risk_usd",
            "score_gain",
            "example",
        )
    )


def top_item(items: DataFrame) -> DataFrame:
    """The first line of the remediation list."""
    return items.limit(1)
