"""Emitting, ordering, filtering and flattening findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import round_exact
from ..model import DETAIL_TYPES, detail_struct, severity_label
from ..sources.staging import numbered, staged


@dataclass(frozen=True)
class Rule:
    """One way a single row can be wrong. `order` breaks ties in the sorted output."""

    check_id: str
    severity: int
    field: str
    when: Column
    message: Column
    order: int = 0
    meta: Mapping[str, Column] = field(default_factory=dict)


def _literal(value: int | str) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def emit(df: DataFrame, object_type: str, rules: Sequence[Rule], id_col: str = "record_id") -> DataFrame:
    """One finding per row and rule that fires, in a single scan of `df`.

    Only the numbers of the fired rules are exploded; message and detail columns
    are evaluated afterwards, so a clean row costs its conditions and nothing else.
    """
    fired = df.withColumn(
        "_rule", F.explode(F.array(*[F.when(r.when, F.lit(i)) for i, r in enumerate(rules)]))
    ).where(F.col("_rule").isNotNull())

    def by_rule(values: dict[int, Column]) -> Column:
        (first, chosen), *others = values.items()
        branch = F.when(F.col("_rule") == first, chosen)
        for i, value in others:
            branch = branch.when(F.col("_rule") == i, value)
        return branch

    def constant(name: str) -> Column:
        branches = " ".join(f"WHEN {i} THEN {_literal(getattr(r, name))}" for i, r in enumerate(rules))
        return F.expr(f"CASE _rule {branches} END AS {name}")

    details = {
        key: by_rule({i: r.meta[key] for i, r in enumerate(rules) if key in r.meta})
        for key in DETAIL_TYPES if any(key in r.meta for r in rules)
    }
    return fired.select(
        constant("check_id"),
        F.lit(object_type).alias("object_type"),
        F.col(id_col).cast("string").alias("record_id"),
        constant("severity").alias("severity_rank"),
        severity_label(constant("severity")).alias("severity"),
        by_rule({i: r.message for i, r in enumerate(rules)}).alias("message"),
        constant("field"),
        F.lit(0.0).alias("revenue_impact_usd"),
        F.expr("cast(array() as array<string>) AS related_record_ids"),
        constant("order").alias("emit_order"),
        detail_struct(details).alias("meta"),
    )


def of_checks(findings: DataFrame, *check_ids: str) -> DataFrame:
    """Findings of the named checks.

    Written as equalities: the optimizer folds those into each branch of the
    union and drops the scans that cannot produce the check.
    """
    wanted = F.lit(False)
    for check_id in check_ids:
        wanted = wanted | (F.col("check_id") == check_id)
    return findings.where(wanted)


def filter_findings(
    findings: DataFrame,
    object_types: Sequence[str] = (),
    severities: Sequence[str] = (),
    check_ids: Sequence[str] = (),
) -> DataFrame:
    """All given conditions must hold; an empty selection keeps everything."""
    for column, selected in (
        ("object_type", object_types), ("severity", severities), ("check_id", check_ids),
    ):
        if selected:
            findings = findings.where(F.col(column).isin(*selected))
    return findings


def report_order() -> list[Column]:
    """The order of the report; findings of repeated ids follow their message."""
    return [F.desc("severity_rank"), F.asc("check_id"), F.asc("record_id"), F.asc("emit_order"), F.asc("message")]


def flatten(findings: DataFrame, *more: str) -> DataFrame:
    """Display columns of a findings table, and `more`; exposure is 0 where not priced yet."""
    at_risk = F.col("at_risk_usd") if "at_risk_usd" in findings.columns else F.lit(0.0)
    return findings.select(
        "check_id",
        "object_type",
        "record_id",
        "severity",
        "severity_rank",
        "message",
        F.coalesce("field", F.lit("")).alias("field"),
        round_exact(F.col("revenue_impact_usd"), 2).alias("revenue_impact_usd"),
        F.concat_ws(", ", "related_record_ids").alias("related_record_ids"),
        at_risk.alias("at_risk_usd"),
        *more,
    )


def with_positions(findings: DataFrame) -> DataFrame:
    """Display columns of every finding after its position in the report.

    Only they and the keys of the order are sorted and written, not the details. They are written
    before the sort too: it reads its rows twice, first to find its ranges.
    """
    shown = staged(flatten(findings, "emit_order"), "unsorted_findings")
    return numbered(shown, report_order(), "findings_table").drop("emit_order")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity with their share of all findings."""
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    # At most three rows reach this window.
    total = F.sum("findings").over(Window.partitionBy())
    return counted.withColumn("share", F.col("findings") / total)


def facets(findings: DataFrame) -> DataFrame:
    """Values a user can filter on, each with its number of findings."""
    combined = findings.groupBy("object_type", "severity", "check_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"))
        for c in ("object_type", "severity", "check_id")
    ])
    return (
        combined.select(F.inline(pairs), "n")
        .groupBy("facet", "value")
        .agg(F.sum("n").alias("findings"))
    )
