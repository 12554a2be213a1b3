"""The audit report: priced findings, score, cost and ranked remediation work."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig, CostAssumptions
from ..functions.values import round_exact
from ..model import OBJECT_TYPES, CrmTables
from ..operators.findings import flatten, report_order, severity_counts, with_positions
from ..operators.scoring import (
    OVERALL, cost_of_findings, health_score, price_findings, punch_list, score_totals, summary_rows, top_item,
)
from ..sources.staging import staged, with_places
from ..sources.writers import write_csv, write_json
from .audit import CHECK_NAMES, CustomCheck, run_checks


def _side_by_side(single_rows: list[DataFrame]) -> DataFrame:
    """Columns of several one-row tables in one row, by stacking and folding them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _folded(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """A few rows (tables or checks) as one sorted array."""
    return df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def _of_object(object_type: str, column: str) -> Column:
    return F.max(F.when(F.col("object_type") == object_type, F.col(column)))


def headline_columns(score: DataFrame, cost: DataFrame, severities: DataFrame) -> DataFrame:
    """One row with every total of the report and the sentence it opens with."""
    overall = score.where(F.col("object_type") == OVERALL).drop("object_type")
    levels = severities.agg(*[
        F.coalesce(F.max(F.when(F.col("severity") == label, F.col("findings"))), F.lit(0))
        .alias(f"{label.lower()}_findings")
        for label in ("High", "Medium", "Low")
    ])
    summary = _side_by_side([overall, cost, levels])
    total = F.col("high_findings") + F.col("medium_findings") + F.col("low_findings")
    summary = summary.withColumn("findings_total", total)
    sentence = F.format_string(
        "Grade %s with %s points: %s of %s records need work (%s findings). Repair takes %s hours, "
        "or $%s; neglected deals expose $%s.",
        "grade", F.format_number("score", 0),
        F.format_number("affected_records", 0), F.format_number("total_records", 0),
        F.format_number("findings_total", 0), F.format_number("remediation_hours", 0),
        F.format_number("direct_cost_usd", 0), F.format_number("at_risk_pipeline_usd", 0),
    )
    return summary.withColumn("headline", sentence)


@dataclass
class Report:
    """All parts are DataFrames; `findings` is the only large one, priced when first asked for."""

    priced: Callable[[], DataFrame]
    counts: DataFrame
    score: DataFrame
    cost: DataFrame
    severities: DataFrame
    items: DataFrame
    as_of: dt.datetime
    assumptions: CostAssumptions
    checks_run: int

    @cached_property
    def findings(self) -> DataFrame:
        return self.priced()

    def findings_table(self) -> DataFrame:
        """Every finding with its position in the report."""
        return with_positions(self.findings)

    def start_here(self) -> DataFrame:
        return top_item(self.items)

    def headline(self) -> DataFrame:
        return headline_columns(self.score, self.cost, self.severities)

    def summary(self) -> DataFrame:
        """One nested row with the whole report but the findings, ready for JSON."""
        item_columns = self.items.columns
        by_object = self.score.agg(
            *[_of_object(o, "score").alias(f"{o}_score") for o in OBJECT_TYPES],
            *[_of_object(o, "total_records").alias(f"{o}_records") for o in OBJECT_TYPES],
        )
        ranked = _folded(
            self.items.withColumn("_value", -(F.col("at_risk_usd") + F.col("cost_usd"))),
            "punch_list", "_value", *item_columns,
        )
        rows = _side_by_side([self.headline(), by_object, ranked])
        bands = F.array(*[
            F.array(F.lit(float(d)), F.lit(float(s))) for d, s in self.assumptions.risk_bands
        ])
        return rows.select(
            "headline",
            F.lit(self.as_of.isoformat()).alias("as_of"),
            F.struct(
                F.col("score").alias("overall"), "grade",
                F.struct(*[F.col(f"{o}_score").alias(o) for o in OBJECT_TYPES]).alias("by_object"),
                "clean_records", "affected_records", "total_records",
            ).alias("score"),
            F.struct(
                "remediation_hours", "direct_cost_usd", "at_risk_pipeline_usd",
                "total_open_pipeline_usd",
                round_exact(F.col("at_risk_share"), 4).alias("at_risk_share"),
            ).alias("cost"),
            F.struct(*[
                F.col(f"{o}_records").alias(o) for o in OBJECT_TYPES
            ]).alias("record_counts"),
            "findings_total",
            F.struct(
                F.col("high_findings").alias("High"), F.col("medium_findings").alias("Medium"),
                F.col("low_findings").alias("Low"),
            ).alias("findings_by_severity"),
            F.lit(self.checks_run).alias("checks_run"),
            F.transform("punch_list", lambda i: F.struct(
                *[i[c].alias(c) for c in item_columns]
            )).alias("punch_list"),
            F.struct(
                F.lit(float(self.assumptions.hourly_cost)).alias("loaded_rep_hourly_cost"),
                bands.alias("forecast_risk_bands"),
            ).alias("assumptions"),
        )

    def write_findings(self, path: str, filtered: DataFrame | None = None, positions: bool = False) -> None:
        """The findings (or a selection from `filter_findings`) as ordered CSV, also with their positions."""
        chosen = self.findings if filtered is None else filtered
        if positions:
            write_csv(with_positions(chosen), path, [F.asc("position")])
        else:
            write_csv(flatten(chosen.orderBy(*report_order())), path)

    def write_summary(self, path: str) -> None:
        write_json(self.summary(), path)


def build_report(
    tables: CrmTables,
    config: AuditConfig,
    assumptions: CostAssumptions | None = None,
    custom_checks: Mapping[str, CustomCheck] | None = None,
    stage: bool = True,
) -> Report:
    """Run every check and assemble the report.

    The findings are written once to the shared staging folder: prices, numbers and exports all
    come from there. Without `stage` the numbers are computed from the checks each time; only the
    priced findings are then written, when they are first asked for.
    """
    assumptions = assumptions or CostAssumptions()
    names = {**CHECK_NAMES, **{c: c.replace("_", " ").title() for c in custom_checks or {}}}
    found = run_checks(tables, config, custom_checks=custom_checks)
    if stage:
        found = with_places(found, "findings")
    numbers = numbers_of(summary_rows(found, assumptions), tables, names, assumptions)
    return Report(
        **numbers,
        priced=lambda: price_findings(found, assumptions),
        as_of=tables.as_of,
        assumptions=assumptions,
        checks_run=len(names),
    )


def numbers_of(
    rows: DataFrame, tables: CrmTables, names: Mapping[str, str], assumptions: CostAssumptions | None = None
) -> dict[str, DataFrame]:
    """Counts, score, cost, severities and items from the rows of `summary_rows`."""
    counts = tables.counts()
    totals = score_totals(rows, counts, list(names))
    return {
        "counts": counts,
        "score": health_score(totals),
        "cost": cost_of_findings(rows, tables.deals, assumptions),
        "severities": severity_counts(rows),
        "items": punch_list(rows, totals, names, assumptions),
    }


def narrow_numbers(
    tables: CrmTables, config: AuditConfig, assumptions: CostAssumptions | None = None
) -> dict[str, DataFrame]:
    """The numbers alone: one audit, of which only the rows of `summary_rows` are written."""
    rows = staged(summary_rows(run_checks(tables, config), assumptions), "finding_numbers")
    return numbers_of(rows, tables, CHECK_NAMES, assumptions)
