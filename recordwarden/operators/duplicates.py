"""Duplicate clusters: every member but the master points at the master."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_company, fold_domain, fold_email, sentence
from ..model import COMPANIES, CONTACTS, HIGH, MEDIUM, detail_struct, severity_label, union_all

# Pieces the members of one key are spread over for the join back: one bit of a long each.
LANES = 64


@dataclass(frozen=True)
class MatchPass:
    """One text key to match on; null and empty match nothing.

    Earlier passes take precedence for the same record.
    """

    key: Column
    severity: int
    field: str
    label: str


def _flagged(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(match_key, record_id, master_record_id) of every member that is not its key's master.

    Equal (key, id) pairs are combined before the shuffle. The join back runs on
    (key, lane of the id), so a key shared by a large part of the table is read
    by many tasks. Which lanes a key uses is kept as bits of a number, so a
    small key gets a row for the lanes of its members only.
    """
    members = (
        df.select(key.alias("match_key"), F.col(id_col).cast("string").alias("record_id"))
        .where(F.col("match_key") != "")
        .groupBy("match_key", "record_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("lane", F.xxhash64("record_id").bitwiseAND(LANES - 1).cast("int"))
    )
    masters = (
        members.groupBy("match_key")
        .agg(
            F.min(F.struct(F.length("record_id").alias("size"), "record_id")).alias("first"),
            F.sum("copies").alias("n"),
            F.bit_or(F.expr("shiftleft(1L, lane)")).alias("lanes"),
        )
        .where(F.col("n") > 1)
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
        .where(F.expr("(shiftright(lanes, lane) & 1L) = 1L"))
        .select("match_key", F.col("first.record_id").alias("master_record_id"), "lane")
    )
    joined = members.join(masters, ["match_key", "lane"])
    # The master itself is only listed when further copies carry the same id.
    return joined.where(
        (F.col("record_id") != F.col("master_record_id")) | (F.col("copies") > 1)
    ).select("match_key", "record_id", "master_record_id")


def duplicate_members(df: DataFrame, passes: Sequence[MatchPass], id_col: str = "record_id") -> DataFrame:
    """One row per duplicate record: the first pass that matched it, then the smallest key."""
    found = union_all([
        _flagged(df, p.key, id_col).withColumn("pass", F.lit(i)) for i, p in enumerate(passes)
    ])
    return (
        found.groupBy("record_id")
        .agg(F.min(F.struct("pass", "match_key", "master_record_id")).alias("hit"))
        .select("record_id", "hit.*")
    )


def duplicate_findings(
    df: DataFrame,
    passes: Sequence[MatchPass],
    check_id: str,
    object_type: str,
    id_col: str = "record_id",
) -> DataFrame:
    def by_pass(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pass") + 1)

    field = by_pass([p.field for p in passes])
    rank = by_pass([p.severity for p in passes])
    master = F.col("master_record_id")
    return duplicate_members(df, passes, id_col).select(
        F.lit(check_id).alias("check_id"),
        F.lit(object_type).alias("object_type"),
        "record_id",
        rank.alias("severity_rank"),
        severity_label(rank).alias("severity"),
        sentence(
            "Same ", by_pass([p.label for p in passes]), " (", F.col("match_key"), ") as record ", master,
            ", which is older. Merge this record into ", master, ".",
        ).alias("message"),
        field.alias("field"),
        F.lit(0.0).alias("revenue_impact_usd"),
        F.array(master).alias("related_record_ids"),
        F.lit(0).alias("emit_order"),
        detail_struct({
            "master_record_id": master, "match_key": F.col("match_key"), "match_type": field,
        }).alias("meta"),
    )


def duplicate_contacts(contacts: DataFrame) -> DataFrame:
    by_email = MatchPass(fold_email(F.col("email")), HIGH, "email", "email")
    return duplicate_findings(contacts, [by_email], "duplicate_contacts", CONTACTS)


def duplicate_companies(companies: DataFrame) -> DataFrame:
    passes = [
        MatchPass(fold_domain(F.col("domain")), HIGH, "domain", "web domain"),
        MatchPass(fold_company(F.col("company_name")), MEDIUM, "company_name", "name without legal words"),
    ]
    return duplicate_findings(companies, passes, "duplicate_companies", COMPANIES)
