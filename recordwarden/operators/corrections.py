"""Correction tables: safe imports, suggestions to review, and worklists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import COMPANIES, CONTACTS, DEALS
from ..sources.atlas import canonical_countries, dimension
from ..sources.staging import staged
from .findings import of_checks

# Export headers, so that a table can be imported again.
EXPORT_HEADERS = {
    CONTACTS: {
        "record_id": "Record ID", "email": "Email", "owner": "Contact owner",
        "lifecycle_stage": "Lifecycle Stage", "country": "Country/Region",
    },
    COMPANIES: {
        "record_id": "Record ID", "domain": "Company Domain Name", "owner": "Company owner",
        "industry": "Industry", "country": "Country/Region",
    },
    DEALS: {
        "record_id": "Record ID", "amount": "Amount", "owner": "Deal owner",
        "close_date": "Close Date",
    },
}
OBJECT_LABELS = {CONTACTS: "Contacts", COMPANIES: "Companies", DEALS: "Deals"}
DUPLICATE_CHECKS = ("duplicate_contacts", "duplicate_companies")
ROUTING_CHECKS = ("routing_contacts", "routing_companies")
DEAL_CHECKS = ("stale_deals", "past_close_date")


def export_header(object_type: str, column: str) -> str:
    return EXPORT_HEADERS.get(object_type, {}).get(column, column)


def _object_label():
    label = F.col("object_type")
    for object_type, shown in OBJECT_LABELS.items():
        label = F.when(F.col("object_type") == object_type, F.lit(shown)).otherwise(label)
    return label


def _uncleaned(df: DataFrame, column: str) -> str:
    return f"{column}_raw" if f"{column}_raw" in df.columns else column


def email_normalization(contacts: DataFrame, findings: DataFrame, repair_padding: bool = False) -> DataFrame:
    """Addresses with stray case, or also with padding. Records about to be merged are left
    out: the corrected address would collide with the one of their master."""
    raw = F.col(_uncleaned(contacts, "email"))
    raw = raw if repair_padding else text.strip(raw)
    changed = contacts.select(
        "record_id", raw.alias("_raw"), text.email_key(raw).alias("_email")
    ).where(F.col("_raw") != F.col("_email"))
    queued = (
        of_checks(findings, *DUPLICATE_CHECKS)
        .where(F.col("object_type") == CONTACTS)
        .select("record_id").distinct()
    )
    return changed.join(queued, "record_id", "left_anti").select(
        F.col("record_id").alias(export_header(CONTACTS, "record_id")),
        F.col("_email").alias(export_header(CONTACTS, "email")),
    )


def with_canonical_country(df: DataFrame, country: str, into: str = "canonical_country") -> DataFrame:
    """Adds the one spelling used for a country, null when the country is not known."""
    names = dimension(df.sparkSession, canonical_countries(), "_country_key", into)
    return (
        df.withColumn("_country_key", text.country_key(F.col(country)))
        .join(names, "_country_key", "left")
        .drop("_country_key")
    )


def country_standardization(df: DataFrame, object_type: str, repair_padding: bool = False) -> DataFrame:
    """Countries under another spelling, or also with padding, and the one spelling to use."""
    raw = F.col(_uncleaned(df, "country"))
    raw = raw if repair_padding else text.strip(raw)
    named = with_canonical_country(df.select("record_id", raw.alias("_raw")), "_raw", "_canonical")
    return named.where(F.col("_raw") != F.col("_canonical")).select(
        F.col("record_id").alias(export_header(object_type, "record_id")),
        F.col("_canonical").alias(export_header(object_type, "country")),
    )


def email_typo_suggestions(findings: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Mistyped domain endings with a proposal, only where one is likely. An ending in capitals
    is replaced only with `ignore_case`."""
    email, tld, likely = F.col("meta.email"), F.col("meta.tld"), F.col("meta.likely_tld")
    stem = F.substr(email, F.lit(1), F.length(email) - F.length(tld))
    suggested = F.when(F.endswith(F.lower(email) if ignore_case else email, tld), F.concat(stem, likely)).otherwise("")
    return (
        of_checks(findings, "email_deliverability")
        .where((F.col("meta.reason") == "suspicious_tld") & likely.isNotNull() & (email != ""))
        .select(
            F.col("record_id").alias("Record ID"),
            email.alias("Current Email"),
            suggested.alias("Suggested Email"),
            F.lit("").alias("Confirmed? (yes/no)"),
        )
    )


def merge_worklist(findings: DataFrame) -> DataFrame:
    return of_checks(findings, *DUPLICATE_CHECKS).select(
        _object_label().alias("Object"),
        F.col("record_id").alias("Merge This Record ID"),
        F.col("meta.master_record_id").alias("Into This Record ID"),
        F.col("meta.match_type").alias("Matched On"),
        F.col("meta.match_key").alias("Matched Value"),
        F.lit("").alias("Done? (yes/no)"),
    )


def routing_worklist(findings: DataFrame) -> DataFrame:
    return of_checks(findings, *ROUTING_CHECKS).select(
        _object_label().alias("Object"),
        F.col("record_id").alias("Record ID"),
        F.col("meta.owner").alias("Current Owner"),
        F.col("meta.owner_region").alias("Owner Covers"),
        F.col("meta.record_country").alias("Record Country"),
        F.col("meta.record_region").alias("Should Be Owned In"),
        F.lit("").alias("New Owner (fill in)"),
    )


def deal_names(deals: DataFrame, name: str = "deal_name") -> DataFrame:
    """One name per deal id; the largest one where an id is repeated."""
    return deals.groupBy("record_id").agg(F.max(name).alias("deal_name"))


def with_deal_names(findings: DataFrame, deals: DataFrame) -> DataFrame:
    """Left lookup of deal names for findings that do not carry one, such as those of own checks."""
    return findings.join(deal_names(deals), "record_id", "left")


def deal_worklist(priced: DataFrame) -> DataFrame:
    """Open deals to decide on. The name was read with the deal, so nothing is joined."""
    return of_checks(priced, *DEAL_CHECKS).select(
        F.col("record_id").alias("Record ID"),
        F.coalesce("meta.deal_name", F.lit("")).alias("Deal Name"),
        F.when(F.col("check_id") == "stale_deals", "Stale").otherwise("Past close date").alias("Issue"),
        F.coalesce("meta.days_inactive", "meta.days_overdue").alias("Days"),
        F.col("meta.amount").alias("Amount"),
        F.col("at_risk_usd").alias("At Risk (USD)"),
        F.lit("").alias("Decision (chase / re-date / close)"),
    )


def missing_fields_seen(findings: DataFrame, object_type: str) -> list[str]:
    """Columns with at least one blank; at most the columns of the policy."""
    rows = of_checks(findings, f"missing_fields_{object_type}").select("field").distinct().collect()
    return sorted(r.field for r in rows if r.field)


def missing_fields_template(
    findings: DataFrame, object_type: str, fields: Sequence[str] | None = None
) -> DataFrame:
    """One row per record: empty where a value is needed, `n/a` where nothing is missing.

    Without `fields` the columns are those that any record lacks. Record and field of every finding
    are then written first, so that the checks run once for the columns and the rows.
    """
    missing = of_checks(findings, f"missing_fields_{object_type}").select("record_id", "field")
    if fields is None:
        missing = staged(missing, "missing_fields")
        fields = sorted(r.field for r in missing.select("field").distinct().collect() if r.field)  # columns of the policy
    needed = [F.max(F.when(F.col("field") == f, 1).otherwise(0)).alias(f"_{f}") for f in fields]
    return missing.groupBy("record_id").agg(F.count(F.lit(1)), *needed).select(
        F.col("record_id").alias(export_header(object_type, "record_id")),
        *[
            F.when(F.col(f"_{f}") == 1, "").otherwise("n/a").alias(export_header(object_type, f))
            for f in sorted(fields)
        ],
    )
