"""Checks that look at one row at a time. Each returns rules for `emit`."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig, RequiredField
from ..functions import text
from ..functions.values import days_between, timestamp_literal
from ..model import COMPANIES, CONTACTS, DEALS, HIGH, MEDIUM
from ..sources.atlas import country_regions, dimension, owner_regions_by_key
from .findings import Rule

# Display names of columns and tables.
FIELD_LABELS = {
    "email": "Email",
    "owner": "Owner",
    "lifecycle_stage": "Lifecycle Stage",
    "country": "Country/Region",
    "domain": "Domain",
    "industry": "Industry",
    "amount": "Amount",
    "close_date": "Close Date",
}
OBJECT_NOUNS = {CONTACTS: "Contact", COMPANIES: "Company", DEALS: "Deal"}


def field_label(column: str) -> str:
    return FIELD_LABELS.get(column, column.replace("_", " ").title())


def missing_field_rules(
    df: DataFrame, object_type: str, policies: Sequence[RequiredField], check_id: str | None = None
) -> list[Rule]:
    """A rule per required column. Columns the table does not have are skipped."""
    types = dict(df.dtypes)
    noun = OBJECT_NOUNS.get(object_type, object_type)
    return [
        Rule(
            check_id=check_id or f"missing_fields_{object_type}",
            severity=policy.severity,
            field=policy.column,
            when=text.is_blank(F.col(policy.column), types[policy.column] == "string"),
            message=F.lit(f"{noun} has no {field_label(policy.column)}: {policy.reason}."),
            order=position,
            meta={
                "required_field": F.lit(policy.column),
                "policy_reason": F.lit(policy.reason),
            },
        )
        for position, policy in enumerate(policies)
        if policy.column in types
    ]


def with_ages(df: DataFrame, as_of: dt.datetime, **dates: str) -> DataFrame:
    """Adds whole days between a date column and the reference date, under the given names."""
    today = timestamp_literal(as_of)
    return df.withColumns({name: days_between(F.col(c), today) for name, c in dates.items()})


def inactivity_rules(
    days: str, threshold: int, check_id: str = "decayed_contacts", field: str = "last_activity_date"
) -> list[Rule]:
    age = F.col(days)
    return [Rule(
        check_id=check_id,
        severity=MEDIUM,
        field=field,
        when=age > threshold,
        message=text.sentence(
            "Silent for ", age, " days (about ", F.floor(age / 30),
            f" months), longer than the {threshold} days allowed. Win back or suppress.",
        ),
        meta={"days_inactive": age, "threshold_days": F.lit(threshold)},
    )]


def with_email_diagnosis(df: DataFrame, email: str, role_mailboxes: Sequence[str]) -> DataFrame:
    """Adds the address, its parts and the first problem that applies.

    The parts are only read once the address is known to be valid, so they need no checks.
    """
    e, problem = F.col("_email"), F.col("_email_problem")
    tld, local = F.substring_index(e, ".", -1), F.substring_index(e, "@", 1)
    return (
        df.withColumn("_address", text.clean_text(F.col(email)))
        .withColumn("_email", F.lower("_address"))
        .withColumn(
            "_email_problem",
            F.when(e.isNull(), F.lit(None).cast("string"))
            .when(~e.rlike(text.EMAIL_PATTERN), "invalid_syntax")
            .when(~tld.isin(*text.KNOWN_TLDS), "suspicious_tld")
            .when(local.isin(*role_mailboxes), "role_based"),
        )
        .withColumn("_email_tld", F.when(problem == "suspicious_tld", tld))
        .withColumn("_email_likely", text.likely_tld(F.col("_email_tld")))
        .withColumn("_email_local", F.when(problem == "role_based", local))
    )


def deliverability_rules(check_id: str = "email_deliverability") -> list[Rule]:
    """Rules over the columns of `with_email_diagnosis`."""
    address, problem, tld = F.col("_address"), F.col("_email_problem"), F.col("_email_tld")
    likely, local = F.col("_email_likely"), F.col("_email_local")
    return [
        Rule(
            check_id, HIGH, "email", problem == "invalid_syntax",
            text.sentence("'", address, "' is not an email address and cannot receive mail."),
            meta={"reason": problem, "email": address},
        ),
        Rule(
            check_id, HIGH, "email", problem == "suspicious_tld",
            text.sentence(
                "'.", tld, "' is not a known domain ending",
                F.coalesce(text.sentence(", probably meant as '.", likely, "'"), F.lit("")),
                "; mail will bounce.",
            ),
            meta={"reason": problem, "tld": tld, "likely_tld": likely, "email": address},
        ),
        Rule(
            check_id, MEDIUM, "email", problem == "role_based",
            text.sentence(
                "'", local, "@' is a role mailbox, not a person; expect complaints and few replies."
            ),
            meta={"reason": problem, "local_part": local},
        ),
    ]


def with_regions(
    df: DataFrame, config: AuditConfig, owner: str = "owner", country: str = "country"
) -> DataFrame:
    """Adds the region the owner covers and the region the country lies in, null where unknown.

    Both dimensions are built from the policy on the driver, never from data.
    """
    spark = df.sparkSession
    owners = dimension(spark, owner_regions_by_key(config.owner_regions), "_owner_key", "_owner_region")
    countries = dimension(spark, country_regions(config.region_countries), "_country_key", "_record_region")
    return (
        df.withColumn("_owner_key", text.person_key(F.col(owner)))
        .withColumn("_country_key", text.country_key(F.col(country)))
        .join(owners, "_owner_key", "left")
        .join(countries, "_country_key", "left")
    )


def routing_rules(
    object_type: str, owner: str = "owner", country: str = "country", check_id: str | None = None
) -> list[Rule]:
    """Rule over the columns of `with_regions`."""
    noun = OBJECT_NOUNS.get(object_type, object_type)
    covers, lies_in = F.col("_owner_region"), F.col("_record_region")
    return [Rule(
        check_id=check_id or f"routing_{object_type}",
        severity=HIGH,
        field="owner",
        when=covers != lies_in,
        message=text.sentence(
            f"{noun} in ", F.col(country), " belongs to ", lies_in, ", but its owner ", F.col(owner),
            " covers ", covers, ". Hand it to someone in ", lies_in, ".",
        ),
        meta={
            "owner": F.col(owner), "owner_region": covers,
            "record_country": F.col(country), "record_region": lies_in,
        },
    )]


def _amount_clause(amount: Column) -> Column:
    return F.coalesce(text.sentence(" worth $", F.format_number(amount, 0)), F.lit(""))


def with_deal_state(df: DataFrame, as_of: dt.datetime, stage: str = "deal_stage") -> DataFrame:
    """Adds whether a deal is open, its idle days and its days past the close date."""
    df = with_ages(df, as_of, _days_idle="last_activity_date", _days_overdue="close_date")
    return df.withColumn("_is_open", text.stage_is_open(F.col(stage)))


def stale_deal_rules(threshold: int, amount: str = "amount", name: str = "deal_name") -> list[Rule]:
    """Rule over the columns of `with_deal_state`."""
    days = F.col("_days_idle")
    return [Rule(
        check_id="stale_deals",
        severity=HIGH,
        field="last_activity_date",
        when=F.col("_is_open") & (days > threshold),
        message=text.sentence(
            "Open deal", _amount_clause(F.col(amount)), " untouched for ", days,
            f" days, limit {threshold}. It still counts in the forecast.",
        ),
        meta={
            "days_inactive": days, "threshold_days": F.lit(threshold),
            "amount": F.col(amount), "deal_name": F.col(name),
        },
    )]


def past_close_rules(amount: str = "amount", name: str = "deal_name") -> list[Rule]:
    """Rule over the columns of `with_deal_state`."""
    days = F.col("_days_overdue")
    return [Rule(
        check_id="past_close_date",
        severity=HIGH,
        field="close_date",
        when=F.col("_is_open") & (days > 0),
        message=text.sentence(
            "Open deal", _amount_clause(F.col(amount)), " should have closed ", days,
            " days ago. Set a new date or close it.",
        ),
        meta={"days_overdue": days, "amount": F.col(amount), "deal_name": F.col(name)},
    )]
