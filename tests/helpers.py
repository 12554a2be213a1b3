"""Small builders shared by the tests."""

import datetime as dt

from recordwarden.model import COMPANIES, CONTACTS, DEALS, CrmTables, detail_struct, severity_label
from recordwarden.sources.csv_tables import conform, empty_table
from pyspark.sql import functions as F

AS_OF = dt.datetime(2026, 7, 30)
REGIONS = {"Nora Lind": "EMEA", "Raj Patel": "APAC", "Zoe Hart": "North America"}


def day(days_ago):
    return str((AS_OF - dt.timedelta(days=days_ago)).date())


def text_table(spark, object_type, rows):
    """A conformed table from dicts of export headers."""
    if not rows:
        return empty_table(spark, object_type)
    headers = list(dict.fromkeys(h for row in rows for h in row))
    schema = ", ".join(f"`{h}` string" for h in headers)
    return conform(spark.createDataFrame([tuple(r.get(h) for h in headers) for r in rows], schema), object_type)


def crm(spark, contacts=(), companies=(), deals=(), as_of=AS_OF):
    return CrmTables(
        text_table(spark, CONTACTS, contacts), text_table(spark, COMPANIES, companies),
        text_table(spark, DEALS, deals), as_of,
    )


def contact(i, **changes):
    row = {
        "Record ID": str(i), "Email": f"person{i}@firm.com", "Contact owner": "Zoe Hart",
        "Lifecycle Stage": "lead", "Country/Region": "Canada", "Last Activity Date": day(5),
    }
    return {**row, **{k.replace("_", " "): v for k, v in changes.items()}}


def company(i, **changes):
    row = {
        "Record ID": str(i), "Company name": f"Firm {i}", "Company Domain Name": f"firm{i}.com",
        "Company owner": "Zoe Hart", "Industry": "Retail", "Country/Region": "Canada",
    }
    return {**row, **{k.replace("_", " "): v for k, v in changes.items()}}


def deal(i, **changes):
    row = {
        "Record ID": str(i), "Deal Name": f"Deal {i}", "Deal Stage": "contractsent", "Amount": "1000",
        "Deal owner": "Zoe Hart", "Close Date": day(-30), "Last Activity Date": day(5),
    }
    return {**row, **{k.replace("_", " "): v for k, v in changes.items()}}


def findings(spark, rows):
    """Findings from (check, object, record, severity, days inactive, days overdue, amount)."""
    rows = [tuple(r) + (None,) * (7 - len(r)) for r in rows]
    df = spark.createDataFrame(
        rows, "check_id string, object_type string, record_id string, severity_rank int, "
        "days_inactive int, days_overdue int, amount double",
    )
    return df.select(
        "check_id", "object_type", "record_id", "severity_rank",
        severity_label(F.col("severity_rank")).alias("severity"),
        F.concat_ws(" ", "check_id", "record_id").alias("message"),
        F.lit(None).cast("string").alias("field"),
        F.lit(0.0).alias("revenue_impact_usd"),
        F.array().cast("array<string>").alias("related_record_ids"),
        F.lit(0).alias("emit_order"),
        detail_struct({k: F.col(k) for k in ("days_inactive", "days_overdue", "amount")}).alias("meta"),
    )
