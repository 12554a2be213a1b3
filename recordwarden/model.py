"""Fixed schemas and the table bundle shared by every module."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTACTS = "contacts"
COMPANIES = "companies"
DEALS = "deals"
OBJECT_TYPES = (CONTACTS, COMPANIES, DEALS)

# Severity ranks.
LOW, MEDIUM, HIGH = 1, 2, 3

DATE_COLUMNS = ("create_date", "last_activity_date", "close_date")
NUMBER_COLUMNS = ("amount", "num_employees")

# Accepted export headers per internal column, in order of preference.
HEADER_ALIASES = {
    CONTACTS: {
        "record_id": ("Record ID", "Contact ID", "id"),
        "first_name": ("First Name",),
        "last_name": ("Last Name",),
        "email": ("Email", "Email Address"),
        "phone": ("Phone Number", "Phone"),
        "job_title": ("Job Title",),
        "owner": ("Contact owner", "HubSpot Owner", "Owner"),
        "lifecycle_stage": ("Lifecycle Stage", "Lifecycle"),
        "lead_status": ("Lead Status",),
        "country": ("Country/Region", "Country"),
        "associated_company_id": ("Associated Company ID", "Primary Associated Company ID"),
        "create_date": ("Create Date", "Created At"),
        "last_activity_date": ("Last Activity Date", "Last Activity"),
    },
    COMPANIES: {
        "record_id": ("Record ID", "Company ID", "id"),
        "company_name": ("Company name", "Name"),
        "domain": ("Company Domain Name", "Domain", "Website"),
        "owner": ("Company owner", "HubSpot Owner", "Owner"),
        "industry": ("Industry",),
        "num_employees": ("Number of Employees", "Employees"),
        "country": ("Country/Region", "Country"),
        "create_date": ("Create Date", "Created At"),
        "last_activity_date": ("Last Activity Date", "Last Activity"),
    },
    DEALS: {
        "record_id": ("Record ID", "Deal ID", "id"),
        "deal_name": ("Deal Name", "Name"),
        "deal_stage": ("Deal Stage", "Stage"),
        "amount": ("Amount", "Deal Amount"),
        "owner": ("Deal owner", "HubSpot Owner", "Owner"),
        "pipeline": ("Pipeline",),
        "close_date": ("Close Date",),
        "create_date": ("Create Date", "Created At"),
        "last_activity_date": ("Last Activity Date", "Last Activity"),
        "associated_company_id": ("Associated Company ID", "Primary Associated Company ID"),
    },
}

# Columns whose text before stripping is kept next to the cleaned one, so the
# correction tables can also repair padding.
RAW_COPIES = {CONTACTS: ("email", "country"), COMPANIES: ("country",), DEALS: ()}


def column_type(column: str) -> T.DataType:
    if column in DATE_COLUMNS:
        return T.TimestampNTZType()
    if column in NUMBER_COLUMNS:
        return T.DoubleType()
    return T.StringType()


def table_columns(object_type: str) -> list[str]:
    """Every column of a conformed table, raw copies last."""
    return [*HEADER_ALIASES[object_type], *(f"{c}_raw" for c in RAW_COPIES[object_type])]


def table_schema(object_type: str) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(c)) for c in table_columns(object_type)])


# Typed detail of a finding; every key is null where a check does not use it.
DETAIL_TYPES = {
    "days_inactive": "int",
    "days_overdue": "int",
    "threshold_days": "int",
    "amount": "double",
    "deal_name": "string",
    "reason": "string",
    "email": "string",
    "tld": "string",
    "likely_tld": "string",
    "local_part": "string",
    "master_record_id": "string",
    "match_key": "string",
    "match_type": "string",
    "required_field": "string",
    "policy_reason": "string",
    "owner": "string",
    "owner_region": "string",
    "record_country": "string",
    "record_region": "string",
}

_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}

FINDINGS_SCHEMA = (
    T.StructType()
    .add("check_id", T.StringType())
    .add("object_type", T.StringType())
    .add("record_id", T.StringType())
    .add("severity_rank", T.IntegerType())
    .add("severity", T.StringType())
    .add("message", T.StringType())
    .add("field", T.StringType())
    .add("revenue_impact_usd", T.DoubleType())
    .add("related_record_ids", T.ArrayType(T.StringType()))
    .add("emit_order", T.IntegerType())
    .add("meta", T.StructType([T.StructField(k, _TYPES[t]) for k, t in DETAIL_TYPES.items()]))
)


def severity_label(rank: Column) -> Column:
    return F.when(rank == HIGH, "High").when(rank == MEDIUM, "Medium").when(rank == LOW, "Low")


def severity_rank(label: Column) -> Column:
    return F.when(label == "High", HIGH).when(label == "Medium", MEDIUM).when(label == "Low", LOW)


def detail_struct(values: dict[str, Column]) -> Column:
    """The `meta` struct with the given keys filled."""
    unknown = set(values) - set(DETAIL_TYPES)
    if unknown:
        raise ValueError(f"unknown finding details: {sorted(unknown)}")
    return F.struct(*[
        values[key].cast(kind).alias(key) if key in values
        else F.expr(f"cast(null as {kind}) AS {key}")
        for key, kind in DETAIL_TYPES.items()
    ])


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


@dataclass
class CrmTables:
    """Three conformed tables and the date every age is measured against."""

    contacts: DataFrame
    companies: DataFrame
    deals: DataFrame
    as_of: dt.datetime

    def frame(self, object_type: str) -> DataFrame:
        if object_type not in OBJECT_TYPES:
            raise ValueError(f"unknown object type {object_type!r}, expected one of {OBJECT_TYPES}")
        return getattr(self, object_type)

    def counts(self) -> DataFrame:
        """One row per table: object_type, total."""
        return union_all([
            self.frame(o).agg(F.count(F.lit(1)).alias("total"))
            .select(F.lit(o).alias("object_type"), "total")
            for o in OBJECT_TYPES
        ])
