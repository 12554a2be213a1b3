"""Contacts, companies and deals read from the order warehouse tables.

contacts   one per customer, active when they order
companies  one per web page, matched on its address
deals      one per order, closing when its last line ships

What the warehouse does not have (addresses, owners, countries, gaps) is derived
from the keys by arithmetic, so every table grows with its source.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import AuditConfig, make_config
from ..model import COMPANIES, CONTACTS, DEALS, CrmTables
from ..sources.csv_tables import conform, resolve_as_of

OWNERS = ["Ada Novak", "Ben Okafor", "Chloe Ruiz", "Dmitri Sato", "Elif Kaya"]
# The last owner has no region on purpose.
OWNER_REGIONS = {
    "Ada Novak": "North America", "Ben Okafor": "EMEA", "Chloe Ruiz": "LATAM", "Dmitri Sato": "APAC",
}
# One spelling per nation key, some of them unknown to the atlas.
COUNTRIES = [
    "U.S.A.", "united states", "Canada", " Mexico ", "Brasil", "Argentina", "chile", "Peru", "UK",
    "Great Britain", "Deutschland", "France", "España", "The Netherlands", "Czech Republic",
    "Russia", "Kenya", "UAE", "Japan", "India", "Republic of Korea", "australia", "Singapore",
    "Atlantis", "new  zealand",
]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def policy() -> AuditConfig:
    return make_config(owner_regions=OWNER_REGIONS)


def _nth(values: list[str], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({items}), cast({index} + 1 as int))"


def _owner(k: str, gap: int) -> str:
    return f"""CASE WHEN {k} % {gap} = 0 THEN NULL
        WHEN {k} % 13 = 0 THEN '  ada   NOVAK ' ELSE {_nth(OWNERS, f"{k} % 5")} END"""


_ADDRESS = """CASE c_custkey % 20
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('info@shop', c_custkey % 50, '.com')
    WHEN 2 THEN concat('User', c_custkey, '@Shop.COM')
    WHEN 3 THEN concat('user', c_custkey, '@shop.cim')
    WHEN 4 THEN concat('user', c_custkey, '.example.com')
    WHEN 5 THEN concat(' USER', c_custkey + 1, '@MAIL.NET ')
    WHEN 6 THEN concat('user', c_custkey, '@mail.net')
    WHEN 7 THEN concat('user', c_custkey, '@shop.online')
    WHEN 8 THEN concat('USER', c_custkey, '@shop.CMO')
    WHEN 9 THEN 'frontdesk@hub.io'
    WHEN 10 THEN 'frontdesk@hub.io'
    WHEN 11 THEN '   '
    WHEN 12 THEN 'sales@hub.io'
    WHEN 13 THEN 'a@@b.com'
    ELSE concat('user', c_custkey, '@mail.org') END"""


def contact_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under export headers, not yet cleaned."""
    activity = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")
    )
    customers = table(spark, sf_dir, "customer")
    return customers.join(activity, F.expr("o_custkey = c_custkey"), "left").selectExpr(
        "cast(c_custkey as string) AS `Record ID`",
        "c_name AS `Last Name`",
        f"{_ADDRESS} AS `Email`",
        f"{_owner('c_custkey', 11)} AS `Contact owner`",
        "CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS `Lifecycle Stage`",
        f"CASE WHEN c_custkey % 19 <> 0 THEN {_nth(COUNTRIES, 'c_nationkey')} END AS `Country/Region`",
        "first_order AS `Create Date`",
        "last_order AS `Last Activity Date`",
    )


def company_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages under company export headers."""
    return table(spark, sf_dir, "pages").selectExpr(
        "cast(page_id as string) AS `Record ID`",
        """CASE page_id % 5
            WHEN 0 THEN concat('Vendor ', page_id div 5, ' Inc.')
            WHEN 1 THEN concat('VENDOR ', page_id div 5, ', LLC')
            WHEN 2 THEN 'The Group'
            WHEN 3 THEN concat('Vendor-', page_id, ' GmbH')
            ELSE concat('Vendor ', page_id div 5, ' Holdings') END AS `Company name`""",
        "CASE WHEN page_id % 29 <> 0 THEN url END AS `Company Domain Name`",
        f"{_owner('page_id', 7)} AS `Company owner`",
        "CASE WHEN page_id % 6 <> 0 THEN concat('Industry ', page_id % 4) END AS `Industry`",
        "cast(page_id % 1000 as double) AS `Number of Employees`",
        f"{_nth(COUNTRIES, 'page_id % 25')} AS `Country/Region`",
    )


def deal_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under deal export headers."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(shipped, F.expr("l_orderkey = o_orderkey"), "left").selectExpr(
        "cast(o_orderkey as string) AS `Record ID`",
        "concat('Order ', o_orderkey) AS `Deal Name`",
        """CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'Closed Won'
            WHEN o_orderstatus = 'F' THEN 'closed_lost'
            WHEN o_orderstatus = 'P' AND o_orderkey % 9 = 0 THEN NULL
            WHEN o_orderstatus = 'P' THEN 'contractsent'
            ELSE 'Qualified To Buy' END AS `Deal Stage`""",
        "CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS `Amount`",
        f"{_owner('o_orderkey', 31)} AS `Deal owner`",
        "o_orderpriority AS `Pipeline`",
        "last_ship AS `Close Date`",
        "o_orderdate AS `Create Date`",
        "o_orderdate AS `Last Activity Date`",
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(contact_export(spark, sf_dir), CONTACTS)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(company_export(spark, sf_dir), COMPANIES)


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(deal_export(spark, sf_dir), DEALS)


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All activity dates of contacts and deals come from this one column."""
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        day.alias("create_date"), day.alias("last_activity_date")
    )


def as_of(spark: SparkSession, sf_dir: str) -> dt.datetime:
    return resolve_as_of([order_dates(spark, sf_dir)])


class WarehouseTables(CrmTables):
    """The three tables, each defined when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._source = (spark, sf_dir)

    @cached_property
    def contacts(self) -> DataFrame:
        return contacts(*self._source)

    @cached_property
    def companies(self) -> DataFrame:
        return companies(*self._source)

    @cached_property
    def deals(self) -> DataFrame:
        return deals(*self._source)

    @cached_property
    def as_of(self) -> dt.datetime:
        return as_of(*self._source)


def crm(spark: SparkSession, sf_dir: str) -> CrmTables:
    return WarehouseTables(spark, sf_dir)
