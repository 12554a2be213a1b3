"""Registered queries: every operator bound to the warehouse tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RequiredField, make_config, months_to_days
from ..functions import text
from ..functions.values import days_between, timestamp_literal
from ..model import (
    COMPANIES, CONTACTS, DEALS, HIGH, LOW, MEDIUM, OBJECT_TYPES, CrmTables, severity_rank, union_all,
)
from ..operators import corrections, owners, scoring
from ..operators.duplicates import MatchPass, duplicate_members
from ..operators.findings import (
    Rule, emit, facets, filter_findings, flatten, of_checks, report_order, severity_counts, with_positions,
)
from ..operators.row_checks import (
    deliverability_rules, inactivity_rules, missing_field_rules, routing_rules, with_ages,
    with_email_diagnosis,
)
from ..plans.audit import CHECK_NAMES, run_checks
from ..plans.correction_bundle import candidate_tables, row_counts, write_corrections
from ..plans.report import build_report, headline_columns, narrow_numbers
from ..sources.csv_tables import latest_activity, load_crm, read_export
from ..sources.staging import staging_path
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _findings(spark: SparkSession, sf_dir: str, *checks: str) -> DataFrame:
    return run_checks(b.crm(spark, sf_dir), b.policy(), checks or None)


def _deal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "missing_fields_deals", "stale_deals", "past_close_date")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.price_findings(_findings(spark, sf_dir))


def _numbers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return narrow_numbers(b.crm(spark, sf_dir), b.policy())


# --- sources -----------------------------------------------------------------

@register
def csv_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written as a CSV export and loaded again."""
    return read_export(spark, _exported(b.contact_export(spark, sf_dir), CONTACTS), CONTACTS, multi_line=False)


def _exported(table: DataFrame, name: str) -> str:
    """Where the table now lies as CSV."""
    path = staging_path(table.sparkSession, f"{name}_export")
    table.write.option("header", True).option("escape", '"').option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _spelled(table: DataFrame) -> DataFrame:
    """Ids as decimals and every date in one of five spellings, by row."""
    spellings = ["yyyy-MM-dd", "MM/dd/yyyy hh:mm a", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd"]
    turn = F.pmod(F.col("`Record ID`").cast("int"), F.lit(len(spellings)))
    dates = [n for n in table.columns if n.endswith("Date")]

    def spelled(name: str) -> Column:
        """A row's own spelling only; an array of them would write every date in all of them."""
        chosen = F.when(turn == 0, F.date_format(name, spellings[0]))
        for i, spelling in enumerate(spellings[1:], start=1):
            chosen = chosen.when(turn == i, F.date_format(name, spelling))
        return chosen

    return table.withColumns({
        "Record ID": F.concat("Record ID", F.lit(".0")),
        **{n: spelled(n) for n in dates},
    })


@register
def csv_multiline_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts whose job titles hold line breaks, blank lines, quotes and commas, through the default read."""
    number = F.col("`Record ID`")
    title = F.concat(F.lit('Buyer\nno. "'), number, F.lit('",\n\nand "more"'))
    table = b.contact_export(spark, sf_dir).withColumn("Job Title", F.when(number.cast("int") % 7 < 3, title))
    return read_export(spark, _exported(table, "multiline"), CONTACTS).select("record_id", "last_name", "job_title", "email", "owner")


@register
def loaded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three tables as CSV text in mixed spellings, loaded, audited and sorted."""
    paths = {
        CONTACTS: _exported(_spelled(b.contact_export(spark, sf_dir)), CONTACTS),
        COMPANIES: _exported(_spelled(b.company_export(spark, sf_dir)), COMPANIES),
        DEALS: _exported(_spelled(b.deal_export(spark, sf_dir)), DEALS),
    }
    return flatten(run_checks(load_crm(spark, **paths, multi_line=False), b.policy()).orderBy(*report_order()))


@register
def contacts_only_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit without companies and deals."""
    path = _exported(b.contact_export(spark, sf_dir), CONTACTS)
    return flatten(run_checks(load_crm(spark, contacts=path, multi_line=False), b.policy()))


@register
def conformed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.companies(spark, sf_dir)


@register
def conformed_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.deals(spark, sf_dir)


@register
def reference_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_activity([b.contacts(spark, sf_dir), b.companies(spark, sf_dir), b.deals(spark, sf_dir)])


@register
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.crm(spark, sf_dir).counts()


# --- standardization ---------------------------------------------------------

@register
def email_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("email_key")
    return (
        b.contacts(spark, sf_dir)
        .select("record_id", text.email_key(F.col("email_raw")).alias("email_key"))
        .select(
            "record_id", "email_key",
            text.email_local(key).alias("local_part"),
            text.email_domain(key).alias("domain"),
            text.email_is_valid(key).alias("is_valid"),
            text.email_tld(key).alias("tld"),
        )
        .withColumn("is_suspicious", text.tld_is_suspicious(F.col("tld")))
        .withColumn("likely_tld", F.when(F.col("is_suspicious"), text.likely_tld(F.col("tld"))))
    )


@register
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.companies(spark, sf_dir).select(
        "record_id", text.company_key(F.col("company_name")).alias("company_key")
    )


@register
def domain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", text.domain_key(F.col("url")).alias("domain_key"))


@register
def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.contacts(spark, sf_dir).select("record_id", "country")
    return corrections.with_canonical_country(
        found.withColumn("country_key", text.country_key(F.col("country"))), "country"
    ).select("record_id", "country_key", "canonical_country")


@register
def owner_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.contact_export(spark, sf_dir).select(
        F.col("Record ID").alias("record_id"), text.person_key(F.col("Contact owner")).alias("owner_key")
    )


@register
def event_age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days, counted from a time of day; negative for later events."""
    noon = timestamp_literal(dt.datetime(2024, 1, 15, 12))
    return b.table(spark, sf_dir, "events").select(
        "event_id", days_between(F.col("ts"), noon).alias("days")
    )


@register
def open_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.deals(spark, sf_dir).select("record_id", text.stage_is_open(F.col("deal_stage")).alias("is_open"))


@register
def blank_contact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells are blank, per column of the contact export."""
    export = b.contact_export(spark, sf_dir)
    names = ["Email", "Contact owner", "Lifecycle Stage", "Country/Region"]
    counts = export.agg(*[F.count_if(text.is_blank(F.col(n))).alias(n) for n in names])
    pairs = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("blanks")) for n in names]
    return counts.select(F.inline(F.array(*pairs)))


# --- checks ------------------------------------------------------------------

def _duplicates(spark: SparkSession, sf_dir: str, check: str) -> DataFrame:
    return _findings(spark, sf_dir, check).select(
        "record_id", "severity", "field", "meta.master_record_id", "meta.match_key", "meta.match_type",
        F.concat_ws(", ", "related_record_ids").alias("related"),
    )


@register
def duplicate_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir, "duplicate_contacts")


@register
def duplicate_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir, "duplicate_companies")


@register
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text is equal once case and outer blanks are ignored."""
    key = F.md5(text.email_key(F.col("text")))
    return duplicate_members(
        b.table(spark, sf_dir, "documents"), [MatchPass(key, HIGH, "text", "text")], "doc_id"
    ).select("record_id", "match_key", "master_record_id")


@register
def duplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by name and brand first, by name alone second."""
    passes = [
        MatchPass(F.concat_ws("|", "p_name", "p_brand"), HIGH, "p_brand", "name and brand"),
        MatchPass(F.col("p_name"), MEDIUM, "p_name", "name"),
    ]
    return duplicate_members(b.table(spark, sf_dir, "part"), passes, "p_partkey")


def _missing(spark: SparkSession, sf_dir: str, object_type: str) -> DataFrame:
    return _findings(spark, sf_dir, f"missing_fields_{object_type}").select(
        "record_id", "severity", "field", "message", "meta.required_field", "meta.policy_reason"
    )


@register
def missing_contact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir, CONTACTS)


@register
def missing_company_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir, COMPANIES)


@register
def missing_deal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir, DEALS)


@register
def unlabeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without quality or toxicity label; a policy column that does not exist is skipped."""
    labeled = b.table(spark, sf_dir, "documents").select("doc_id").join(
        b.table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    policy = [
        RequiredField("quality", HIGH, "it cannot be selected"),
        RequiredField("toxic", MEDIUM, "it cannot be screened"),
        RequiredField("reviewer", LOW, "nobody checked it"),
    ]
    rules = missing_field_rules(labeled, "documents", policy)
    return emit(labeled, "documents", rules, "doc_id").select("check_id", "record_id", "severity", "field")


def _decay_columns(findings: DataFrame) -> DataFrame:
    return findings.select("record_id", "severity", "message", "meta.days_inactive", "meta.threshold_days")


@register
def decayed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decay_columns(_findings(spark, sf_dir, "decayed_contacts"))


@register
def decayed_after_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts silent for longer than four months."""
    config = make_config(decayed_contact_days=months_to_days(4))
    return _decay_columns(run_checks(b.crm(spark, sf_dir), config, ["decayed_contacts"]))


@register
def lapsed_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last purchase is more than three whole days before the last event."""
    events = b.table(spark, sf_dir, "events")
    last_event = events.agg(F.max("ts")).first()[0]
    bought = events.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_purchase")
    )
    rules = inactivity_rules("days", 3, "lapsed_buyers", "last_purchase")
    return _decay_columns(emit(with_ages(bought, last_event, days="last_purchase"), "users", rules, "user_id"))


@register
def email_deliverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "email_deliverability").select(
        "record_id", "severity", "message", "meta.reason", "meta.email", "meta.tld", "meta.likely_tld",
        "meta.local_part",
    )


@register
def published_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of every address found in whole documents and web pages."""
    # A match starts where a run of these characters starts; no other place is tried, so long runs
    # without an @ cost one pass.
    run = r"\s<>\"'(),;:="
    pattern = F.lit(rf"(?<![^{run}])(?:@[^@{run}]*+|[^@{run}]++)@[^{run}]+")
    sources = union_all([
        b.table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("place"),
            F.explode(F.regexp_extract_all(F.col(body), pattern, F.lit(0))).alias("address"),
        )
        for name, prefix, key, body in (
            ("documents", "d", "doc_id", "text"), ("pages", "p", "page_id", "html"),
        )
    ])
    diagnosed = with_email_diagnosis(sources, "address", b.policy().role_mailboxes)
    return emit(diagnosed, "documents", deliverability_rules(), "place").select(
        "record_id", "severity", "meta.reason", "meta.email", "meta.tld", "meta.likely_tld"
    )


def _routed(spark: SparkSession, sf_dir: str, check: str) -> DataFrame:
    return _findings(spark, sf_dir, check).select(
        "record_id", "message", "meta.owner", "meta.owner_region", "meta.record_country",
        "meta.record_region",
    )


@register
def routing_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "routing_contacts")


@register
def routing_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "routing_companies")


@register
def shipments_across_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose supplier and customer lie in different regions; two nations are unmapped."""
    regions = (
        b.table(spark, sf_dir, "nation")
        .join(b.table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .select("n_nationkey", "n_name", F.when(~F.col("n_nationkey").isin(3, 17), F.col("r_name")).alias("r_name"))
    )
    supplied = b.table(spark, sf_dir, "supplier").join(
        regions, F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col("s_name").alias("owner"), F.col("r_name").alias("_owner_region"))
    ordered = (
        b.table(spark, sf_dir, "customer")
        .join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("country"), F.col("r_name").alias("_record_region"))
        .join(b.table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "country", "_record_region")
    )
    lines = (
        b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        .join(supplied, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    )
    return emit(lines, "lines", routing_rules("lines"), "line").select(
        "record_id", "meta.owner", "meta.owner_region", "meta.record_country", "meta.record_region"
    )


@register
def stale_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "stale_deals").select(
        "record_id", "message", "meta.days_inactive", "meta.threshold_days", "meta.amount"
    )


@register
def past_close_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "past_close_date").select(
        "record_id", "message", "meta.days_overdue", "meta.amount"
    )


@register
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding, priced, with its position in the report."""
    return with_positions(_priced(spark, sf_dir))


@register
def selected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High findings on contacts and deals from two checks."""
    return flatten(filter_findings(
        _findings(spark, sf_dir), [CONTACTS, DEALS], ["High"], ["email_deliverability", "stale_deals"]
    ))


@register
def subset_with_custom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built-in check next to one of the user's own, priced with the fallback."""
    def huge_deals(tables: CrmTables, config) -> DataFrame:
        return emit(tables.deals, DEALS, [Rule(
            "huge_deals", LOW, "amount", F.coalesce(F.col("amount") > 400_000, F.lit(False)),
            F.lit("Amount needs a second look."),
        )])

    findings = run_checks(
        b.crm(spark, sf_dir), b.policy(), ["missing_fields_deals", "huge_deals"], {"huge_deals": huge_deals}
    )
    return flatten(scoring.price_findings(findings)).select(
        "check_id", "record_id", "severity", "field", "revenue_impact_usd"
    )


# --- scoring -----------------------------------------------------------------

@register
def record_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.record_penalties(_findings(spark, sf_dir))


@register
def deal_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of neglect, risk factor and exposure of each stale or overdue deal."""
    priced = scoring.price_findings(_deal_findings(spark, sf_dir))
    days = scoring.neglect_days()
    return of_checks(priced, "stale_deals", "past_close_date").select(
        "record_id", "check_id", days.alias("days"),
        scoring.risk_factor(days, scoring.CostAssumptions().risk_bands).alias("factor"),
        F.col("meta.amount").alias("amount"), "at_risk_usd",
    )


@register
def deal_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The money of the deals table: work, exposure and open value."""
    tables = b.crm(spark, sf_dir)
    findings = run_checks(
        tables, b.policy(), ["missing_fields_deals", "stale_deals", "past_close_date"]
    )
    return scoring.cost_of_findings(findings, tables.deals)


@register
def exposure_of_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure per record id when a third of the ids is blank and the others repeat."""
    tables = b.crm(spark, sf_dir)
    number = F.col("record_id").cast("long")
    deals = tables.deals.withColumn("record_id", F.when(number % 3 == 0, "").otherwise((number % 100).cast("string")))
    renamed = CrmTables(tables.contacts, tables.companies, deals, tables.as_of)
    priced = scoring.price_findings(run_checks(renamed, b.policy(), ["stale_deals", "past_close_date"]))
    return priced.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("findings"), (F.count_if(F.col("at_risk_usd") > 0) == 1).alias("is_exposed"),
        F.sum("at_risk_usd").alias("at_risk_usd"),
    )


@register
def open_deal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.open_deal_value(b.deals(spark, sf_dir)).select(
        F.round("open_usd", 2).alias("open_usd")
    )


@register
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = b.crm(spark, sf_dir)
    return scoring.cost_of_findings(run_checks(tables, b.policy()), tables.deals)


@register
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = b.crm(spark, sf_dir)
    return scoring.health_score(
        scoring.score_totals(run_checks(tables, b.policy()), tables.counts())
    )


@register
def severity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_counts(_findings(spark, sf_dir)).withColumn(
        "severity_rank", severity_rank(F.col("severity"))
    )


@register
def score_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = b.crm(spark, sf_dir)
    findings = run_checks(tables, b.policy())
    return scoring.score_gains(scoring.score_totals(findings, tables.counts(), list(CHECK_NAMES)))


@register
def punch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir)["items"]


@register
def start_here(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most valuable remediation item."""
    return scoring.top_item(punch_list(spark, sf_dir))


@register
def report_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = _numbers(spark, sf_dir)
    return headline_columns(numbers["score"], numbers["cost"], numbers["severities"])


@register
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, written as nested JSON and read back."""
    report = build_report(b.crm(spark, sf_dir), b.policy())
    path = staging_path(spark, "summary")
    report.write_summary(path)
    return spark.read.schema(report.summary().schema).json(path).select(
        "headline", "score.overall", "score.grade", "score.clean_records", "score.affected_records",
        *[F.col(f"score.by_object.{o}").alias(f"{o}_score") for o in OBJECT_TYPES],
        *[F.col(f"record_counts.{o}").alias(f"{o}_records") for o in OBJECT_TYPES],
        "cost.remediation_hours", "cost.direct_cost_usd", "cost.at_risk_pipeline_usd", "findings_total",
        *[F.col(f"findings_by_severity.{s}").alias(f"{s.lower()}_findings") for s in ("High", "Medium", "Low")],
        F.col("checks_run").cast("long").alias("checks_run"),
        F.size("punch_list").cast("long").alias("items"), F.col("punch_list")[0]["priority_check"].alias("first_item"),
    )


@register
def findings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priced finding with its position, written as ordered CSV and read back."""
    report = build_report(b.crm(spark, sf_dir), b.policy())
    path = staging_path(spark, "findings_file")
    report.write_findings(path, positions=True)
    schema = f"position long, {', '.join(f'{n} {t}' for n, t in flatten(report.findings).dtypes)}"
    found = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return found.fillna("", ["field", "related_record_ids"])


@register
def correction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every correction table that has rows, written as CSV; the rows are counted in the files."""
    tables = b.crm(spark, sf_dir)
    priced = scoring.price_findings(run_checks(tables, b.policy()))
    path = staging_path(spark, "corrections")
    listed = write_corrections(tables, priced, path).select("position", "filename", "kind", "object_type", "rows")
    files = [r.filename for r in listed.select("filename").collect()]  # at most ten
    written = union_all([
        spark.read.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        .agg(F.count(F.lit(1)).alias("rows_written")).select(F.lit(name).alias("filename"), "rows_written")
        for name in files
    ])
    return listed.join(written, "filename")


@register
def correction_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every correction file but amounts, as read back from the files."""
    tables = b.crm(spark, sf_dir)
    path = staging_path(spark, "corrections")
    listed = write_corrections(tables, scoring.price_findings(run_checks(tables, b.policy())), path)
    parts = []
    for r in listed.select("filename").collect():  # at most ten
        file = spark.read.option("header", True).option("escape", '"').csv(f"{path}/{r.filename}")
        cells = [F.coalesce(f"`{c}`", F.lit("")) for c in file.columns if c not in ("Amount", "At Risk (USD)")]
        parts.append(file.select(F.lit(r.filename).alias("filename"), F.concat_ws("|", *cells).alias("cells")))
    return union_all(parts)


# --- owners and filters ------------------------------------------------------

@register
def owner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = b.crm(spark, sf_dir)
    return owners.distinct_owners([tables.frame(o) for o in OBJECT_TYPES])


@register
def routing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners.routing_coverage(owner_names(spark, sf_dir), b.OWNER_REGIONS)


@register
def finding_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(_findings(spark, sf_dir))


# --- correction tables -------------------------------------------------------

@register
def fix_email_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = b.crm(spark, sf_dir)
    return corrections.email_normalization(tables.contacts, run_checks(tables, b.policy()))


@register
def fix_email_case_and_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = b.crm(spark, sf_dir)
    return corrections.email_normalization(tables.contacts, run_checks(tables, b.policy()), repair_padding=True)


@register
def fix_contact_countries_and_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.country_standardization(b.contacts(spark, sf_dir), CONTACTS, repair_padding=True)


@register
def fix_email_typos_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.email_typo_suggestions(_findings(spark, sf_dir), ignore_case=True)


@register
def fix_contact_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.country_standardization(b.contacts(spark, sf_dir), CONTACTS)


@register
def fix_company_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.country_standardization(b.companies(spark, sf_dir), COMPANIES)


@register
def fix_email_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.email_typo_suggestions(_findings(spark, sf_dir))


@register
def fix_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.merge_worklist(_findings(spark, sf_dir))


@register
def fix_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.routing_worklist(_findings(spark, sf_dir))


@register
def fix_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.deal_worklist(scoring.price_findings(_findings(spark, sf_dir, *corrections.DEAL_CHECKS)))


@register
def fix_contact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.missing_fields_template(_findings(spark, sf_dir), CONTACTS)


@register
def fix_company_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.missing_fields_template(_findings(spark, sf_dir), COMPANIES)


@register
def fix_deal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.missing_fields_template(_findings(spark, sf_dir), DEALS)


@register
def fix_table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every correction table, the base of the manifest."""
    policy = b.policy()
    seen = {o: [f.column for f in policy.required_fields[o]] for o in OBJECT_TYPES}
    tables = b.crm(spark, sf_dir)
    priced = scoring.price_findings(run_checks(tables, policy))
    return row_counts(candidate_tables(tables, priced, seen))


@register
def deal_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir, "missing_fields_deals").select("record_id", "field")
    return corrections.with_deal_names(found, b.deals(spark, sf_dir))
