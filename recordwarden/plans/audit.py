"""All checks over the three tables as one findings DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..config import AuditConfig
from ..model import COMPANIES, CONTACTS, DEALS, FINDINGS_SCHEMA, CrmTables, empty_findings, union_all
from ..operators.duplicates import duplicate_companies, duplicate_contacts
from ..operators.findings import Rule, emit
from ..operators.row_checks import (
    deliverability_rules, inactivity_rules, missing_field_rules, past_close_rules, routing_rules,
    stale_deal_rules, with_ages, with_deal_state, with_email_diagnosis, with_regions,
)

# Check ids in running order with their display names.
CHECK_NAMES = {
    "duplicate_contacts": "Duplicate Contacts",
    "duplicate_companies": "Duplicate Companies",
    "missing_fields_contacts": "Missing Required Fields — Contact",
    "missing_fields_companies": "Missing Required Fields — Company",
    "missing_fields_deals": "Missing Required Fields — Deal",
    "decayed_contacts": "Decayed Contacts",
    "email_deliverability": "Email Deliverability Risk",
    "routing_contacts": "Territory Routing — Contact",
    "routing_companies": "Territory Routing — Company",
    "stale_deals": "Stale Deals",
    "past_close_date": "Deals Past Close Date",
}

# A check of the user's own: (tables, policy) -> findings with FINDINGS_SCHEMA.
CustomCheck = Callable[[CrmTables, AuditConfig], DataFrame]


def contact_findings(tables: CrmTables, config: AuditConfig, checks: Sequence[str]) -> DataFrame | None:
    wanted = {"missing_fields_contacts", "decayed_contacts", "email_deliverability"} & set(checks)
    routed = "routing_contacts" in checks and config.routing_enabled
    if not wanted and not routed:
        return None
    df, rules = tables.contacts, []
    if "missing_fields_contacts" in wanted:
        rules += missing_field_rules(df, CONTACTS, config.required_fields.get(CONTACTS, ()))
    if "decayed_contacts" in wanted:
        df = with_ages(df, tables.as_of, _days_idle="last_activity_date")
        rules += inactivity_rules("_days_idle", config.decayed_contact_days)
    if "email_deliverability" in wanted:
        df = with_email_diagnosis(df, "email", config.role_mailboxes)
        rules += deliverability_rules()
    if routed:
        df = with_regions(df, config)
        rules += routing_rules(CONTACTS)
    return _emitted(df, CONTACTS, rules)


def company_findings(tables: CrmTables, config: AuditConfig, checks: Sequence[str]) -> DataFrame | None:
    routed = "routing_companies" in checks and config.routing_enabled
    if "missing_fields_companies" not in checks and not routed:
        return None
    df, rules = tables.companies, []
    if "missing_fields_companies" in checks:
        rules += missing_field_rules(df, COMPANIES, config.required_fields.get(COMPANIES, ()))
    if routed:
        df = with_regions(df, config)
        rules += routing_rules(COMPANIES)
    return _emitted(df, COMPANIES, rules)


def deal_findings(tables: CrmTables, config: AuditConfig, checks: Sequence[str]) -> DataFrame | None:
    wanted = {"missing_fields_deals", "stale_deals", "past_close_date"} & set(checks)
    if not wanted:
        return None
    df, rules = tables.deals, []
    if "missing_fields_deals" in wanted:
        rules += missing_field_rules(df, DEALS, config.required_fields.get(DEALS, ()))
    if wanted != {"missing_fields_deals"}:
        df = with_deal_state(df, tables.as_of)
    if "stale_deals" in wanted:
        rules += stale_deal_rules(config.stale_deal_days)
    if "past_close_date" in wanted:
        rules += past_close_rules()
    return _emitted(df, DEALS, rules)


def _emitted(df: DataFrame, object_type: str, rules: list[Rule]) -> DataFrame | None:
    return emit(df, object_type, rules) if rules else None


def run_checks(
    tables: CrmTables,
    config: AuditConfig,
    checks: Sequence[str] | None = None,
    custom_checks: Mapping[str, CustomCheck] | None = None,
) -> DataFrame:
    """Findings of the selected checks, unsorted; `report_order()` sorts them for output.

    All row checks of a table share one scan. Only duplicates need a shuffle.
    """
    selected = list(CHECK_NAMES) if checks is None else list(checks)
    custom = dict(custom_checks or {})
    unknown = set(selected) - set(CHECK_NAMES) - set(custom)
    if unknown:
        raise ValueError(f"unknown checks: {sorted(unknown)}")

    parts = [
        contact_findings(tables, config, selected),
        company_findings(tables, config, selected),
        deal_findings(tables, config, selected),
    ]
    if "duplicate_contacts" in selected:
        parts.append(duplicate_contacts(tables.contacts))
    if "duplicate_companies" in selected:
        parts.append(duplicate_companies(tables.companies))
    for check_id, check in custom.items():
        if checks is None or check_id in selected:
            parts.append(check(tables, config).select(*FINDINGS_SCHEMA.fieldNames()))
    found = [p for p in parts if p is not None]
    return union_all(found) if found else empty_findings(SparkSession.active())
