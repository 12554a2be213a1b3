import pytest

from recordwarden import AuditConfig, RequiredField, make_config, months_to_days, run_checks
from recordwarden.model import CONTACTS, DEALS, HIGH, LOW
from recordwarden.operators.findings import Rule, emit, facets, filter_findings, flatten, severity_counts
from recordwarden.operators.owners import distinct_owners, routing_coverage
from pyspark.sql import functions as F

from .helpers import REGIONS, company, contact, crm, day, deal


def flagged(spark, check, config=None, **tables):
    found = run_checks(crm(spark, **tables), config or make_config(owner_regions=REGIONS), [check])
    return {r.record_id: r for r in found.collect()}


def test_missing_fields(spark):
    rows = [contact(1), contact(2, Email=" "), contact(3, Contact_owner=None, **{"Country/Region": ""})]
    found = run_checks(crm(spark, contacts=rows), AuditConfig(), ["missing_fields_contacts"]).collect()
    assert {(r.record_id, r.field, r.severity) for r in found} == {
        ("2", "email", "High"), ("3", "owner", "High"), ("3", "country", "Medium"),
    }
    assert all(r.meta.required_field == r.field and r.meta.policy_reason in r.message for r in found)


def test_unreadable_amounts_and_dates_are_missing(spark):
    rows = [deal(1, Amount="1,000"), deal(2, Close_Date="later"), deal(3)]
    found = run_checks(crm(spark, deals=rows), AuditConfig(), ["missing_fields_deals"]).collect()
    assert {(r.record_id, r.field) for r in found} == {("1", "amount"), ("2", "close_date")}


def test_policy_is_data(spark):
    config = AuditConfig(required_fields={CONTACTS: [
        RequiredField("job_title", LOW, "it's useful"), RequiredField("shoe_size", HIGH, "unknown column"),
    ]})
    (found,) = flagged(spark, "missing_fields_contacts", config, contacts=[contact(1)]).values()
    assert (found.severity, found.field, found.message) == ("Low", "job_title", "Contact has no Job Title: it's useful.")


def test_decay_threshold_is_exclusive(spark):
    rows = [contact(1, Last_Activity_Date=day(183)), contact(2, Last_Activity_Date=day(184)),
            contact(3, Last_Activity_Date=None), contact(4, Last_Activity_Date=day(-10))]
    found = flagged(spark, "decayed_contacts", contacts=rows)
    assert set(found) == {"2"}
    assert found["2"].meta.days_inactive == 184 and "about 6 months" in found["2"].message


@pytest.mark.parametrize("email,expected", [
    ("kim@firm.com", None), ("kim@firm.co", None), ("kim@firm.de", None), (None, None), ("  ", None),
    ("kim.firm.com", ("invalid_syntax", "High", None)), ("kim@firm", ("invalid_syntax", "High", None)),
    ("kim@firm.cim", ("suspicious_tld", "High", "com")), ("kim@firm.online", ("suspicious_tld", "High", None)),
    ("info@firm.cim", ("suspicious_tld", "High", "com")), ("Sales@firm.com", ("role_based", "Medium", None)),
    ("no-reply@firm.io", ("role_based", "Medium", None)),
])
def test_deliverability(spark, email, expected):
    found = flagged(spark, "email_deliverability", contacts=[contact(1, Email=email)])
    got = [(r.meta.reason, r.severity, r.meta.likely_tld) for r in found.values()]
    assert got == ([] if expected is None else [expected])


def test_routing(spark):
    rows = [
        contact(1, Contact_owner="nora  LIND", **{"Country/Region": "U.K."}),
        contact(2, Contact_owner="Nora Lind", **{"Country/Region": "usa"}),
        contact(3, Contact_owner="Somebody Else"),
        contact(4, Contact_owner="Raj Patel", **{"Country/Region": "Russia"}),
        contact(5, Contact_owner=None), contact(6, **{"Country/Region": None}),
    ]
    found = flagged(spark, "routing_contacts", contacts=rows)
    assert set(found) == {"2"}
    assert (found["2"].meta.owner_region, found["2"].meta.record_region) == ("EMEA", "North America")
    companies = [company(1, Company_owner="Raj Patel"), company(2)]
    assert set(flagged(spark, "routing_companies", companies=companies)) == {"1"}


def test_routing_is_off_without_owners(spark):
    rows = [contact(1, Contact_owner="Raj Patel")]
    assert not flagged(spark, "routing_contacts", make_config(), contacts=rows)
    assert not flagged(spark, "routing_contacts", make_config(owner_regions=REGIONS, territory_routing=False), contacts=rows)
    assert not make_config(owner_regions={"A": "", "": "EMEA"}).routing_enabled


def test_deals(spark):
    rows = [
        deal(1, Last_Activity_Date=day(30)), deal(2, Last_Activity_Date=day(31)),
        deal(3, Last_Activity_Date=day(99), Deal_Stage="Closed Won"),
        deal(4, Last_Activity_Date=day(40), Deal_Stage=None, Amount=None), deal(5, Last_Activity_Date=None),
    ]
    found = flagged(spark, "stale_deals", deals=rows)
    assert set(found) == {"2", "4"}
    assert "worth $1,000" in found["2"].message and "worth" not in found["4"].message
    rows = [deal(1, Close_Date=day(0)), deal(2, Close_Date=day(1)), deal(3, Close_Date=day(9), Deal_Stage="closedlost"),
            deal(4, Close_Date=None)]
    found = flagged(spark, "past_close_date", deals=rows)
    assert set(found) == {"2"} and found["2"].meta.days_overdue == 1


def test_custom_and_selected_checks(spark):
    tables = crm(spark, contacts=[contact(1, Email=None)], deals=[deal(1, Amount="5")])

    def tiny(data, config):
        return emit(data.deals, DEALS, [Rule("tiny_deals", LOW, "amount", F.col("amount") < 10, F.lit("Tiny."))])

    everything = run_checks(tables, AuditConfig(), custom_checks={"tiny_deals": tiny})
    assert {r.check_id for r in everything.collect()} == {"missing_fields_contacts", "tiny_deals"}
    only = run_checks(tables, AuditConfig(), ["tiny_deals"], {"tiny_deals": tiny})
    assert [r.check_id for r in only.collect()] == ["tiny_deals"]
    assert run_checks(tables, AuditConfig(), []).count() == 0
    with pytest.raises(ValueError, match="unknown checks"):
        run_checks(tables, AuditConfig(), ["nonsense"])


def test_filters_facets_and_flat_columns(spark):
    found = run_checks(crm(
        spark, contacts=[contact(1, Email=None), contact(2, **{"Country/Region": None})], deals=[deal(1, Amount=None)],
    ), AuditConfig())
    assert filter_findings(found).count() == 3
    assert filter_findings(found, [CONTACTS], ["High"]).count() == 1
    assert filter_findings(found, [DEALS, CONTACTS], [], ["missing_fields_deals"]).count() == 1
    assert {(r.facet, r.value, r.findings) for r in facets(found).collect()} >= {
        ("object_type", CONTACTS, 2), ("severity", "High", 2), ("check_id", "missing_fields_deals", 1),
    }
    shares = {r.severity: (r.findings, r.share) for r in severity_counts(found).collect()}
    assert shares == {"High": (2, 2 / 3), "Medium": (1, 1 / 3)}
    assert flatten(found).columns == [
        "check_id", "object_type", "record_id", "severity", "severity_rank", "message", "field",
        "revenue_impact_usd", "related_record_ids", "at_risk_usd",
    ]


def test_owner_coverage(spark):
    tables = crm(spark, contacts=[contact(1), contact(2, Contact_owner=" Zoe Hart ")],
                 companies=[company(1, Company_owner="New Hire")], deals=[deal(1, Deal_owner=None)])
    names = distinct_owners([tables.contacts, tables.companies, tables.deals])
    assert [r.owner for r in names.collect()] == ["New Hire", "Zoe Hart"]
    assert routing_coverage(names, REGIONS).first().asDict() == {
        "owners_found": 2, "owners_assigned": 1, "owners_unassigned": 1, "routing_active": True,
    }
    assert routing_coverage(names, {}).first().routing_active is False


def test_settings():
    assert months_to_days(6) == 183 and months_to_days(12) == 365
    config = make_config(stale_deal_days=10, decayed_contact_days=90)
    assert (config.stale_deal_days, config.decayed_contact_days, config.owner_regions) == (10, 90, {})
    with pytest.raises(ValueError):
        make_config(stale_deal_days=-1)


def test_all_tables_empty(spark):
    assert run_checks(crm(spark), make_config(owner_regions=REGIONS)).count() == 0
