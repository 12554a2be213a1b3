import json
import re
from collections import Counter

import pytest

from recordwarden import CHECK_NAMES, build_corrections, build_report, load_crm, make_config, write_corrections
from recordwarden.operators import findings
from recordwarden.operators.corrections import with_deal_names
from recordwarden.operators.findings import filter_findings, of_checks
from recordwarden.plans import correction_bundle

from .helpers import AS_OF, REGIONS, company, contact, crm, day, deal

CONFIG = dict(owner_regions=REGIONS)


def planted(spark):
    """Clean records with a known set of problems."""
    contacts = [contact(i) for i in range(1, 41)]
    contacts += [contact(100, Email=" PERSON1@firm.com"), contact(101, Email="Person2@Firm.COM")]
    contacts += [contact(110, Email=None), contact(111, Contact_owner=None), contact(112, Lifecycle_Stage=None),
                 contact(113, **{"Country/Region": None})]
    contacts += [contact(120, Last_Activity_Date=day(400))]
    contacts += [contact(130, Email="info@firm.com"), contact(131, Email="kim@firm.cim"), contact(132, Email="kim.firm"),
                 contact(133, Email="kim@FIRM.CMO")]
    contacts += [contact(140, Contact_owner="Raj Patel")]
    contacts += [contact(150, Email="Mixed.Case@firm.com"), contact(151, Email="  padded@firm.com"),
                 contact(152, **{"Country/Region": "canada"})]
    companies = [company(i) for i in range(1, 11)]
    companies += [company(20, Company_Domain_Name="www.firm1.com"), company(21, Company_name="FIRM 2, Inc.")]
    companies += [company(22, Industry=None), company(23, **{"Country/Region": "U.S.A."})]
    deals = [deal(i) for i in range(1, 11)]
    deals += [deal(20, Last_Activity_Date=day(95), Amount="48000"), deal(21, Close_Date=day(60), Amount="12000"),
              deal(22, Last_Activity_Date=day(70), Close_Date=day(95), Amount="5000"), deal(23, Amount=None)]
    return crm(spark, contacts, companies, deals)


EXPECTED = {
    "duplicate_contacts": {"100", "101"},
    "duplicate_companies": {"20", "21"},
    "missing_fields_contacts": {"110", "111", "112", "113"},
    "missing_fields_companies": {"22"},
    "missing_fields_deals": {"23"},
    "decayed_contacts": {"120"},
    "email_deliverability": {"130", "131", "132", "133"},
    "routing_contacts": {"140"},
    "stale_deals": {"20", "22"},
    "past_close_date": {"21", "22"},
}


@pytest.fixture(scope="module")
def tables(spark):
    return planted(spark)


@pytest.fixture(scope="module")
def report(tables):
    return build_report(tables, make_config(**CONFIG))


def test_exactly_the_planted_problems(report):
    found = {}
    for r in report.findings.collect():
        found.setdefault(r.check_id, set()).add(r.record_id)
    assert found == EXPECTED


def test_parts_agree(report, tables):
    items = report.items.collect()
    cost = report.cost.first()
    assert {i.priority_check for i in items} == set(EXPECTED)
    assert sum(i.records for i in items) == report.findings.count() == sum(r.findings for r in report.severities.collect())
    assert sum(i.cost_usd for i in items) == cost.direct_cost_usd
    assert sum(i.at_risk_usd for i in items) == cost.at_risk_pipeline_usd == 36000.0 + 6000.0 + 3750.0
    assert cost.at_risk_pipeline_usd <= cost.total_open_pipeline_usd
    assert all(i.score_gain >= 0 for i in items)
    values = [i.at_risk_usd + i.cost_usd for i in items]
    assert values == sorted(values, reverse=True) and items[0].priority_check == "stale_deals"
    assert report.start_here().collect() == items[:1]
    assert {r.object_type: r.total for r in report.counts.collect()} == {"contacts": 55, "companies": 14, "deals": 14}


def test_findings_are_sorted(report):
    rows = [(-r.severity_rank, r.check_id, r.record_id) for r in report.findings_table().collect()]
    assert rows == sorted(rows)


def test_summary_is_json(report, tmp_path):
    report.write_summary(str(tmp_path / "summary"))
    (part,) = (tmp_path / "summary").glob("*.json")
    summary = json.loads(part.read_text())
    score = {r.object_type: r.score for r in report.score.collect()}
    assert summary["score"]["overall"] == score["overall"] and summary["score"]["by_object"]["deals"] == score["deals"]
    assert summary["record_counts"] == {"contacts": 55, "companies": 14, "deals": 14}
    assert [i["priority_check"] for i in summary["punch_list"]] == [i.priority_check for i in report.items.collect()]
    assert summary["checks_run"] == len(CHECK_NAMES) == 11
    assert summary["as_of"] == AS_OF.isoformat()
    assert summary["assumptions"]["forecast_risk_bands"][0] == [90.0, 0.75]
    assert summary["findings_total"] == 20
    assert re.match(r"Grade [A-F] with \d+ points: 19 of 83 records need work \(20 findings\)", summary["headline"])


def test_findings_as_csv(report, tmp_path):
    chosen = filter_findings(report.findings, ["contacts"], ["High"])
    report.write_findings(str(tmp_path / "f"), chosen)
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("*.csv")))
    assert text.count("\n") >= chosen.count() + 1 and "companies" not in text


def corrections(tables, report):
    return {t.filename: (t, [r.asDict() for r in t.frame.collect()]) for t, _ in build_corrections(tables, report.findings)}


def test_correction_tables(tables, report):
    built = corrections(tables, report)
    rows = {name: r for name, (_, r) in built.items()}
    for name, (table, found) in built.items():
        assert found and table.kind in ("import", "review", "worklist") and table.instructions
        if table.kind == "import":
            assert len(table.frame.columns) == 2 and table.frame.columns[0] == "Record ID"
    emails = {r["Record ID"]: r["Email"] for r in rows["import_contacts_email_normalized.csv"]}
    # Duplicates wait for their merge; padding alone is not a change.
    assert emails == {"150": "mixed.case@firm.com", "133": "kim@firm.cmo"}
    assert rows["import_contacts_country_standardized.csv"] == [{"Record ID": "152", "Country/Region": "Canada"}]
    assert rows["import_companies_country_standardized.csv"] == [{"Record ID": "23", "Country/Region": "United States"}]
    typos = {r["Record ID"]: (r["Current Email"], r["Suggested Email"]) for r in rows["review_email_typos.csv"]}
    assert typos == {"131": ("kim@firm.cim", "kim@firm.com"), "133": ("kim@FIRM.CMO", "")}
    assert all(r["Confirmed? (yes/no)"] == "" for r in rows["review_email_typos.csv"])
    assert "NOT ready to import" in built["review_email_typos.csv"][0].instructions
    merges = {(r["Object"], r["Merge This Record ID"], r["Into This Record ID"]) for r in rows["worklist_merge_duplicates.csv"]}
    assert merges == {("Contacts", "100", "1"), ("Contacts", "101", "2"), ("Companies", "20", "1"), ("Companies", "21", "2")}
    assert "Do NOT import" in built["worklist_merge_duplicates.csv"][0].instructions
    (move,) = rows["worklist_reassign_owners.csv"]
    assert move["Owner Covers"] == "APAC" and move["Should Be Owned In"] == "North America" and move["New Owner (fill in)"] == ""
    review = {(r["Record ID"], r["Issue"]): (r["Deal Name"], r["Days"], r["At Risk (USD)"]) for r in rows["worklist_pipeline_review.csv"]}
    assert review == {
        ("20", "Stale"): ("Deal 20", 95, 36000.0), ("21", "Past close date"): ("Deal 21", 60, 6000.0),
        ("22", "Stale"): ("Deal 22", 70, 0.0), ("22", "Past close date"): ("Deal 22", 95, 3750.0),
    }
    template = rows["template_contacts_missing_fields.csv"]
    assert len(template) == 4 and list(template[0]) == ["Record ID", "Country/Region", "Email", "Lifecycle Stage", "Contact owner"]
    assert next(r for r in template if r["Record ID"] == "110") == {
        "Record ID": "110", "Country/Region": "n/a", "Email": "", "Lifecycle Stage": "n/a", "Contact owner": "n/a"}
    assert rows["template_companies_missing_fields.csv"] == [{"Record ID": "22", "Industry": ""}]
    assert "DELETE every cell still reading 'n/a'" in built["template_deals_missing_fields.csv"][0].instructions


def test_written_bundle(tables, report, tmp_path):
    listing = write_corrections(tables, report.findings, str(tmp_path / "out")).collect()
    names = [r.filename for r in listing]
    assert names[0] == "worklist_pipeline_review.csv" and len(names) == 10
    for row in listing:
        text = "".join(p.read_text() for p in (tmp_path / "out" / row.filename).glob("*.csv"))
        assert len(text.splitlines()) >= row.rows + 1
        assert "backup" in row.before_importing.lower() and "cannot be undone" in row.before_importing.lower()


def test_a_bundle_stages_only_what_its_tables_show(tables, report, tmp_path, monkeypatch):
    kept, staged = [], correction_bundle.staged
    monkeypatch.setattr(correction_bundle, "staged", lambda df, name: kept.append(df.columns) or staged(df, name))
    write_corrections(tables, report.findings, str(tmp_path / "out"))
    assert kept == [["check_id", "object_type", "record_id", "field", "meta", "at_risk_usd"]]


def test_sorted_findings_are_priced_once(report):
    """The sort reads its rows twice, so the table it sorts is a written one without any join."""
    sorted_rows = []
    numbered = findings.numbered
    findings.numbered = lambda df, *more: sorted_rows.append(df) or numbered(df, *more)
    try:
        table = report.findings_table()
    finally:
        findings.numbered = numbered
    assert "Join" not in sorted_rows[0]._jdf.queryExecution().executedPlan().toString()
    assert table.count() == report.findings.count()


def test_deal_names_for_findings_without_one(tables, report):
    found = with_deal_names(of_checks(report.findings, "missing_fields_deals"), tables.deals).collect()
    assert [(r.record_id, r.deal_name) for r in found] == [("23", "Deal 23")]


def test_clean_tables(spark):
    clean = crm(spark, [contact(1)], [company(1)], [deal(1)])
    report = build_report(clean, make_config(**CONFIG))
    assert report.findings.count() == 0 and report.items.count() == 0
    assert build_corrections(clean, report.findings) == []
    assert report.score.where("object_type = 'overall'").first().score == 100.0
    assert "at_risk_usd" in report.findings_table().columns


def test_any_subset_of_exports(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text("Record ID,Email,Contact owner,Lifecycle Stage,Country/Region\n1,a@b.co,Zoe Hart,lead,Canada\n2,,Zoe Hart,lead,Canada\n")
    some = build_report(load_crm(spark, contacts=str(path), as_of="2026-07-25"), make_config(**CONFIG))
    assert Counter(r.check_id for r in some.findings.collect()) == {"missing_fields_contacts": 1}
    assert some.headline().first().total_records == 2
    nothing = build_report(load_crm(spark, as_of="2026-07-25"), make_config(**CONFIG), stage=False)
    summary = nothing.summary().first()
    assert (summary.score.overall, summary.cost.direct_cost_usd, summary.findings_total, summary.punch_list) == (100.0, 0.0, 0, [])


def test_tighter_thresholds_never_find_less(tables):
    from recordwarden import run_checks
    sizes = [run_checks(tables, make_config(stale_deal_days=d, decayed_contact_days=d * 6), ["stale_deals", "decayed_contacts"]).count()
             for d in (5, 30, 80)]
    assert sizes == sorted(sizes, reverse=True)


def test_routing_switch_removes_only_routing(tables):
    from recordwarden import run_checks
    on = {(r.check_id, r.record_id) for r in run_checks(tables, make_config(**CONFIG)).collect()}
    off = {(r.check_id, r.record_id) for r in run_checks(tables, make_config(territory_routing=False, **CONFIG)).collect()}
    assert on - off == {("routing_contacts", "140")} and off <= on
