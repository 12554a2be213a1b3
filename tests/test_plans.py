"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry_points
from recordwarden.catalog import bindings
from recordwarden.plans.report import narrow_numbers
from recordwarden.plans.audit import (
    CHECK_NAMES, company_findings, contact_findings, deal_findings, run_checks,
)

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", [contact_findings, company_findings, deal_findings])
def test_generated_methods_are_small_enough_to_be_compiled(spark, part):
    """The JVM only interprets methods beyond 8000 bytes."""
    found = part(bindings.crm(spark, SF_DIR), bindings.policy(), list(CHECK_NAMES))
    code = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    assert all(int(size) < 8000 for size in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_row_checks_of_a_table_share_one_scan(spark):
    checks = ["missing_fields_companies", "routing_companies"]
    text = plan(run_checks(bindings.crm(spark, SF_DIR), bindings.policy(), checks))
    assert text.count("FileScan") == 1 and text.count("Generate explode") == 1 and "Exchange hash" not in text


def test_selecting_a_check_prunes_the_other_scans(spark):
    found = run_checks(bindings.crm(spark, SF_DIR), bindings.policy())
    text = plan(found.where("object_type = 'companies' AND check_id = 'missing_fields_companies'"))
    assert "pages" in text and "customer" not in text and "lineitem" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(entry_points.queries()["duplicate_companies"](spark, SF_DIR))
    assert "url" in text and "html" not in text
    assert "l_shipdate" not in plan(entry_points.queries()["stale_deals"](spark, SF_DIR))


def test_members_are_shuffled_once_for_both_uses(spark):
    df = entry_points.queries()["duplicate_contacts"](spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_number_queries_scan_each_source_once(spark):
    """The checks run once; all numbers come from the narrow rows they wrote."""
    numbers = narrow_numbers(bindings.crm(spark, SF_DIR), bindings.policy())
    assert all("finding_numbers" in file for file in numbers["severities"].inputFiles())
    assert "Generate explode" not in plan(numbers["items"]) and "Window" not in plan(numbers["items"])


def test_ordered_findings_have_no_window_over_findings(spark):
    df = entry_points.queries()["all_findings"](spark, SF_DIR)
    for window in re.findall(r"Window \[.*", plan(df)):
        assert "_n" in window and "message" not in window
    written = spark.read.parquet(*df.inputFiles()).columns
    assert "message" in written and "meta" not in written  # details are not sorted


def test_templates_read_what_was_written(spark):
    found = entry_points.queries()["fix_contact_fields"](spark, SF_DIR)
    assert all("missing_fields" in file for file in found.inputFiles())
