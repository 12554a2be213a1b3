"""Column expressions against plain Python, value by value."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordwarden.functions import text, values
from recordwarden.sources.atlas import canonical_countries, country_regions, owner_regions_by_key


def apply(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, pairs, expression, kind="string"):
    got = apply(spark, [p[0] for p in pairs], expression, kind)
    assert got == [p[1] for p in pairs]


def test_strip_matches_python_on_all_blanks(spark):
    samples = [f"{c} a{c}b {c}" for c in text.WHITESPACE] + ["", " ", "x", None]
    check(spark, [(s, None if s is None else s.strip()) for s in samples], text.strip)


def test_clean_id(spark):
    check(spark, [
        ("12.0", "12"), (" 7 ", "7"), (None, ""), ("  ", ""), ("1.0.0", "1.0"), ("a.0 ", "a"), (".0", ""),
    ], text.clean_id)


def test_email_parts(spark):
    addresses = [" KIM@X.COM ", "a@b@c.de", "@x.com", "x@", "plain", "", None, "a@b", "a@x.", "Ä@x.de"]

    def python(v):
        e = (v or "").strip().lower() or None
        if not e or "@" not in e:
            return e, None, None, None
        local, _, domain = e.partition("@")
        if not local or not domain:
            return e, None, None, None
        return e, local, domain, domain.rpartition(".")[2] or None

    key = text.email_key
    got = list(zip(
        apply(spark, addresses, key),
        apply(spark, addresses, lambda c: text.email_local(key(c))),
        apply(spark, addresses, lambda c: text.email_domain(key(c))),
        apply(spark, addresses, lambda c: text.email_tld(key(c))),
    ))
    assert got == [python(a) for a in addresses]


def test_email_syntax(spark):
    check(spark, [
        ("a@b.co", True), ("a@b", False), ("a b@c.de", False), ("a@@b.com", False), ("a@b.c.", False),
        ("a@b..com", True), ("a　b@c.de", False), (None, False), ("a@.com", False),
    ], lambda c: text.email_is_valid(text.email_key(c)))


def test_every_blank_breaks_an_address_and_joins_a_name(spark):
    check(spark, [(f"a{c}b@x.com", False) for c in text.WHITESPACE], text.email_is_valid)
    check(spark, [(f"a@x{c}.com", False) for c in text.WHITESPACE], text.email_is_valid)
    check(spark, [(f"{c}Al{c}{c}Bo{c}", "al bo") for c in text.WHITESPACE], text.person_key)


def test_suspicious_endings(spark):
    check(spark, [
        ("co", False), ("io", False), ("de", False), ("cim", True), ("online", True), (None, False),
    ], text.tld_is_suspicious)
    check(spark, [
        ("cim", "com"), ("cm", "com"), ("nett", "net"), ("orq", "org"), ("online", None), ("ii", "io"),
        ("cmo", "co"), ("com", "co"),
    ], text.likely_tld)


def test_company_key(spark):
    check(spark, [
        ("Northwind7 LLC", "northwind7"), ("Northwind7, Inc.", "northwind7"), ("The Group", None),
        ("S.A. Foods", "s a foods"), ("Incorporate Co-op", "incorporate op"), ("  ", None), (None, None),
        ("A_B  Holdings C", "a b c"), ("Théâtre", "th tre"), ("co2 the inc incline", "co2 incline"), ("the the co", None),
        (" The A the B group", "a b"), ("inc.co a", "a"),
    ], text.company_key)


def test_domain_key(spark):
    check(spark, [
        ("https://www.ACME.com/a/b", "acme.com"), ("www.www.x.io", "www.x.io"), ("x.io:80?q=1", "x.io:80?q=1"),
        ("http://", None), (" acme.com ", "acme.com"), (None, None), ("HTTPS://X.DE", "x.de"),
    ], text.domain_key)


def test_country_and_person_keys(spark):
    check(spark, [
        ("U.S.A.", "u s a"), ("España", "espa a"), ("  The   Netherlands ", "the netherlands"), ("...", None),
        ("Straße", "strasse"),
    ], text.country_key)
    check(spark, [
        ("  Mara\t OLSEN ", "mara olsen"), ("Groß", "gross"), (" ", None), (None, None),
    ], text.person_key)
    for raw in ("U.S.A.", "Straße", "  The   Netherlands "):
        assert apply(spark, [raw], text.country_key) == [text.country_key_value(raw)]
        assert apply(spark, [raw], text.person_key) == [text.person_key_value(raw)]


def test_country_dimensions():
    names = canonical_countries()
    assert names["usa"] == names["u s a"] == "United States"
    assert "russia" not in names
    regions = country_regions({"A": ["Germany", "France"], "B": ["France", "Mars"]})
    assert regions == {"germany": "A", "france": "A", "mars": "B", "deutschland": "A"}
    assert owner_regions_by_key({" Bo  Li": "A", "bo li": "B", "Al": "", " ": "C"}) == {"bo li": "B"}


def test_open_stages(spark):
    check(spark, [
        ("Closed Won", False), ("closed_lost", False), (" C LOSED", False), ("contractsent", True),
        (None, True), ("reclosed", True), ("", True),
    ], text.stage_is_open)


def test_numbers(spark):
    check(spark, [
        (" 12 ", 12.0), ("1e3", 1000.0), ("-.5", -0.5), ("1,000", None), ("$5", None), ("1d", None),
        ("1f", None), ("nan", None), ("", None), ("abc", None), ("inf", math.inf), ("5.", 5.0),
    ], values.parse_number)


def test_dates(spark):
    day = dt.datetime(2026, 7, 1)
    check(spark, [
        ("2026-07-01", day), ("07/01/2026", day), ("2026/7/1", day), ("2026-07-01 10:30", day.replace(hour=10, minute=30)),
        ("2026-07-01T10:30:05", day.replace(hour=10, minute=30, second=5)), ("10:00", None), ("2026", None),
        ("soon", None), ("2026-02-30", None), ("", None), (" 2026-07-01 ", day), ("7/1/2026 08:15", day.replace(hour=8, minute=15)),
    ], values.parse_date)


def test_dates_in_rarer_spellings(spark):
    day = dt.datetime(2026, 7, 1)
    check(spark, [
        ("2026-07-01T10:00:00Z", day.replace(hour=10)), ("2026-07-01 10:00:00+00:00", day.replace(hour=10)),
        ("2026-07-01 10:00:00.5-0230", day.replace(hour=12, minute=30, microsecond=500000)), ("2026-07-01T01:00+02:00", dt.datetime(2026, 6, 30, 23)),
        ("Jul 1, 2026", day), ("july 1 2026", day), ("Sept. 9, 2026", dt.datetime(2026, 9, 9)), ("Julian 1, 2026", None), ("Feb 30, 2026", None),
        ("07/01/2026 3:15 PM", day.replace(hour=15, minute=15)), ("2026-07-01 12:00:05 am", day.replace(second=5)),
        ("Jul 1, 2026 12:30 pm", day.replace(hour=12, minute=30)), ("07/01/2026 13:15 PM", None), ("2026-07-01Z", None),
    ], values.parse_date)


def test_frequent_spellings_of_a_date_need_no_interpreted_steps(spark):
    """Each is read in a branch before the steps for mixtures, and as those steps read it."""
    spelled = ["2026-07-01T10:00:00Z", "2026-7-1 1:05:09.25 z", "07/01/2026 03:15 PM", "2026-07-01 12:00:05am", "Sept. 9, 2026", "jul 1 2026"]
    frame = spark.createDataFrame([(v,) for v in spelled], "v string")
    general = frame.select(values._parse_spelled_date(F.regexp_replace("v", r"^(\d+)/(\d+)/(\d+)", "$3-$1-$2"))).collect()
    steps = values._parse_spelled_date
    values._parse_spelled_date = lambda c: F.lit(None).cast("timestamp_ntz")
    try:
        branches = frame.select(values.parse_date(F.col("v"))).collect()
    finally:
        values._parse_spelled_date = steps
    assert branches == general and None not in [r[0] for r in branches]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_are_elapsed_whole_days(spark, zone):
    as_of = dt.datetime(2026, 7, 30, 1)
    stamps = [
        dt.datetime(2026, 6, 29, 23), dt.datetime(2026, 6, 30, 1), dt.datetime(2026, 6, 30, 1, 0, 1),
        dt.datetime(2026, 3, 7, 1), dt.datetime(2026, 7, 30, 1, 0, 1), dt.datetime(2026, 8, 1, 1), None,
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check(
            spark, [(s, None if s is None else (as_of - s).days) for s in stamps],
            lambda c: values.days_between(c, values.timestamp_literal(as_of)), "timestamp_ntz",
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(
    st.floats(allow_nan=False, allow_infinity=True),
    st.floats(min_value=-1e7, max_value=1e7),
    st.integers(min_value=-10**9, max_value=10**9).map(lambda n: n / 1000),
    st.integers(min_value=-10**6, max_value=10**6).map(lambda n: n * 0.25 / 10),
), min_size=1, max_size=200))
def test_rounding_matches_python(spark, numbers):
    numbers += [2.675, 96.25, 56473.135, 0.125, 1.005, -2.5, 0.0]
    for digits in (1, 2, 4):
        got = apply(spark, numbers, lambda c: values.round_exact(c, digits), "double")
        assert got == [round(n, digits) for n in numbers]
