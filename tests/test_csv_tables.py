import datetime as dt
import random

import pytest

from recordwarden import load_crm
from recordwarden.model import COMPANIES, CONTACTS, DEALS, HEADER_ALIASES
from recordwarden.sources.csv_records import _lines, read_records
from recordwarden.sources.csv_tables import read_export, resolve_headers


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_headers_match_in_any_spelling():
    assert resolve_headers(["record_id", "E-MAIL address", "HubSpot Owner"], CONTACTS) == {
        "record_id": 0, "email": 1, "owner": 2,
    }
    # The preferred spelling wins, whatever the order of the columns.
    assert resolve_headers(["Owner", "Contact owner"], CONTACTS) == {"owner": 1}
    # Same spelling but for case: the last. Exactly repeated: the first.
    assert resolve_headers(["Email", "EMAIL"], CONTACTS) == {"email": 1}
    assert resolve_headers(["Email", "x", "Email"], CONTACTS) == {"email": 0}
    # An internal name counts as the last spelling of itself.
    assert resolve_headers(["num_employees", "Number of Employees"], COMPANIES) == {"num_employees": 1}
    assert resolve_headers(["num_employees"], COMPANIES) == {"num_employees": 0}


def test_conformed_shape_and_types(spark, tmp_path):
    path = write(tmp_path, "deals.csv", "Record ID,Deal Name,Amount,Close Date,Extra\n9.0, Big ,1e3,2026-12-01,x\n10,,abc,soon,\n")
    df = read_export(spark, path, DEALS)
    assert df.columns == list(HEADER_ALIASES[DEALS])
    types = dict(df.dtypes)
    assert types["amount"] == "double" and types["close_date"] == "timestamp_ntz" and types["pipeline"] == "string"
    assert sorted(rows(df, "record_id", "deal_name", "amount", "close_date", "owner")) == [
        ("10", None, None, None, None),
        ("9", "Big", 1000.0, dt.datetime(2026, 12, 1), None),
    ]


def test_only_empty_cells_are_null(spark, tmp_path):
    path = write(tmp_path, "c.csv", 'Record ID,Email,Country\n1,NA,null\n2,"",None\n,  ,"  x "\n')
    assert sorted(rows(read_export(spark, path, CONTACTS), "record_id", "email", "country", "country_raw")) == [
        ("", None, "x", "  x "), ("1", "NA", "null", "null"), ("2", None, "None", "None"),
    ]


def test_quotes_line_breaks_and_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, "c.csv", '﻿Record ID,Email,Job Title\n1,a@b.co,"Head of ""Ops"",\nEMEA"\n\n2,c@d.co,x\n')
    assert sorted(rows(read_export(spark, path, CONTACTS), "record_id", "email", "job_title")) == [
        ("1", "a@b.co", 'Head of "Ops",\nEMEA'), ("2", "c@d.co", "x"),
    ]


def test_repeated_headers_keep_their_position(spark, tmp_path):
    path = write(tmp_path, "c.csv", "Record ID,Email,Email,email\n1,first,second,third\n")
    assert rows(read_export(spark, path, CONTACTS), "record_id", "email") == [("1", "third")]
    path = write(tmp_path, "d.csv", "Record ID,Email,Email\n1,first,second\n")
    assert rows(read_export(spark, path, CONTACTS), "record_id", "email") == [("1", "first")]


@pytest.mark.parametrize("multi_line", [True, False])
def test_short_rows_are_filled_and_long_rows_stop_the_read(spark, tmp_path, multi_line):
    short = write(tmp_path, "s.csv", "Record ID,Email,Phone\n1,a@b.co\n2\n")
    df = read_export(spark, short, CONTACTS, multi_line=multi_line)
    assert sorted(rows(df, "record_id", "email", "phone")) == [("1", "a@b.co", None), ("2", None, None)]
    long = write(tmp_path, "l.csv", "Record ID,Email\n1,a@b.co\n2,c@d.co,surplus\n")
    with pytest.raises(Exception, match="more cells than the header"):
        read_export(spark, long, CONTACTS, multi_line=multi_line).collect()
    loose = read_export(spark, long, CONTACTS, multi_line=multi_line, check_rows=False)
    assert sorted(rows(loose, "record_id", "email")) == [("1", "a@b.co"), ("2", "c@d.co")]


def test_files_of_one_export_must_share_their_header(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder, "a.csv", "Record ID,Email\n1,a@b.co\n")
    write(folder, "b.csv", "Record ID,Email\n2,c@d.co\n")
    assert read_export(spark, str(folder), CONTACTS).count() == 2
    write(folder, "c.csv", "Email,Record ID\ne@f.co,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_export(spark, str(folder), CONTACTS).collect()


def test_header_only_absent_and_empty_files(spark, tmp_path):
    header_only = write(tmp_path, "c.csv", "Record ID,Email\n")
    tables = load_crm(spark, contacts=header_only, as_of="2026-07-25")
    assert {r.object_type: r.total for r in tables.counts().collect()} == {CONTACTS: 0, COMPANIES: 0, DEALS: 0}
    assert tables.as_of == dt.datetime(2026, 7, 25)
    with pytest.raises(ValueError, match="no header"):
        read_export(spark, write(tmp_path, "empty.csv", ""), CONTACTS)


def test_reference_date(spark, tmp_path):
    contacts = write(tmp_path, "c.csv", "Record ID,Last Activity\n1,2026-06-30 14:00\n")
    deals = write(tmp_path, "d.csv", "Record ID,Create Date,Close Date\n1,2026-06-01,2026-12-31\n")
    assert load_crm(spark, contacts=contacts, deals=deals).as_of == dt.datetime(2026, 6, 30, 14)
    nothing = write(tmp_path, "n.csv", "Record ID\n1\n")
    assert load_crm(spark, contacts=nothing).as_of.date() == dt.date.today()


def test_an_export_is_parsed_once(spark, tmp_path):
    contacts = write(tmp_path, "c.csv", "Record ID,Email,Last Activity\n1.0, a@b.co ,07/01/2026 03:15 PM\n2,,\n")
    tables = load_crm(spark, contacts=contacts)
    plan = tables.contacts._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan csv" not in plan
    assert sorted(rows(tables.contacts, "record_id", "email", "email_raw", "last_activity_date"), key=str) == [
        ("1", "a@b.co", " a@b.co ", dt.datetime(2026, 7, 1, 15, 15)), ("2", None, None, None)]


def test_unknown_table(spark):
    tables = load_crm(spark, as_of="2026-07-25")
    assert tables.frame(DEALS).count() == 0
    with pytest.raises(ValueError, match="unknown object type"):
        tables.frame("tickets")


def test_surplus_cells_stop_every_kind_of_read(spark, tmp_path):
    for multi_line in (True, False):
        unknown_first = write(tmp_path, "u.csv", "Notes,Record ID,Email\nx,1,a@b.co\ny,2,c@d.co,surplus\n")
        known = write(tmp_path, "k.csv", "Record ID,Email\n1,a@b.co\n2,c@d.co,surplus\n")
        for path in (unknown_first, known):
            df = read_export(spark, path, CONTACTS, multi_line=multi_line)
            for action in (df.count, df.select("email").collect, df.collect):
                with pytest.raises(Exception, match="more cells than the header"):
                    action()


def test_line_breaks_in_quotes_need_multi_line(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'Record ID,Job Title\n1,"Head of\nEMEA"\n2,Clerk\n')
    assert read_export(spark, path, CONTACTS).count() == 2
    with pytest.raises(ValueError, match="line break inside quotes"):
        read_export(spark, path, CONTACTS, multi_line=False)


def _plain_records(text):
    """A CSV text record by record, character by character."""
    records, start, at, quoted, first = [], 0, 0, False, True
    while at < len(text):
        c = text[at]
        if quoted:
            if c == '"' and text[at + 1:at + 2] == '"':
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"' and first:
            quoted = True
        elif c == "\n":
            records.append(text[start:at])
            start = at + 1
        first = not quoted and c in ",\n"
        at += 1
    records.append(text[start:])
    return [r for r in (r.removesuffix("\r") for r in records) if r.strip()]


@pytest.mark.parametrize("seed", range(4))
def test_records_equal_a_plain_reader_however_files_are_split(spark, tmp_path, seed):
    rnd = random.Random(seed)
    cells = ["plain", "", '5" pipe', 'a "b" c', '"q"', '"two\nlines"', '"he said ""no"",\nthen\n\nleft"', '"crlf\r\nin"', '"end\n"', "x y", '"a,b"', '""', '"""\n"""']
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [",".join(rnd.choice(cells) for _ in range(3)) for _ in range(120)]
        text = "h1,h2,h3" + "".join(rnd.choice(["\n", "\r\n", "\n\n"]) + r for r in rows)
        (tmp_path / name).write_bytes(text.encode())
        want += _plain_records(text)
    for size in ("128m", "64b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = read_records(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(r.record for r in found) == sorted(want)
        assert [r.record for r in found if r.is_header] == ["h1,h2,h3"] * 2


def test_default_read_keeps_line_breaks_and_lone_quotes(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Record ID,Last Name,Job Title,Email\n1,"O""Neil","Buyer\n\nand, seller",a@b.com\n2,5" pipe,x\n3,Lee,"y",c@d.com\n')
    got = {r.record_id: (r.last_name, r.job_title, r.email) for r in read_export(spark, str(path), CONTACTS).collect()}
    assert got == {"1": ('O"Neil', "Buyer\n\nand, seller", "a@b.com"), "2": ('5" pipe', "x", None), "3": ("Lee", "y", "c@d.com")}
    lone = tmp_path / "lone.csv"
    lone.write_text('Record ID,Last Name\n1,5" pipe\n2,Lee\n')
    assert [r.last_name for r in read_export(spark, str(lone), CONTACTS, multi_line=False).orderBy("record_id").collect()] == ['5" pipe', "Lee"]


def test_records_that_cannot_be_read(spark, tmp_path):
    def read(name, text, **options):
        (tmp_path / name).write_text(text)
        return read_export(spark, str(tmp_path / name), CONTACTS, **options).collect()

    with pytest.raises(Exception, match="never closed"):
        read("open.csv", 'Record ID,Last Name\n1,"a\nb"\n2,"c\n')
    surplus = 'Record ID,Last Name\n1,"a\nb",c\n'
    with pytest.raises(Exception, match="more cells than the header"):
        read("long.csv", surplus)
    assert [r.last_name for r in read("long.csv", surplus, check_rows=False)] == ["a\nb"]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text('Record ID,Last Name\n1,"a\nb"\n')
    (tmp_path / "two" / "b.csv").write_text("Record ID,Email\n2,c\n")
    with pytest.raises(Exception, match="another header"):
        read_export(spark, str(tmp_path / "two"), CONTACTS).collect()


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("Record ID,Last Name\n" + "".join(f'{i},"name\n{i}"\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = read_export(spark, str(path), CONTACTS)
        assert df.count() == 5000 and df.where("last_name = 'name\\n77'").first().record_id == "77"
        assert _lines(spark, str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
