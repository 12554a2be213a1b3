import random
from collections import defaultdict

from pyspark.sql import functions as F

from recordwarden.model import HIGH, MEDIUM
from recordwarden.operators.duplicates import (
    MatchPass, duplicate_companies, duplicate_contacts, duplicate_members,
)

from .helpers import company, contact, crm


def brute_force(rows, n_keys):
    """record -> (pass, key, master): first pass wins, then the smallest key."""
    found = {}
    for p in range(n_keys):
        clusters = defaultdict(list)
        for row in rows:
            if row[1 + p]:
                clusters[row[1 + p]].append(row[0])
        hits = {}
        for key in sorted(clusters):
            master, *others = sorted(clusters[key], key=lambda r: (len(r), r))
            for record in others:
                hits.setdefault(record, (p, key, master))
        for record, hit in hits.items():
            found.setdefault(record, hit)
    return found


def run(spark, rows):
    df = spark.createDataFrame(rows, "record_id string, a string, b string")
    passes = [MatchPass(F.col("a"), HIGH, "a", "a"), MatchPass(F.col("b"), MEDIUM, "b", "b")]
    return {r.record_id: (r["pass"], r.match_key, r.master_record_id) for r in duplicate_members(df, passes).collect()}


def test_random_tables_against_brute_force(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [
            (str(rnd.randrange(0, 150)) if rnd.random() < 0.9 else "",
             rnd.choice([None, "", *[f"k{i}" for i in range(40)]]),
             rnd.choice([None, *[f"n{i}" for i in range(25)]]))
            for _ in range(200)
        ]
        assert run(spark, rows) == brute_force(rows, 2)


def test_one_key_on_a_third_of_all_rows(spark):
    rows = [(str(i), "shared" if i % 3 == 0 else f"k{i // 2}", None) for i in range(30_000)]
    found = run(spark, rows)
    assert found == brute_force(rows, 1)
    assert sum(hit[1] == "shared" for hit in found.values()) == 9_999


def test_copies_of_one_record(spark):
    rows = [("7", "k", None)] * 3 + [("8", "k", None)]
    assert run(spark, rows) == {"7": (0, "k", "7"), "8": (0, "k", "7")}
    assert run(spark, [("7", "k", None), ("10", "k", None)]) == {"10": (0, "k", "7")}


def test_contacts(spark):
    tables = crm(spark, contacts=[
        contact(1, Email=" Kim@Firm.com "), contact(2, Email="kim@firm.COM"), contact(3, Email=None),
        contact(4, Email="  "), contact(5, Email="other@firm.com"),
    ])
    (found,) = duplicate_contacts(tables.contacts).collect()
    assert (found.record_id, found.severity, found.meta.master_record_id, found.meta.match_key) == (
        "2", "High", "1", "kim@firm.com")
    assert found.related_record_ids == ["1"] and found.field == "email"


def test_companies_by_domain_then_name(spark):
    rows = [
        company(1, Company_Domain_Name="https://www.acme.io/x", Company_name="Acme Inc."),
        company(2, Company_Domain_Name="ACME.io", Company_name="Other"),
        company(3, Company_name="The Acme Group"),
        company(4, Company_name="Other Ltd"),
        company(5, Company_Domain_Name=None, Company_name="Holdings"),
    ]
    found = {r.record_id: (r.severity, r.meta.master_record_id, r.meta.match_type)
             for r in duplicate_companies(crm(spark, companies=rows).companies).collect()}
    # 2 is queued by domain and still the master of 4 by name.
    assert found == {"2": ("High", "1", "domain"), "3": ("Medium", "1", "company_name"),
                     "4": ("Medium", "2", "company_name")}
