"""Resolution: the cases that its order of rules decides."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import match

SCHOOLS = [
    ("001", "Harbor Elementary School", "North East Independent School District", "TX", "10"), ("002", "Hill Middle School", "North East Independent School District", "TX", "10"),
    ("003", "Lake School Of Fine Arts", "Lake School Of Fine Arts", "TX", "11"), ("004", "Lincoln High School", "Kansas City Schools", "KS", "12"), ("005", "Lincoln High School", "Tulsa Schools", "OK", "13"),
    ("006", "Oak School", "Union Schools", "TX", "14"), ("007", "Elm School", "Union Schools", "TX", "14"), ("008", "Ash School", "Union Schools", "KS", "15"), ("009", "Yew School", "Union Schools", "KS", "15"),
    ("010", "Burnham Wood Academy West", "Burnham Wood Charter Schools", "TX", "16"), ("011", "Burnham Wood Academy East", "Burnham Wood Charter Schools", "TX", "16"), ("012", "Westfield Magnet", "Quiet District", "NY", "17"), ("013", "Other Magnet", "Quiet District", "NY", "17"),
]


def run(spark, asked, **more):
    df = spark.createDataFrame(SCHOOLS, "nces_id string, school_name string, district_name string, state string, lea_id string")
    df = df.withColumn("norm", text.normalize_name(F.col("school_name"))).withColumn("district_norm", text.normalize_name(F.col("district_name")))
    rows = spark.createDataFrame([(i, n, h, c) for i, (n, h, c) in enumerate(asked)], "iid int, norm string, hint string, city string").withColumn("norm", text.normalize_name(F.col("norm")))
    return [r.asDict() for r in match.resolve(rows, df, **more).orderBy("iid").collect()]


def test_resolution_rules(spark):
    asked = [("NEISD", None, None), ("n e i s d", "TX", None), ("Lake School of Fine Arts", None, None), ("Lincoln High School", None, None), ("Lincoln High School", None, "Tulsa"), ("Lincoln High School", "OK", None), ("Union Schools", None, None), ("Union Schools", "KS", None), ("Burnham Wood Charter", None, None), ("Hill Midle Schol", "TX", None), ("Nothing Like It", None, None), ("NEISD", "KS", None)]
    got = run(spark, asked)
    show = [(r["entity_type"], r["resolved_name"], r["nces_id"], r["confidence"], r["needs_review"]) for r in got]
    ne = "North East Independent School District"
    assert show == [
        ("DISTRICT", ne, "10", 0.85, False), ("DISTRICT", ne, "10", 0.85, False), ("SCHOOL", "Lake School Of Fine Arts", "003", 1.0, False), ("AMBIGUOUS", None, None, 0.0, True), ("SCHOOL", "Lincoln High School", "004", 1.0, False), ("SCHOOL", "Lincoln High School", "005", 1.0, False),
        ("AMBIGUOUS", None, None, 0.0, True), ("DISTRICT", "Union Schools", "15", 1.0, False), ("DISTRICT", "Burnham Wood Charter Schools", "16", 0.85, False), ("SCHOOL", "Hill Middle School", "002", 0.72, False), ("NOT_A_K12", None, None, 0.3, True), ("NOT_A_K12", None, None, 0.3, True),
    ]
    assert got[7]["children"] == ["Ash School", "Yew School"] and got[0]["children"] == ["Harbor Elementary School", "Hill Middle School"]


def test_curated_tables(spark):
    parents = spark.createDataFrame([("harbor lights network", "Harbor Lights Network", "hl.example")], "norm string, name string, domain string")
    programs = spark.createDataFrame([("evening studio at oak school", "Evening Studio", "s.example", "TX", "Oak School")], "norm string, name string, domain string, state string, parent string")
    behind = spark.createDataFrame([("quiet district", "Quiet Foundation", False)], "norm string, name string, confirmed boolean")
    got = run(spark, [("The Harbour Lights Netwrk", None, None), ("Evening Studio at Oak School", "KS", None), ("Westfield Magnet", None, None)], parents=parents, programs=programs, district_parents=behind)
    assert [(r["entity_type"], r["resolved_name"], r["parent_entity"], r["needs_review"]) for r in got] == [("PARENT_ORG", "Harbor Lights Network", None, False), ("PROGRAM", "Evening Studio", "Oak School", False), ("SCHOOL", "Westfield Magnet", "Quiet Foundation", True)]
    assert got[2]["parent_entity_type"] == "PARENT_ORG"


@pytest.mark.parametrize("compat,want", [(False, {"b"}), (True, set())])
def test_prefix_hits_of_other_states(spark, compat, want):
    index = spark.createDataFrame([("oak grove school", "KS", "a"), ("oak grov", "TX", "b")], "norm string, state string, nces_id string")
    asked = spark.createDataFrame([(1, "oak grove", "TX")], "iid int, norm string, hint string")
    assert {r["nces_id"] for r in match.lookup(asked, index, compat=compat).collect()} == want


def test_display_title(spark):
    got = spark.range(1).select(text.display_title(F.lit("TEXAS school OF the arts o'neil")).alias("t")).first()["t"]
    assert got == "Texas School Of The Arts O'Neil"


def test_closest_names_equal_difflib():
    import difflib
    import random

    random.seed(1)
    for alphabet in ["ab", "abc 01", "abcdefghij ", "aéñ漢b\0"]:
        for size in [3, 20, 70, 230]:
            base = random.choices(alphabet, k=size)

            def change():
                x = list(base)
                for _ in range(random.randint(0, 3)):
                    x[random.randrange(len(x)) : random.randint(0, len(x))] = random.choices(alphabet, k=random.randint(0, 2))
                    x = x or ["a"]
                return "".join(x)

            keys = sorted({change() for _ in range(60)} | {""})
            near = match._Closest(keys)
            for asked in [change(), change(), ""]:
                assert [k for _, k in near.closest(asked, 0.82, 5)] == difflib.get_close_matches(asked, keys, 5, 0.82)


def test_closest_names_need_few_ratios(monkeypatch):
    import difflib

    looks = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: (looks.append(1), ratio(m))[1])
    near = match._Closest([f"supplier {i:06d} high school" for i in range(5_000)])
    assert [k for _, k in near.closest("subblier 001234 hiqh school", 0.82, 5)][0] == "supplier 001234 high school" and len(looks) < 50


def test_rows_of_the_same_initials_are_dealt_to_parts(spark):
    index = spark.createDataFrame([("high school", "KS" if i else "TX", f"{i:03d}") for i in range(200)], "norm string, state string, nces_id string")
    asked = spark.createDataFrame([(1, "hs", "TX"), (2, "h s", None), (3, "hs", "KS"), (4, "ms", None)], "iid int, norm string, hint string")
    hits = match.by_acronym(asked, index)
    assert {(r["iid"], r["norm"], r["n"]) for r in hits.groupBy("iid", "norm").agg(F.count_distinct("nces_id").alias("n")).collect()} == {(1, "hs", 200), (2, "h s", 200)}
    assert hits.count() == 400 and "part" in hits._jdf.queryExecution().analyzed().toString()


def test_questions_are_asked_once(spark, monkeypatch):
    asked = []
    lookup = match.lookup
    monkeypatch.setattr(match, "lookup", lambda rows, *a, **k: (asked.append(rows.count()), lookup(rows, *a, **k))[1])
    got = run(spark, [("Union Schools", "KS", None)] * 3 + [("Union Schools", None, None)] * 2)
    assert asked == [2, 2] and [(r["entity_type"], r["children"]) for r in got] == [("DISTRICT", ["Ash School", "Yew School"])] * 3 + [("AMBIGUOUS", [])] * 2
