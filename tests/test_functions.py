"""Table-driven cases of the column functions, with invented names."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import classify, email, text, web


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_is_art(spark):
    yes = ["Visual Arts Teacher", "Ceramics", "Band Director", "Theatre", "Choir", "Visual Arts / Language Arts"]
    no = ["Language Arts", "ELA Teacher", "Martial Arts", "Culinary Arts", "Liberal Arts", "Industrial Arts", "Dean of Arts and Sciences", "", None, "Special Education"]
    assert run(spark, yes + no, classify.is_art) == [True] * len(yes) + [False] * len(no)


def test_discipline_order(spark):
    assert [r["discipline"] for r in run(spark, ["Studio Art", "Digital Art", "Fine Arts", "Drama", "Art"], classify.classify)] == ["visual art", "media", "unknown", "theatre", "visual art"]


def test_excluded_role(spark):
    assert run(spark, ["Choir", "Sped Aide", "Special  Education", "Broadband Manager", "Special Programs", "", None], classify.excluded_role) == [True, True, True, False, False, False, False]


def test_names(spark):
    good = ["Anna Lindqvist", "Dev Patterson-Hale", "Elise O'Rourke", "J. Marsh", "KATE HOLM"]
    bad = ["School Board", "Job Postings", "Wind Ensemble", "1 Year", "GISD Showcase", "Holiday Concerts", "Fine Arts", "Anna", "", "anna lindqvist", None]
    assert run(spark, good + bad, text.valid_name) == [True] * len(good) + [False] * len(bad)


def test_person_name(spark):
    assert run(spark, ["  ANNA   O'BRIEN-SMITH ", "carla mcdowell", "Hugo Marsh", "FELIX HOLM III", "", None], text.person_name) == ["Anna O'Brien-Smith", "Carla McDowell", "Hugo Marsh", "Felix Holm III", "", None]


def test_title_case(spark):
    assert run(spark, ["NORTH ISD HS", "Mixed Case", "3RD STREET MS", None], text.title_case) == ["North ISD HS", "Mixed Case", "3Rd Street MS", None]


def test_last_first(spark):
    assert run(spark, ["Holm, Greta", "Greta Holm", ", X", None], text.last_first) == ["Greta Holm", "Greta Holm", ", X", None]


def test_clean_title(spark):
    assert run(spark, ["Art/Yearbook x.y@example.org", "Art Teacher Send a Message to X"], text.clean_title) == ["Art/Yearbook", "Art Teacher"]


def test_campus_tag(spark):
    assert run(spark, ["Landry - Art", "Art Teacher - FJH", "Art Teacher", "", None], text.campus_tag) == ["Landry", "FJH", None, None, None]


def test_munge(spark):
    f = lambda c: email.munge_decode(c)["email"]
    assert run(spark, ["a.b [at] x [dot] org", "a(at)x.org", "mail a@x.org", "Look at the dotted line", ""], f) == ["a.b@x.org", "a@x.org", "a@x.org", None, None]
    assert run(spark, ["Look at the dotted line"], lambda c: email.munge_decode(c, compat=True)["email"]) == ["Look@the.ted"]


def test_cf_bad(spark):
    assert run(spark, ["zz", "2a", "", None, "2a0", "nothex"], email.cf_decode) == [None] * 6


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.from_regex(r"[a-z0-9.]{1,12}@[a-z]{1,8}\.[a-z]{2,4}", fullmatch=True), st.integers(1, 127)), min_size=1, max_size=20))
def test_cf_round_trip(spark, cases):
    coded = [bytes([k, *(ord(c) ^ k for c in a)]).hex() for a, k in cases]
    assert run(spark, coded, email.cf_decode) == [a for a, _ in cases]


def uses(spark, f, kind="string"):
    """How often the expression of ``f`` reads its column."""
    import re

    plan = spark.createDataFrame([], f"v {kind}").select(f(F.col("v")).alias("r"))._jdf.queryExecution().analyzed().toString()
    return len(re.findall(r"\bv#", plan.split("\n")[0]))


def test_cf_reads_its_text_once(spark):
    assert uses(spark, email.cf_decode) == 1


def test_domain(spark):
    assert run(spark, ["https://www.west.org:80/a", "west.org", "http://X.org?q"], web.domain) == ["west.org", "west.org", "x.org"]
    assert run(spark, ["west.org"], lambda c: web.domain(c, compat=True)) == ["est.org"]


def test_pagination(spark):
    r = run(spark, [["/s?page=1", "/s?page=5", "/t?p=5"], ["/x"], []], web.find_pagination, "array<string>")
    assert [(x["param"], x["max_page"], x["base"]) for x in r] == [("page", 5, "/s"), (None, 1, None), (None, 1, None)]


def test_walls(spark):
    assert run(spark, ["Please log in", "hello", None], lambda c: web.auth_wall(c, F.lit(False))) == [True, False, False]
    assert run(spark, ["Checking your browser", "hello", None], lambda c: web.bot_challenge(F.lit(200), c)) == [True, False, False]


@pytest.mark.parametrize("n", [1, 7])
def test_group_does_not_depend_on_partitions(spark, sf, n):
    from quillon.plans import queries as q
    from quillon.operators import merge

    rows = q.joined(spark, sf)
    a = merge.group_contacts(rows.repartition(n), ["school_name", "id"])
    b = merge.group_contacts(rows, ["school_name", "id"])
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_text_scan_looks_two_lines_back(spark):
    from quillon.operators import crawl

    rows = [(1, 1, "body", ["Anna Lindqvist", "Room 12", "Art Teacher"], None), (2, 1, "body", ["Anna Lindqvist", "Bruno Ashford", "Art Teacher"], None), (3, 1, "body", ["Anna Lindqvist", "Room 12", "Floor 3", "Art Teacher"], None), (4, 1, "mailto", ["Anna Lindqvist", "Room 12", "Art Teacher"], None)]
    got = crawl.extract_staff(spark.createDataFrame(rows, "page_id int, pos int, kind string, lines array<string>, mailto string")).collect()
    assert sorted((r["page_id"], r["name"], r["title"]) for r in got) == [(1, "Anna Lindqvist", "Art Teacher"), (2, "Bruno Ashford", "Art Teacher")]


def test_arts_page_reads_words_as_sql_does(spark):
    import duckdb

    from quillon.functions import rules

    arts = ["art", "\u00e4rt", "\u00e9art", "art\u0301", "\u0301art", "art\u00e9", "art\uff11", "\u0661art", "fine art\u017f", "vi\u017fual art", "F\u0130NE ART", "arts", "FINE ARTS", "art_", "_art", "art\u00aa", "art\u200d", "art\u203f", ""]
    staff = ["staff", "\u00e9staff", "\u017ftaff", "in\u017ftructor\u00e9", "teacher\u0301", "faculty_", "a@b.co", ""]
    texts = [f"{a} {s}" for a in arts for s in staff]
    sql = f"SELECT regexp_matches(t, '(?i){rules.ARTS_WORD}') AND (regexp_matches(t, '{rules.EMAIL}') OR regexp_matches(t, '(?i){rules.STAFF_WORD}')) FROM (SELECT unnest(?) AS t)"
    assert run(spark, [*texts, None], web.arts_page) == [*[r[0] for r in duckdb.execute(sql, [texts]).fetchall()], False]


def test_mx_of_equal_preferences_is_the_first(spark):
    from quillon.operators import crawl

    rows = [("d", "mx9.", 1, 9), ("d", "mx10.", 1, 10), ("d", "mx1.", 2, 1), ("d", "mx0.", None, 0), ("e", None, 1, 0)]
    assert {tuple(r) for r in crawl.mx_top(spark.createDataFrame(rows, "domain string, exchange string, preference int, ord int")).collect()} == {("d", "mx9"), ("e", None)}


def test_table_rows_read_their_lines_once(spark):
    assert uses(spark, text.table_rows, "array<string>") == uses(spark, text.table_row) == uses(spark, text.last_first) == uses(spark, text.valid_name) == 1


def test_split_name_title_reads_its_line_once(spark):
    assert uses(spark, text.split_name_title) == 1
    assert [tuple(x) if x else x for x in run(spark, ["Anna Lindqvist, Band", "Anna Lindqvist", "Anna Lindqvist : ", "Fine Arts, Band", None], text.split_name_title)] == [("Anna Lindqvist", "Band"), None, None, None, None]


def test_addresses_and_disciplines_read_their_text_once(spark):
    assert uses(spark, email.munge_decode) == uses(spark, classify.classify) == uses(spark, lambda c: text.email_matches_name(c, F.lit("Ann Lee"))) == 1
