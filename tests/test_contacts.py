"""Contact pages, shared directories and time filters, by cases with invented names."""

from datetime import UTC, datetime

import pytest

from pyspark.sql import functions as F

from quillon.functions import email, web
from quillon.operators import contacts, crawl, merge

COLUMNS = "school_id int, page_ord int, page_url string, pos int, kind string, href string, label string, email string, container string"


def found(spark, *rows, compat=False):
    df = spark.createDataFrame([(1, *r) for r in rows], COLUMNS)
    return {r["name"]: (r["value"], r["method"], r["cid"]) for r in contacts.school_contacts(contacts.page_contacts(df, compat)).collect()}


def test_better_ways_come_first_on_a_page(spark):
    got = found(
        spark,
        (0, "u", 5, "mailto", "mailto:a.holm@x.org?subject=1", None, None, "\n  Anna  HOLM \nArt"),
        (0, "u", 1, "button", None, "Send Messageto Anna Holm", None, None),
        (0, "u", 2, "button", None, "Send  Message to Dev Marsh", None, None),
        (0, "u", 3, "link", "https://x.org/f", "Get in touch", None, "Ines Reed\n"),
        (0, "u", 4, "link", "https://x.org/g", "Lunch menu", None, "Kira Stone"),
        (0, "u", 6, "data", None, None, "not an address", "Lars Reed"),
        (0, "u", 7, "button", None, "Contact me", None, "Jonas Reed"),
        (0, "u", 8, "mailto", "mailto:b@x.org", None, None, " \n "),
        (0, "u", 9, "body", None, None, None, None),
    )
    assert got == {"anna holm": ("a.holm@x.org", "email", 1), "dev marsh": ("u", "send_message_button", 2), "ines reed": ("https://x.org/f", "send_message_button", 3), "jonas reed": ("u", "send_message_button", 4)}


def test_last_page_wins_but_order_stays(spark):
    got = found(spark, (0, "u", 0, "data", None, None, "a@x.org", "Anna Holm"), (0, "u", 1, "data", None, None, "b@x.org", "Bea Holm"), (2, "w", 0, "data", None, None, "new@x.org", "ANNA HOLM"))
    assert got == {"anna holm": ("new@x.org", "email", 1), "bea holm": ("b@x.org", "email", 2)}


def test_no_elements(spark):
    assert found(spark) == {}


def test_spelt_out(spark):
    texts = ["Anna Holm\na.holm [at] x [dot] org\nBea Reed\nb at y dot net", "x" * 300 + "\nc(at)z(dot)org", "Look at the dotted line", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r["s"] for r in df.select(email.spelt_out(F.col("t")).alias("s")).collect()]
    assert [(x["email"], x["before"].strip().split("\n")[-1]) for x in got[0]] == [("a.holm@x.org", "Anna Holm"), ("b@y.net", "Bea Reed")]
    assert [(x["email"], x["before"]) for x in got[1]] == [("c@z.org", "x" * 199 + "\n")]
    assert [list(x or []) for x in got[2:]] == [[], [], []]
    loose = df.select(email.spelt_out(F.col("t"), compat=True).alias("s")).collect()[2]["s"]
    assert [x["email"] for x in loose] == ["Look@the.ted"]


def test_district_directories(spark):
    rows = [("d", 1, "a", "sitemap", 3), ("d", 2, "a", "sitemap", 0), ("d", 3, "b", "nav", 4), ("d", 4, "c", "cms:edlio", 1), ("d", 5, "x", "nav", 0), ("d", 6, "c", "nav", 2), (None, 1, "a", "sitemap", 3), (None, 2, "a", "sitemap", 3)]
    df = spark.createDataFrame(rows, "district string, ord int, directory_url string, source string, records int")
    got = {(r["district"], r["ord"]): r["shared_url"] for r in crawl.district_directories(df).collect()}
    assert got == {("d", 1): None, ("d", 2): "a", ("d", 3): None, ("d", 4): None, ("d", 5): "c", ("d", 6): "c", (None, 1): None, (None, 2): None}


@pytest.mark.parametrize("value, want", [("today", "2024-08-24T00:00:00+00:00"), ("week", "2024-08-17T09:30:00+00:00"), ("month", "2024-07-25T09:30:00+00:00"), ("2024-01-02", "2024-01-02T00:00:00"), ("soon", None), ("", None), (None, None)])
def test_added_cutoff(value, want):
    assert merge.added_cutoff(value, datetime(2024, 8, 24, 9, 30, tzinfo=UTC)) == want


def test_since_keeps_rows_whose_time_is_no_time(spark):
    df = spark.createDataFrame([(1, "2024-08-01T00:00:00"), (2, "zzz"), (3, "1999"), (4, None)], "id int, added_at string")
    assert [r["id"] for r in merge.since(df, "2024-01-01T00:00:00").orderBy("id").collect()] == [1, 2]
    assert merge.since(df, None).count() == 4


def test_preferred_base(spark):
    df = spark.createDataFrame([("http://x.org", 200), ("http://x.org", 404), ("http://x.org", None), ("https://x.org", 200), (None, 200)], "u string, s int")
    assert [r[0] for r in df.select(web.preferred_base(F.col("u"), F.col("s"))).collect()] == ["https://x.org", "http://x.org", "http://x.org", "https://x.org", None]


def test_staff_without_contact_stays(spark):
    staff = spark.createDataFrame([(1, 1, "Anna Holm", None, "unresolved"), (2, 1, "Holm", "", "unresolved"), (3, 1, "Bea Marsh", None, "unresolved"), (4, 2, "Anna Holm", None, "unresolved")], "id int, school_id int, teacher_name string, email string, resolution_method string")
    schools = spark.createDataFrame([(1, "TX"), (2, "OK")], "id int, state string")
    pages = spark.createDataFrame([(1, 0, "u", 0, "data", None, None, "a@x.org", "Anna Holm"), (2, 0, "u", 0, "data", None, None, "b@x.org", "Anna Holm")], COLUMNS)
    got = {r["id"]: r["email"] for r in contacts.check_contacts(staff, schools, pages, ["TX"]).collect()}
    assert got == {1: "a@x.org", 2: "a@x.org", 3: None, 4: None}
    assert {r["id"]: r["email"] for r in contacts.check_contacts(staff, schools, pages, ["TX"], limit=1).collect()}[2] == ""
