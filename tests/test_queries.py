"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from quillon import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_queries_without_sql_run(spark, sf):
    for name in catalog.QUERIES.keys() - catalog.ORACLES.keys():
        assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_fuzzy_equals_difflib(spark, sf):
    import difflib

    from pyspark.sql import functions as F

    from quillon.plans import queries as q
    from quillon.functions import text

    asked = q.inputs(spark, sf, F.translate(text.normalize_name(F.col("school_name")), "pg", "bq")).collect()
    rows = q.index(spark, sf).collect()
    want = set()
    for a in asked:
        keys = sorted({r["norm"] for r in rows if a["hint"] is None or r["state"] == a["hint"]})
        for k in difflib.get_close_matches(a["norm"], keys, 5, 0.82):
            want |= {(a["iid"], r["nces_id"]) for r in rows if r["norm"] == k and (a["hint"] is None or r["state"] == a["hint"])}
    assert {(r["iid"], r["nces_id"]) for r in q.lookup_fuzzy(spark, sf).collect()} == want


def test_resolve_matches_curated_names_fuzzily(spark, sf):
    from pyspark.sql import functions as F

    from quillon.plans import queries as q

    got = {r["iid"]: (r["entity_type"], r["resolved_name"]) for r in q.resolve_entity(spark, sf).filter(F.col("iid") % 10 > 2).collect()}
    assert {v for k, v in got.items() if k % 10 == 3} == {("PARENT_ORG", "Harbor Lights Charter Network")}
    assert {v for k, v in got.items() if k % 10 == 7} == {("PROGRAM", "Evening Studio Program of the Arts")}
    assert all(v[0] not in ("PARENT_ORG", "PROGRAM") for k, v in got.items() if k % 10 not in (3, 7))


def plain_name(c):
    """The rules of a valid name, written out."""
    import re

    from quillon.functions import rules

    w = c.split()
    bare = [re.sub(r"^[.,]+|[.,]+$", "", x) for x in w]
    art = re.sub("|".join(rules.EXCLUDE_PHRASES), " ", c, flags=re.I)
    caps = [len(b) >= 2 and x == x.upper() and x != x.lower() for x, b in zip(w, bare)]
    return (
        2 <= len(w) <= 5 and len(c) <= 60 and not re.search(r"[0-9&/:@|]", c) and not re.search(r"\b(" + "|".join(p for p, _ in rules.DISCIPLINES) + r")\b", art, re.I)
        and (not any(caps) or all(caps)) and not any(b.lower() in rules.NAV_WORDS or re.sub("s$", "", b.lower()) in rules.NAV_WORDS for b in bare)
        and all(re.fullmatch(r"[A-Z][A-Za-z]*(?:['\-][A-Z][A-Za-z]*)*\.?", x) for x in w)
    )


def test_lines_against_brute_force(spark, sf):
    """Names, titles and names on the lines before, over all lines."""
    import re

    from quillon.functions import rules

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    lines = {(r["doc_id"], k): x for r in docs for k, x in enumerate((r["text"] or "").split("\n")) if r["text"] is not None}
    title = lambda x: x != "" and not re.search(rules.TITLE_JUNK, x, re.I) and len(x) <= 100 and len(x.split()) <= 12 and x.count(".") <= 1
    names = {k: x for k, x in lines.items() if plain_name(x)}
    q = catalog.QUERIES
    assert {(r["doc_id"], r["pos"]): r["name"] for r in q["name_valid"](spark, sf).collect()} == names
    assert {(r["doc_id"], r["pos"]) for r in q["title_valid"](spark, sf).collect()} == {k for k, x in lines.items() if title(x)}
    got = {(r["doc_id"], r["pos"]): r["near_name"] for r in q["prev_line_name"](spark, sf).collect()}
    assert got == {(d, k): names.get((d, k - 1)) or names.get((d, k - 2)) for d, k in lines}
