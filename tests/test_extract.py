"""Staff rows of blocks: what each strategy takes, and which one ends the search."""

import pytest

from quillon.operators import crawl

SCHEMA = "page_id int, pos int, kind string, lines array<string>, emails array<string>, cfemail string, link string, evidence_url string"


def run_pages(spark, pages, permissive):
    rows = [(p, i, kind, lines, *([*more, None, None, None][:3]), "https://x.example/staff") for p, blocks in enumerate(pages) for i, (kind, lines, *more) in enumerate(blocks)]
    got = crawl.extract_staff(spark.createDataFrame(rows, SCHEMA), permissive).orderBy("pos", "name").collect()
    assert all(r["evidence_url"] == "https://x.example/staff" for r in got)
    return [[(r["name"], r["title"], r["email"], r["email_source"], r["strategy"]) for r in got if r["page_id"] == p] for p in range(len(pages))]


CASES = [
        (("block", ["Jane Doe", "Art Teacher", "Bob Ray, Ceramics Teacher"]), False, [("Bob Ray", "Ceramics Teacher", None, None, "name_title_line")]),
        (("block", ["Bob Ray, Ceramics Teacher", "Ann Lee, Art Teacher"]), False, [("Bob Ray", "Ceramics Teacher", None, None, "name_title_line")]),
        (("block", ["Jane Doe", "Room 12", "Art Teacher"]), False, [("Jane Doe", "Art Teacher", None, None, "generic_block")]),
        (("block", ["Jane Doe", "Math Teacher"]), False, []),
        (("block", ["Jane Doe", "Math Teacher"]), True, []),
        (("block", ["Jane Doe", "Math Teacher"], ["jd@x.example"]), True, [("Jane Doe", "Math Teacher", "jd@x.example", "MAILTO", "generic_block")]),
        (("block", ["Doe, Jane\tArt Teacher", "Ray, Bob\tMath Teacher"], ["j@x.example", "b@x.example"]), False, [("Jane Doe", "Art Teacher", "j@x.example", "MAILTO", "table_row")]),
        (("block", ["Doe, Jane\tArt Teacher", "Ray, Bob\tMath Teacher"], ["j@x.example", "b@x.example"]), True, [("Bob Ray", "Math Teacher", "b@x.example", "MAILTO", "table_row"), ("Jane Doe", "Art Teacher", "j@x.example", "MAILTO", "table_row")]),
        (("block", ["Doe, Jane\tArt Teacher", "Ray, Bob\tArt Teacher"], ["j@x.example"]), False, [("Bob Ray", "Art Teacher", None, None, "table_row"), ("Jane Doe", "Art Teacher", None, None, "table_row")]),
        (("card", ["Jane Doe", "Art Teacher"], [], None, "https://x.example/msg"), False, [("Jane Doe", "Art Teacher", "https://x.example/msg", None, "semantic_card")]),
        (("mailto", ["Jane Doe", "Art Teacher"], ["jd@x.example"]), False, [("Jane Doe", "Art Teacher", "jd@x.example", "MAILTO", "mailto_context")]),
        (("mailto", ["Jane Doe", "Room 12", "Art Teacher"], ["jd@x.example"]), False, []),
        (("body", ["Jane Doe", "Room 12", "Art Teacher", "other@x.example jdoe@x.example"]), False, [("Jane Doe", "Art Teacher", "jdoe@x.example", "MAILTO", "text_scan")]),
        (("body", ["Jane Doe", "Room 12", "Floor 3", "Art Teacher"]), False, []),
]


@pytest.mark.parametrize("permissive", [False, True])
def test_blocks(spark, permissive):
    cases = [(block, want) for block, p, want in CASES if p == permissive]
    assert run_pages(spark, [[block] for block, _ in cases], permissive) == [want for _, want in cases]


def test_better_kinds_end_the_search(spark):
    text = ("body", ["Ann Lee, Art Teacher"])
    pages = [[text, ("mailto", ["Bob Ray, Art Teacher"]), ("block", ["Cy Fox, Art Teacher"])], [text, ("card", ["Bob Ray", "Math Teacher"])], [("card", ["Bob Ray", "Art Teacher and Band"]), text]]
    assert [[r[0] for r in page] for page in run_pages(spark, pages, False)] == [["Cy Fox"], ["Ann Lee"], []]
