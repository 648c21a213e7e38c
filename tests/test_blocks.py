"""Blocks of made pages."""

from quillon.functions.blocks import blocks_of

PAGE = """<html><head><title>T</title></head><body><div class="staff-card"><h3 class=name>Ann <b>Lee</b></h3><p class=title>Art Teacher</p><a href="mailto:al@x.example">mail</a><span data-cfemail="2a4b"></span></div>
<table><tr><td>Ray, Bob<td>Math Teacher<tr><td>Fox, Cy</td><td>Art&nbsp;Teacher</td></tr></table><ul><li>Jo Day, Dance<li><p>Kim Roe</p><p>Drama</p><a href="/c">Contact me</a></ul><script>x</script></body></html>"""


def test_blocks_of_a_page():
    got = blocks_of(PAGE)
    assert [b["pos"] for b in got] == list(range(len(got)))
    card = got[0]
    assert (card["kind"], card["lines"], card["emails"], card["cfemail"], card["link"]) == ("card", ["Ann Lee", "Art Teacher"], ["al@x.example"], "2a4b", None)
    rows = [b["lines"] for b in got if b["kind"] == "block"]
    assert rows == [["Ann Lee", "Art Teacher", "mail"], ["Ray, Bob\tMath Teacher"], ["Fox, Cy\tArt Teacher"], ["Jo Day, Dance"], ["Kim Roe", "Drama", "Contact me"]]
    assert [b["link"] for b in got if b["kind"] == "block"][-1] == "/c"
    assert [(b["lines"], b["emails"]) for b in got if b["kind"] == "mailto"] == [(["Ann Lee", "Art Teacher", "mail"], ["al@x.example"])]
    body = got[-1]
    assert body["kind"] == "body" and body["lines"][0] == "Ann Lee" and "x" not in body["lines"]


def test_blocks_of_nothing():
    assert blocks_of(None) == blocks_of("") == []
    assert [b["kind"] for b in blocks_of("<div><p>open")] == ["body"]


def test_pages_go_on_in_small_pieces():
    import pyarrow as pa

    from quillon.functions.blocks import pieces

    html = ["x" * n if n is not None else None for n in (4, 4, 20, None, 3, 3, 3, 3)]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(8)), "url": ["u"] * 8, "html": pa.array(html, pa.string())})
    assert [x for b in pieces(batch, 10) for x in b.column(0).to_pylist()] == list(range(8)) and list(pieces(batch.slice(0, 0))) == []
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(2).to_pylist()) <= 10 for b in pieces(batch, 10))
