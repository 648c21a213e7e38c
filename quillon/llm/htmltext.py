"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Blocks in menus, footers, adverts and the
like are out from the start, as no density tells a notice in prose from an article.
Pass 1 decides the others: blocks that are mostly links are out; blocks that are long
enough and dense enough in stop words are in, with lower limits in an article.  Pass 2
gives each block that is left, short or ambiguous, the label of its nearest decided
neighbours.  An article's edges count as neighbours that are in, so its neighbours are
those of the same article.

Both passes, and the cutting, take time in proportion to the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import store

# HTML elements and the words of class and id attributes that name a page's parts.
_RAW = "script style noscript template iframe object svg math canvas textarea select option button datalist audio video map xmp noembed noframes"
_BLOCK = "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul"
_OUT_TAGS = "head nav footer aside form menu dialog fieldset search title"
_OUT_WORDS = "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay footer foot masthead menu menus nav navbar navigation navi newsletter pagination pager promo promoted promotion related recommended share sharing social sidebar side sponsor sponsored subscribe subscription signup login toolbar widget widgets copyright legal disclaimer skip hidden"
_IN_WORDS = "article content entry main post story text body"
_HEADS = "h1 h2 h3 h4 h5 h6"
# Frequent function words of English, French, German and Spanish.
_STOP = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do "
    "le la les de des du un une et en est que qui dans pour pas sur au aux par plus ce se ne son sa ses avec il elle nous vous ils sont ou mais comme "
    "der die das und den dem des ein eine einer eines ist nicht von zu mit sich auf für im auch als an es wird aus bei nach wie hat er sie ich wir ihr oder aber "
    "el los las del y una que es no se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre"
)
RAW, BLOCK, OUT_TAGS, OUT_WORDS, IN_WORDS, HEADS, STOP = (frozenset(x.split()) for x in (_RAW, _BLOCK, _OUT_TAGS, _OUT_WORDS, _IN_WORDS, _HEADS, _STOP))

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*\"|'[^']*')?+|[^>=])*+)(?P<close>>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‚‘’…–—¿¡"
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}

IN, OUT, OPEN = 1, -1, 0
#: Characters of a long and of a short block, and shares of links and of stop words.
LONG, SHORT, LINKED, STOPPED = 140, 60, 0.4, 0.2
#: Elements that hold no blocks, and those that a new one of their kind ends.
_EMPTY = frozenset("col frame hr link meta".split())
_SAME = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th"}
_SAME = {k: frozenset(v.split()) for k, v in _SAME.items()}


def _place(tag: str, attrs: str, inside: bool) -> int | None:
    """What an element says of its blocks; None: nothing.  ``inside``: it stands in an article."""
    words = set()
    if "=" in attrs:
        for m in _NAMES.finditer(attrs):
            words.update(_WORDS.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()))
        if "hidden" in words or words & OUT_WORDS and tag not in ("body", "html", "main"):
            return OUT
    if tag in OUT_TAGS or tag == "header" and not inside:
        return OUT
    if tag in ("article", "main") or tag in ("div", "section") and words & IN_WORDS:
        return IN
    return None


def blocks(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, characters in links, place, heading) of each block that has text, in page order.

    A place is OUT, OPEN, or the number of the article (from 1) that the block stands in.
    """
    out: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, int]] = []  # element, place, the article around it
    held: Counter = Counter()  # elements of the stack by tag
    endless: set[str] = set()  # elements without text whose end doesn't come
    parts: list[str] = []
    linked, in_link, head, place, articles = 0, 0, False, OPEN, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, linked, place, head))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def pop() -> None:
        held[stack.pop()[0]] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None or not m["close"]:
            continue
        tag = tag.lower()
        end = bool(m["end"])
        if tag in RAW:
            if not end and tag not in endless and not (m["attrs"].endswith("/") and tag in ("svg", "math")):
                e = _ENDS[tag].search(page, at)
                if e is None:
                    endless.add(tag)
                at = e.end() if e else n if tag in ("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes") else at
            continue
        if tag == "a":
            in_link = 0 if end else 1
        elif tag == "br" or tag == "img":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if end:
                if held[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                in_link = 0 if tag in ("p", "li", "div", "td") else in_link
                head = head and tag not in HEADS
            else:
                head = tag in HEADS or head and tag not in ("p", "div", "li", "section")
                if stack and stack[-1][0] == "p":
                    pop()
                if stack and (stack[-1][0] in _SAME.get(tag, ()) or tag in ("body", "article", "main") and stack[-1][0] == "head"):
                    pop()
                if tag not in _EMPTY:
                    around = stack[-1][1:] if stack else (OPEN, 0)
                    says = _place(tag, m["attrs"], around[1] > 0)
                    if says == IN and around[0] != OUT and not around[1]:
                        articles += 1
                        around = (articles, articles)
                    # An article within a part that is out, such as a comment, stays out.
                    stack.append((tag, OUT if says == OUT else around[0], around[1]))
                    held[tag] += 1
            place = stack[-1][1] if stack else OPEN
    flush()
    return out


def first_pass(found: list[tuple[str, int, int, bool]]) -> list[int]:
    """IN, OUT or OPEN for each block, by its place, links, length and stop words."""
    first = []
    for text, linked, place, head in found:
        density = linked / len(text)
        if place == OUT or density > LINKED and not head:
            first.append(OUT)
        elif len(text) < SHORT or head:
            first.append(OPEN)
        else:
            words = text.lower().split()
            stop = sum(w.strip(_MARKS) in STOP for w in words) / len(words)
            inside = place > 0
            if stop >= (STOPPED / 2 if inside else STOPPED) and (len(text) >= LONG or inside or density == 0):
                first.append(IN)
            else:
                first.append(OUT if not inside and len(text) >= LONG and stop < STOPPED / 4 and density > LINKED / 2 else OPEN)
    return first


def label(found: list[tuple[str, int, int, bool]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    n, first = len(found), first_pass(found)

    def nearest(order: range) -> list[tuple[int, int]]:
        """(label, index) of the decided block that comes before each one in the given order, within its article."""
        got, last = [(OUT, -1)] * n, {}
        for k in order:
            part = max(found[k][2], 0)
            # What is out by its place isn't in the article, but stands between other blocks.
            got[k] = last.get(part, (IN if part else OUT, order.start - (1 if order.step > 0 else -1)))
            if first[k] and (found[k][2] != OUT or not part):
                last[part] = (first[k], k)
        return got

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for k in range(n):
        x = first[k]
        if not x:
            (b, i), (a, j) = before[k], after[k]
            if found[k][2] > 0:
                x = OUT if a == b == OUT else IN
            else:
                x = a if a == b or found[k][3] else b if k - i < j - k else a if j - k < k - i else OUT
        out.append(x == IN)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, each with white space made one space, joined by one line feed."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, ok in zip(found, label(found)) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for each row of ``pages``.

    Null and empty pages, and pages without main text, have an empty text.  Repeated
    rows give repeated results, and an empty table gives none; columns other than page_id,
    url and html are ignored.
    """
    store.workers(pages.sparkSession)

    def run(batches):
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
