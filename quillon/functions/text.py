"""Names, titles and casing as column expressions.

Patterns follow Unicode rules for ``\\w`` and ``\\s`` (``(?U)``); white space is
trimmed by :func:`trim_ws`, as ``trim`` takes spaces alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions.bind import let


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def words(c: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    """Each run of ASCII letters with its first in upper case."""
    return F.array_join(F.transform(F.regexp_extract_all(w, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def _mc(w: Column) -> Column:
    return let(w, lambda w: F.when(w.rlike("^Mc[a-z]"), F.concat(F.lit("Mc"), F.upper(F.substring(w, 3, 1)), F.substr(w, F.lit(4)))).otherwise(w))


def person_name(c: Column) -> Column:
    """Collapse white space and recase words that are all upper or all lower case."""

    def recase(w: Column) -> Column:
        bare = F.upper(F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
        one = w.rlike("[A-Za-z]") & ((w == F.upper(w)) | (w == F.lower(w)))
        return F.when(~one, w).when(bare.isin("II", "III", "IV", "V"), F.upper(w)).otherwise(_mc(_capital(w)))

    return F.array_join(F.transform(words(c), recase), " ")


def title_case(c: Column) -> Column:
    """Title case for texts that shout; others, and null, pass."""
    shouts = c.rlike("[A-Z]") & ~c.rlike("[a-z]")
    runs = F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z'-]*|[^A-Za-z]+)"), F.lit(1))
    keep = F.array(*map(F.lit, rules.KEEP_UPPER))
    return F.when(shouts, F.array_join(F.transform(runs, lambda w: F.when(F.array_contains(keep, F.upper(w)), F.upper(w)).otherwise(_mc(_capital(w)))), "")).otherwise(c)


def normalize_name(c: Column) -> Column:
    """Lower case, ``+`` and ``&`` as "and", punctuation as space, abbreviations spelt out."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(trim_ws(c)), r"[+&]", " and "), r"(?U)[^\w\s]", " ")

    def spell(w: Column) -> Column:
        out = F
        for short, full in rules.ABBREVIATIONS.items():
            out = out.when(w == short, full)
        return out.otherwise(w)

    return F.array_join(F.transform(words(plain), spell), " ")


def strip_stopwords(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(rules.STOPWORDS)), " ")


def acronym(c: Column) -> Column:
    """First letters of a normalised name's words but stop words."""
    return F.array_join(F.transform(F.filter(words(c), lambda w: ~w.isin(rules.STOPWORDS)), lambda w: F.substring(w, 1, 1)), "")


def clean_title(c: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(c, r"(?i)\s*\bsend\s+(?:a\s+)?message\b.*$", ""), rules.EMAIL, ""))


def valid_title(c: Column) -> Column:
    """A short job title without page furniture."""
    ok = lambda c: (c != "") & (F.length(c) <= 100) & ~c.rlike("(?i)" + rules.TITLE_JUNK) & (F.size(words(c)) <= 12) & (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) <= 1)
    return F.coalesce(let(c, ok), F.lit(False))


def valid_name(c: Column) -> Column:
    """Two to five name-like words and nothing of a menu or a notice."""
    from quillon.functions.classify import is_art

    def ok(c: Column, w: Column, bare: Column) -> Column:
        shouted = F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(F.regexp_replace(x, r"^[.,]+|[.,]+$", "")) >= 2)))
        nav = F.exists(bare, lambda x: let(F.lower(x), lambda y: y.isin(rules.NAV_WORDS) | F.regexp_replace(y, "s$", "").isin(rules.NAV_WORDS)))
        shape = F.forall(w, lambda x: x.rlike(r"^[A-Z][A-Za-z]*(?:['\-][A-Z][A-Za-z]*)*\.?$"))
        return F.size(w).between(2, 5) & (F.length(c) <= 60) & ~c.rlike(r"[0-9&/:@|]") & shape & ~is_art(c) & let(shouted, lambda n: (n == 0) | (n == F.size(w))) & ~nav

    bare = lambda w: F.transform(w, lambda x: F.regexp_replace(x, r"^[.,]+|[.,]+$", ""))
    return F.coalesce(let(c, lambda c: let(words(c), lambda w: let(bare(w), lambda b: ok(c, w, b)))), F.lit(False))


def split_name_title(line: Column) -> Column:
    """struct(name, title) of a line like "Name, Title"; null unless the name is valid."""
    pair = lambda p: F.struct(trim_ws(F.get(p, F.lit(0))).alias("name"), trim_ws(F.get(p, F.lit(1))).alias("title"))
    whole = lambda p: F.when(F.size(p) == 2, let(pair(p), lambda x: F.when((x["title"] != "") & valid_name(x["name"]), x)))
    return let(F.split(line, r"\s*,\s*|\s*:\s*|\s+[-–—]\s+", 2), whole)


def last_first(c: Column) -> Column:
    """"Last, First" as "First Last"; anything else as it is."""
    parts = lambda c: F.struct(trim_ws(F.substring_index(c, ",", 1)).alias("a"), trim_ws(F.regexp_extract(c, r"^[^,]*,(.*)$", 1)).alias("b"))
    turn = lambda c: let(parts(c), lambda p: F.when((p["a"] != "") & (p["b"] != ""), F.concat(p["b"], F.lit(" "), p["a"])).otherwise(c))
    return let(c, lambda c: F.when(c.contains(","), turn(c)).otherwise(c))


def display_title(c: Column) -> Column:
    """Each run of letters with its first in upper case and the others in lower case, whatever case it had."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def table_row(line: Column) -> Column:
    """struct(name, title) of a tab-separated row of two or more cells; null if either is not valid."""
    pair = lambda cells: F.struct(last_first(F.get(cells, F.lit(0))).alias("name"), clean_title(F.get(cells, F.lit(1))).alias("title"))
    whole = lambda cells: F.when(F.size(cells) >= 2, let(pair(cells), lambda x: F.when(valid_title(x["title"]) & valid_name(x["name"]), x)))
    return let(F.filter(F.transform(F.split(line, r"\t+"), trim_ws), lambda x: x != ""), whole)


def table_rows(lines: Column) -> Column:
    """All rows of a table's lines; none unless two or more are valid."""
    return let(F.filter(F.transform(lines, table_row), lambda x: x.isNotNull()), lambda found: F.when(F.size(found) >= 2, found).otherwise(F.slice(found, 1, 0)))


def campus_tag(title: Column) -> Column:
    """A trailing abbreviation, else a leading place, of a title; null for most."""
    t = trim_ws(title)
    tail = F.regexp_extract(t, r"^(.+?)\s*-\s*([A-Z]{2,6}[a-z]?)$", 2)
    head = F.regexp_extract(t, r"^([A-Z][A-Za-z']+(?:\s+[A-Z][A-Za-z']+)?)\s*-\s*(.+)$", 1)
    return F.coalesce(F.nullif(tail, F.lit("")), F.nullif(head, F.lit("")))


def tag_matches(tag: Column, school: Column) -> Column:
    """Whether a campus tag may stand for a school: part of a word of it, or its initials."""
    w = F.filter(F.regexp_extract_all(F.coalesce(school, F.lit("")), F.lit("([A-Za-z']+)"), F.lit(1)), lambda x: F.length(x) > 2)
    t = F.lower(tag)
    part = F.exists(w, lambda x: F.lower(x).contains(t) | t.contains(F.lower(x)))
    return (F.size(w) > 0) & (part | (t == F.lower(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))))


def email_matches_name(email: Column, name: Column) -> Column:
    """Whether an address's letters hold the first or last name, or initial and name."""
    local = F.lower(F.regexp_replace(F.substring_index(email, "@", 1), "[^A-Za-z]", ""))
    w = F.filter(F.transform(words(name), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z]", ""))), lambda x: x != "")
    ends = let(w, lambda w: F.struct(F.try_element_at(w, F.lit(1)).alias("first"), F.try_element_at(w, F.lit(-1)).alias("last")))

    def ok(local: Column, first: Column, last: Column) -> Column:
        has = lambda x: (F.length(x) >= 3) & local.contains(x)
        return (local != "") & (has(last) | has(first) | (local == F.concat(F.substring(first, 1, 1), last)) | (local == F.concat(first, F.substring(last, 1, 1))))

    return F.coalesce(let(local, lambda x: let(ends, lambda e: ok(x, e["first"], e["last"]))), F.lit(False))
