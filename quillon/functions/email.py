"""E-mail addresses: decoding, choice and candidates.  A candidate never counts as verified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions.bind import let

FULL = rf"^(?:{rules.EMAIL})\z"
def _found(email: Column, source: str) -> Column:
    return let(email, lambda e: F.when(e.isNotNull() & (e != ""), F.struct(e.alias("email"), F.lit(source).alias("source"))))


def cf_decode(hexed: Column) -> Column:
    """An address that is XOR-ed with its first byte, in hex; null if it isn't one."""
    byte = lambda h, at: F.conv(h.substr(at, F.lit(2)), 16, 10).cast("int")
    places = lambda h: F.sequence(F.lit(3), F.length(h) - 1, F.lit(2))
    text = lambda h: let(byte(h, F.lit(1)), lambda key: F.array_join(F.transform(places(h), lambda at: F.char(byte(h, at).bitwiseXOR(key))), ""))
    decoded = let(F.regexp_replace(hexed, r"\s", ""), lambda h: F.when(h.rlike(r"^(?:[0-9a-fA-F]{2}){2,}$"), text(h)))
    return let(decoded, lambda t: F.when(t.rlike(FULL), t))


def munge_decode(text: Column, compat: bool = False) -> Column:
    """struct(email, source) of a plain or spelt-out address."""
    p = rules.COMPAT if compat else rules.STRICT

    def read(t: Column) -> Column:
        plain = F.regexp_extract(t, f"({rules.EMAIL})", 1)
        spelt = F.when(t.rlike(p), F.concat(F.regexp_extract(t, p, 1), F.lit("@"), F.regexp_extract(t, p, 2), F.lit("."), F.regexp_extract(t, p, 3)))
        at = F.when(t.rlike(rules.AT_ONLY), F.concat(F.regexp_extract(t, rules.AT_ONLY, 1), F.lit("@"), F.regexp_extract(t, rules.AT_ONLY, 2)))
        return F.coalesce(_found(plain, "MAILTO"), _found(spelt, "JS_DECODED"), _found(at, "JS_DECODED"))

    return let(F.regexp_replace(text, "[​‌‍﻿]", ""), read)


def onclick_decode(c: Column) -> Column:
    """An address in a click handler: a mailto literal, else its quoted parts put together."""
    mail = F.regexp_extract(c, rf"(?i)mailto:({rules.EMAIL})", 1)
    joined = F.array_join(F.regexp_extract_all(c, F.lit("""['"]([^'"]*)['"]"""), F.lit(1)), "")
    joined = F.regexp_replace(joined, "(?i)^mailto:", "")
    return F.coalesce(F.nullif(mail, F.lit("")), F.when(joined.rlike(FULL), joined))


def resolve_email(link: Column, hexed: Column, text: Column, compat: bool = False) -> Column:
    """struct(email, source): a link's address, else a decoded one, else the link as it is without a source."""
    mail = let(F.regexp_replace(F.regexp_replace(link, "(?i)^mailto:", ""), r"\?.*$", ""), lambda x: F.when(x.rlike(FULL), x))
    raw = F.when(link.isNotNull() & (link != ""), F.struct(link.alias("email"), F.lit(None).cast("string").alias("source")))
    return F.coalesce(_found(mail, "MAILTO"), _found(cf_decode(hexed), "CF_DECODED"), munge_decode(text, compat), raw)


def resolution_method(email: Column) -> Column:
    return F.when(email.isNull() | (email == ""), "unresolved").when(email.startswith("http"), "send_message_button").otherwise("scraped")


def name_parts(name: Column) -> tuple[Column, Column]:
    """First and last name in lower case; null for a blank name."""
    w = F.filter(F.split(F.lower(name), r"(?U)\s+"), lambda x: x != "")
    return F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(-1))


def candidates(first: Column, last: Column, domain: Column) -> Column:
    """Seven addresses in the order in which they are tried; none if a part is missing."""
    at = lambda *p: F.concat(*p, F.lit("@"), domain)
    f, i = first, F.substring(first, 1, 1)
    all_of = F.array(at(f, F.lit("."), last), at(i, last), at(f, last), at(f, F.substring(last, 1, 1)), at(last, i), at(f), at(last))
    return F.when((F.coalesce(f, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "") & (F.coalesce(domain, F.lit("")) != ""), all_of).otherwise(F.array().cast("array<string>"))


def five_candidates(first: Column, last: Column, domain: Column) -> Column:
    """The first five of the seven forms, without those of one name alone."""
    return F.slice(candidates(first, last, domain), 1, 5)


def reverse_text(c: Column) -> Column:
    """Text that is written backwards and turned by a style, in reading order."""
    return F.reverse(c)


def first_of_name(found: Column, name: Column) -> Column:
    """The first address of an array that fits a name; null for none."""
    from quillon.functions.text import email_matches_name

    return F.get(F.filter(found, lambda x: email_matches_name(x, name)), F.lit(0))


def contact_label(method: Column, email: Column) -> Column:
    web = method.isin("send_message_button", "contact_form") | email.startswith("http")
    return F.when(F.coalesce(web, F.lit(False)), "contact on website").otherwise(F.coalesce(email, F.lit("")))


def spelt_out(text: Column, compat: bool = False) -> Column:
    """Spelt-out addresses of a page's text: array of ``email`` and ``before``, the 200 characters in front.

    "at" and "dot" need brackets or white space on both sides; with ``compat`` bare letters do.
    """
    form = rules.SPELT_OUT if compat else rules.SPELT_OUT_STRICT
    hits = F.regexp_extract_all(text, F.lit(f"({form})"), F.lit(1))
    # The pieces between hits give the hits' places.
    step = F.transform(F.arrays_zip(F.slice(F.split(text, form), 1, F.size(hits)).alias("piece"), hits.alias("hit")), lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["hit"]).alias("n"), x["hit"].alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<hit:string,at:int>>").alias("out"))
    placed = F.aggregate(step, start, lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["hit"].alias("hit"), (a["at"] + x["gap"]).alias("at")))).alias("out")))["out"]
    if compat:
        mail = lambda h: F.regexp_replace(F.regexp_replace(h, r"(?iU)\s*\[?at\]?\s*", "@"), r"(?iU)\s*\[?dot\]?\s*", ".")
    else:
        mail = lambda h: F.regexp_replace(F.regexp_replace(h, r"(?iU)\s*[\[(]at[\])]\s*|\s+at\s+", "@"), r"(?iU)\s*[\[(]dot[\])]\s*|\s+dot\s+", ".")
    return F.transform(placed, lambda x: F.struct(mail(x["hit"]).alias("email"), F.substring(text, F.greatest(x["at"] - 199, F.lit(1)), F.least(x["at"], F.lit(200))).alias("before")))


def align(emails: Column, rows: Column) -> Column:
    """The addresses where there is one for each row, else a null for each."""
    return F.when(F.size(emails) == F.size(rows), emails).otherwise(F.transform(rows, lambda _: F.lit(None).cast("string")))
