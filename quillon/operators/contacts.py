"""Contacts on captured directory pages: five ranked ways to find them, merged by page and matched to staff.

Captured ``elements`` have ``school_id``, ``page_ord`` (the page's place among the
school's), ``page_url``, ``pos`` (the element's place on its page), ``kind``, ``href``,
``label`` (visible text, value or label attribute), ``email`` (data attribute) and
``container`` (text of the card, row or block around it; for ``kind`` body, the page's
text).  Kinds: mailto, button, link, data, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import email, rules, text
from quillon.operators import match, upsert
from quillon.operators.merge import first_wins


def _key(name: Column) -> Column:
    """Words in lower case between single spaces; null for none."""
    return F.nullif(F.array_join(text.words(F.lower(name)), " "), F.lit(""))


def _line(c: Column, last: bool = False) -> Column:
    """The first or last line that isn't blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"), text.trim_ws), lambda x: x != "")
    return F.get(lines, F.size(lines) - 1 if last else F.lit(0))


def page_contacts(elements: DataFrame, compat: bool = False) -> DataFrame:
    """``school_id``, ``page_ord``, ``name`` (normalised), ``value``, ``method``, ``rank``, ``pos``, ``k``: of a name on a page, the first.

    Better ranks come first, then places.  Addresses must begin like one; elements without
    a name nearby give none; null texts count as empty.
    """
    address = text.trim_ws(F.substring_index(F.regexp_replace("href", "(?i)^mailto:", ""), "?", 1))
    valid = lambda c: c.rlike(f"^(?:{rules.EMAIL})")
    # A link's own address counts even when it isn't a valid one.
    place = F.coalesce(F.nullif(F.col("href"), F.lit("")), F.col("page_url"))
    mail = F.col("href").startswith("mailto:")
    kind = lambda *k: F.col("kind").isin(*k)
    found = lambda ok, rank, name, value, method: F.when(F.coalesce(ok, F.lit(False)), F.array(F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("k"), _key(name).alias("name"), value.alias("value"), method.alias("method"))))
    none = F.array().cast("array<struct<rank:int,k:int,name:string,value:string,method:string>>")
    label = F.array_join(text.words(F.col("label")), " ")
    data = text.trim_ws(F.col("email"))
    near = F.transform(email.spelt_out(F.coalesce("container", F.lit("")), compat), lambda x, i: F.struct(F.lit(5).alias("rank"), i.alias("k"), _key(_line(x["before"], last=True)).alias("name"), x["email"].alias("value"), F.lit("email").alias("method")))
    ways = [
        found(kind("mailto") & valid(address), 1, _line(F.col("container")), address, F.lit("email")),
        found(kind("button"), 2, F.regexp_extract(label, rules.MESSAGE_TO, 1), F.col("page_url"), F.lit("send_message_button")),
        found(kind("mailto", "link", "button") & F.col("label").rlike(rules.CONTACT_TEXT), 3, _line(F.col("container")), F.when(mail, address).otherwise(place), F.when(mail, "email").otherwise("send_message_button")),
        found(kind("data") & valid(data), 4, _line(F.col("container")), data, F.lit("email")),
        F.when(kind("body"), near),
    ]
    rows = elements.select("school_id", "page_ord", "pos", F.explode(F.concat(*[F.coalesce(w, none) for w in ways])).alias("c")).select("school_id", "page_ord", "pos", "c.*").filter("name IS NOT NULL")
    return first_wins(rows, ["school_id", "page_ord", "name"], ["rank", "pos", "k"])


def school_contacts(contacts: DataFrame) -> DataFrame:
    """``school_id``, ``cid``, ``name``, ``value``, ``method``: of a name on several pages, the last page's; ``cid`` counts names as first seen."""
    at = F.struct("page_ord", "rank", "pos", "k")
    g = contacts.groupBy("school_id", "name").agg(F.max_by(F.struct("value", "method"), "page_ord").alias("c"), F.min(at).alias("at"))
    w = Window.partitionBy("school_id").orderBy("at", "name")
    return g.select("school_id", F.row_number().over(w).alias("cid"), "name", "c.value", "c.method")


def contact_updates(staff: DataFrame, elements: DataFrame) -> DataFrame:
    """``id``, ``email``, ``resolution_method``, ``how`` for each row of ``staff`` (``id``, ``school_id``, ``teacher_name``) with a contact.

    The same name first; else the first contact that shares two words, or the only one.
    """
    found = school_contacts(page_contacts(elements))
    asked = staff.select(F.col("id").alias("tid"), "school_id", F.col("teacher_name").alias("name"))
    hit = match.match_contacts(asked, found).join(asked.select("tid", "school_id"), "tid")
    return hit.join(found.select("school_id", "cid", "value", "method"), ["school_id", "cid"]).select(F.col("tid").alias("id"), F.col("value").alias("email"), F.col("method").alias("resolution_method"), "how")


def check_contacts(staff: DataFrame, schools: DataFrame, elements: DataFrame, states: list[str], limit: int | None = None, reset: bool = False) -> DataFrame:
    """``staff`` with the contacts found for its rows in ``states``.

    Rows without an address are looked up, with ``reset`` all; ``limit`` takes the first
    ones by school and id.
    """
    here = schools.filter(F.col("state").isin(*states)).select(F.col("id").alias("school_id"))
    todo = staff.join(here, "school_id", "left_semi")
    if not reset:
        todo = todo.filter(F.coalesce(F.col("email"), F.lit("")) == "")
    if limit:
        todo = todo.orderBy("school_id", "id").limit(limit)
    return upsert.update(staff, contact_updates(todo, elements), "id", ["email", "resolution_method"])
