"""Titles: disciplines, roles out of scope, schools of the arts, grade levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions.bind import let


def strip_excludes(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + "|".join(rules.EXCLUDE_PHRASES), " ")


def classify(title: Column, department: Column | None = None) -> Column:
    """struct(is_art, discipline, matched_term): the first term of the list that occurs."""
    both = F.concat_ws(" ", title, department) if department is not None else F.coalesce(title, F.lit(""))

    def first(text: Column) -> Column:
        out = F.lit(None).cast("struct<discipline:string,matched_term:string>")
        for pattern, name in reversed(rules.DISCIPLINES):
            whole = rf"(?i)\b({pattern})\b"
            out = F.when(text.rlike(whole), F.struct(F.lit(name).alias("discipline"), F.regexp_extract(text, whole, 1).alias("matched_term"))).otherwise(out)
        return out

    return let(let(strip_excludes(both), first), lambda x: F.struct(x.isNotNull().alias("is_art"), F.coalesce(x["discipline"], F.lit("unknown")).alias("discipline"), x["matched_term"].alias("matched_term")))


def is_art(c: Column) -> Column:
    return strip_excludes(F.coalesce(c, F.lit(""))).rlike(r"(?i)\b(" + "|".join(p for p, _ in rules.DISCIPLINES) + r")\b")


def excluded_role(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + rules.EXCLUDED_ROLE), F.lit(False))


def arts_school(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + rules.ARTS_SCHOOL), F.lit(False))


def grade(c: Column) -> Column:
    """A grade as a number: kindergarten 0; before it, ungraded and unreadable -1."""
    g = F.upper(F.trim(c))
    return F.when(g.isin("PK", "P", "PR", "UN"), -1).when(g.isin("KG", "K"), 0).otherwise(F.coalesce(F.try_to_number(F.when(g.rlike("^[0-9]{1,3}$"), g), F.lit("999")).cast("int"), F.lit(-1)))


def middle_or_high(level: Column, high: Column, name: Column) -> Column:
    """Whether a school has any of the grades 6 to 12, by level, highest grade, then name; unknown: yes."""
    lv, hi = F.lower(F.trim(F.coalesce(level, F.lit("")))), F.trim(F.coalesce(high, F.lit("")))
    n = F.lower(F.coalesce(name, F.lit("")))
    by_level = F.when(lv.isin("2", "3"), True).when(lv == "1", False).when(lv.rlike("middle|high|secondary"), True).when(lv.rlike("elementary|primary|prekindergarten"), False)
    by_grade = F.when((hi != "") & (grade(hi) >= 6), True).when((hi != "") & (grade(hi) >= 0), False)
    return F.coalesce(by_level, by_grade, ~n.rlike(r"\b(elementary|primary|elem\b|primaria|pre.?k)\b"))
