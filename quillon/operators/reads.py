"""Reads with optional filters: pages of rows with their total, and the sheets made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import email
from quillon.operators import merge


def all_of(*clauses: Column | None) -> Column:
    """The conjunction of the clauses that are given; true for none.  Null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in clauses if c is not None], F.lit(True))


def like(term: str | None, *columns: str) -> Column | None:
    """Any of the columns holds the term, in either case; the term's % and _ are wildcards.  No term, no clause."""
    term = (term or "").strip()
    if not term:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns])


def in_state(state: str | None) -> Column | None:
    return F.col("state") == state.upper() if state else None


def school_rows(schools: DataFrame, state: str | None = None, search: str | None = None, only_url: bool = False) -> DataFrame:
    return schools.filter(all_of(in_state(state), like(search, "school_name", "city", "district_name"), F.col("website_url").isNotNull() if only_url else None))


def schools_page(schools: DataFrame, page: int = 1, state: str | None = None, search: str | None = None, only_url: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of schools by name and id, and a table of the one number of all of them, ``total``."""
    rows = school_rows(schools, state, search, only_url)
    return merge.page(rows, ["school_name", "id"], page), rows.agg(F.count("*").alias("total"))


def teacher_rows(staff: DataFrame, schools: DataFrame, state: str | None = None, search: str | None = None, only_email: bool = False, added: str | None = None) -> DataFrame:
    """Staff with their schools, filtered; ``added`` is the least text time of :func:`merge.added_cutoff`."""
    s = schools.select(F.col("id").alias("school_id"), "school_name", "city", "state", "district_name", "website_url", "directory_url")
    rows = staff.join(s, "school_id").filter(all_of(in_state(state), like(search, "teacher_name", "school_name", "city"), F.col("email") != "" if only_email else None))
    return merge.since(rows, added) if added else rows


def teachers_page(staff: DataFrame, schools: DataFrame, page: int = 1, **filters) -> tuple[DataFrame, DataFrame]:
    """A page of merged contacts, as they are first seen by state, school and name, and their ``total``."""
    g = merge.group_contacts(teacher_rows(staff, schools, **filters), ["school_name", "teacher_name", "id"])
    g = g.withColumn("_school", F.col("first_seen.school_name"))
    return merge.page(g, ["state", "_school", "teacher_name", "district_name"], page).drop("_school", "first_seen"), g.agg(F.count("*").alias("total"))


def teachers_sheet(staff: DataFrame, schools: DataFrame, state: str | None = None, only_email: bool = False) -> DataFrame:
    """The merged contacts' nine columns as a sheet shows them; columns 3 and 9 hold addresses.

    The page that someone was found on comes before the school's own, also where it is an empty text.
    """
    g = merge.group_contacts(teacher_rows(staff, schools, state, None, only_email), ["school_name", "teacher_name", "id"])
    place = F.coalesce(F.nullif(F.col("directory_url"), F.lit("")), F.nullif(F.col("website_url"), F.lit("")), F.lit(""))
    names = {"teacher_name": "Teacher Name", "title": "Title"}
    out = g.orderBy("state", "first_seen", "teacher_name", "district_name")
    return out.select(*[F.col(c).alias(n) for c, n in names.items()], email.contact_label(F.col("resolution_method"), F.col("email")).alias("Email"), F.coalesce("resolution_method", F.lit("")).alias("Contact Method"), F.col("school_name").alias("School"), F.col("city").alias("City"), F.col("state").alias("State"), F.col("district_name").alias("District"), place.alias("School Website"))


def sheet_name(state: str | None) -> str:
    return f"art_teachers{'_' + state.upper() if state else ''}.xlsx"
