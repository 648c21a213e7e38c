"""Ordered merging of contact rows and other first-wins operators.

Spark has no row order of its own: all of these take explicit order columns.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_contacts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Merge rows of one person in one district and state, in the order of ``order``.

    School names and cities are distinct, sorted and joined.  Title, e-mail, method and
    addresses come together from the first row with an e-mail, else the first row.  All
    aggregates combine before the shuffle, but for the ids of a group.
    """
    ord_ = F.struct(*order)
    best = F.struct(F.coalesce(F.col("email") == "", F.lit(True)).alias("none"), ord_.alias("o"))
    together = ["title", "email", "resolution_method", "website_url", "directory_url"]
    names = lambda c: F.concat_ws(", ", F.sort_array(F.collect_set(F.nullif(c, F.lit("")))))
    g = rows.groupBy("teacher_name", "district_name", "state").agg(
        names("school_name").alias("school_name"), names("city").alias("_cities"), F.min_by("city", ord_).alias("_city"), F.min_by(F.struct(*together), best).alias("b"),
        F.transform(F.sort_array(F.collect_list(F.struct(ord_.alias("o"), F.col("id").alias("id")))), lambda x: x["id"]).alias("ids"), F.min(ord_).alias("first_seen"),
    )
    return g.select("teacher_name", "district_name", "state", "school_name", F.when(F.col("_cities") == "", F.col("_city")).otherwise(F.col("_cities")).alias("city"), *[F.col(f"b.{c}").alias(c) for c in together], "ids", "first_seen")


def first_wins(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page(rows: DataFrame, order: list[str | Column], number: int, size: int = 50) -> DataFrame:
    """One page of sorted rows; pages start from 1, smaller numbers count as 1."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def context(lines: DataFrame, keys: list[str], at: str, before: int, after: int) -> DataFrame:
    """``context``: each line with those around it, joined by line feeds."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(w), "\n"))


def added_cutoff(value: str | None, now: datetime) -> str | None:
    """The least ``added_at`` text for today, week, month or a date; None (no filter) for anything else."""
    now = now.astimezone(UTC)
    if value == "today":
        at = now.replace(hour=0, minute=0, second=0, microsecond=0)
    elif value in ("week", "month"):
        at = now - timedelta(days=7 if value == "week" else 30)
    else:
        try:
            at = datetime.fromisoformat(value or "")
        except ValueError:
            return None
    return at.isoformat()


def since(rows: DataFrame, cutoff: str | None, column: str = "added_at") -> DataFrame:
    """Rows added at the cutoff or later, compared as times; as texts where a row's isn't a time."""
    if cutoff is None:
        return rows
    t = F.try_to_timestamp(column)
    return rows.filter(F.when(t.isNotNull(), t >= F.to_timestamp(F.lit(cutoff))).otherwise(F.col(column) >= cutoff))
