"""Idempotent writes as snapshot rewrites: insert-ignore, update by key, delete, recase."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.operators.merge import first_wins


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``, in its order and types; what is missing is null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def insert_ignore(have: DataFrame, new: DataFrame, keys: list[str], order: list[str | Column], limit: int | None = None) -> DataFrame:
    """The rows of ``new`` to append: the first of each key that ``have`` lacks; of these the first ``limit``."""
    fresh = first_wins(new, keys, order).join(have.select(*keys), keys, "left_anti")
    return fresh.orderBy(*order).limit(limit) if limit else fresh


def update(have: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``have`` with ``columns`` of the rows whose key is in ``changes``, which has each key once."""
    new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = have.join(new, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in have.columns])


def update_where(have: DataFrame, where: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """``have`` with columns set where the condition holds, and a table of the number of rows set."""
    hit = F.coalesce(where, F.lit(False))
    out = have.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in have.columns])
    return out, have.agg(F.count_if(hit).alias("changed"))


def parse_ids(text: str) -> list[int]:
    """Ids of a comma-separated list; what isn't digits is ignored.  None: a bad request."""
    ids = [int(x) for x in (p.strip() for p in text.split(",")) if x.isdigit()]
    if not ids:
        raise ValueError("no valid id")
    return ids


def delete_cascade(schools: DataFrame, staff: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schools without those of ``ids`` (id), and staff without theirs."""
    gone = ids.select(F.col("id").alias("school_id"))
    return schools.join(ids.select("id"), "id", "left_anti"), staff.join(gone, "school_id", "left_anti")


def recase(rows: DataFrame, column: str, keys: list[str], fix: Callable[[Column], Column], drop: bool) -> DataFrame:
    """Recase ``column``; where the new key exists already, drop the row, or else leave it as it was.

    A row whose case is right comes before others of its key; then the smallest id does.
    """
    w = Window.partitionBy(*keys, "_new").orderBy(F.col(column) != F.col("_new"), "id")
    out = rows.withColumn("_new", fix(F.col(column))).withColumn("_n", F.row_number().over(w))
    if drop:
        return out.filter("_n = 1").withColumn(column, F.col("_new")).drop("_new", "_n")
    return out.withColumn(column, F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.col(column))).drop("_new", "_n")
