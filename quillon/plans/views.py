"""Stand-in tables: schools, staff and page snapshots made from the test tables.

Each view is a mapping of columns to expressions that Spark and ANSI SQL share, so
that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["ANNA LINDQVIST", "Bruno Ashford", "carla mcdowell", "Dev Patterson-Hale", "Elise O'Rourke", "FELIX VAN DOREN III", "Greta Holm", "Hugo Marsh", "Ines Calloway", "Jonas Reed", "Kira Stone", "Lars Whitcombe"]
TITLES = ["Visual Arts Teacher", "Language Arts Teacher", "Band Director", "Ceramics Instructor", "Special Education Teacher", "Fine Arts Teacher", "Digital Media Teacher", "Landry - Art", "Art Teacher - FJH", "Math Teacher", "Theatre Arts Teacher", "Photography Teacher", "Art Teacher. Send a Message", "Studio Art and Dance"]


def pick(key: str, values: list[str]) -> str:
    """A CASE that picks a value by a key's remainder."""
    whens = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {whens} END"


SCHOOLS = {
    "id": "s_suppkey",
    "nces_id": "lpad(CAST(s_suppkey AS STRING), 12, '0')",
    "school_name": "concat(s_name, CASE s_suppkey % 5 WHEN 0 THEN ' School of the Arts' WHEN 1 THEN ' Middle School' WHEN 2 THEN ' Design Academy' ELSE ' High School' END)",
    "state": "n_name",
    "district_name": "r_name",
    "city": "concat('City ', CAST(s_nationkey % 4 AS STRING))",
    "website_url": "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN concat('www.school', CAST(s_suppkey AS STRING), '.example.org') ELSE concat('https://www.school', CAST(s_suppkey AS STRING), '.example.org/home') END",
    "directory_url": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('https://school', CAST(s_suppkey AS STRING), '.example.org/staff') END",
    "scraped": "CAST(s_suppkey % 2 AS INT)",
    "scrape_status": "CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN 'OK' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'robots_blocked' WHEN 3 THEN 'error: page closed' WHEN 4 THEN 'NO_TEACHERS_LISTED' ELSE NULL END",
    "is_arts_school": "CAST(CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 5 = 2 THEN 1 ELSE 0 END AS INT)",
    "level": "CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '2' WHEN 1 THEN 'Elementary' WHEN 2 THEN '' ELSE 'High' END",
    "high_grade": "CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '05' WHEN 1 THEN '12' ELSE 'KG' END",
    "open_status": "CASE CAST(s_suppkey % 9 AS INT) WHEN 0 THEN 'Closed' WHEN 1 THEN '1' WHEN 2 THEN '' ELSE 'Open' END",
}
STAFF = {
    "id": "c_custkey",
    "school_id": "c_custkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier)",
    "teacher_name": pick("c_custkey", NAMES),
    "title": pick("c_custkey", TITLES),
    "email": "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('person', CAST(c_custkey AS STRING), '@example.org') WHEN 3 THEN concat('https://example.org/contact/', CAST(c_custkey AS STRING)) ELSE concat('alindqvist', CAST(c_custkey % 11 AS STRING), '@example.org') END",
    "resolution_method": "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'scraped' WHEN 3 THEN 'send_message_button' ELSE 'hunter' END",
    "added_at": "concat('2024-0', CAST(c_custkey % 9 + 1 AS STRING), '-15T08:00:00')",
}
FROM = {"schools": "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "staff": "customer"}


def _select(columns: dict[str, str], name: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {FROM[name]}"


def with_views(sql: str, *extra: str) -> str:
    """SQL with the views (and further WITH parts) before it."""
    return ", ".join([f"WITH schools AS ({_select(SCHOOLS, 'schools')})", f"staff AS ({_select(STAFF, 'staff')})", *extra]) + " " + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark(e: str) -> str:
    return e.replace("''", "\\'") if "O''" in e else e


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(*[F.expr(_spark(e)).alias(c) for c, e in SCHOOLS.items()])


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("_n"), F.min("s_suppkey").alias("_min"))
    j = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))  # one row
    return j.select(*[F.expr("c_custkey % _n + _min" if c == "school_id" else _spark(e)).alias(c) for c, e in STAFF.items()])
