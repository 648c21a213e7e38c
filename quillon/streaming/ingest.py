"""Streaming upserts of school payloads, idempotent by key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.functions import email, text
from quillon.operators.shared import keep
from quillon.operators.upsert import conform, insert_ignore

SCHOOL = "nces_id string, school_name string, city string, state string, district_name string, website_url string, school_level string, is_arts_school boolean"
RECORD = "name string, title string, email string, discipline string, email_source string, email_verified boolean, evidence_url string, extraction_strategy string"
RESOLUTION = "entity_type string, parent_entity string, parent_entity_type string, resolution_confidence double, resolution_note string, domain string, needs_human_review boolean"


def _struct(fields: str) -> str:
    return f"struct<{', '.join(p.replace(' ', ':', 1) for p in fields.split(', '))}>"


PAYLOAD = f"school {_struct(SCHOOL)}, status string, directory_url string, paths_attempted array<struct<url:string,status:string,rejected_because:string>>, resolution {_struct(RESOLUTION)}, records array<{_struct(RECORD)}>"
#: Columns of a school that every payload sets anew; the others are those of the first one.
SET = ["entity_type", "parent_entity", "parent_entity_type", "resolution_confidence", "resolution_note", "domain", "needs_human_review", "directory_url", "paths_attempted", "status", "scrape_status", "scraped"]
BUCKETS = 64


def schools_of(payloads: DataFrame) -> DataFrame:
    """Schools of payloads with an id, blank names empty, states in upper case; ``ord`` tells their order."""
    s = payloads.select("ord", "school.*", "resolution.*", "directory_url", F.to_json(F.coalesce("paths_attempted", F.from_json(F.lit("[]"), payloads.schema["paths_attempted"].dataType)), {"ignoreNullFields": "false"}).alias("paths_attempted"), F.coalesce("status", F.lit("")).alias("status"))
    s = s.withColumn("nces_id", F.trim("nces_id")).filter(F.coalesce("nces_id", F.lit("")) != "")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return s.withColumns({"school_name": F.coalesce("school_name", F.lit("")), "state": F.upper(F.coalesce("state", F.lit(""))), "is_arts_school": flag("is_arts_school"), "needs_human_review": flag("needs_human_review"), "scrape_status": F.col("status"), "scraped": F.lit(1)})


def merge_schools(have: DataFrame, payloads: DataFrame) -> DataFrame:
    """``have`` with the schools of payloads: new ones by their first payload, and what payloads set by the last one."""
    new = schools_of(payloads)
    rest = [c for c in new.columns if c not in ("ord", "nces_id", *SET)]
    last = new.groupBy("nces_id").agg(F.min_by(F.struct(*rest), "ord").alias("first"), F.max_by(F.struct(*SET), "ord").alias("set"))
    j = conform(have, new.drop("ord").schema).join(last.withColumnRenamed("nces_id", "id"), F.col("nces_id") == F.col("id"), "full")
    old = F.col("nces_id").isNotNull()
    return j.select(F.coalesce("nces_id", "id").alias("nces_id"), *[F.when(old, F.col(c)).otherwise(F.col(f"first.{c}")).alias(c) for c in rest], *[F.when(F.col("set").isNotNull(), F.col(f"set.{c}")).otherwise(F.col(c)).alias(c) for c in SET])


def merge_staff(have: DataFrame, payloads: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``have`` with the new staff of payloads, the first of each school and name, and the rows ``nces_id``, ``saved`` that were added."""
    rows = staff_of(payloads).withColumn("added_at", now)
    old = conform(have, rows.drop("ord", "pos").schema)
    fresh = insert_ignore(old, rows, ["nces_id", "teacher_name"], ["ord", "pos"]).drop("ord", "pos")
    return old.unionByName(fresh), fresh.groupBy("nces_id").agg(F.count("*").alias("saved"))


def staff_of(payloads: DataFrame) -> DataFrame:
    """Staff of payloads, recased before the key is formed; blank names are left out."""
    r = payloads.select("ord", F.trim("school.nces_id").alias("nces_id"), F.posexplode("records").alias("pos", "r")).select("ord", "nces_id", "pos", "r.*")
    r = r.filter((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.coalesce("nces_id", F.lit("")) != ""))
    r = r.withColumn("email_verified", F.coalesce("email_verified", F.lit(False)).cast("int"))
    return r.withColumn("teacher_name", text.person_name(F.trim("name"))).withColumn("resolution_method", email.resolution_method(F.col("email"))).drop("name")


def run(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read JSON payloads from a folder and write schools and staff below ``target``, all that is there at once.

    The tables are dealt to buckets by id; a batch reads and rewrites only the buckets that
    it has payloads for.  A batch that is written again changes nothing.  Payloads of one
    batch count in the order of their files' times and names.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
        batch = keep(batch.withColumn("ord", F.struct("ord.t", "ord.f", F.monotonically_increasing_id().alias("n"))), "payloads")
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        # At most BUCKETS numbers.
        touched = [r[0] for r in batch.select(bucket(F.trim("school.nces_id")).alias("b")).filter("b IS NOT NULL").distinct().collect()]

        def have(name: str, like: DataFrame) -> DataFrame:
            try:
                return spark.read.schema(StructType([*like.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{target}/{name}").filter(F.col("bucket").isin(touched)).drop("bucket")
            except AnalysisException as e:  # the first batch: nothing is there
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                return like.limit(0)

        def write(name: str, rows: DataFrame) -> None:
            keep(rows.withColumn("bucket", bucket("nces_id")), name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{target}/{name}")

        write("schools", merge_schools(have("schools", schools_of(batch).drop("ord")), batch))
        write("staff", merge_staff(have("staff", staff_of(batch).withColumn("added_at", now).drop("ord", "pos")), batch, now)[0])

    order = F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"))
    stream = spark.readStream.schema(PAYLOAD).json(source)
    return stream.select("*", order.alias("ord")).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
