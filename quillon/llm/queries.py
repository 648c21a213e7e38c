"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, htmltext, licenses, lines, pieces, quality, secrets, simhash, topk, toxicity

#: The folder of public tokenizer files.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(folder: str = TOKENIZERS) -> bytes:
    """The driver's copy of the SentencePiece model."""
    with open(f"{folder}/piece_bpe_32k.model", "rb") as f:
        return f.read()


def fold(n: int, rest: int) -> Column:
    """Whether a row of ``doc_id`` is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    d = quality.classify(table(spark, sf_dir, "documents"), known, fold(3, 1))
    return d.select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    d = toxicity.classify(table(spark, sf_dir, "documents"), known, fold(4, 2))
    return d.select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), piece_model())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spans")
    text = lambda x: F.array_join(F.transform(x, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(s, lambda e: e["kind"] == k)).cast("long")
    base = text(F.filter(s, lambda e: e["kind"] != "literal"))
    d = secrets.scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), text(s).alias("spans"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(v.filter("vec_id % 20 = 0"), v)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a tree of directories by source and number, every 25th document a licence file."""
    i = F.col("doc_id")
    name = F.when(i % 25 == 0, "LICENSE").otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 25 % 40").cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(as_files(table(spark, sf_dir, "documents"))).select("doc_id", "path", "license", "cosine", "origin")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_quality, op3_line_dedup, op4_simhash, op5_html, op6_toxicity, op7_sentencepiece, op8_secrets, op9_topk, op10_licenses)
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT CAST(item_id AS STRING) AS item_id, array_to_string(w[s:s + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM w WHERE len(w) > 0)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM i))),
m AS (SELECT doc_id, s, g.n, item_id FROM g JOIN i ON g.g = i.g AND g.n = i.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
n AS (SELECT *, trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) AS t FROM l),
m AS (SELECT t, min(doc_id) AS keep FROM n WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {lines.SITES}),
o AS (SELECT doc_id, count(*) - count(*) FILTER (gone) AS n_kept, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text FROM (SELECT doc_id, k, line, coalesce(m.keep <> doc_id, false) AS gone FROM n LEFT JOIN m ON n.t = m.t) GROUP BY doc_id)
SELECT doc_id, n_removed, CAST(length(text) AS BIGINT) AS n_left, sha256(text) AS text_sha256 FROM o""",
    "op9_topk": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) WHERE rank <= 20""",
}
