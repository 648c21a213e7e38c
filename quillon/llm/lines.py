"""Line dedup by distinct-site spread.

Each line is known by a 128-bit hash.  HyperLogLog sketches of the sites of a line merge
by aggregation.  Lines whose estimate is within the sketch's error of the threshold get
an exact distinct count.  Of a line that at least ``sites`` sites share, the
least document keeps its copy; all others lose theirs.  All steps are DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import store
from quillon.llm.store import small, unused

#: log2 of a sketch's registers; the estimate's relative standard error is about 1.04 / sqrt(2**12).
LG_K, ERROR = 12, 0.0163
SITES = 5


def known() -> Column:
    """The hash that tells the rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def exploded(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``source``, ``k`` (place in its document), ``a`` and ``b`` (hash) of each line that isn't blank."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), known().alias("h"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    line = F.trim(F.translate("line", "\t\r", "  "))
    return lines.select("doc_id", "h", "source", "k", line.alias("line")).filter("line <> ''").select("doc_id", "h", "source", "k", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def occurrences(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """The rows of ``lines`` whose line ``sites`` or more sites have, with ``keep_doc``, the least document that has it.

    One pass merges the sketches.  A second one gathers the occurrences of the lines whose
    estimate may reach the threshold, and counts the close ones' sites exactly.
    """
    margin = max(1.0, 5 * ERROR * sites)
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_K))).alias("about"), F.min("doc_id").alias("keep_doc"))
    maybe = store.materialize(sketched.filter(F.col("about") >= sites - margin), "line-candidates")
    found = store.materialize(lines.join(small(maybe), ["a", "b"]), "line-occurrences")
    close = found.filter(F.col("about") <= sites + margin)
    exact = close.groupBy("a", "b", "source").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") < sites).select("a", "b")
    return found.join(small(store.materialize(exact, "line-rejects")), ["a", "b"], "left_anti")


def dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The rows of ``docs`` with ``text`` less widespread lines, and ``n_removed``.

    The least document that has such a line keeps it; all others lose it.  Lines compare
    without spaces, tabs and carriage returns at their ends; blank lines stay.  Null
    sources are one site, null texts stay null, and a text whose lines all go becomes
    empty.  A document is known by its id and its text's hash: rows that repeat both lose the
    same places, and rows of one id (or of none) with different texts their own.
    """
    found = occurrences(exploded(docs), sites).filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    d, h, g, x = (unused([*docs.columns, "n_removed"], c) for c in ("doc", "known", "gone", "lines"))
    gone = found.select("doc_id", "h", "k").distinct().groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.collect_list("k").alias(g))
    gone = store.materialize(gone, "lines-gone")
    same = (known() == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    # The list grows with the documents: only where it is small do texts stay where they are.
    out = docs.join(small(gone), same, "left").withColumn(x, F.when(F.col(g).isNotNull(), F.split("text", "\n")))
    # The places that are left, in order; a column of lines, as an expression would be split anew for each place.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(g)), lambda k: F.get(F.col(x), k))
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.concat_ws("\n", left))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_removed"))
