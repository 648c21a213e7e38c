"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, document, position) in the shared folder.  A
search takes the windows of the test items, intersects the offset-adjusted lists of
each window's two rarest terms, and then asks the remaining terms' lists only for what
is left.  All steps are DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import store
from quillon.llm.store import small, unused

# Fixed value: what parts words, as a character class.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


@dataclass(frozen=True)
class Index:
    """``postings``: t (term number), doc_id, h (hash of the text), p (position).  ``terms``: term, t.

    A document's end is posted as term -1 at the position after its last word, so that
    the index knows all lengths, that of empty documents too.
    """

    postings: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, wanted: DataFrame | None = None) -> Index:
    """Post the words of all rows of ``docs``; of ``wanted`` (a table of ``term``) only, where given.

    A document is known by its id and its text's hash, so that rows of one id with
    different texts stay apart and repeated rows count once.  Null ids are kept.
    """
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("p", "term"))
    if wanted is None:
        wanted = key.select("term").filter("term <> ''")
    numbered = wanted.select("term").filter("term <> ''").distinct().withColumn("t", F.xxhash64("term").bitwiseAND(F.lit((1 << 62) - 1)))
    terms = store.materialize(numbered.unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("t"))), "terms")
    return Index(store.materialize(key.join(small(terms), "term").select("t", "doc_id", "h", "p"), "postings"), terms)


def windows(items: DataFrame, length: int = 10) -> DataFrame:
    """``item_id``, ``s`` (first word's place), ``n`` (words), ``w`` (the words) of each window of the items.

    An item of fewer words than ``length``, but not none, is one window.
    """
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))
    w = w.select("item_id", "w", F.explode(starts).alias("s"))
    return w.select("item_id", "s", F.slice("w", F.col("s") + 1, F.lit(length)).alias("w")).withColumn("n", F.size("w"))


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """Every occurrence of a phrase: ``phrase``, ``doc_id``, ``h``, ``at`` (first word's position).

    ``phrases``: ``phrase`` (the key, of any type) and ``w`` (its words).  A phrase with a term
    that is posted nowhere has no occurrence.
    """
    posted = index.postings.filter("t >= 0")
    asked = store.materialize(phrases.select("phrase", F.size("w").alias("n"), F.posexplode("w").alias("o", "term")).join(small(index.terms), "term").select("phrase", "n", "o", "t"), "asked")
    # One row for each term: broadcast where that is small, so that frequent terms of the phrases meet no single task.
    count = store.materialize(posted.groupBy("t").agg(F.count("*").alias("c")), "term-counts")
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("c", "o"))
    ranked = asked.join(small(count), "t").withColumn("r", rank)
    whole = ranked.groupBy("phrase", "n").agg(F.count("*").alias("have")).filter("have = n").select("phrase")
    ranked = store.materialize(ranked.join(whole, "phrase"), "ranked")
    # The lists of the two rarest terms, adjusted by their offsets, meet where both bits are set.
    rare = small(ranked.filter("r <= 2").select("t", "phrase", "o", "r", F.when(F.col("n") == 1, 1).otherwise(3).alias("full")))
    lists = posted.join(rare, "t").filter("p >= o").select("phrase", "doc_id", "h", (F.col("p") - F.col("o")).alias("at"), F.col("r").alias("bit"), "full")
    met = lists.groupBy("phrase", "doc_id", "h", "at").agg(F.bit_or("bit").alias("bits"), F.max("full").alias("full")).filter("bits = full")
    met = store.materialize(met.select("phrase", "doc_id", "h", "at"), "met")
    # The other terms' lists are asked only in the documents and at the places that are left.
    rest = met.join(small(ranked.filter("r > 2").select("phrase", "o", "t", "n")), "phrase").select("phrase", "doc_id", "h", "at", (F.col("at") + F.col("o")).alias("p"), "t", "n")
    held = small(met.select("doc_id", "h").distinct())
    near = posted.join(held, (posted["h"] == held["h"]) & posted["doc_id"].eqNullSafe(held["doc_id"]), "left_semi").select("doc_id", "h", "p", "t")
    good = rest.select("doc_id", "h", "p", "t").intersect(near).select(F.col("doc_id").alias("d"), F.col("h").alias("k"), F.col("p").alias("q"), F.col("t").alias("u"))
    sure = rest.join(good, (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("p") == F.col("q")) & (F.col("t") == F.col("u")))
    sure = sure.groupBy("phrase", "doc_id", "h", "at", "n").agg(F.count("*").alias("c")).filter("c = n - 2").select("phrase", "doc_id", "h", "at")
    short = met.join(small(ranked.filter("n <= 2").select("phrase").distinct()), "phrase", "left_semi")
    return sure.unionAll(short)


def proximity_matches(index: Index, phrases: DataFrame, slop: int = 20) -> DataFrame:
    """Places near which all terms of a phrase stand: ``phrase``, ``doc_id``, ``h``, ``at``.

    ``at`` is a position of the phrase's rarest term with each other term of the phrase
    within ``slop`` words before or after it.
    """
    posted = index.postings.filter("t >= 0")
    asked = phrases.select("phrase", F.explode(F.array_distinct("w")).alias("term")).join(index.terms, "term", "left").select("phrase", "t")
    count = posted.groupBy("t").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(F.col("c").asc_nulls_first(), "t"))
    ranked = asked.join(count, "t", "left").withColumn("r", rank)
    need = ranked.groupBy("phrase").agg(F.count("*").alias("need"), F.count("c").alias("have")).filter("need = have").select("phrase", "need")
    ranked = store.materialize(ranked.join(need, "phrase"), "ranked")
    step = F.floor(F.col("p") / slop).cast("long")
    first = posted.join(small(ranked.filter("r = 1").select("phrase", "t", "need")), "t").select("phrase", "doc_id", "h", F.col("p").alias("at"), "need", F.explode(F.array(step - 1, step, step + 1)).alias("cell"))
    other = posted.join(small(ranked.filter("r > 1").select("phrase", "t")), "t").select("phrase", F.col("doc_id").alias("d"), "h", "p", "t", step.alias("cell"))
    near = first.join(other, ["phrase", "h", "cell"]).filter(F.col("doc_id").eqNullSafe(F.col("d")) & (F.abs(F.col("p") - F.col("at")) <= slop))
    near = near.groupBy("phrase", "doc_id", "h", "at", "need").agg(F.count_distinct("t").alias("c")).filter("c = need - 1")
    alone = first.filter("need = 1").select("phrase", "doc_id", "h", "at").distinct()
    return near.select("phrase", "doc_id", "h", "at").unionAll(alone)


def _hits(docs: DataFrame, items: DataFrame, length: int) -> tuple[Index, DataFrame]:
    """The index, and ``d``, ``k`` (a document's id and hash), ``n_hit``, ``items`` of documents with hits."""
    win = windows(items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text"), length)
    # 128 bits, so that no two windows are taken for one.
    key = F.concat(F.hex(F.xxhash64("w")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "w")))
    win = store.materialize(win.withColumn("phrase", key), "windows")
    distinct = win.groupBy("phrase").agg(F.first("w").alias("w"))
    index = build_index(docs, win.select(F.explode("w").alias("term")))
    found = store.materialize(phrase_matches(index, distinct), "found")
    size = store.materialize(win.select("phrase", "n").distinct(), "phrases")
    owner = store.materialize(win.select("phrase", "item_id").distinct(), "owners")
    key = ["doc_id", "h"]
    # Words are hit by phrases, whatever number of items has them; a document has a phrase once, however often it occurs.
    hit = found.join(small(size), "phrase").select(*key, F.explode(F.expr("sequence(at, at + n - 1)")).alias("p")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    of = found.select(*key, "phrase").distinct().join(small(owner), "phrase").select(*key, "item_id").distinct().groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    same = (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    got = store.materialize(hit.join(of, same).select("d", "k", "n_hit", "items"), "hits")
    return index, got


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted array of item ids as strings) for each row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``length`` consecutive item
    words.  Null and empty texts have no words.  Repeated rows give repeated results;
    repeated items count once; items without an id or words have no window.  An empty
    table of items leaves all documents clean.
    """
    index, got = _hits(docs, items, length)
    ends = index.postings.filter("t = -1").select("doc_id", "h", F.col("p").cast("long").alias("n_words"))
    same = (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    out = ends.join(small(got), same, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, with all their columns.

    Null and empty texts have no words and stay; repeated rows stay or go together; rows of
    one id with different texts, and rows without an id, stand for themselves.  An empty
    table of items leaves all rows, and an empty table of documents gives none.
    """
    bad = _hits(docs, items, length)[1]
    d, k = (unused(docs.columns, x) for x in ("doc", "known"))
    same = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    return docs.join(small(bad.select(F.col("d").alias(d), F.col("k").alias(k))), same, "left_anti")
