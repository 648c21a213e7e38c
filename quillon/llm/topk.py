"""Exact top-k inner products by a three-phase uniform threshold.

Candidates are dealt to blocks.  Phase 1 gathers from each block a short list of its
best entries for each query; the k-th best of all lists is a score that at least k
candidates reach, so it is a safe cutoff.  Phase 2 sends the cutoff to the blocks whose
list was too short to tell: those whose last entry still reaches it.  Only they are asked
again, for their further entries that reach the cutoff.  Phase 3 resolves what was
collected by exact scores and ids.

Scores are integers of any size: double products decide where their rounding error can't
matter, and what is left is multiplied in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm import store

_ROWS = 256
_LONG = 2**63


def quantize(df: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id`` and ``v``, floor(scale * x) of each component, as doubles, which hold these whole numbers exactly.

    Rows whose id or vector is null, or whose vector holds a component that is null or not
    finite (scaled, too), are left out.  Repeated rows of one id and vector count once.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda e: F.rint(e * scale) - F.when(F.rint(e * scale) > e * scale, 1.0).otherwise(0.0))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < float("inf")))
    # Adding zero makes -0.0 zero, so that equal vectors are equal rows.
    return df.filter(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select(F.col("vec_id").cast("long"), F.transform(whole, lambda e: e + 0.0).alias("v")).distinct()


def _key(score: int) -> str:
    """What orders scores beyond a long, whose clipped values are equal: larger scores have larger keys."""
    if -_LONG <= score < _LONG:
        return "" if score >= 0 else "~"
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}" + "".join(chr(57 - int(c) + 48) for c in digits)


def _vectors(t: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: (row numbers, matrix)."""
    col = t.column(name).combine_chunks()
    start = col.offsets.to_numpy()
    n, flat = np.diff(start), col.values.to_numpy()
    return {int(k): (i := np.flatnonzero(n == k), flat[start[i][:, None] + np.arange(k)]) for k in np.unique(n)}


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each row of ``q``: (row, places, scores) of its ``k`` best rows of ``c``, by score and then id; ``ids`` ascend."""
    with np.errstate(over="ignore", invalid="ignore"):
        about = q @ c.T
        size = np.abs(q).max(axis=1, initial=0)[:, None] * np.abs(c).max(axis=1, initial=0)[None, :] * q.shape[1]
        # Below 2**53 no product or sum is rounded; the bound of the error is generous.
        error = np.where(size < 2.0**53, 0.0, size * 2.0**-52 * (q.shape[1] + 2))
        odd = ~(np.isfinite(about) & np.isfinite(error))
    about[odd], error[odd] = 0.0, np.inf
    for n in range(len(q)):
        mine = np.flatnonzero(ids != own[n])
        low, high = about[n, mine] - error[n, mine], about[n, mine] + error[n, mine]
        if len(mine) > k:
            mine = mine[high >= np.partition(low, len(mine) - k)[len(mine) - k]]
        if error[n, mine].any():
            row = [int(x) for x in q[n]]
            score = [sum(a * int(b) for a, b in zip(row, c[m])) for m in mine]
        else:
            score = about[n, mine].astype(np.int64).tolist()
        order = sorted(range(len(mine)), key=lambda m: -score[m])[:k]  # stable: ids ascend
        yield n, [int(mine[m]) for m in order], [score[m] for m in order]


def _block(depth: int, past: int):
    """Entries of a block for its queries: the ``depth`` best, without the first ``past``; of them those that reach ``cut``, where given."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "key": [], "cb": [], "last": []}
        if left.num_rows and right.num_rows:
            qid, cid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            cb = right.column("cb")[0].as_py()
            by = _vectors(right, "v")
            for length, (i, q) in _vectors(left, "q").items():
                if length not in by:
                    continue
                j, c = by[length]
                order = np.argsort(cid[j], kind="stable")
                j, c = j[order], c[order]
                for lo in range(0, len(i), _ROWS):
                    part = i[lo : lo + _ROWS]
                    for n, at, score in _best(q[lo : lo + _ROWS], c, cid[j], qid[part], depth):
                        more = past == 0 and len(at) == depth
                        for r in range(past, len(at)):
                            out["query_id"].append(int(qid[part[n]]))
                            out["vec_id"].append(int(cid[j[at[r]]]))
                            out["score"].append(min(max(score[r], -_LONG), _LONG - 1))
                            out["key"].append(_key(score[r]))
                            out["cb"].append(cb)
                            out["last"].append(more and r == depth - 1)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.string()), ("cb", pa.int32()), ("last", pa.bool_())]))

    return run


_ENTRY = "query_id long, vec_id long, score long, key string, cb int, last boolean"


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 2048, block: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` best candidates, all if there are fewer.

    Both tables hold ``vec_id`` and ``v`` (whole numbers as doubles).  A query's own id is
    no candidate.  Ties go to the smaller id; vectors of another length than the query's
    are no candidates of it.  Scores are compared exactly, and shown held at a long's
    ends.  Of equal vectors, which tie with every query, only the first ``k`` + 1 ids can
    come up, so no others are dealt.  An empty table of either kind gives no rows.
    """
    spark = candidates.sparkSession
    store.workers(spark)
    queries = store.materialize(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    same = Window.partitionBy("v").orderBy("vec_id")
    few = candidates.select("vec_id", "v").withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    candidates = store.materialize(few, "candidates")
    nq, nc = -(-queries.count() // query_block), max(-(-candidates.count() // block), spark.sparkContext.defaultParallelism)
    if not nq:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    # Twice a block's fair share of the k best, so that few blocks are asked again.
    depth = min(k, 2 + 2 * k // nc)
    cell = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    held = candidates.select("vec_id", "v", cell("vec_id", nc, 1).alias("cb"))
    asked = queries.withColumn("qb", cell("query_id", nq, 2))
    right = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).groupBy("cb", "qb")

    first = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).groupBy("cb", "qb").cogroup(right).applyInArrow(_block(depth, 0), _ENTRY)
    first = store.materialize(first, "lists")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    top = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    if depth < k:
        # A list whose last entry is among the k best so far may lack entries that reach the cutoff.
        short = store.materialize(top.filter("last").select("query_id", "cb"), "short-lists")
        again = store.materialize(asked.join(short, "query_id"), "asked-again")
        cells = store.materialize(again.select("cb", "qb").distinct(), "cells")
        more = again.groupBy("cb", "qb").cogroup(held.join(cells, "cb").select("vec_id", "v", "cb", "qb").groupBy("cb", "qb")).applyInArrow(_block(k, depth), _ENTRY)
        cut = top.filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("s"), F.col("key").alias("t"))
        more = more.join(cut, F.col("query_id") == F.col("id"), "left").filter(F.col("s").isNull() | (F.col("score") > F.col("s")) | (F.col("score") == F.col("s")) & (F.col("key") >= F.col("t")))
        top = top.drop("r").unionByName(more.drop("id", "s", "t")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    return top.select("query_id", F.col("r").alias("rank"), "vec_id", "score")
