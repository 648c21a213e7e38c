"""Logistic regression over hashed features, trained by follow-the-regularised-leader updates.

Texts become sparse rows of a fixed number of hashed coordinates.  Training keeps
one learning rate for each coordinate and an L1 term that leaves most weights
exactly zero, so that the broadcast weights have a fixed upper size: at most
``2**BITS`` coordinates of 12 bytes.  Scores are sparse dot products.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import store

BITS = 20
_SHIFT = np.uint64(64 - BITS)
#: Odd 64-bit multipliers, one for each place in an n-gram.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

#: (text, live) -> coordinates, values.  ``live`` tells which coordinates matter (None: all);
#: others may be left out, which changes no dot product with weights that are zero there.
Features = Callable[[bytes, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``coordinates`` bound the labelled sample that one task trains on: so many texts, and as many non-zero coordinates in all of them (4 to 8 bytes each)."""

    rows: int = 8000
    coordinates: int = 40_000_000
    epochs: int = 6
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0


def slots(ids: np.ndarray, gaps: tuple[int, ...], salt: int) -> np.ndarray:
    """Hashed coordinates of the n-grams of ``ids`` that hold the places 0 and ``gaps``; 0 is kept for the bias."""
    span = gaps[-1] if gaps else 0
    n = len(ids) - span
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = ids[:n] * MIX[0]
    for k, g in enumerate(gaps):
        h = (h ^ (h >> np.uint64(29))) * MIX[1] + ids[g : g + n] * MIX[k % 3 + 1]
    h = (h ^ np.uint64(salt * 0x9E3779B1)) * MIX[2]
    h = (h ^ (h >> np.uint64(32))) * MIX[0]
    return np.maximum((h >> _SHIFT).astype(np.int64), 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights after ``s.epochs`` passes over (coordinates, values, label) in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    w0 = lambda i: np.where(np.abs(z[i]) <= l1[i > 0], 0.0, -(z[i] - np.sign(z[i]) * l1[i > 0]) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    class _L1:
        def __getitem__(self, notbias):
            return np.where(notbias, s.l1, 0.0)

    l1 = _L1()
    for _ in range(s.epochs):
        for i, x, y in rows:
            w = w0(i)
            p = 1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35)))
            g = (p - y) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g2
    return w0(np.arange(1 << BITS))


def train(docs: DataFrame, labels: DataFrame, features: Features, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights (coordinates, values) learnt from the rows of ``labels`` (doc_id, label).

    Of the labelled ids, the ``s.rows`` with the smallest hashes are taken, up to the one
    with which they exceed ``s.coordinates``; their whole texts are used.  Null labels and ids are left out; an id with several rows counts
    once, by its largest label.  No labelled rows: no weights, and every score is 0.5.
    """
    spark = docs.sparkSession
    store.workers(spark)
    few = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.rows)

    def rows(batches):
        store.enter("ftrl")
        for b in batches:
            at = [features(t or b"", None) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in at], pa.binary()), pa.array([b"" if (x == 1).all() else x.astype("<f4").tobytes() for _, x in at], pa.binary())], ["doc_id", "label", "i", "x"])

    # Broadcast: at most s.rows rows of two numbers.
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).join(F.broadcast(few), "doc_id").select("doc_id", "label", "text").mapInArrow(rows, "doc_id long, label int, i binary, x binary")

    made = store.materialize(made, "features")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most s.rows rows of two numbers, so that one task may add them up.
    sizes = made.groupBy("doc_id").agg(F.sum(F.length("i") / 4).alias("n")).withColumn("sum", F.sum("n").over(order))
    made = made.join(F.broadcast(sizes.filter(F.col("sum") <= s.coordinates).select("doc_id")), "doc_id", "left_semi")

    def learn(batches):
        got = {}
        for b in batches:
            for d, y, i, x in zip(*(c.to_pylist() for c in b.columns)):
                got[(d, i, x)] = (np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4") if x else np.float32(1), y)
        if not got:
            return
        order = sorted(got, key=lambda k: (hash_of(k[0]), k[1], k[2]))
        w = fit([got[k] for k in order], s)
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w[i])], ["i", "w"])

    w = made.repartition(1).mapInArrow(learn, "i int, w double").toPandas()
    return w["i"].to_numpy(np.int64), w["w"].to_numpy(np.float64)


def hash_of(x: int) -> int:
    """A fixed shuffle of integers."""
    return (x * 0x9E3779B97F4A7C15 ^ (x >> 7)) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], features: Features, columns: tuple[str, ...] = ("doc_id",), least: float | None = None, name: str = "score") -> DataFrame:
    """``columns`` and ``name``, the sparse dot product through the logistic function, for each row of ``docs``.

    ``least``: leave out rows with a lower score.  The rows pass through the scoring task
    whole, so that no join is needed to go on with them.
    """
    spark = docs.sparkSession
    store.workers(spark)
    shared = spark.sparkContext.broadcast((weights[0].astype(np.int32), weights[1].astype(np.float32)))
    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = T.StructType([docs.schema[c] for c in columns]).add(name, "double")

    def run(batches):
        store.enter("ftrl")
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        live = w != 0
        for b in batches:
            s = np.empty(b.num_rows)
            for k, t in enumerate(b.column("text").cast(pa.binary())):
                i, x = features(t.as_py() or b"", live)
                s[k] = w[i] @ x
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s)], [*columns, name])
            yield out if least is None else out.filter(pa.array(s >= least))

    return docs.mapInArrow(run, schema)


class Ids(dict):
    """Word -> 64-bit id, kept between calls; emptied when it holds ``most`` words, and long ones aren't kept, so memory stays bounded."""

    def __init__(self, make: Callable[[bytes], int], most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most
        store.caches("ftrl", self.clear)

    def __missing__(self, word: bytes) -> int:
        if len(word) > 64:
            return self.make(word)
        if len(self) >= self.most:
            self.clear()
        x = self[word] = self.make(word)
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
