"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader updates.

Words are read in two ways: as they stand, and by their shape (runs of upper-case,
lower-case, digits; punctuation as it is).  A word that repeats one of the four before
it has a shape of its own, so that looping text shows whatever its words are.
Coordinates hold an n-gram's share of the text, so that scores don't depend on length.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import ftrl, store

SETTINGS = ftrl.Settings(rows=8000, epochs=6, alpha=0.5, beta=1.0, l1=0.1, l2=0.01)
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def _shape(word: bytes) -> int:
    s = word.decode("utf-8", "replace")
    s = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in s)
    return xxhash.xxh64_intdigest(_RUN.sub(r"\1", s).encode(), 2)


_WORD = ftrl.Ids(lambda w: xxhash.xxh64_intdigest(w, 1))
_SHAPE = ftrl.Ids(_shape)
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(text: bytes, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a UTF-8 text; an empty one has the bias alone."""
    words = text.split()
    ids, shapes = _WORD.of(words), _SHAPE.of(words)
    again = np.zeros(len(ids), dtype=bool)
    for k in range(1, min(5, len(ids))):
        again[k:] |= ids[k:] == ids[:-k]
    shapes = np.where(again, _REPEAT, shapes)
    idx, val = [np.zeros(1, dtype=np.int64)], [np.ones(1)]
    for views in ([ftrl.slots(ids, (), 1), ftrl.slots(ids, (1,), 2)], [ftrl.slots(shapes, (), 3), ftrl.slots(shapes, (1,), 4), ftrl.slots(shapes, (1, 2), 5)]):
        for at in views:
            if all_of := len(at):
                i, n = np.unique(at if live is None else at[live[at]], return_counts=True)
                x = np.sqrt(n / all_of)
                idx.append(i)
                val.append(x)
    i, x = np.concatenate(idx), np.concatenate(val)
    u, where = np.unique(i, return_inverse=True)
    return u, np.bincount(where, weights=x, minlength=len(u))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, settings: ftrl.Settings = SETTINGS, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``score`` (likelihood of label 1), ``predicted`` for each row of ``docs``.

    ``labels`` has ``doc_id`` and ``label``; only those that ``held_out`` is not true of
    are learnt from.  Null and empty texts are scored by the bias alone.  Repeated rows
    give repeated results, and an empty table gives none; without labels all scores are 0.5.
    """
    known = labels if held_out is None else labels.filter(~held_out)
    w = ftrl.train(docs, known, features, settings)
    return ftrl.score(docs, w, features).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, with a score of ``threshold`` or more, learnt from all of ``labels``.

    Null and empty texts are scored by the bias alone; repeated rows stay or go together;
    an empty table gives none, and without labels every row stays.
    """
    w = ftrl.train(docs, labels, features, settings)
    name = store.unused(docs.columns, "score")
    return ftrl.score(docs, w, features, tuple(docs.columns), threshold, name).drop(name)
