"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words lose ASCII case and punctuation.  Coordinates tell whether a word, a pair of
neighbours or a pair with one or two words between them occurs at all.  As insults are
inflected and compounded, so do coordinates for the beginnings of longer words, and for
beginnings that two or more different words share.  Values shrink slowly with length, as
long texts hold more words by chance.  Rates are kept for each coordinate, and the L1
term leaves few non-zero weights to broadcast.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import ftrl, store

SETTINGS = ftrl.Settings(rows=16000, epochs=5, alpha=0.7, beta=1.0, l1=2.5, l2=0.5)
#: Lower case; everything in ASCII but letters, digits and the apostrophe parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 39 or chr(c).isalnum() else 32 for c in range(256))
_WORD = ftrl.Ids(lambda w: xxhash.xxh64_intdigest(w, 1))
#: Characters in a word's beginning; only longer words have one.
HEADS = (5, 6, 7, 8)
#: Texts of so many words have values of 1, or of more if they are shorter.
_EVEN = 30


_NONE = bytes(8 * len(HEADS))


class _Heads(dict):
    """Word -> the 64-bit ids of its beginnings as bytes, 0 for none; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most = most
        store.caches("ftrl", self.clear)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) <= HEADS[0]:
            return _NONE
        s = word.decode("utf-8", "replace")
        n = len(s)
        x = b"".join([xxhash.xxh64_intdigest(s[:k].encode(), k).to_bytes(8, "little") if n > k else bytes(8) for k in HEADS])
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = x
        return x


_HEADS = _Heads()


def features(text: bytes, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a UTF-8 text; an empty one has the bias alone."""
    words = text.translate(_FOLD).split()
    ids = _WORD.of(words)
    at = [ftrl.slots(ids, (), 1), ftrl.slots(ids, (1,), 2), ftrl.slots(ids, (2,), 3), ftrl.slots(ids, (3,), 4)]
    different = list(dict.fromkeys(words))
    ids_of = np.frombuffer(b"".join(map(_HEADS.__getitem__, different)), dtype="<u8").reshape(-1, len(HEADS))
    for j, k in enumerate(HEADS):
        heads, n = np.unique(ids_of[:, j], return_counts=True)
        at += [ftrl.slots(heads[heads > 0], (), 10 + k), ftrl.slots(heads[(heads > 0) & (n > 1)], (), 20 + k)]
    at = np.concatenate(at)
    i = np.unique(at if live is None else at[live[at]])
    x = np.full(len(i) + 1, (max(1, len(words)) / _EVEN) ** -0.25)
    x[0] = 1  # the bias
    return np.concatenate([np.zeros(1, dtype=np.int64), i]), x


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, settings: ftrl.Settings = SETTINGS, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` (likelihood of label 1), ``predicted`` for each row of ``docs``.

    ``labels`` has ``doc_id`` and ``label``; only those that ``held_out`` is not true of
    are learnt from.  Null and empty texts are scored by the bias alone.  Repeated rows
    give repeated results, and an empty table gives none; without labels all scores are 0.5.
    """
    known = labels if held_out is None else labels.filter(~held_out)
    w = ftrl.train(docs, known, features, settings)
    return ftrl.score(docs, w, features).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
