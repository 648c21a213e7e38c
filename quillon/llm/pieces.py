"""SentencePiece encoding and decoding as a weighted transducer.

The normaliser (white space to its mark, a mark before the text), the pieces and the
byte fallback are compiled into one transducer.  A text composed with it gives a
lattice: its states are (place, last piece), its arcs are pieces.  A piece may follow
another exactly if the two, merged anew from their characters by score, come out as
the same two; other arcs have infinite weight, all others the weight one, and a
character without a piece costs one for each of its bytes.  The shortest path in the
tropical semiring is then the encoding that repeated merging of the best-scored
neighbours gives, which the model's own library computes.

As no piece has a mark after another character, the lattice falls apart before each
run of marks; the shortest paths of its parts are kept for reuse.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import store

MARK = "▁"
INF = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            x = b[i]
            i += 1
            v |= (x & 127) << shift
            shift += 7
            if x < 128:
                return v

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            value = b[i : i + n]
            i += n
        yield key >> 3, value


@dataclass
class Transducer:
    """A compiled model: :meth:`encode` and :meth:`decode` texts."""

    words: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool = True
    kept: int = 120_000
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {w: i for i, (w, k) in enumerate(zip(self.words, self.kinds)) if k in (NORMAL, USER)}
        self._trie: dict = {}  # a node has the nodes that follow by character, and its own piece's (length, id) under ""
        for word, i in self.ids.items():
            node = self._trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (len(word), i)
        self.fallback = {int(w[3:5], 16): i for i, (w, k) in enumerate(zip(self.words, self.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.raw = [bytes([int(w[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else w.replace(MARK, " ").encode() for w, k in zip(self.words, self.kinds)]
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", w) for w in self.ids)
        self.rank = [-x for x in self.scores]
        self._follows: dict[int, dict[int, bool]] = {}  # by last piece, then by the piece that follows
        self._met = 0
        self._near: dict[str, tuple[list, dict | None]] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._paths: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # what was kept before; what is used again moves on

    @classmethod
    def load(cls, model: bytes) -> Transducer:
        """Compile a serialised model.  Only the identity normaliser is supported."""
        words, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                words.append(f.get(1, b"").decode())
                scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(f.get(3, NORMAL))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("the model has a character map; only the identity normaliser is supported")
                if f.get(4, 1):
                    raise ValueError("the model removes white space; only models that keep it are supported")
                prefix = bool(f.get(3, 1))
        return cls(words, scores, kinds, prefix)

    def merge(self, text: str, stop: int = 0) -> list[str]:
        """The pieces of a short text by repeated merging of the best-scored neighbours, leftmost first.

        ``stop``: don't make a piece of that many characters.
        """
        s: list[str | None] = list(text)
        right = list(range(1, len(s) + 1))
        left = list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(s) and (p := self.ids.get(w := s[i] + s[j])) is not None:
                heapq.heappush(heap, (-self.scores[p], i, w))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, w = heapq.heappop(heap)
            if len(w) == stop:
                break
            if s[i] is None or (j := right[i]) >= len(s) or s[i] + s[j] != w:
                continue
            s[i], s[j] = w, None
            right[i] = right[j]
            if right[j] < len(s):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x in s if x is not None]

    def halves(self, piece: int) -> tuple[int, int]:
        """The two pieces whose merge gives ``piece`` when its characters are merged; (-1, -1) if it is one character.

        (-2, -2): merging its characters gives another result, so no path has it.
        """
        x = self._halves.get(piece)
        if x is None:
            word = self.words[piece]
            done = self.merge(word)
            if len(word) == 1:
                x = (-1, -1)
            elif len(done) > 1:
                x = (-2, -2)
            else:
                two = self.merge(word, stop=len(word))
                x = (self.ids[two[0]], self.ids[two[1]])
            self._halves[piece] = x
        return x

    def follows(self, a: int, b: int) -> bool:
        """Whether the arc of piece ``b`` may leave a state whose last piece is ``a`` (-1: none).

        It may if no merge across the border comes up while the two are merged from
        their characters.  The merges at the border are gone through backwards: ``top``
        is the rank that a merge across the border must beat, ties going to the left one.
        """
        if self.halves(b)[0] == -2:
            return False
        if a < 0:
            return True
        words, ids, rank = self.words, self.ids, self.rank
        top, tie = INF, False
        while True:
            c = ids.get(words[a] + words[b])
            if c is not None and (rank[c] < top or tie and rank[c] == top):
                return False
            left, right = self.halves(a)[1], self.halves(b)[0]
            if left < 0 and right < 0:
                return True
            if right < 0 or left >= 0 and rank[a] > rank[b]:
                top, tie, a = rank[a], False, left
            else:
                top, tie, b = rank[b], True, right

    def near(self, head: str) -> tuple[list, dict | None]:
        """The (length, id) of all pieces that ``head``, three characters or a text's last ones, begins with, and the node after it.

        The longest come first.  No node: no longer piece begins so.  What is kept is dropped when it grows large.
        """
        if len(self._near) > self.kept // 4:
            self._near.clear()
        node, arcs = self._trie, []
        for c in head:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                arcs.append(node[""])
        x = self._near[head] = (arcs[::-1], node if node and len(node) > ("" in node) else None)
        return x

    def shortest(self, text: str) -> list[int]:
        """The ids on the shortest path through the lattice of a normalised text.

        Pieces of which every two neighbours come out as they are when the two are merged
        come out of the whole text's merges, as the first merge across a border would have
        crossed it in that pair, too.  So all paths of finite weight to a place are one, and
        the first that gets to the end is the shortest.  States are gone through depth
        first, by the longest arcs; one that leads nowhere isn't entered again.
        """
        n, ids, follows = len(text), self.ids, self.follows
        if self._met > 4 * self.kept:
            self._follows.clear()
            self._met = 0
        rows, near, dead = self._follows, self._near, set()
        i, last, way, path = 0, -1, [], []  # the states before this one with the arcs not tried yet, and the piece of each arc taken
        arcs = None
        while i < n:
            if arcs is None:
                few, node = near.get(head := text[i : i + 3]) or self.near(head)
                if node is not None:
                    more, j = [], i + 3
                    while j < n and (node := node.get(text[j])) is not None:
                        j += 1
                        if "" in node:
                            more.append(node[""])
                    if more:
                        few = more[::-1] + few
                arcs = iter(few if text[i] in ids else [*few, (1, -1)])
            row = rows.get(last)
            if row is None:
                row = rows[last] = {-1: True}
            for size, p in arcs:
                ok = row.get(p)
                if ok is None:
                    ok = row[p] = follows(last, p)
                    self._met += 1
                if ok and (not dead or (i + size, p) not in dead):
                    way.append((i, last, arcs))
                    path.append(p)
                    i, last, arcs = i + size, p, None
                    break
            else:
                dead.add((i, last))
                i, last, arcs = way.pop()
                path.pop()
        if -1 not in path:
            return path
        out: list[int] = []
        for (i, _, _), p in zip(way, path):
            out.extend([p] if p >= 0 else [self.fallback.get(b, self.unknown) for b in text[i].encode()])
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers; none for an empty one."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        if self.crossing:
            return np.array(self.shortest(text), dtype="<i4").tobytes()
        parts = _PARTS.findall(text)
        out = list(map(self._paths.get, parts))
        for k in [k for k, x in enumerate(out) if x is None]:
            part = parts[k]
            x = self._paths.get(part)  # it may have come up since
            if x is None:
                x = self._older.get(part)
                if x is None:
                    x = array("i", self.shortest(part)).tobytes()
                if len(part) <= 64:
                    if len(self._paths) >= self.kept:
                        self._older, self._paths = self._paths, {}
                    self._paths[part] = x
            out[k] = x
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LOADED: dict[int, Transducer] = {}
store.caches("pieces", _LOADED.clear)


def _of(shared) -> Transducer:
    """This worker's transducer, compiled once from the broadcast model."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer.load(shared.value)
    return _LOADED[key]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens``, ``round_trip`` for each row of ``docs``.

    ``round_trip`` tells whether decoding gives the text again.  Null and empty texts
    have no ids.  Repeated rows give repeated results, and an empty table gives none.
    ``model`` is a serialised SentencePiece model; it is broadcast, and its size (about a
    megabyte) doesn't depend on the data.
    """
    store.workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        store.enter("pieces")
        t = _of(shared)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                text = [x or "" for x in part.column(1).to_pylist()]
                raw = [t.encode_bytes(x) for x in text]
                n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                same = [t.decode(np.frombuffer(r, "<i4").tolist()) == x for r, x in zip(raw, text)]
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; null ids give a null text."""
    store.workers(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        t = _of(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
