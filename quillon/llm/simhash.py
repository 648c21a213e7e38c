"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2r`` bits exactly when some 64-bit word lies
within ``r`` bits of both.  Every distinct fingerprint therefore emits all words
of its ball of radius ``r`` (the *variants*), and equal variants meet.

Shuffling 2,081 variants for each fingerprint would move 16 bytes for each of
them.  Instead, the variants are dealt by their leading bits: a fingerprint goes
once to each *prefix* that some of its variants have, with the number of bits
already flipped there, and the remaining bits of the variants are written out by
the task that owns the prefix.  This is the same set of variants in fewer bytes.
Prefixes with many members are lengthened until each is small; at full length a
prefix is one variant, which at most 2,081 distinct fingerprints share.

All members of a variant are within ``2r`` bits of one another, so one verified
edge to the least of them keeps every link's component; no pairs of a group are
listed.  Components are found by alternating large-star and small-star steps on
tables in the shared folder.

Texts that share four fifths of their shingles differ in some ten of 64 bits, too many for
a ball around one long fingerprint.  :func:`deduplicate` therefore takes balls around
several short ones, and verifies what meets there.  Fingerprints find most links, not all:
:func:`pairs_left` then lists every pair of texts that no link connects yet and that may
still be similar enough, by the rarest shingles of each, so that no link is lost.  Numbers of
shingles by hash (:func:`may_reach`) rule most of them out before whole sets are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import acos, ceil, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import store
from quillon.llm.store import small

BITS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def simhash64(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority fingerprint of the XXH64 of all word shingles of a UTF-8 text, repeats included.

    No words (null, empty or white space): zero.  Fewer words than ``shingle``: one
    shingle of the whole sequence.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    width = min(shingle, len(words))
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[starts[i] : starts[i + width] - 1], seed) for i in range(lo, hi)), dtype="<u8", count=hi - lo)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) of every row."""
    store.workers(docs.sparkSession)

    def run(batches):
        store.enter("simhash")
        for b in batches:
            fps = [simhash64(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _ball(lo: int, hi: int, r: int) -> list[tuple[int, int]]:
    """(xor mask, flips) of all ways to flip at most ``r`` of the bits ``lo`` to ``hi`` - 1, counted from the top."""
    at = [1 << (BITS - 1 - i) for i in range(lo, hi)]
    return [(sum(c), k) for k in range(r + 1) for c in combinations(at, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spread(rows: DataFrame, lo: int, hi: int, r: int) -> DataFrame:
    """Lengthen the prefixes of ``rows`` (fp, prefix, used) from ``lo`` to ``hi`` bits."""
    masks = F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.lit(k).alias("k")) for m, k in _ball(lo, hi, r)])
    keep = _signed(((1 << hi) - 1) << (BITS - hi))
    x = F.explode(F.filter(masks, lambda s: s["k"] + F.col("used") <= r)).alias("x")
    tail = F.col("fp").bitwiseAND(F.lit(_signed(((1 << (hi - lo)) - 1) << (BITS - hi))))
    return rows.select("fp", "prefix", "used", x).select("fp", F.col("prefix").bitwiseOR(tail.bitwiseXOR(F.col("x.m"))).bitwiseAND(F.lit(keep)).alias("prefix"), (F.col("used") + F.col("x.k")).alias("used"))


def _meet(bits: int, r: int):
    """For one prefix: write out the variants' other bits, and link all fingerprints that share a variant."""
    tails = {k: np.array([m for m, _ in _ball(bits, BITS, k)], dtype=np.uint64) for k in range(r + 1)}
    low = np.uint64((1 << (BITS - bits)) - 1)

    def run(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy()
        used = t.column("used").to_numpy()
        own, var = [], []
        for d in range(r + 1):
            i = np.flatnonzero(used == d)
            if len(i):
                own.append(np.repeat(i, len(tails[r - d])))
                var.append(((fp[i].view(np.uint64) & low)[:, None] ^ tails[r - d][None, :]).ravel())
        own, var = np.concatenate(own), np.concatenate(var)
        order = np.argsort(var, kind="stable")
        own, var = own[order], var[order]
        new = np.concatenate([[True], var[1:] != var[:-1]])
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [len(var)]]))
        rank = np.argsort(np.argsort(fp))
        by_rank = np.argsort(fp)
        least = np.repeat(by_rank[np.minimum.reduceat(rank[own], at)], size)
        pick = own != least
        pairs = np.unique(own[pick].astype(np.int64) * len(fp) + least[pick])
        a, b = pairs // len(fp), pairs % len(fp)
        near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= 2 * r
        a, b = a[near], b[near]
        label = rank.copy()
        while True:  # components of this prefix's own edges, least rank first
            m = np.minimum(label[a], label[b])
            was = label.copy()
            np.minimum.at(label, a, m)
            np.minimum.at(label, b, m)
            label = label[by_rank[label]]
            if (label == was).all():
                break
        moved = label != rank
        return pa.table({"u": fp[moved], "v": fp[by_rank[label[moved]]]})

    return run


def links(fps: DataFrame, radius: int = 4, members: int = 4096) -> DataFrame:
    """Edges ``u`` > ``v`` whose components are those of all pairs of distinct ``fp`` at ``radius`` or fewer differing bits.

    ``radius`` is even.  ``members`` bounds what one task holds for a prefix: longer
    ones are split further, so the bound loses nothing.
    """
    spark, r = fps.sparkSession, radius // 2
    store.workers(spark)
    n = fps.count()
    hi = next((p for p in range(4, 25) if n * sum(comb(p, k) for k in range(r + 1)) / 2**p <= members / 2), 24)
    rows, lo, out = fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("used")), 0, None
    while rows is not None:
        rows = _spread(rows, lo, hi, r)
        full = None
        if hi < BITS:
            full = store.materialize(rows.groupBy("prefix").count().filter(F.col("count") > members).select("prefix"), "simhash-full")
            if not full.isEmpty():
                rows = store.materialize(rows, "simhash-rows")
                rest, more = rows.join(full, "prefix", "left_anti"), rows.join(full, "prefix", "left_semi")
            else:
                rest, more = rows, None
        else:
            rest, more = rows, None
        found = rest.groupBy("prefix").applyInArrow(_meet(hi, r), "u long, v long")
        out = found if out is None else out.unionAll(found)
        rows, lo, hi = more, hi, min(BITS, hi + 12)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, the least node that it reaches, for each node of ``edges`` but the least ones.

    Large-star and small-star steps alternate until the edges stay the same; each
    round is written to the shared folder.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = store.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    was = mark(e)
    while was[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store.materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = store.materialize(small, "edges")
        store.drop(e)
        store.drop(large)
        e, now = new, mark(new)
        if now == was:
            break
        was = now
    return e


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp``, ``component_id``.

    ``component_id`` is the least ``doc_id`` reachable over fingerprints that differ in
    ``radius`` or fewer bits.  Null and empty texts have the fingerprint zero and link
    like any other; repeated rows give repeated results; an empty table gives none.
    Null ``doc_id`` values are never a component's least one unless it has no other.
    """
    rows = store.materialize(fingerprints(docs, shingle), "fingerprints")
    least = store.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(links(least.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    least = least.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Plan:
    """``count`` short fingerprints of ``bits`` bits, dealt by their first ``prefix`` bits."""

    bits: int
    count: int
    prefix: int

    @property
    def words(self) -> int:
        """64-bit words that hold all of them; two at least, which verify pairs."""
        return max(2, -(-self.bits * self.count // BITS))


def plan(n: int, similarity: float = 0.8, recall: float = 0.95) -> Plan:
    """Short fingerprints for ``n`` texts: so long that a text meets some 500 strangers in each at most, whatever
    ``n`` is, and so many that a pair of ``similarity`` meets in one or more of them with probability ``recall``.

    A pair of sets of one size and of Jaccard similarity J differs in each bit with probability acos(2J / (1 + J)) / pi.
    """
    differs = acos(2 * similarity / (1 + similarity)) / pi
    ball = lambda b: 1 + b + comb(b, 2)
    bits = next(b for b in range(12, BITS) if n * ball(b) / 2**b <= 512)
    meets = sum(comb(bits, k) * differs**k * (1 - differs) ** (bits - k) for k in range(3))
    count = next(c for c in range(1, 999) if 1 - (1 - meets) ** c >= recall)
    prefix = next((p for p in range(6, bits) if n * (1 + p) / 2**p <= 32_768), bits)
    return Plan(bits, count, min(prefix, bits))


#: Of the two words that verify a pair, so many bits may differ: 0.8 gives 19 on average, with a deviation of 4.
_FAR = 28
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted XXH64 of a text's different word shingles; fewer words than ``shingle`` are one, no words none."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    width = min(shingle, len(words))
    n = len(words) - width + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[starts[i] : starts[i + width] - 1], seed) for i in range(n)), dtype=np.uint64, count=n))


def wide(h: np.ndarray, words: int) -> np.ndarray:
    """Majority fingerprint of ``words`` 64-bit words over a set of hashes."""
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words):
        counts = np.zeros(BITS, dtype=np.int64)
        for lo in range(0, len(h), _CHUNK):
            x = _mix(h[lo : lo + _CHUNK] + _STEP * np.uint64(w + 1))
            counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


@dataclass(frozen=True)
class Order:
    """An order of all shingles: those of ``often`` (sorted hashes) come last, by ``count``; ties go by hash.

    Any order gives the same links; with frequent shingles last, fewer pairs are to be verified.
    """

    often: np.ndarray
    count: np.ndarray

    def prefix(self, h: np.ndarray, similarity: float) -> np.ndarray:
        """So many first shingles of a set (its sorted hashes) that those of any set of ``similarity`` have one of them."""
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
            h = h[np.argsort(np.where(self.often[at] == h, self.count[at], 0), kind="stable")]
        return h[: len(h) - ceil(similarity * len(h) - 1e-9) + 1] if len(h) else h


def shingle_order(docs: DataFrame, shingle: int, sample: int = 64 << 20, most: int = 100_000) -> Order:
    """An :class:`Order` whose frequent shingles are the ``most`` frequent of those that three or more texts
    of a sample of some ``sample`` bytes have."""
    store.workers(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        store.enter("simhash")
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), shingle).view(np.int64))], ["x"])

    texts = docs.select("text").filter(F.length("text") > 0)
    if size > sample:
        texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(sample / size * (1 << 20))))
    counts = texts.distinct().select(F.col("text").cast("binary")).mapInArrow(run, "x long").groupBy("x").count()
    got = counts.filter("count > 2").orderBy(F.desc("count"), "x").limit(most).toArrow()
    h, count = got.column("x").to_numpy().view(np.uint64), got.column("count").to_numpy()
    at = np.argsort(h)
    return Order(h[at], count[at])


def sketches(docs: DataFrame, shingle: int, words: int, similarity: float = 1.0, order: Order | None = None) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``s`` (hash of the set of shingles), ``fp`` (its wide fingerprint) of every row.

    With an ``order`` also ``n``, the number of shingles, ``prefix``, the first of them, and ``counts`` (:func:`counted`).
    """
    store.workers(docs.sparkSession)

    def run(batches):
        store.enter("simhash")
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(2)]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            out = [b.column(0), b.column(1), pa.array(s), pa.array([wide(x, words).tobytes() for x in sets], pa.binary())]
            if order:
                out += [pa.array([len(x) for x in sets], pa.int64()), _lists([order.prefix(x, similarity) for x in sets]), pa.array(map(counted, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "h", "s", "fp", "n", "prefix", "counts"][: len(out)])

    schema = "doc_id long, h long, s long, fp binary" + (", n long, prefix array<long>, counts binary" if order else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _known().alias("h"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def counted(h: np.ndarray) -> bytes:
    """For each value of a hash's first byte, the number of a set's hashes with it, 255 at most."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as an Arrow column of lists."""
    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)), pa.array(flat))


def _known() -> Column:
    """The hash that tells the rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _dealt(nodes: DataFrame, q: Plan) -> DataFrame:
    """Each node (s, fp) once for every prefix that a variant of one of its short fingerprints has.

    ``bucket``: the short fingerprint's number and the prefix.  ``rest``: its other bits, and
    in the last one whether the one flip is spent in the prefix.  ``a``, ``b``: two words to verify pairs.
    """
    store.workers(nodes.sparkSession)
    tail = q.bits - q.prefix
    flips = np.concatenate([[0], 1 << np.arange(q.prefix)]).astype(np.uint64)

    def run(batches):
        store.enter("simhash")
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                part = whole.slice(lo, 2048)
                s = part.column(0).to_numpy()
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u8").reshape(len(s), -1)
                bucket, rest = [], []
                for t in range(q.count):
                    w, sh = divmod(t * q.bits, BITS)
                    x = fp[:, w] >> np.uint64(sh)
                    if sh + q.bits > BITS:
                        x = x | fp[:, w + 1] << np.uint64(BITS - sh)
                    x = x & np.uint64((1 << q.bits) - 1)
                    bucket.append((np.uint64(t << 40) | (x >> np.uint64(tail)))[:, None] ^ flips)
                    rest.append(((x & np.uint64((1 << tail) - 1)) << np.uint64(1))[:, None] | (flips > 0))
                bucket, rest = np.concatenate(bucket, axis=1).ravel(), np.concatenate(rest, axis=1).ravel()
                n = len(bucket) // len(s)
                a, b = np.repeat(fp[:, 0], n), np.repeat(fp[:, 1], n)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (bucket, rest, a, b)] + [pa.array(np.repeat(s, n))], ["bucket", "rest", "a", "b", "s"])

    return nodes.select("s", "fp").mapInArrow(run, "bucket long, rest long, a long, b long, s long")


def _led(q: Plan, leaders: bool):
    """For one prefix: write out the variants' other bits, and link the members of each variant that are close to a leader.

    A variant's first member by a fixed shuffle leads; those that are close to it are linked
    to it, and the rest go on among themselves.  ``leaders``: give the leaders, too, as links to themselves.
    """
    tails = np.concatenate([[0], 1 << np.arange(q.bits - q.prefix)]).astype(np.int64)

    def run(t: pa.Table) -> pa.Table:
        rest, s = t.column("rest").to_numpy(), t.column("s").to_numpy()
        a, b = (t.column(c).to_numpy().view(np.uint64) for c in "ab")
        free = np.flatnonzero(rest & 1 == 0)
        spent = np.flatnonzero(rest & 1)
        own = np.concatenate([np.repeat(free, len(tails)), spent])
        var = np.concatenate([((rest[free] >> 1)[:, None] ^ tails).ravel(), rest[spent] >> 1])
        first = _mix(s.view(np.uint64) + _STEP * np.uint64(1 + int(t.column("bucket")[0].as_py() >> 40)))
        order = np.lexsort((first[own], var))
        own, var = own[order], var[order]
        found, led = [], []
        while len(own):
            new = np.concatenate([[True], var[1:] != var[:-1]])
            lead = own[np.flatnonzero(new)][np.cumsum(new) - 1]
            near = np.bitwise_count(a[own] ^ a[lead]).astype(np.int64) + np.bitwise_count(b[own] ^ b[lead]) <= _FAR
            pick = near & ~new
            found.append(np.unique(own[pick].astype(np.int64) * len(s) + lead[pick]))
            led.append(np.unique(own[new]))
            own, var = own[~near], var[~near]
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        u, v = s[pairs // len(s)], s[pairs % len(s)]
        if leaders:
            all_led = s[np.unique(np.concatenate(led))]
            u, v = np.concatenate([u, all_led]), np.concatenate([v, all_led])
        return pa.table({"u": u, "v": v})

    return run


def pairs_to_verify(nodes: DataFrame, q: Plan, members: int = 131_072) -> DataFrame:
    """Links ``u``, ``v`` (hashes of sets) of ``nodes`` that meet in a variant and whose wide fingerprints are close.

    Not all similar pairs: some meet in no variant, and members are linked to leaders only.  :func:`pairs_left` lists the rest.

    Prefixes with more than ``members`` entries, such as those of a large group of near
    copies, are dealt anew by salt, so that no task holds them whole; then the leaders of
    all salts meet.
    """
    out, left = None, nodes
    where, size = None, None
    while left is not None:
        dealt = _dealt(left, q)
        if where is not None:
            dealt = dealt.join(F.broadcast(where), "bucket", "left_semi")
        full = store.materialize(dealt.groupBy("bucket").count().filter(F.col("count") > members), "simhash-full")
        total = full.agg(F.sum("count")).first()[0]
        if not total:
            found, left = dealt.groupBy("bucket").applyInArrow(_led(q, False), "u long, v long"), None
        else:
            # Broadcast: a full prefix stands for more than ``members`` entries.
            salt = F.pmod(F.xxhash64("s", F.lit(size or 0)), F.ceil(2 * F.col("count") / members)).cast("int")
            hot = dealt.join(F.broadcast(full), "bucket").withColumn("salt", salt).drop("count")
            hot = store.materialize(hot.groupBy("bucket", "salt").applyInArrow(_led(q, True), "u long, v long"), "simhash-hot")
            found = dealt.join(F.broadcast(full), "bucket", "left_anti").groupBy("bucket").applyInArrow(_led(q, False), "u long, v long")
            found = found.unionAll(hot.filter("u <> v"))
            heads = hot.filter("u = v").select(F.col("u").alias("s")).distinct()
            # Leaders that are unlike one another don't get fewer by another round.
            left = store.materialize(nodes.join(heads, "s", "left_semi"), "simhash-leaders") if size is None or total <= size / 2 else None
            where, size = full.select("bucket"), total
        out = found if out is None else out.unionAll(found)
    return store.materialize(out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-links")


#: Pairs that a task looks at at once.
_PAIRS = 1 << 18
#: In the rounds of :func:`all_links`, so many rows at most that a row meets in a shingle; the last round has no limit.
_EACH = (8, 64, None)


def _apart(similarity: float, each: int | None = None):
    """All pairs with a common shingle, of different groups, that may have ``similarity``.

    With ``each``, a row meets so many others of a shingle at most, and shingles of which pairs are missing follow as ``u`` without ``v``.
    """
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, s, root, n, at = (t.column(c).to_numpy() for c in ("x", "s", "root", "n", "at"))
        # Groups, and rows of a group, have another order in each shingle.
        salt = _mix(x.view(np.uint64))
        turn = _mix(root.view(np.uint64) + salt)
        order = np.lexsort((_mix(s.view(np.uint64) + salt), turn, x))
        x, s, turn, n, left = x[order], s[order], turn[order], n[order], (n - at)[order]
        block = t.column("block").to_numpy()[order] if "block" in t.column_names else None
        ends = lambda new: np.append(np.flatnonzero(new)[1:], len(x))[np.cumsum(new) - 1]
        new = np.concatenate([[True], x[1:] != x[:-1]])
        # A row meets the rows of its shingle after those of its own group.
        first = ends(new | np.concatenate([[True], turn[1:] != turn[:-1]]))
        size = ends(new) - first
        if each is not None:
            cut = np.unique(x[size > each])
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.array(cut), pa.nulls(len(cut), pa.int64())], ["u", "v"])
            size = np.minimum(size, each)
        # Equal pairs of a task have equal numbers, which sort in less memory than pairs do.
        known, number = np.unique(s, return_inverse=True)
        rows = np.flatnonzero(size)
        total = np.cumsum(size[rows])
        lo = 0
        while lo < len(rows):
            done = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + _PAIRS, side="right")))
            some = size[rows[lo:hi]]
            i = np.repeat(rows[lo:hi], some)
            j = first[i] + np.arange(len(i)) - np.repeat(total[lo:hi] - some - done, some)
            # At their first common shingle, so many must be left in both.
            ok = np.minimum(left[i], left[j]) >= share * (n[i] + n[j]) - 1e-6
            if block is not None:
                ok &= block[i] != block[j]
            a, b = number[i[ok]], number[j[ok]]
            if len(a):
                pairs = np.unique(np.maximum(a, b) * len(known) + np.minimum(a, b))
                yield pa.RecordBatch.from_arrays([pa.array(known[pairs // len(known)]), pa.array(known[pairs % len(known)])], ["u", "v"])
            lo = hi
        store.release()

    return run


def pairs_left(nodes: DataFrame, root: DataFrame, similarity: float, members: int = 131_072, each: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """All pairs ``u``, ``v`` of ``nodes`` (s, n, prefix) in different groups of ``root`` (s, root) that may have ``similarity``.

    Two sets of a Jaccard similarity have a shingle in both prefixes, and at the first such one enough
    others are left in both; what fails that is not similar.  Groups that earlier links connected are not
    compared within.  Shingles that more than ``members`` nodes have are dealt as pairs of blocks.

    With ``each``, a node meets so many others of a shingle at most, and the shingles of which pairs are
    missing are ``u`` in rows without ``v``.  ``among`` (x): only pairs that meet in one of these shingles.
    """
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    known = nodes.select("s", "n", "prefix").join(small(root), "s", "left").withColumn("root", F.coalesce("root", "s"))
    posts = known.select("s", "root", "n", F.posexplode("prefix").alias("at", "x"))
    if among is not None:
        posts = posts.join(small(among), "x", "left_semi")
    posts = posts.withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(ceil(2 * total / members) or 1)))
    meet, pairs = _apart(similarity, each), "u long, v long"
    # Few buckets are that full without a frequent shingle.
    full = store.materialize(posts.groupBy("bucket").count().filter(F.col("count") > members).select("bucket"), "simhash-full")
    if full.isEmpty():
        out = posts.groupBy("bucket").applyInArrow(meet, pairs)
    else:
        often = posts.join(F.broadcast(full), "bucket").groupBy("x").agg(F.count("*").alias("count"), (F.min("root") < F.max("root")).alias("mixed"))
        often = store.materialize(often.filter(F.col("count") > members), "simhash-often")
        out = posts.join(F.broadcast(often), "x", "left_anti").groupBy("bucket").applyInArrow(meet, pairs)
        mixed = often.filter("mixed").select("x", F.ceil(2 * F.col("count") / members).cast("long").alias("blocks"))
        rows = posts.join(F.broadcast(mixed), "x").withColumn("own", F.pmod(F.xxhash64("s", "x"), F.col("blocks")))
        if each is None:
            out = out.unionAll(_blocks(rows).groupBy("x", "lo", "hi").applyInArrow(meet, pairs))
        else:
            out = out.unionAll(rows.groupBy("x", "own").applyInArrow(meet, pairs)).unionAll(mixed.select(F.col("x").alias("u"), F.lit(None).cast("long").alias("v")))
    return store.materialize(out.distinct(), "simhash-left")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows``, dealt into ``blocks`` by ``own``, once for every pair ``lo`` <= ``hi`` of blocks that has theirs.

    ``block``: which of the two; in a pair of a block with itself, each row has its own.
    """
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.when(F.col("own") == F.col("other"), F.col("s")).otherwise(F.col("own"))
    return rows.select("x", "s", "root", "n", "at", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), block.alias("block"))


def all_links(found: DataFrame, nodes: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float, members: int = 131_072) -> DataFrame:
    """The groups (s, root) of all links of ``similarity``, of which ``found`` are some.

    In the first rounds a node meets few others of a shingle, which joins most groups; the last one
    verifies all pairs of different groups in the shingles of which pairs were missing, so none is lost.
    """

    def rooted() -> DataFrame:
        return components(found).select(F.col("u").alias("s"), F.col("v").alias("root"))

    root, among = rooted(), None
    for each in _EACH:
        left = pairs_left(nodes, root, similarity, members, each, among)
        # A pair of sets takes kilobytes in the join that verifies it, a pair of numbers by first byte 512 bytes.
        near = store.materialize(may_reach(left.filter("v IS NOT NULL"), nodes, similarity), "simhash-near")
        more = verified(near, rows, docs, shingle, similarity)
        if not more.isEmpty():
            found = found.unionAll(more)
            root = rooted()
        among = left.filter("v IS NULL").select(F.col("u").alias("x"))
        if among.isEmpty():
            break
    return root


def may_reach(links: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``links`` whose sets may have ``similarity``, by the numbers of their shingles (``n``, ``counts``).

    Two sets differ in as many shingles at least as their numbers do, added up over all first
    bytes; capped numbers differ by no more than whole ones.  So no row of that similarity is left out.
    """
    store.workers(links.sparkSession)
    share = similarity / (1 + similarity)

    def run(batches):
        store.enter("simhash")
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, 256) for c in ("cu", "cv"))
                both = b.column("nu").to_numpy() + b.column("nv").to_numpy()
                common = (both - (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)) / 2
                yield b.select(["u", "v"]).filter(pa.array(common >= share * both - 1e-6))

    # Not broadcast: the numbers grow with the texts.
    of = lambda c: nodes.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}")).hint("merge")
    return links.join(of("u"), "u").join(of("v"), "v").mapInArrow(run, "u long, v long")


def verified(links: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of ``links`` whose sets of shingles have a Jaccard similarity of ``similarity`` or more."""
    asked = links.select(F.explode(F.array("u", "v")).alias("s")).distinct()
    # One text for each set: that of the least (id, hash), null ids last.
    one = rows.join(small(asked), "s", "left_semi").groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x"))
    one = store.materialize(one.select("s", F.col("x.doc_id").alias("d"), F.col("x.h").alias("k")), "simhash-asked")

    def run(batches):
        store.enter("simhash")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t.as_py(), shingle) for t in b.column(1)])], ["s", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _known().alias("h"), "text").join(small(one), (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    sets = texts.select("s", F.col("text").cast("binary").alias("text")).mapInArrow(run, "s long, x array<long>")
    sets = store.materialize(sets.groupBy("s").agg(F.first("x").alias("x")), "simhash-sets")
    both = F.size(F.array_intersect("x", "y"))
    # Not broadcast: the sets grow with the texts.
    out = links.join(sets.select(F.col("s").alias("u"), "x").hint("merge"), "u").join(sets.select(F.col("s").alias("v"), F.col("x").alias("y")).hint("merge"), "v")
    return store.materialize(out.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("u", "v"), "simhash-verified")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: that of the least ``doc_id``, null ids last, then of the least text hash.

    Near copies are texts whose sets of ``shingle``-word shingles have a Jaccard similarity
    of ``similarity`` or more; a group is what such links connect.  Links are searched by
    ball hashing of several short fingerprints (``plan``), of which each emits all variants
    within one bit, so that two meet if they differ in two or fewer; pairs that meet are
    verified by wider fingerprints and then by the shingles themselves.  Of the groups that
    this gives, every pair of texts in different ones that may be similar is then verified by
    its shingles (:func:`all_links`), so that the groups are those of all links.

    A document is known by its id and its text's hash, so that rows of one id (or of
    none) with different texts stand for themselves; repeated rows are copies.  Null and
    empty texts have no shingles and are copies of one another.  An empty table gives none.
    """
    q = plan(max(1, docs.count()), similarity)
    rows = store.materialize(sketches(docs, shingle, q.words, similarity, shingle_order(docs, shingle)), "sketches")
    nodes = store.materialize(rows.groupBy("s").agg(*[F.first(c).alias(c) for c in ("fp", "n", "prefix", "counts")]), "simhash-nodes")
    found = verified(pairs_to_verify(nodes.select("s", "fp"), q), rows, docs, shingle, similarity)
    root = all_links(found, nodes, rows, docs, shingle, similarity)
    known = rows.select("doc_id", "h", "s").join(small(root), "s", "left").select("doc_id", "h", F.coalesce("root", "s").alias("root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = known.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    first = store.materialize(first.select("root", "first"), "simhash-first")
    grouped = store.materialize(known.join(small(first), "root").groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first("first").alias("first")), "simhash-groups")
    d, k, n = (store.unused(docs.columns, x) for x in ("doc", "known", "n"))
    stays = grouped.filter(rank.eqNullSafe(F.col("first")))
    gone = grouped.filter(~rank.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(d), F.col("h").alias(k))
    same = (_known() == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    out = docs.join(small(gone), same, "left_anti")
    # Of rows that repeat id and text, one stays.
    twice = store.materialize(stays.filter("n > 1").select(F.col("doc_id").alias(d), F.col("h").alias(k)), "simhash-repeated")
    if twice.isEmpty():
        return out
    once = out.join(small(twice), same, "left_semi").withColumn(n, _known()).dropDuplicates(["doc_id", n]).drop(n)
    return out.join(small(twice), same, "left_anti").unionByName(once)


def hex16(fp: Column) -> Column:
    """A fingerprint's 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
