"""Name lookups in tiers, contact matching, and entity resolution.

Lookups find, for each input (``iid``, ``norm``, ``hint``), rows of an index
(``norm``, ``state`` and others).  Prefixes and initials are equi-joins on
exploded keys, and a tier sees only inputs that the tiers before it left.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions import rules
from quillon.functions.text import acronym, display_title, normalize_name, strip_stopwords, words
from quillon.operators.shared import keep


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher's ratio; not symmetric, ``b`` is its second sequence."""
    m, out, last = difflib.SequenceMatcher(), [], None
    for x, y in zip(a, b):
        if y != last:
            m.set_seq2(y)
            last = y
        m.set_seq1(x)
        out.append(m.ratio())
    return pd.Series(out)


def fuzzy_eq(a: Column, b: Column, cutoff: float = rules.FUZZY) -> Column:
    return (a == b) | (ratio(a, b) >= cutoff)


def prefer_state(hits: DataFrame) -> DataFrame:
    """Hits in the hinted state, or all where none is or there's no hint."""
    same = F.coalesce(F.col("state") == F.col("hint"), F.lit(False))
    any_ = F.max(same).over(Window.partitionBy("iid"))
    return hits.withColumn("_any", any_).filter(same | ~F.col("_any")).drop("_any")


def exact(inputs: DataFrame, index: DataFrame) -> DataFrame:
    return prefer_state(inputs.join(index, "norm"))


def _prefixes(norm: Column) -> Column:
    w = words(norm)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda n: F.array_join(F.slice(w, 1, n), " "))


def prefix(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows, of all states, whose name begins with the input's words, or the other way round."""
    idx = index.withColumnRenamed("norm", "key")
    down = inputs.join(idx.withColumn("norm", F.explode(_prefixes(F.col("key")))), "norm").filter("key <> norm")
    up = inputs.withColumn("key", F.explode(_prefixes(F.col("norm")))).filter("key <> norm").join(idx, "key")
    cols = ["iid", "norm", "hint", "key", *[c for c in index.columns if c != "norm"]]
    return down.select(*cols).unionByName(up.select(*cols))


def in_state(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("hint").isNull() | (F.col("state") == F.col("hint")))


_PARTS = 64  # Parts of rows that share their initials.
_ASKED, _NAMES = 1_000, 100_000  # Most names, about, that one task gets of either side at once.


class _Closest:
    """Names (``keys``) among which the closest to another are sought without a look at each.

    The characters in blocks that match are a common subsequence, and that is a part of the
    characters in common.  So a ratio has two bounds: the cheaper one is worked out once for
    all names of the same characters, the other for what may be left.  Names are then
    compared by falling bound until what is found can't be beaten.
    """

    def __init__(self, keys: list[str]) -> None:
        self.keys = sorted(keys, reverse=True)
        n = np.array([len(k) for k in self.keys])
        flat = np.frombuffer("".join(self.keys).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(n)), n)
        counts = np.zeros((len(n), 64), np.int32)  # Characters share 64 counters, which only raises the bound.
        np.add.at(counts, (owner, flat % 64), 1)
        seen: dict[bytes, int] = {}
        kind = np.array([seen.setdefault(x.tobytes(), len(seen)) for x in counts])
        kinds = np.frombuffer(b"".join(seen), np.int32).reshape(-1, 64)
        self.members = np.argsort(kind, kind="stable")
        self.ends = np.searchsorted(kind[self.members], np.arange(len(kinds) + 1))
        self.kinds, self.kind_length = np.ascontiguousarray(kinds.T), kinds.sum(axis=1)
        self.letters, code = np.unique(flat, return_inverse=True)
        self.length = n
        short = (n <= 64)[owner]
        self.codes = np.full((int(min(n.max(initial=0), 64)), len(n)), len(self.letters), np.int32)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self.codes[place[short], owner[short]] = code.reshape(-1)[short]

    def common(self, name: str, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengths of longest common subsequences with ``rows``, in words of 64 bits; ``most`` where a name is longer."""
        if len(name) > 64:
            return most
        masks = dict.fromkeys(name, 0)
        for i, c in enumerate(name):
            masks[c] |= 1 << i
        at = np.zeros(len(self.letters) + 1, np.uint64)
        for c, m in masks.items():
            i = np.searchsorted(self.letters, ord(c))
            if i < len(self.letters) and self.letters[i] == ord(c):
                at[i] = m
        v = np.full(len(rows), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for column in self.codes[: int(self.length[rows].max(initial=0))]:
            u = v & at[column[rows]]
            v = (v + u) | (v - u)
        return np.where(self.length[rows] <= 64, np.minimum(np.bitwise_count(~v), most), most)

    def closest(self, name: str, cutoff: float, most: int) -> list[tuple[float, str]]:
        """(ratio, name) of the ``most`` closest names of ``cutoff`` or more, larger names first among equals."""
        m = difflib.SequenceMatcher()
        m.set_seq2(name)
        flat = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)
        shared = np.zeros(self.kinds.shape[1], np.int64)
        for c, k in zip(*np.unique(flat % 64, return_counts=True)):
            shared += np.minimum(self.kinds[c], k)
        total = self.kind_length + len(name)
        bound = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
        near = np.flatnonzero(bound >= cutoff)
        near = near[np.argsort(-bound[near], kind="stable")]
        best: list[tuple[float, str]] = []
        waiting: list[tuple[float, int]] = []  # Names by falling second bound and name.
        i = 0
        while i < len(near) or waiting:
            level = bound[near[i]] if i < len(near) else -1.0
            if waiting and -waiting[0][0] > level:
                upper, row = heapq.heappop(waiting)
                key = self.keys[row]
                if len(best) == most and (-upper, key) < best[0]:
                    break
                m.set_seq1(key)
                found = (m.ratio(), key)
                if found[0] >= cutoff:
                    (heapq.heappush if len(best) < most else heapq.heappushpop)(best, found)
                continue
            if len(best) == most and level < best[0][0]:
                break
            j = i
            while j < len(near) and bound[near[j]] == level:
                j += 1
            rows = np.concatenate([self.members[self.ends[k] : self.ends[k + 1]] for k in near[i:j]])
            upto = np.repeat(shared[near[i:j]], self.ends[near[i:j] + 1] - self.ends[near[i:j]])
            both = self.length[rows] + len(name)
            upper = np.where(both > 0, 2.0 * self.common(name, rows, upto) / np.maximum(both, 1), 1.0)
            ok = upper >= max(cutoff, best[0][0] if len(best) == most else 0.0)
            waiting += zip((-upper[ok]).tolist(), rows[ok].tolist())
            heapq.heapify(waiting)
            i = j
        return sorted(best, reverse=True)


def fuzzy(inputs: DataFrame, index: DataFrame, cutoff: float = rules.FUZZY, most: int = 5) -> DataFrame:
    """Rows of the ``most`` closest names of ``cutoff`` or more, in the hinted state; larger names first among equals.

    Names are asked for within a pool, those of the hinted state or all.  A pool's names are
    dealt to blocks and what is asked of it to chunks, so that a task holds one of each at a
    time; :class:`_Closest` finds a block's closest names.
    """
    pool = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    keys = keep(index.select(F.col("norm").alias("key"), "state").filter("key IS NOT NULL").distinct(), "fuzzy-keys")
    inputs = inputs.select("iid", "norm", "hint").distinct()
    asked = keep(inputs.filter("norm IS NOT NULL").select("norm", pool("hint").alias("pool")).distinct(), "fuzzy-names")
    names = keys.select("key", F.lit("").alias("pool")).distinct().unionAll(keys.filter("state IS NOT NULL").select("key", pool("state").alias("pool")))
    parts = lambda df, size, c: df.groupBy("pool").agg(F.ceil(F.count("*") / size).cast("long").alias(c))
    deal = F.broadcast(parts(asked, _ASKED, "chunks").join(parts(names, _NAMES, "blocks"), "pool"))  # Broadcast: a row for each state.
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    group = ["pool", "chunk", "block"]
    left = asked.join(deal, "pool").select("pool", F.pmod(F.xxhash64("norm"), F.col("chunks")).alias("chunk"), every("blocks").alias("block"), "norm")
    right = names.join(deal, "pool").select("pool", every("chunks").alias("chunk"), F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"), "key")
    schema = pa.schema([("pool", pa.string()), ("norm", pa.string()), ("key", pa.string()), ("score", pa.float64())])

    def search(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        near = _Closest(b.column("key").to_pylist())
        rows = [(key[0].as_py(), x, k, s) for x in a.column("norm").to_pylist() for s, k in near.closest(x, cutoff, most)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()

    # The number of tasks is given, as their work isn't told by their bytes.
    left, right = left.repartition(192, *group), right.repartition(192, *group)
    near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(search, "pool string, norm string, key string, score double")
    pairs = inputs.withColumn("pool", pool("hint")).join(near, ["pool", "norm"]).select("iid", "norm", "hint", "key", "score")
    w = Window.partitionBy("iid").orderBy(F.desc("score"), F.desc("key"))
    best = pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return in_state(best.join(index.withColumnRenamed("norm", "key"), "key"))


def by_acronym(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose name's initials are the input, two to eight letters, spaced or not.

    With a hint, a name counts if its first row, by ``nces_id``, is in that state; then all its rows do.
    """
    bare = F.replace("norm", F.lit(" "), F.lit(""))
    asked = inputs.filter(bare.rlike("^[a-z]{2,8}$")).select("*", bare.alias("initials")).withColumnRenamed("norm", "asked")
    first = index.groupBy("norm").agg(F.min_by("state", "nces_id").alias("first_state"))
    rows = index.join(first, "norm").withColumn("initials", acronym(F.col("norm"))).withColumnRenamed("norm", "key")
    # Initials are few and their rows many: the rows are dealt to parts, and what is asked goes to each part.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("nces_id"), F.lit(_PARTS)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))))
    sure = asked.filter("hint IS NOT NULL").join(rows.withColumn("hint", F.col("first_state")), ["initials", "part", "hint"])
    free = asked.filter("hint IS NULL").join(rows, ["initials", "part"])
    hits = sure.select(*free.columns).unionByName(free)
    return hits.drop("initials", "first_state", "part").withColumnRenamed("asked", "norm")


def lookup(inputs: DataFrame, index: DataFrame, initials: bool = False, compat: bool = False) -> DataFrame:
    """Hits of the first tier that has any: ``iid``, ``tier`` and the index's columns.

    Prefix hits of other states than the hinted one are passed over, and the next tier may
    search; with ``compat`` they end the tiers with nothing, but for the initials.
    """
    cols = ["iid", F.col("norm").alias("asked"), F.col("key").alias("norm"), *[c for c in index.columns if c != "norm"]]
    out, left, ended = None, inputs, None

    def take(got: DataFrame, tier: int) -> DataFrame:
        nonlocal out
        got = got if "key" in got.columns else got.withColumn("key", F.col("norm"))
        got = keep(got.select(*cols).withColumn("tier", F.lit(tier)), "lookup")
        out = got if out is None else out.unionByName(got)
        return got.select("iid").distinct()

    left = keep(left.join(take(exact(left, index), 1), "iid", "left_anti"), "lookup-left")
    hits = keep(prefix(left, index), "lookup-prefix")
    after = left.join(take(in_state(hits), 2), "iid", "left_anti")
    if compat:
        after = after.join(hits.select("iid").distinct(), "iid", "left_anti")
    after = keep(after, "lookup-left")
    found = take(fuzzy(after, index), 3)
    if initials:
        ended = left.join(out.select("iid").distinct(), "iid", "left_anti") if compat else after.join(found, "iid", "left_anti")
        take(by_acronym(ended, index), 4)
    return out


def resolve(inputs: DataFrame, schools: DataFrame, parents: DataFrame | None = None, programs: DataFrame | None = None, notes: DataFrame | None = None, district_parents: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """What each input (``iid``, ``norm``, ``hint``, perhaps ``city``) is: school, district, parent organisation, program, ambiguous or no K-12 entity.

    ``schools``: ``nces_id``, ``norm``, ``school_name``, ``district_norm``, ``district_name``,
    ``lea_id``, ``state``.  The curated tables are small and given by the caller: parents and
    programs (``norm``, ``name``, ``domain``; programs perhaps ``state``, ``parent``), notes
    (``norm``, ``note``) and the organisations behind districts (``norm``, ``name``, ``confirmed``).
    Parents and programs match by fuzzy equality of the full or the stop-word-stripped name.

    A district whose hits hold a school of the input's name, or only one school, is that
    school.  Schools count where no other district is hit.  Several schools in several
    states, or several districts, are ambiguous without a hint of state or city.
    """
    spark = inputs.sparkSession
    if "city" not in inputs.columns:
        inputs = inputs.withColumn("city", F.lit(None).cast("string"))
    inputs = keep(inputs, "inputs")
    # Many inputs may ask the same, and each may have many hits: the tiers see every question once.
    bare = keep(inputs.select("norm", "hint").distinct().withColumn("iid", F.struct("norm", "hint")), "questions")
    field = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    none = spark.range(0).select(F.lit("").alias("norm"), F.lit("").alias("name"), F.lit("").alias("domain"))
    parents, programs = parents or none, programs or none
    part = lambda df, kind: df.select(F.col("norm").alias("key"), F.col("name").alias("c_name"), F.col("domain").alias("c_domain"), field(df, "state").alias("c_state"), field(df, "parent").alias("c_parent"), F.lit(kind).alias("c_type"))
    curated = part(parents, "PARENT_ORG").unionAll(part(programs, "PROGRAM"))
    # Broadcast: the curated tables.  Either form may be near; parents count first, then equal names, then the closest.
    near = bare.select("norm").distinct().crossJoin(F.broadcast(curated)).withColumn("_r", F.greatest(ratio("norm", "key"), ratio(strip_stopwords(F.col("norm")), strip_stopwords(F.col("key"))))).filter((F.col("norm") == F.col("key")) | (F.col("_r") >= rules.FUZZY))
    curated = near.groupBy("norm").agg(F.min_by(F.struct("c_name", "c_domain", "c_state", "c_parent", "c_type"), F.struct(F.when(F.col("c_type") == "PARENT_ORG", 0).otherwise(1).alias("t"), (F.col("norm") != F.col("key")).alias("n"), (-F.col("_r")).alias("r"), "key")).alias("c"))
    # A program's own state takes the place of the hint.
    bare = bare.join(curated, "norm", "left").select("iid", "norm", F.when(F.col("c.c_type") == "PROGRAM", F.col("c.c_state")).otherwise(F.col("hint")).alias("hint"))
    s = lookup(bare, schools.select("norm", "state", "nces_id", "school_name", "district_name", "district_norm", "lea_id"), compat=compat).withColumnRenamed("norm", "school_norm")
    d = lookup(bare, schools.select(F.col("district_norm").alias("norm"), "state", "nces_id", "school_name", "district_name", "lea_id", F.col("norm").alias("school_norm")), initials=True, compat=compat).withColumnRenamed("norm", "district_norm")
    campus = F.struct((F.col("school_norm") != F.col("asked")).alias("other"), "nces_id")
    row = F.struct("nces_id", "school_name", "school_norm", "district_name", "district_norm", "lea_id", "state", "asked")
    d = keep(d.groupBy("iid", "lea_id").agg(F.min_by(row, campus).alias("one"), F.max(F.col("school_norm") == F.col("asked")).alias("named"), F.count_distinct("school_name").alias("names"), F.min("nces_id").alias("first"), F.sort_array(F.collect_set(display_title(F.col("school_name")))).alias("children")), "districts")
    alone = d.filter("named OR names = 1").select("iid", "one.*")
    s = s.select("iid", *[c for c in ("nces_id", "school_name", "school_norm", "district_name", "district_norm", "lea_id", "state", "asked")]).unionByName(alone).dropDuplicates(["iid", "nces_id"])
    hint = bare.select("iid", "hint")
    inputs = inputs.withColumn("_q", F.struct("norm", "hint"))
    rank = F.struct(F.coalesce(F.col("state") != F.col("hint"), F.lit(False)).alias("other"), "nces_id")
    s = s.join(hint, "iid").groupBy("iid").agg(F.min_by(row, rank).alias("s"), F.count_distinct("nces_id").alias("s_n"), F.count_distinct("state").alias("s_states"))
    kids = d.select(F.struct(F.col("iid").alias("q"), "lea_id").alias("_kin"), "children")  # Met at the end, as they are long.
    d = d.filter("NOT (named OR names = 1)").groupBy("iid").agg(F.min_by(F.struct("one"), "first").alias("d"), F.count("*").alias("d_n"))
    out = inputs.join(curated, "norm", "left").join(s.withColumnRenamed("iid", "_q"), "_q", "left").join(d.withColumnRenamed("iid", "_q"), "_q", "left")
    out = out.join(notes.select("norm", "note"), "norm", "left") if notes is not None else out.withColumn("note", F.lit(None).cast("string"))
    loose = F.col("hint").isNull() & F.col("city").isNull()
    kind = F.when(F.col("c").isNotNull(), F.col("c.c_type")).when(F.col("d").isNotNull(), F.when((F.col("d_n") > 1) & loose, "AMBIGUOUS").otherwise("DISTRICT")).when((F.col("s_n") > 1) & (F.col("s_states") > 1) & loose, "AMBIGUOUS").when(F.col("s").isNotNull(), "SCHOOL").otherwise("NOT_A_K12")
    out = out.withColumn("entity_type", kind)
    out = out.withColumn("_kin", F.when(F.col("entity_type") == "DISTRICT", F.struct(F.col("_q").alias("q"), F.col("d.one.lea_id").alias("lea_id")))).join(kids, "_kin", "left")
    is_ = lambda *k: F.col("entity_type").isin(*k)
    pass_by = (district_parents or spark.range(0).select(F.lit("").alias("norm"), F.lit("").alias("name"), F.lit(True).alias("confirmed"))).select(F.col("norm").alias("p_norm"), F.col("name").alias("p_name"), "confirmed")
    lea = F.when(is_("SCHOOL"), F.col("s.district_norm")).when(is_("DISTRICT"), F.col("d.one.district_norm"))
    out = out.withColumn("_lea", lea).join(F.broadcast(pass_by), F.col("_lea") == F.col("p_norm"), "left")  # Broadcast: a curated table.
    sure = F.when(is_("PARENT_ORG"), 0.95).when(is_("PROGRAM"), 0.9).when(is_("SCHOOL"), F.when(F.col("s.school_norm") == F.col("norm"), 1.0).otherwise(0.72)).when(is_("DISTRICT"), F.when(F.col("d.one.district_norm") == F.col("norm"), 1.0).otherwise(0.85)).when(is_("NOT_A_K12"), 0.3).otherwise(0.0)
    parent = F.coalesce(F.col("p_name"), F.when(is_("SCHOOL"), display_title(F.col("s.district_name"))), F.when(is_("PROGRAM"), F.col("c.c_parent")))
    return out.select(
        "iid", "norm", "entity_type", F.when(is_("SCHOOL"), display_title(F.col("s.school_name"))).when(is_("DISTRICT"), display_title(F.col("d.one.district_name"))).when(is_("PARENT_ORG", "PROGRAM"), F.col("c.c_name")).alias("resolved_name"),
        F.when(is_("SCHOOL", "PROGRAM"), F.col("s.nces_id")).when(is_("DISTRICT"), F.col("d.one.lea_id")).alias("nces_id"), parent.alias("parent_entity"),
        F.when(F.col("p_name").isNotNull(), "PARENT_ORG").when(is_("SCHOOL"), "DISTRICT").alias("parent_entity_type"), F.col("c.c_domain").alias("domain"),
        F.when(is_("DISTRICT"), F.col("children")).otherwise(F.array().cast("array<string>")).alias("children"), sure.alias("confidence"), "note", (is_("AMBIGUOUS", "NOT_A_K12") | F.coalesce(~F.col("confirmed"), F.lit(False))).alias("needs_review"),
    )


def containment_key(kind: Column, name: Column, nces_id: Column, parent: Column, parent_kind: Column, asked: Column) -> Column:
    """One key for all inputs that mean the same subtree: the parent organisation first, then the id, then the name as asked."""
    org = lambda c: F.concat(F.lit("org:"), normalize_name(c))
    return F.when(kind == "PARENT_ORG", org(F.coalesce(name, asked))).when((parent_kind == "PARENT_ORG") & (F.coalesce(parent, F.lit("")) != ""), org(parent)).when(F.coalesce(nces_id, F.lit("")) != "", F.concat(F.lit("nces:"), nces_id)).otherwise(F.concat(F.lit("unresolved:"), normalize_name(asked)))


def match_contacts(teachers: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each teacher's contact within the school: ``tid``, ``cid``, ``how``.

    The same normalised name first; else the first contact that shares two words of the
    name, or the only word.
    """
    t = teachers.withColumn("_w", F.array_distinct(words(F.lower("name"))))
    c = contacts.withColumn("_v", F.array_distinct(words(F.lower("name"))))
    same = t.withColumn("k", F.array_join(words(F.lower("name")), " ")).join(c.withColumn("k", F.array_join(words(F.lower("name")), " ")).select("school_id", "k", "cid"), ["school_id", "k"]).groupBy("tid").agg(F.min("cid").alias("cid")).withColumn("how", F.lit("exact"))
    left = t.join(same.select("tid"), "tid", "left_anti").select("tid", "school_id", F.size("_w").alias("n"), F.explode("_w").alias("w"))
    shared = left.join(c.select("school_id", "cid", F.explode("_v").alias("w")), ["school_id", "w"]).groupBy("tid", "cid", "n").agg(F.count("*").alias("m"))
    some = shared.filter("m >= 2 OR (n = 1 AND m >= 1)").groupBy("tid").agg(F.min("cid").alias("cid")).withColumn("how", F.lit("tokens"))
    return same.unionByName(some)


def consensus(addresses: DataFrame) -> DataFrame:
    """``domain`` and ``pattern`` of domains whose known addresses (first, last, domain, email) all follow one pattern."""
    local = F.substring_index("email", "@", 1)
    p = F.when(local == F.concat(F.col("first"), F.lit("."), F.col("last")), "first.last").when(local == F.concat(F.substring("first", 1, 1), F.col("last")), "flast")
    return addresses.withColumn("pattern", p).filter(p.isNotNull()).groupBy("domain").agg(F.count_distinct("pattern").alias("n"), F.min("pattern").alias("pattern")).filter("n = 1").select("domain", "pattern")
