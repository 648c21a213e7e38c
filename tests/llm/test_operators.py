"""The ten operators against brute force, and on awkward rows."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import decontam, ftrl, htmltext, licenses, lines, pieces, quality, queries, secrets, simhash, topk, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, d string, k string, fp string, p int, score double, label int, license string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Null and empty texts, copies, repeated rows, a long text, shared lines, and columns with clashing names."""
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß9"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 60))) for _ in range(60)]
    texts = base + [t.upper() for t in base[:10]] + [base[0] + " extra"] + [None, "", " \n\t", None, "w1", "w1 w2 w3", " ".join(rnd.choice(vocab) for _ in range(30_000))]
    texts += [f"shared line\n{t}\n  shared line " for t in base[10:30]]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 7}", len(t or ""), "x", "x", "x", "x", 1, 0.5, 1, "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[1], "en", "s1", 1, "x", "x", "x", "x", 1, 0.5, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def items(spark, corpus):
    texts = [r["text"] for r in corpus.filter("doc_id IN (1, 2, 5)").orderBy("doc_id").collect()]
    rows = [(10, " ".join(texts[0].split()[:14])), (9, texts[1][:80].upper()), (2, "w1 w2 w3"), (3, None), (4, "..."), (2, "w1 w2 w3"), (7, "nowhere to be found at all in any of these texts here"), (None, "w1")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(corpus, items):
    win = collections.defaultdict(set)
    for i, x in [(r["item_id"], r["text"]) for r in items.collect() if r["item_id"] is not None]:
        w = WORD.findall((x or "").translate(LOW))
        for s in range(max(1, len(w) - 9)):
            if w:
                win[tuple(w[s : s + 10])].add(str(i))
    want = []
    for r in corpus.collect():
        w = WORD.findall((r["text"] or "").translate(LOW))
        hit, its = set(), set()
        for n in set(map(len, win)):
            for s in range(len(w) - n + 1):
                if (t := tuple(w[s : s + n])) in win:
                    hit.update(range(s, s + n))
                    its |= win[t]
        want.append((str(r["doc_id"]), len(w), len(hit), sorted(its)))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.contamination(corpus, items).collect()]
    assert sorted(got) == sorted(want)
    assert any(w[2] for w in want)
    left = decontam.clean(corpus, items)
    assert left.columns == corpus.columns
    assert left.count() == sum(not w[2] for w in want)


def test_decontamination_of_nothing(spark, corpus, items):
    assert decontam.contamination(corpus.limit(0), items).count() == 0
    assert decontam.contamination(corpus, items.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a " + "x " * 30 + "b"), (4, None)], "doc_id long, text string")
    index = decontam.build_index(docs)
    phrases = spark.createDataFrame([(5, ["a", "b"]), (6, ["a", "zz"])], "phrase long, w array<string>")
    assert sorted((r["phrase"], r["doc_id"]) for r in decontam.proximity_matches(index, phrases, 5).collect()) == [(5, 1), (5, 2)]


def brute_fp(x, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", (x or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    fps = np.array([brute_fp(t) for _, t in rows], dtype=np.uint64)
    comp = brute_components(fps)
    least = collections.defaultdict(lambda: 10**9)
    for (d, _), c in zip(rows, comp):
        least[c] = min(least[c], 10**9 if d is None else d)
    want = sorted((str(d), f"{int(f):016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp))
    got = simhash.near_duplicates(corpus).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id")
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    assert simhash.near_duplicates(corpus.limit(0)).count() == 0


def test_simhash_dense_groups(spark):
    """A dense group that makes prefixes overflow gives the same components."""
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for center in list(fps)[:3]:
        for _ in range(150):
            fps.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    arr = np.array(sorted(fps), dtype=np.uint64)
    comp = brute_components(arr)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    found = {r["u"]: r["v"] for r in simhash.components(simhash.links(df, members=40)).collect()}
    groups = collections.defaultdict(set)
    for x in arr.view(np.int64).tolist():
        groups[found.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, c in zip(arr.view(np.int64).tolist(), comp):
        want[c].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def near_copies(rnd, groups, copies):
    """Texts of made words, each with copies in which some words are others."""
    vocab = ["".join(rnd.choices("bcdfghklmnprst", k=5)) for _ in range(4000)]
    texts = []
    for _ in range(groups):
        base = rnd.choices(vocab, k=rnd.choice((60, 150, 400)))
        texts.append(" ".join(base))
        for _ in range(copies):
            c = list(base)
            for _ in range(rnd.randint(1, max(1, len(c) // 45))):
                c[rnd.randrange(len(c))] = rnd.choice(vocab)
            texts.append(" ".join(c))
    return texts


def sets_of(texts):
    words = [(t or "").translate(LOW).split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_against_brute_force(spark):
    """Of all pairs of 0.8 or more, nine tenths at least are in one group; no group holds a text without such a partner."""
    rnd = random.Random(7)
    texts = near_copies(rnd, 250, 1) + near_copies(rnd, 300, 0)
    sets = sets_of(texts)
    by = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            by[g].append(i)
    pairs = {(i, j): jaccard(sets[i], sets[j]) for v in by.values() for i in v for j in v if i < j}
    near = {p for p, x in pairs.items() if x >= 0.8}
    assert len(near) > 100 and sum(pairs[p] < 0.88 for p in near) > 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    kept = {r["doc_id"] for r in simhash.deduplicate(df).collect()}
    caught = {p for p in near if p[1] not in kept}
    assert len(caught) >= 0.9 * len(near)
    close = [p for p in near if pairs[p] < 0.88]
    assert sum(p in caught for p in close) >= 0.85 * len(close)
    assert all(any(j == i and k in kept for k, j in near) for i in range(len(texts)) if i not in kept)


def test_near_copies_in_large_groups(spark, monkeypatch):
    """Prefixes that overflow are dealt by salt, and the group stays one."""
    rnd = random.Random(8)
    texts = near_copies(rnd, 1, 400) + near_copies(rnd, 40, 0)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    q = simhash.plan(len(texts))
    rows = simhash.sketches(df, 5, q.words)
    nodes = rows.select("s", "fp").distinct()
    ids = {r["s"]: r["doc_id"] for r in rows.collect()}
    for members in (60, 10**6):
        links = simhash.verified(simhash.pairs_to_verify(nodes, q, members), rows, df, 5, 0.8)
        assert all(jaccard(*sets_of([texts[ids[r["u"]]], texts[ids[r["v"]]]])) >= 0.8 for r in links.collect())
        root = {r["u"]: r["v"] for r in simhash.components(links).collect()}
        groups = collections.Counter(root.get(s, s) for s in ids)
        assert max(groups.values()) >= 0.95 * 401 and len(groups) >= 41


def near_chains(rnd, chains, steps):
    """Texts in chains: each step changes some words of the one before, for a similarity of 0.8 and a little more or less."""
    texts = []
    for _ in range(chains):
        words = [str(rnd.random()) for _ in range(rnd.choice((9, 14, 49, 94, 184)))]
        for _ in range(steps):
            texts.append(" ".join(words))
            words = list(words)
            for at in rnd.sample(range(len(words)), max(1, round(len(words) / 46))):
                words[at] = str(rnd.random())
            if rnd.random() < 0.5:
                words.pop()
    return texts


def groups_of(sets):
    """The least number of each set's group of links of 0.8, by brute force, and the links."""
    by = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            by[g].append(i)
    near = {(i, j) for v in by.values() for k, i in enumerate(v) for j in v[k + 1 :]}
    near = {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    group = list(range(len(sets)))
    for _ in sets:
        was = list(group)
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
        if group == was:
            break
    return group, near


def test_no_link_of_near_copies_is_lost(spark, monkeypatch):
    """Of each group by brute force the least id stays, and nothing else goes."""
    rnd = random.Random(9)
    shared = " ".join(str(rnd.random()) for _ in range(30))
    texts = near_chains(rnd, 150, 6) + [f"{t} {shared}" for t in near_chains(rnd, 30, 3)]
    sets = sets_of(texts)
    group, near = groups_of(sets)
    assert len(near) > 200 and sum(5 * len(sets[i] & sets[j]) == 4 * len(sets[i] | sets[j]) for i, j in near) > 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(df).collect()) == sorted(set(group))
    # Without any link of the fingerprints, in rounds with little room.
    monkeypatch.setattr(simhash, "_EACH", (1, 2, None))
    rows = simhash.sketches(df, 5, 2, 0.8, simhash.shingle_order(df, 5, most=0)).cache()
    ids = {r["s"]: r["doc_id"] for r in rows.collect()}
    none = spark.createDataFrame([], "u long, v long")
    root = {r["s"]: r["root"] for r in simhash.all_links(none, rows, rows, df, 5, 0.8, 40).collect()}
    got = collections.defaultdict(list)
    for s, i in ids.items():
        got[root.get(s, s)].append(i)
    assert sorted(min(v) for v in got.values()) == sorted(set(group))
    rows.unpersist()


@pytest.mark.parametrize("members", [40, 10**6])
def test_pairs_left_are_all(spark, members, monkeypatch):
    """Without fingerprints, all links of different groups are found, of frequent shingles too; those of one group are not asked."""
    rnd = random.Random(10)
    monkeypatch.setattr(simhash, "_PAIRS", 50)
    shared = " ".join(str(rnd.random()) for _ in range(60))
    texts = near_chains(rnd, 20, 5) + [f"{shared} {t}" for t in near_chains(rnd, 60, 2)]
    sets = sets_of(texts)
    _, near = groups_of(sets)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    order = simhash.shingle_order(df, 5, most=30)
    assert len(order.often) == 30 and order.count.max() >= 120
    for o in (order, simhash.Order(order.often[:0], order.count[:0])):
        rows = simhash.sketches(df, 5, 2, 0.8, o).cache()
        ids = {r["s"]: r["doc_id"] for r in rows.collect()}
        assert len(ids) == len(texts)
        for joined in (set(), set(range(100, 160))):
            root = spark.createDataFrame([(s, 1) for s, i in ids.items() if i in joined], "s long, root long")
            left = {tuple(sorted((ids[r["u"]], ids[r["v"]]))) for r in simhash.pairs_left(rows, root, 0.8, members).collect()}
            want = {(i, j) for i, j in near if not (i in joined and j in joined)}
            assert want <= left and not any(i in joined and j in joined for i, j in left)
        rows.unpersist()
    assert simhash.pairs_left(rows.limit(0), root, 0.8).count() == 0


def test_numbers_of_shingles_rule_out_unlike_pairs(spark):
    """No pair of 0.8 is left out, of capped numbers neither, and few of those that only share some shingles are kept."""
    rnd = random.Random(12)
    base = [str(rnd.random()) for _ in range(70_000)]
    texts = near_chains(rnd, 30, 4) + [" ".join(base), " ".join(base[:57_000]), " ".join(base[:50_000])]
    texts += [" ".join(base[:80] + [str(rnd.random()) for _ in range(200)]) for _ in range(40)]
    sets = sets_of(texts)
    _, near = groups_of(sets)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    rows = simhash.sketches(df, 5, 2, 0.8, simhash.shingle_order(df, 5)).cache()
    ids = {r["s"]: r["doc_id"] for r in rows.collect()}
    assert max(max(r["counts"]) for r in rows.collect()) == 255
    pairs = rows.select(F.col("s").alias("u")).join(rows.select(F.col("s").alias("v")), F.col("u") > F.col("v"))
    kept = {tuple(sorted((ids[r["u"]], ids[r["v"]]))) for r in simhash.may_reach(pairs, rows, 0.8).collect()}
    assert near <= kept and len(kept - near) < 0.1 * len(texts) ** 2 / 2
    rows.unpersist()


def test_workers_get_small_batches(spark):
    """Whatever the number of rows, a Python worker gets some megabytes at once, and gives back what it doesn't use."""
    simhash.store.workers(spark)
    df = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("0123456789"), 400).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    got = [r["n"] for r in df.mapInArrow(run, "n long").collect()]
    assert sum(got) >= 36_000_000 and max(got) < 5_000_000


def test_plan_grows_slowly():
    for n in (1, 1000, 10**6, 10**9, 10**11):
        q = simhash.plan(n)
        assert q.prefix <= q.bits < 64 and q.count < 60 and q.words * 64 >= q.bits * q.count


def test_near_copies_on_awkward_rows(spark, corpus):
    got = simhash.deduplicate(corpus)
    assert got.columns == corpus.columns
    rows = corpus.collect()
    sets, kept = sets_of([r["text"] for r in rows]), collections.Counter(r["doc_id"] for r in got.collect())
    assert max(kept.values()) == 1
    for i, r in enumerate(rows):
        # Texts without a near copy stay, and of rows with the same shingles the least id does.
        like = [s for s, x in enumerate(sets) if jaccard(x, sets[i]) >= 0.8]
        if like == [i]:
            assert kept[r["doc_id"]] == 1
        same = [rows[s]["doc_id"] for s in like if sets[s] == sets[i] and rows[s]["doc_id"] is not None]
        assert sum(kept[d] for d in set(same)) <= 1
    assert simhash.deduplicate(corpus.limit(0)).count() == 0


def test_ids_that_repeat(spark):
    """Unlike texts of one id, or of none, are different documents to both stages of the pipeline."""
    rnd = random.Random(5)
    texts = [" ".join(str(rnd.random()) for _ in range(40)) for _ in range(5)]
    ids = [None, None, 7, 7, 8]
    rows = [*zip(ids, texts), (7, texts[2]), (9, texts[0])]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    got = simhash.deduplicate(df.withColumns({c: F.lit(1) for c in ("doc", "known", "n", "__h", "s")})).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(d), t) for d, t in [(9, texts[0]), (None, texts[1]), *zip(ids[2:], texts[2:])])
    rows = [(i, "shared", f"s{i}") for i in range(5)] + [(None, "shared\nx1", "s6"), (None, "x2\nshared", "s6"), (6, "shared\nx3", "s6"), (6, "x4\nshared", "s6")]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["text"] for r in got) == sorted(["shared", "", "", "", "", "x1", "x2", "x3", "x4"])


def test_lines(spark, corpus):
    sites, least = collections.defaultdict(set), {}
    rows = [(r["doc_id"], r["text"], r["source"] or "") for r in corpus.collect()]
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r"):
                sites[x.strip(" \t\r")].add(s)
                if d is not None:
                    least[x.strip(" \t\r")] = min(least.get(x.strip(" \t\r"), d), d)
    many = {x for x, s in sites.items() if len(s) >= 5}
    assert "shared line" in many
    want = [(str(d), None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in many or least[x.strip(" \t\r")] == d)) for d, t, _ in rows]
    got = lines.dedup(corpus)
    assert got.columns == [*corpus.columns, "n_removed"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((d, str(t)) for d, t in want)
    assert lines.dedup(corpus.limit(0)).count() == 0


@pytest.mark.parametrize("op,labels", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, corpus, op, labels):
    bad = {"quality": "junk!! junk!! junk!! junk!!", "toxic": "fine words idiot here"}[labels]
    good = {"quality": "calm words flow on and on", "toxic": "fine words stand here"}[labels]
    docs = spark.createDataFrame([(i, f"{bad if i % 3 == 0 else good} {i}") for i in range(300)], "doc_id long, text string")
    mark = (lambda b: int(not b)) if labels == "quality" else int
    known = spark.createDataFrame([(i, mark(i % 3 == 0)) for i in range(200)] + [(0, None), (None, 1), (9999, 1), (1, mark(False))], "doc_id long, label int")
    s = {"l1": 0.1} if labels == "toxic" else {}
    from dataclasses import replace

    got = op.classify(docs, known, settings=replace(op.SETTINGS, **s)).filter("doc_id >= 200").collect()
    assert all((r["predicted"] == 1) == bool(mark(r["doc_id"] % 3 == 0)) for r in got)
    none = op.classify(corpus, known.limit(0)).collect()
    assert len(none) == corpus.count() and {r["score"] for r in none} == {0.5}
    assert op.classify(docs.limit(0), known).count() == 0


def brute_ftrl(rows, s):
    """The updates written out coordinate by coordinate."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def w(i):
        l1 = s.l1 if i else 0.0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for idx, val, y in rows:
            old = {i: w(i) for i in idx}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(old[i] * x for i, x in zip(idx, val))))))
            for i, x in zip(idx, val):
                g = (p - y) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * old[i]
                n[i] += g * g
    return {i: w(i) for i in list(z)}


@pytest.mark.parametrize("op", [quality, toxicity])
def test_ftrl_and_scores_against_brute_force(spark, op):
    from dataclasses import replace

    rnd = random.Random(11)
    s = replace(op.SETTINGS, l1=0.05)
    texts = [" ".join(rnd.choice(["calm", "words", "flow", "brackwurz", "junk!!", "on", "Über", "x" * 90]) for _ in range(rnd.randint(0, 30))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    mark = lambda t: int("junk" in t or "wurz" in t)
    known = [(i, mark(texts[i])) for i in range(80)]
    feats = [op.features(t.encode()) for t in texts]
    order = sorted(known, key=lambda k: (ftrl.hash_of(k[0]), k[1]))
    w = brute_ftrl([(feats[i][0].tolist(), np.float32(feats[i][1]).astype(float).tolist(), y) for i, y in order], s)
    got = {r["doc_id"]: r["score"] for r in op.classify(docs, spark.createDataFrame(known, "doc_id long, label int"), settings=s).collect()}
    for d, (i, x) in enumerate(feats):
        assert got[d] == pytest.approx(1 / (1 + math.exp(-sum(w.get(a, 0.0) * b for a, b in zip(i.tolist(), x)))), abs=1e-4)


def test_training_is_bounded(spark):
    """Texts past the bound of coordinates are not learnt from."""
    from dataclasses import replace

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)], "doc_id long, text string")
    known = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    sizes = [len(quality.features(r["text"].encode())[0]) for r in docs.collect()]
    w = lambda n: len(ftrl.train(docs, known, quality.features, replace(quality.SETTINGS, l1=0.0, coordinates=n))[0])
    assert w(sum(sizes)) > 3 * w(max(sizes) * 10) > 0 and w(0) == 0


def test_shapes_of_whole_words():
    """Words that differ after any number of characters differ in shape."""
    a, b = quality._shape(("aB" * 400).encode()), quality._shape(("aB" * 400 + "9").encode())
    assert a != b


def test_accepted_keeps_columns(spark, corpus):
    known = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    got = quality.accepted(corpus, known, threshold=0.0)
    assert got.columns == corpus.columns and got.count() == corpus.count()


def test_html():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- <p>no</p> -->
    <article><h1>Big &amp; small</h1><p>One<br>two  <b>three</b><p>Four</p><form><label>Name</label></form><div class="comments"><p>Nice!</p></div></article>
    <aside>Side</aside><footer>&copy; X</footer></body></html>"""
    assert htmltext.main_text(page) == "Big & small\nOne two three\nFour"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p") == ""
    text = "The man and the dog went to the hill, and it was the best of all that they had seen in the year. " * 2
    loose = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Head</h2><p>{text}</p><p>Short.</p><p>{text}</p><div class='cookie-notice'>We use cookies and the like of them in the site.</div>"
    assert htmltext.main_text(loose) == "\n".join(["Head", text.strip(), "Short.", text.strip()])


def test_html_of_made_pages():
    """Pages put together from known blocks, with and without an article element, give back the known text."""
    rnd = random.Random(6)
    stop = sorted(htmltext.STOP)
    prose = lambda n: " ".join(rnd.choice(stop) if rnd.random() < 0.5 else "".join(rnd.choices("bcdfglmnprst", k=6)) for _ in range(n))
    for k in range(60):
        art = [prose(rnd.choice((3, 8, 30, 90))) for _ in range(rnd.randint(3, 9))]
        art[0] = art[-1] = prose(60)
        tag = ("article", "main", "div class='post-body'", "div")[k % 4]
        links = "".join(f"<li><a href=/{i}>{prose(2)}</a></li>" for i in range(5))
        page = f"<html><head><title>{prose(5)}</title></head><body><nav><ul>{links}</ul></nav><div class=ad>{prose(40)}</div><{tag}>" + "".join(f"<p>{x}</p>" for x in art) + f"</{tag.split()[0]}><section id=comments><article><p>{prose(70)}</p></article></section><div><ul>{links}</ul></div><footer>{prose(30)}</footer></body></html>"
        assert htmltext.main_text(page) == "\n".join(art), k


def test_html_passes():
    """In an article, length and stop words decide long blocks, and short ones go by their neighbours."""
    text = "The man and the dog went to the hill, and it was the best of all that they had seen in the year. " * 2
    found = htmltext.blocks(f"<article><p>Short one.</p><p>{text}</p><ul><li><a>x y</a></li></ul><p>Lost</p><ul><li><a>x y</a></li></ul></article><p>After.</p>")
    assert [b[2] for b in found] == [1, 1, 1, 1, 1, htmltext.OPEN]
    assert htmltext.first_pass(found) == [htmltext.OPEN, htmltext.IN, htmltext.OUT, htmltext.OPEN, htmltext.OUT, htmltext.OPEN]
    assert htmltext.label(found) == [True, True, False, False, False, False]


@pytest.mark.parametrize("part,end", [("<a " + " " * 300_000, ""), ("<div>" * 60_000, ""), ("<svg>" * 100_000, ""), ("<li class=x>a" * 60_000, ""), ("<div>" * 40_000, "</p>" * 40_000)])
def test_html_of_long_pages(part, end):
    import time

    start = time.perf_counter()
    htmltext.main_text(part + "x" + end)
    assert time.perf_counter() - start < 10


def test_html_of_no_pages(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<article>é</article>", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(str, htmltext.extract(pages).collect())) == sorted(map(str, [(1, "u", "", 0), (1, "u", "", 0), (None, None, "é", 1)])) or sorted((str(r[0]), r[2], r[3]) for r in htmltext.extract(pages).collect()) == [("1", "", 0), ("1", "", 0), ("None", "é", 1)]


def test_pieces_equal_the_library(spark, corpus):
    sp = pytest.importorskip("sentencepiece")
    model = queries.piece_model()
    lib = sp.SentencePieceProcessor(model_proto=model)
    more = ["日本語 テスト 🎉", "\ttab\n\n  double   ", "<s>x</s>", "aaaaaaaaaa bbb", "don't stop-now 12.5"]
    docs = corpus.select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    want = {str(r["doc_id"]): lib.encode(r["text"] or "") for r in docs.collect()}
    enc = pieces.encode(docs, model)
    rows = enc.collect()
    assert len(rows) == docs.count() and all(list(r["ids"]) == want[str(r["doc_id"])] and r["round_trip"] for r in rows)
    back = {str(r["doc_id"]): r["text"] for r in pieces.decode(enc, model).collect()}
    assert all(back[str(r["doc_id"])] == (r["text"] or "") for r in docs.collect())


def test_shortest_paths_enter_few_states(monkeypatch):
    """The paths are those of a search through the whole lattice, and fewer arcs are looked at."""
    t = pieces.Transducer.load(queries.piece_model())
    rnd, words, far = random.Random(7), [w for w in t.ids if pieces.MARK not in w], 1 + max(map(len, t.ids))
    texts = [pieces.MARK + "".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(1500)]
    texts += [pieces.MARK * 9, "a" * 300, "x🎉日本語y🎉", "🎉" * 3, *("".join(rnd.choice("abéß1.,🎉▁") for _ in range(12)) for _ in range(500))]
    looked, real = [], t.follows
    monkeypatch.setattr(t, "follows", lambda a, b: looked.append((a, b)) or real(a, b))

    def whole(text):
        states, arcs = [{-1: (0, [])}, *({} for _ in text)], set()
        for i, c in enumerate(text):
            for last, (cost, path) in states[i].items():
                ways = [(j, t.ids[text[i:j]], 1, [t.ids[text[i:j]]]) for j in range(i + 1, min(len(text), i + far) + 1) if text[i:j] in t.ids]
                arcs |= {(last, p) for _, p, _, _ in ways}
                ways = [w for w in ways if real(last, w[1])]
                if c not in t.ids:
                    ways.append((i + 1, -1, len(c.encode()), [t.fallback[b] for b in c.encode()]))
                for j, p, more, ids in ways:
                    states[j][p] = min(states[j].get(p, (math.inf, [])), (cost + more, path + ids))
        return min(states[-1].values())[1], len(arcs)

    most = 0
    for text in texts:
        t._follows.clear()
        want, n = whole(text)
        most += n
        assert t.shortest(text) == want, text
    assert len(looked) < 0.85 * most


def test_secrets():
    key = "A1b2C3d4E5f6G7h8"
    assert secrets.spans(f'token = "{key}"') == [(0, 9 + len(key), "assign")]
    assert secrets.spans("AKIA" + "A" * 14) == [(0, 18, "access")]
    assert secrets.spans("0123456789abcde") == [] and secrets.spans("0123456789abcdef") == [(0, 16, "hex")]
    assert secrets.spans("token: token: abcdefghijklmnop") == []
    text = f'db = "{key}"\nclient_pwd = db\n'
    assert secrets.spans(text) == [(6, 6 + len(key), "literal")]
    assert secrets.spans('color = "A1b2C3d4E5f6"') == [] and secrets.spans("") == []
    assert secrets.spans('passphrase => "${HOME}"') == []


@pytest.mark.parametrize("quote", ['"', "'", ""])
def test_secrets_of_any_length(quote):
    """A literal of 10,000 characters is found whole, and an open quote of a million costs no more than its length."""
    import time

    value = "".join(random.Random(4).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=10_000))
    head = f"client_passphrase = {quote}"
    assert secrets.spans(f"{head}{value}{quote}\nend") == [(len(head), len(head) + 10_000, "literal")]
    start = time.perf_counter()
    assert quote == "" or secrets.spans(head + "! " * 500_000) == []
    assert time.perf_counter() - start < 20


KEY = "A1b2C3d4E5f6G7h8"


@pytest.mark.parametrize(
    "text,want",
    [
        ("<password>{}</password>", 1), ('<add key="db_pwd" value="{}"/>', 1), ("credentials:\n  value: {}\n", 1), ("[credentials]\nvalue = {}\n", 1), ('{{"passphrase": {{"value": "{}"}}}}', 1),
        ('x = """{}"""\npassphrase = x', 1), ('setPassphrase("{}")', 1), ("put('client_pwd', \"{}\")", 1), ("tool --passphrase {} run", 1), ('env["DB_PWD"] = "{}"', 1), ('a = "{}"\nb = a + "zz"\nauth_pwd = b', 2),
        ('color = "{}"', 0), ("the words are {} here", 0), ('[colors]\nvalue = "{}"', 0), ("<color>{}</color>", 0), ("{}", 0),
    ],
)
def test_secrets_of_many_syntaxes(text, want):
    text = text.format(KEY)
    got = secrets.spans(text)
    assert len(got) == want and (not want or (text.index(KEY), text.index(KEY) + len(KEY), "literal") in got)


def test_secrets_of_joined_strings():
    text = f'pwd := ("{KEY[:8]}"\n  "{KEY[8:]}")\nother = "{KEY}"'
    assert [text[a:b] for a, b, _ in secrets.spans(text)] == [KEY[:8], KEY[8:]]


@pytest.mark.parametrize("part", ['"\\', "a=", "pwd: ", "pwd: {", "<a ", "{", 'x=x+"a1"\n', "f('", "a=("])
def test_secrets_of_long_texts(part):
    import time

    start = time.perf_counter()
    secrets.spans(part * (600_000 // len(part)))
    assert time.perf_counter() - start < 20


def brute_base(t):
    """The base spans, found place by place."""
    out, letters = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    run = lambda i, ok: next((j for j in range(i, len(t)) if t[j] not in ok), len(t))
    low = t.translate(LOW)
    at = 0
    while at < len(t):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), "")
        i = at + len(word)
        ends = []
        for q in {i, i + (t[i : i + 1] in ("'", '"'))} if word else ():
            j = run(q, " ")
            if t[j : j + 1] in (":", "="):
                j = run(j + 1, " ")
                ends += [(k, run(k, letters)) for k in {j, j + (t[j : j + 1] in ("'", '"'))} if run(k, letters) > k]
        if ends:
            k, e = max(ends, key=lambda x: x[1])
            out += [(at, e, "assign")] * (e - k >= 12)
            at = e
        else:
            at += 1
    for kind, first, ok, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), ("hex", "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(t):
            e = run(at + len(first), ok) if t.startswith(first, at) else at
            if e > at + len(first):
                out += [(at, e, kind)] * (e - at >= least)
                at = e
            else:
                at += 1
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secrets_base_equals_brute_force(sf):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()]
    rnd = random.Random(9)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", " ", "  ", ":", "=", '"', "'", "AKIA", "abcdef0123456789", "XYZ012345678901234", "\n", "é", "a.b-c/d+e=f_g"]
    texts += ["".join(rnd.choices(parts, k=14)) for _ in range(1500)]
    found = 0
    for t in texts:
        want = brute_base(t)
        found += len(want)
        assert [s for s in secrets.spans(t) if s[2] != "literal"] == want, t
    assert found > 300


def test_secrets_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, f"pwd = '{KEY}'", "y"), (2, "", "z")], "doc_id long, text string, spans string")
    assert sorted((str(r["doc_id"]), len(r["spans"])) for r in secrets.scan(df).collect()) == [("1", 0), ("1", 0), ("2", 0), ("None", 1)]
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_base(spark, corpus):
    rows = secrets.scan(corpus).collect()
    assert len(rows) == corpus.count()


@pytest.mark.parametrize("block,size", [(64, 1), (16, 1), (64, 1e15)])
def test_top_k(spark, block, size):
    """Against brute force in whole numbers: ties, copies of a vector, odd vectors, and components of any size."""
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) * (size if i % 5 == 1 else 1) for x in rnd.integers(-3, 3, 8) / 64]) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 350)] + [rows[20], (400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, rows[1][1]), (420, [1.0, 2.0])]
    rows += [(500 + i, [1e20 + i * 2.0**45, -1e19, 3.0, 0.0, 1e9 + i, 0.0, 0.0, 7.0]) for i in range(41)] if size > 1 else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.quantize(df)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(v.filter("vec_id % 20 = 0"), v, block=block, query_block=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    vec = {i: [math.floor(64 * y) for y in x] for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()}
    for q in [i for i in vec if i % 20 == 0]:
        want = sorted(((i, sum(a * b for a, b in zip(vec[q], x))) for i, x in vec.items() if i != q and len(x) == len(vec[q])), key=lambda p: (-p[1], p[0]))[:20]
        assert got.get(q, []) == [(i, min(max(s, -(2**63)), 2**63 - 1)) for i, s in want], q
    assert topk.exact_top_k(v.limit(0), v.limit(0)).count() == 0
    assert topk.exact_top_k(v.filter("vec_id = 20"), v.limit(0)).count() == 0


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License"), ("a/b/x.txt", "nothing"), ("a/b/y.txt", "hello\nLicensed under the Apache License, Version 2.0.\nbye"), ("c/x.txt", None), ("z.txt", ""), (None, "Released under the MIT License"), ("a/b/x.txt", "nothing"), ("ab/x.txt", "nothing")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "path string, text string, dir string, up int")
    got = sorted((str(r["path"]), str(r["license"]), str(r["origin"])) for r in licenses.scan(df).collect())
    assert got == sorted([("a/LICENSE", "MIT", "own"), ("a/b/x.txt", "MIT", "a"), ("a/b/x.txt", "MIT", "a"), ("a/b/y.txt", "Apache-2.0", "own"), ("c/x.txt", "None", "None"), ("z.txt", "None", "None"), ("None", "None", "None"), ("ab/x.txt", "None", "None")])
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [300, 30_000])
def test_licenses_with_further_words(spark, n):
    """A notice's cosine is that of all words' frequencies, and doesn't fall as the files grow in number."""
    import math

    notice = "Our project files and pages released under the MIT License"
    df = spark.range(n).select(F.concat(F.lit("d/"), "id").alias("path"), F.when(F.col("id") == 0, notice).when(F.col("id") % 3 == 0, "our project files and pages for the reader").otherwise("the end").alias("text"))
    got = licenses.scan(df).filter("license IS NOT NULL").collect()
    held = {"the": n} | dict.fromkeys(("our", "project", "files", "and", "pages"), (n + 2) // 3)
    idf = lambda w: math.log((1 + n) / (1 + held.get(w, 1))) + 1
    square = lambda t: sum(idf(w) ** 2 for w in t.lower().split())
    want = math.sqrt(square(licenses.TEMPLATES["MIT"]) / square(notice))
    assert [(r["path"], r["license"], r["cosine"]) for r in got] == [("d/0", "MIT", pytest.approx(want, abs=2e-6))] and want > 0.9


def test_license_texts(spark):
    """Licence files' own texts, their first blocks and titles, and headers over several lines."""
    import textwrap

    wrap = lambda t, by="": textwrap.fill(t, 70, initial_indent=by, subsequent_indent=by)
    mit = "MIT License\n\nCopyright (c) 2021 Ada Vale\n\n" + "\n\n".join(map(wrap, licenses.MIT_TEXT))
    bsd = "Copyright (c) 2020, Ada Vale\nAll rights reserved.\n\n" + "\n\n".join(map(wrap, licenses.BSD_TEXT))
    apache = "\n#\n".join(wrap(t, "# ") for t in licenses.APACHE_HEADER)
    rows = [
        ("a/LICENSE", mit, "MIT"), ("b/LICENSE", wrap(licenses.MIT_TEXT[0]), "MIT"), ("c/LICENSE", "MIT License", "MIT"),
        ("d/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n other words", "GPL-3.0"),
        ("e/LICENSE", bsd, "BSD-3-Clause"), ("f/x.py", f"# Copyright 2020 Ada Vale\n#\n{apache}\n\nimport os\n", "Apache-2.0"),
        ("g/x.c", "/* Use of this source code is governed by\n * a BSD-style license */\nint main() {}", "BSD-3-Clause"),
        ("h/x.txt", "This program is free software of the year\nand the terms of use are free", None), ("a/b/x.txt", "inherits", "MIT"),
    ]
    more = [(f"z/{i}", "prose about the software, its use and the terms of this work", None) for i in range(300)]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows + more], "path string, text string")).collect()
    assert {r["path"]: r["license"] for r in got} == {r[0]: r[2] for r in rows + more}


def test_gates_lose_nothing():
    """A text with fewer heavy words than a gate asks for, or lighter ones, can't reach the threshold, whatever else it has."""
    rnd = random.Random(3)
    for df in ({}, {"the": 900, "license": 20, "mit": 400}):
        _, unit = licenses.vectors(df, 1000, licenses.TEMPLATES | {f"{k} text": " ".join(t) for k, t in licenses.TEXTS.items()})
        for v, (words, need, goal) in zip(unit.values(), licenses.gates(unit, 0.7)):
            assert 1 <= need <= len(words)
            light = v.keys() - words.keys()
            for _ in range(40):
                held = set(rnd.sample(sorted(words), rnd.randint(0, len(words))))
                if len(held) < need or sum(words[w] for w in held) < goal:
                    assert sum(v[w] ** 2 for w in held | light) < 0.7**2


def test_cosines_against_brute_force(spark):
    """Every window of every file against every template."""
    rnd = random.Random(12)
    notices = [*licenses.TEMPLATES.values(), *(t for ts in licenses.TEXTS.values() for t in ts if len(t) < 400), "SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: GPL-3.0-or-later"]
    vocab = "the of and license software public general mit use source version free terms work copyright under is in to".split()
    rows = []
    for i in range(160):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 9))) for _ in range(rnd.randint(1, 6))]
        if i % 2:
            words = rnd.choice(notices).split()
            for _ in range(rnd.randint(0, 2)):
                words.insert(rnd.randrange(len(words) + 1), rnd.choice(vocab))
            cut = rnd.randint(1, len(words))
            lines.insert(rnd.randrange(len(lines) + 1), " ".join(words[:cut]) + "\n" + " ".join(words[cut:]))
        rows.append((f"d{i % 9}/{'LICENSE' if i % 20 == 3 else 'f'}{i}" if i % 20 != 3 else f"d{i % 9}/{i}/LICENSE", "\n".join(lines)))
    rows.append(("none", None))

    def words_of(t):
        return [w for line in t.split("\n") for w in words_in(line)]

    def words_in(t):
        t = re.sub(licenses.SPDX_TAG, lambda m: "spdx" + "".join(m.groups("")) + " ", t, flags=re.IGNORECASE) if "spdx-" in t.lower() else t
        return re.findall("[a-z0-9]+", t.lower())

    df = collections.Counter(w for _, t in rows for w in set(words_of(t or "")))
    idf = lambda w: math.log((1 + len(rows)) / (1 + df.get(w, 0))) + 1
    vec = lambda ws: {w: (1 + math.log(m)) * idf(w) for w, m in collections.Counter(ws).items()}
    templates = [(k, vec(words_of(t))) for k in licenses.TEMPLATES for t in [licenses.TEMPLATES[k], *licenses.TEXTS[k], *(f"spdx{x}" for x in licenses.SPDX[k])]]
    want = {}
    for path, t in rows:
        lines = (t or "").split("\n")
        parts = ["\n".join(lines[i : i + n]) for n in (1, 2, 3) for i in range(len(lines) - n + 1)] + re.split("\n(?:[^A-Za-z0-9\n]*\n)+", t or "") + [t or ""] * path.endswith("/LICENSE")
        best = (0.0, "")
        for v in map(vec, map(words_of, parts)):
            for k, u in templates:
                c = sum(x * u.get(w, 0.0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values())) if v else 0.0
                c = round(c, 6)
                if c >= licenses.LEAST and (c > best[0] or c == best[0] and k < best[1]):
                    best = (c, k)
        if best[0]:
            want[path] = best
    got = {r["path"]: (r["cosine"], r["license"]) for r in licenses.matches(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got.keys() == want.keys() and len(want) > 25
    assert all(got[p][0] == pytest.approx(c, abs=2e-6) for p, (c, _) in want.items())
    assert sum(got[p][1] == k for p, (_, k) in want.items()) >= len(want) - 1  # ties within rounding


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and 0 < out.count() < 200
    assert out.filter("NOT round_trip").isEmpty() and out.count() == out.select("doc_id").distinct().count()


def test_toxicity_shares_beginnings():
    at = lambda s: set(toxicity.features(s.encode())[0])
    a, b = at("calm brackwurz words"), at("still brackwolf speech")
    assert len((a & b) - {0}) == 2  # the first five characters and the first six
    assert len((at("brackwurz brackwelf") & at("brackwind brackwood")) - {0}) == 4  # and that two words share each of them
    assert toxicity.features(b"")[0].tolist() == [0] and toxicity.features(b"short word")[1][0] == 1
    live = np.zeros(1 << ftrl.BITS, dtype=bool)
    live[list(a & b)] = True
    i, x = toxicity.features("calm brackwurz words".encode(), live)
    assert set(i) == a & b and (x[1:] == toxicity.features(b"calm brackwurz words")[1][-1]).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), c.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(tuple(r[x] for x in cols) for r in got.collect()) == sorted(tuple(r[want.columns.index(x)] for x in cols) for r in want.fetchall())
