"""Fingerprints, links and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streamweave.llm import similar_groups, simhash
from streamweave.llm.components import connected_components


def brute_print(text, size=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius):
    nodes = sorted(prints)
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if bin(prints[a] ^ prints[b]).count("1") <= radius and comp[a] != comp[b]:
                    low = min(comp[a], comp[b])
                    comp[a] = comp[b] = low
                    changed = True
    return comp


def test_near_duplicates(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one", "a b", " ".join(rng.choice("abcdefgh") for _ in range(3000))]
    base = [rng.choice(["red", "Green", "bLue", "x", "é"]) for _ in range(120)]
    for _ in range(20):
        t = list(base)
        t[rng.randrange(120)] = "w" + str(rng.random())
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + [(None, "one"), (3, "One")], "doc_id long, text string").withColumn("Fingerprint", F.lit(1))
    got = simhash.near_duplicates(df.select("doc_id", "text", "Fingerprint")).collect()
    prints = {i: brute_print(t) for i, t in rows}
    comp = brute_components(prints, 2)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16
            assert r["component_id"] == comp[r["doc_id"]]
        else:
            assert r["component_id"] == comp[3]
    assert simhash.near_duplicates(df.limit(0).select("doc_id", "text")).count() == 0


def test_no_link_is_lost_in_large_keys(spark):
    """Hundreds of fingerprints share segments; small `direct` forces the refinement."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = set()
    while len(values) < 300:
        v = centre
        for b in rng.sample(range(64), rng.randrange(5)):
            v ^= 1 << b
        values.add(v)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    links = simhash.near_links(spark.createDataFrame(rows, "node long, fingerprint long"), 2, direct=10).collect()
    vs = sorted(values)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(vs[i] ^ vs[j]).count("1") <= 2}
    assert {(r["a"], r["b"]) for r in links} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {}
    for a, b in edges:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(80):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {n: c for n, c in comp.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_test_is_implied():
    rng = np.random.default_rng(0)
    bits = np.zeros(500, np.uint64)
    for i in range(500):
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            bits[i] |= np.uint64(1) << np.uint64(b)
    near = np.bitwise_count(bits) <= similar_groups.RADIUS
    assert similar_groups.chains_hold(bits)[near].all()


def jaccard(a, b, size=5):
    def runs(t):
        w = t.lower().split()
        return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or ({" ".join(w)} if w else set())

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize(("block", "levels"), [(7, 5), (7, 1)])
def test_similar_groups(spark, monkeypatch, block, levels):
    """Each way of comparing: whole seeds, dealt again, block against block."""
    monkeypatch.setattr(similar_groups, "BLOCK", block)
    monkeypatch.setattr(similar_groups, "LEVELS", levels)
    monkeypatch.setattr(similar_groups, "MANY", 1 if levels > 1 else 16)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(150)]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(150)] = word()
            texts.append(" ".join(t))
    texts += [texts[0], "", "short one", "Short  one"]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} " + " ".join(word() for _ in range(40)) for _ in range(12)]  # alike, but not enough
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("__digest", F.lit("kept"))
    got = {r["doc_id"]: r["group_id"] for r in similar_groups.similar_groups(df).collect()}
    n = len(texts)
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(i):
                if comp[i] != comp[j] and jaccard(texts[i], texts[j]) >= 0.8:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for i in range(n):
        for j in range(i):
            assert (got[i] == got[j]) == (comp[i] == comp[j])
    if levels == 1:
        kept = similar_groups.keep_one(df)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp)) and kept.columns == df.columns
        assert kept.where("__digest = 'kept'").count() == kept.count()
        assert similar_groups.keep_one(df.limit(0)).count() == 0


def test_similar_groups_whatever_the_repeats(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    texts = []
    for words, line, times in [(200, 10, 30), (300, 8, 100), (150, 20, 10)] * 8:
        body, foot = text(words), text(line)
        texts += [f"{body} {foot}", body + f" {foot}" * times]
    assert all(jaccard(a, b) >= 0.9 for a, b in zip(texts[::2], texts[1::2], strict=True))
    got = {r["doc_id"]: r["group_id"] for r in similar_groups.similar_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert all(got[i] == got[i + 1] for i in range(0, len(texts), 2)) and len(set(got.values())) == len(texts) // 2


def test_short_sets_are_not_pruned():
    sets = [np.arange(4, dtype=np.uint32), np.arange(5, dtype=np.uint32), np.arange(3, dtype=np.uint32)]
    prints = np.array([0, (1 << 40) - 1, 0], np.uint64)
    assert similar_groups.linking_pairs(np.arange(3), prints, sets, range(3), range(3), 0.8) == [(0, 1)]


def test_radius_and_seeds_miss_next_to_nothing():
    """Pairs at 0.8 and a little above: SimHash distance, shared seeds and deeper seeds."""
    rng = np.random.default_rng(8)
    far = seedless = deep = n = 0
    for _ in range(400):
        size = int(rng.integers(30, 400))
        common = rng.integers(1, 1 << 63, int(size * 0.8) + 1, dtype=np.int64).astype(np.uint64)
        extra = rng.integers(1, 1 << 63, (2, (size - len(common)) // 2), dtype=np.int64).astype(np.uint64)
        a, b = (np.concatenate([common, x]) for x in extra)
        n += 1
        far += bin(simhash.majority(np.unique(a)) ^ simhash.majority(np.unique(b))).count("1") > similar_groups.RADIUS
        least = lambda h: [int((h * m >> np.uint64(3)).min()) for m in similar_groups._MULTIPLIERS]
        x, y = least(a), least(b)
        seedless += not any(x[2 * i : 2 * i + 2] == y[2 * i : 2 * i + 2] for i in range(similar_groups.SEEDS))
        low = lambda h: np.unique(h.astype(np.uint32)).astype("<u4").tobytes()
        deep += not {*similar_groups.deeper_seeds(low(a), 1)} & {*similar_groups.deeper_seeds(low(b), 1)}
    assert far <= 0.005 * n and seedless <= 0.01 * n and deep <= 0.005 * n
