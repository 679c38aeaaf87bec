"""Consistent weighted sampling and Hilbert shards."""

import hashlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from streamweave.llm import fingerprints, sharding


def similarity(a, b):
    x, y = Counter(a.encode().split()), Counter(b.encode().split())
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in got}
    errors = []
    for i, (doc, text) in enumerate(order):
        text, follows = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        r = got[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        errors.append((r["near_edited"] - similarity(text, edited) if text.split() else 0.0, r["near_next"] - similarity(text, follows) if text.split() and follows.split() else 0.0))
    return np.array(errors)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = fingerprints.fingerprints(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(got) == len(rows)
    errors = check(rows, got)
    assert abs(errors.mean(axis=0)).max() < 0.02 and errors.std(axis=0).max() < 0.1
    texts = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_edges(spark):
    rows = [(1, None), (2, ""), (5, "  "), (7, "Ünï cödé " * 9), (9, "a b"), (9, "a c"), (11, "word " * 40_000), (12, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Fingerprint", F.lit("x")).withColumn("run", F.lit(1))
    got = fingerprints.fingerprints(df).collect()
    assert len(got) == len(rows)
    check([r for r in rows], got)
    one = fingerprints.fingerprints(spark.createDataFrame([(4, "x y z w")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"x yx y").hexdigest() or one["n_chars"] == 7
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "n m"), (None, "n m"), (1, "q")], "doc_id long, text string")
    assert fingerprints.fingerprints(nulls).count() == 3


def test_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        assert set(np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)) == {1}


def test_shards(spark, tmp_path):
    rows = [(i, None if i == 3 else "é" * (i % 17), None if i == 5 else "en", "s", i % 17) for i in range(101)] + [(7, "x", "en", "s", None), (None, "x", "de", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, n_chars long")
    got = sharding.hilbert_shards(df, ["n_chars", "lang", "shard"]).collect()
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    one = next(r for r in got if r["doc_id"] == 4)
    assert one["size"] == 9 and one["text_crc32"] == zlib.crc32("éééé".encode()) and one["grown_shard"] is None
    assert next(r for r in got if r["doc_id"] == 3)["size"] == 1
    assert sharding.hilbert_shards(df.limit(0), ["n_chars", "lang"]).count() == 0
    few = sharding.hilbert_shards(df.limit(3), ["n_chars"]).collect()
    assert len({r["shard"] for r in few}) == 3
    unique = df.where("doc_id < 50 and text <> 'x'").withColumnRenamed("shard", "source")
    sharding.write_shards(unique, str(tmp_path / "out"), ["n_chars", "lang"], shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == unique.count()


def test_curve_prunes_better_than_row_order():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 32, (4000, 2))
    order = np.argsort(sharding.hilbert_index(cells, 5))
    spans = lambda c: np.mean([np.ptp(p, axis=0).prod() for p in np.array_split(c, 16)])
    assert spans(cells[order]) < 0.3 * spans(cells)


def test_text_marks_are_quantiles(spark):
    values = ["b"] * 50 + ["a"] * 25 + ["d"] * 20 + ["c"] * 5 + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "v string")
    order = sorted(v for v in values if v)
    assert sharding.text_marks(df, "v", 3) == [order[len(order) * j // 8] if len(order) * j % 8 else order[len(order) * j // 8] for j in range(1, 8)]
    assert sharding.text_marks(df.limit(0), "v", 3) == []


def test_shards_prune_every_dimension(spark, sf):
    """A query for one value opens the shards whose least..greatest holds it."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").dropDuplicates(["doc_id"])
    got = docs.join(sharding.hilbert_shards(docs, ["n_chars", "lang", "source"]).select("doc_id", "shard"), "doc_id").select("shard", "n_chars", "lang", "source").collect()
    opened = {}
    for at, d in enumerate(("n_chars", "lang", "source"), 1):
        values = [[r[at] for r in got if r["shard"] == s and r[at] is not None] for s in range(8)]
        spans = [(min(v), max(v)) for v in values]
        every = [r[at] for r in got if r[at] is not None]
        opened[d] = sum(sum(a <= x <= b for a, b in spans) for x in every) / len(every) / 8
    assert sum(opened.values()) < 2.1 and max(opened.values()) < 0.9, opened


def test_placement_equals_a_plain_sort(spark):
    rows = [(i, f"text {i * 7 % 13}", i * i % 31, "abcdefg"[i % 7]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, w string")
    got = {r["doc_id"]: (r["shard"], r["slot"], r["curve_index"]) for r in sharding.hilbert_shards(df, ["n", "w"]).collect()}
    order = sorted(rows, key=lambda r: (got[r[0]][2], zlib.crc32(r[1].encode()), r[0]))
    for rank, r in enumerate(order):
        shard = (rank * 8 + 7) // 150
        assert got[r[0]][:2] == (shard, rank - shard * 150 // 8)
    # Equal words are in one cell, and cells follow the order of the words.
    marks = sharding.text_marks(df, "w", 5)
    cell = lambda w: sum(m <= w for m in marks)
    assert sorted("abcdefg", key=cell) == list("abcdefg") and len({cell(w) for w in "abcdefg"}) == 7
    numbers = sorted(df.approxQuantile("n", [i / 32 for i in range(1, 32)], 0.25 / 32))
    cells = np.array([[sum(m <= r[2] for m in numbers), cell(r[3])] for r in rows])
    assert [got[r[0]][2] for r in rows] == sharding.hilbert_index(cells, 5).tolist()


def test_large_and_null_ids(spark):
    big = 1 << 60
    rows = [(big + i, f"w{i} v{i} u{i}") for i in range(60)]
    check(rows, fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    only = fingerprints.fingerprints(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 0.0
