"""The index of names against the scan of all of them."""

import random

from pyspark.sql import functions as F

from streamweave.operators import checks, names

PARTS = ["Rio", "São", "Preto", "Francisco", "do", "Ribeirão", "Xingu", "ﬁno", "Água", "aaa", "a", ""]


def _rows(spark):
    rng = random.Random(5)
    made = [(i, " ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4)))) for i in range(400)]
    return spark.createDataFrame([*made, (400, None), (401, ""), (402, "rio PRETO"), (403, "Rio Preto"), (404, "é o%_\\")], "id int, name string").cache()


def test_lookup_equals_the_scan(spark):
    rows = _rows(spark)
    index = names.build(rows, "name")
    for wanted in ("São Franc", "SAO FRANC", "ri", "o p", " xingu ", "aaa", "aaaa", "fino", "é", "r", "", "zzqx", "riozz", "%_\\", "AG"):
        scan = {r["id"] for r in checks.search_names(rows, "name", wanted).collect()}
        got = [r["id"] for r in names.lookup(index, wanted).collect()]
        assert sorted(got) == sorted(scan), wanted
    wanted = [("rio preto",), ("sao",), ("o ",), ("zz",), ("x",), (None,), ("aa",), ("AA",), ("ribeirao do",), ("aa",)]
    got = {(r["search"], r["id"]) for r in names.search_all(index, spark.createDataFrame(wanted, "s string"), "s").collect()}
    want = {(w, r["id"]) for (w,) in set(wanted) if w and len(w.strip()) > 1 for r in checks.search_names(rows, "name", w).collect()}
    assert got == want
    assert names.search_all(index, spark.createDataFrame([], "s string"), "s").count() == 0
    index.drop()


def test_only_postings_of_the_grams_are_read(spark):
    rows = spark.range(5_000).select("id", F.concat(F.lit("rio "), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    index = names.build(rows, "name")
    some = rows.where("id = 1234").first()["name"][:12]
    chosen = names.needed(index, spark.createDataFrame([(some,)], "s string"), "s").collect()
    assert len(chosen) == names.RAREST and "rio" not in {r["gram"] for r in chosen}
    assert sum(r["n"] for r in chosen) < 3_000  # of some 300,000 postings
    got = names.lookup(index, some)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters: [In(gram" in plan
    assert 1234 in {r["id"] for r in got.collect()}
    empty = names.build(rows.limit(0), "name")
    assert names.lookup(empty, "rio").count() == 0 and names.search_all(empty, rows, "name").count() == 0


def test_postings_read_grow_with_the_hits(spark):
    """Twenty searches of eight letters, a hundred hits each: what is read isn't the product of searches and names."""
    rows = spark.range(2_000).select("id", F.format_string("river#%09d", F.col("id")).alias("name"))
    wanted = rows.select(F.substring("name", 6, 8).alias("s")).distinct()  # '#' and seven digits
    index = names.build(rows, "name")
    assert wanted.count() == 20 and names.search_all(index, wanted, "s").count() == 2_000
    assert names.needed(index, wanted, "s").agg(F.sum("n")).first()[0] == 2_000
    index.drop()
