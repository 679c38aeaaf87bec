"""Forests with dangling keys and cycles, ranks, packed text, and the sources' paging."""

import json
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from streamweave.functions.scalar import title_case, without_accents
from streamweave.operators import checks, codec, forest, ranking, spatial, trend
from streamweave.sources import paged, sinks, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dangling_keys_end_the_forest(spark):
    df = frame(spark, [(1, None, 1.0), (2, 1, 1.0), (3, 99, 1.0), (4, 3, 1.0), (5, 4, 1.0)], "id long, down long, v double")
    assert {r["id"]: r["root"] for r in forest.roots(df, "id", "down").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert {r["id"]: r["v"] for r in forest.accumulate(df, "id", "down", ["v"]).collect()} == {1: 2.0, 2: 1.0, 3: 3.0, 4: 2.0, 5: 1.0}
    owner = forest.nearest_anchor_downstream(df, "id", "down", F.col("id") == 4)
    assert {r["id"]: r["owner"] for r in owner.collect()} == {1: None, 2: None, 3: None, 4: 4, 5: 4}


@pytest.mark.parametrize("edges", [[(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (4, 1)]])
def test_cycles_are_errors(spark, edges):
    df = frame(spark, [(a, b, 1.0) for a, b in edges], "id long, down long, v double")
    with pytest.raises(ValueError):
        forest.roots(df, "id", "down")
    with pytest.raises(ValueError):
        forest.accumulate(df, "id", "down", ["v"])


def plain_forest(down, value):
    totals, root = dict(value), {}
    for n in down:
        at = n
        while down.get(at) in down:
            at = down[at]
            totals[at] += value[n]
        root[n] = at
    return {n: (root[n], totals[n]) for n in down}


@pytest.mark.parametrize("kind, n, finish", [("chain", 600, 40), ("star", 600, 0), ("random", 600, 20), ("deep", 60, 0), ("broom", 400, 1 << 17)])
def test_contraction_is_linear(spark, kind, n, finish):
    rng = random.Random(kind)
    down = {i: None if i == 0 else {"chain": i - 1, "star": 0, "random": rng.randrange(i), "deep": i - 1 - i % 3 if i > 2 else 0, "broom": i - 1 if i < n // 2 else n // 2 - 1}[kind] for i in range(n)}
    names = rng.sample(range(10_000), n)  # keys in no order
    down = {names[k]: None if v is None else names[v] for k, v in down.items()} | {-1: None, -2: 77_777}
    value = {k: rng.randrange(100) for k in down}
    df = frame(spark, [(k, v, value[k]) for k, v in down.items()], "id long, down long, v long")
    want = plain_forest(down, value)
    sizes = []
    got = forest.contract(df, "id", "down", ["v"], finish=finish, sizes=sizes)
    assert {r["node"]: (r["root"], r["v"]) for r in got.collect()} == want
    assert sum(sizes) <= 4 * n and len(sizes) <= 16
    # A written table's size, not a product of the rounds' estimates.
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20


def test_rings_are_numbered(spark):
    rings = [[5, 9, 2, 7], [11, 10], [20], list(range(40, 140))]
    rows = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1])]
    got = {r["id"]: (r["ring"], r["position"]) for r in forest.ring_positions(frame(spark, rows, "id long, next long"), "id", "next").collect()}
    want = {}
    for r in rings:
        at = r.index(min(r))
        want |= {n: (min(r), i) for i, n in enumerate(r[at:] + r[:at])}
    assert got == want


def test_numbers_totals_and_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), float(rng.randrange(12))) for _ in range(500)] + [("d", None), (None, 3.0), ("e", 1.0)]
    df = frame(spark, rows, "k string, v double")
    got = ranking.numbered(df, "k", "v", F.lit(0), name="n", total="all").collect()
    assert sorted(r["n"] for r in got) == list(range(503)) and {r["all"] for r in got} == {503}
    q = {r["k"]: r["q"] for r in ranking.quantiles(df, ["k"], "v", [0.1, 0.5, 1.0]).collect()}
    for k in ("a", "b", "c"):
        values = [v for x, v in rows if x == k]
        assert q[k][1] == pytest.approx(statistics.median(values)) and q[k][2] == max(values)
        assert q[k][0] == pytest.approx(statistics.quantiles(values, n=10, method="inclusive")[0])
    assert q["e"] == [1.0, 1.0, 1.0] and q[None] == [3.0, 3.0, 3.0] and "d" not in q
    assert ranking.numbered(df.limit(0), "k").count() == 0


def test_false_discovery_over_ranges(spark):
    rng = random.Random(6)
    ps = [round(rng.random() ** 2, 3) for _ in range(200)]
    got = {r["k"]: (r["rank"], r["q"]) for r in trend.benjamini_hochberg(frame(spark, [*enumerate(ps)], "k int, p double"), "p", "k").collect()}
    order = sorted(range(200), key=lambda i: (ps[i], i))
    least = 1.0
    for rank in range(200, 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * 200 / rank)
        assert got[i] == (rank, pytest.approx(least))


def test_varint_text_is_the_formats(spark):
    row = frame(spark, [([31, -32, 0, 1],)], "v array<bigint>").select(codec.encode_varint(F.col("v")).alias("t")).first()
    assert row["t"] == "-B_BAC"


def test_long_arrays_are_linear(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: (i * 7919 % 1000).cast("bigint")).alias("v"))
    began = time.time()
    back = df.select("v", codec.encode_varint(codec.deltas(F.col("v"))).alias("t")).select("v", codec.running_sum(codec.decode_varint(F.col("t"))).alias("b"))
    assert back.where("v = b").count() == 1
    assert time.time() - began < 20


def test_marks_and_titles(spark):
    row = frame(spark, [("ŢĂŐ éã Ñandú", "são JOÃO-d'el rei")], "a string, b string").select(without_accents(F.col("a")).alias("a"), title_case(F.col("b")).alias("b")).first()
    assert row["a"] == "TAO ea Nandu" and row["b"] == "São João-D'El Rei"


def test_river_hits_have_states(spark):
    rows = [(1, "Rio Preto", 5.0, "BA"), (1, "Rio Preto", 9.0, "AL"), (1, "Rio Preto", 1.0, "AL"), (2, "Rio Prêto", 7.0, None), (3, "Outro", 8.0, "SP"), (4, None, 1.0, "SP")]
    got = checks.search_rivers(frame(spark, rows, "id int, name string, q double, uf string"), "id", "name", "q", "uf", "rio preto").orderBy(F.desc("flow")).collect()
    assert [(r["river"], r["flow"], r["states"]) for r in got] == [(1, 9.0, "AL/BA"), (2, 7.0, "")]
    assert checks.count_gap(frame(spark, [(1,)], "a int"), 3) == 2


def test_nearest_within_radius(spark):
    rng = random.Random(7)
    pts = [(i, rng.uniform(-30, 5), rng.uniform(-70, -35)) for i in range(40)]
    sts = [(i, rng.uniform(-30, 5), rng.uniform(-70, -35)) for i in range(60)]
    got = spatial.nearest_within_km(frame(spark, pts, "id int, lat double, lon double"), frame(spark, sts, "st int, slat double, slon double"), "id", "st", 3, 400.0)
    import math

    km = lambda a, b, c, d: 6371.0 * math.hypot(math.radians(d - b) * math.cos(math.radians((a + c) / 2)), math.radians(c - a))
    want = {(i, s, n) for i, la, lo in pts for n, (dist, s) in enumerate(sorted((km(la, lo, a, b), s) for s, a, b in sts)[:3], 1) if dist <= 400}
    assert {(r["id"], r["st"], r["nth"]) for r in got.collect()} == want


def test_long_segments_cross_few_cells(spark):
    rng = random.Random(8)
    seg = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(30)] + [(99, 1.0, -1.5, 1.0, 1.5), (98, -1.0, 0.5, 1.0, 0.5)]
    pts = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(80)]
    got = spatial.near_segments(frame(spark, pts, "id int, x double, y double"), frame(spark, seg, "line int, x1 double, y1 double, x2 double, y2 double"), 0.1)

    def far(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return ((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2) ** 0.5

    assert {(r["id"], r["line"]) for r in got.collect()} == {(p[0], s[0]) for p in pts for s in seg if far(p[1], p[2], *s[1:]) < 0.1}


def test_pages_until_short(spark):
    for total in (0, 1, 9, 10, 11, 25, 80, 87):
        calls = []

        def fetch(offset, size, total=total, calls=calls):
            calls.append(offset)
            return [{"id": i} for i in range(offset, min(total, offset + size))]

        assert paged.find_total(fetch, 10) == total and len(calls) <= 10
    df = paged.read_until_short(spark, lambda offset, size: [{"id": i} for i in range(offset, min(25, offset + size))], 100, "id int", server_most=10)
    assert sorted(r["id"] for r in df.collect()) == list(range(25))
    assert paged.page_size_of(100, None) == 100 and paged.page_size_of(100, 40) == 40


def test_geojson_in_splits(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"id": i}, "geometry": {"type": "LineString", "coordinates": [[i, 1], [2, 3]]}} for i in range(200)]
    text = json.dumps({"type": "FeatureCollection", "features": features}, separators=(",", ":"))
    (tmp_path / "g.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.geojson_scan(spark, str(tmp_path / "g.json"), "id: long")
        assert got.rdd.getNumPartitions() > 2
        assert sorted(r["id"] for r in got.collect()) == list(range(200))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sinks.geojson_collections(got.select("id", "coordinates").repartition(3), str(tmp_path / "out"), "coordinates")
    back = [f for p in (tmp_path / "out").glob("part-*") for f in json.loads(p.read_text())["features"]]
    assert sorted(f["properties"]["id"] for f in back) == list(range(200)) and back[0]["type"] == "Feature"
    sinks.geojson_lines(got.select("id", "coordinates"), str(tmp_path / "lines"), "coordinates")
    assert spark.read.text(str(tmp_path / "lines")).count() == 200


def test_xml_series_and_consult(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<all><row><m>1</m><level>1</level><v>5</v></row><row><m>1</m><level>2</level><v>7</v></row><row><m>2</m><level>1</level><v>9</v></row></all>")
    got = tables.xml_series(spark, str(tmp_path / "x.xml"), "row", "m int, level int, v double", ["m"], "level", "v")
    assert {r["m"]: r["v"] for r in got.collect()} == {1: 7.0, 2: 9.0}
    assert tables.consult(spark, "SELECT sum(v) AS s FROM {t}", t=got).first()["s"] == 16.0


def test_ligatures_are_spelt_out(spark):
    texts = ["ofﬁce ﬂæﬀ", "Ǆor ŉa ĳs", "São Tomé", "e\u0301t\u00e9", "", None, "Łódź ñandú ﬁ" * 200, "한글"]
    import unicodedata

    got = [r[0] for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(without_accents(F.col("t"))).collect()]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert got[:-1] == [plain(t) for t in texts[:-1]] and got[-1] == "한글"


def test_a_service_tells_its_limit_and_misses_are_told(spark):
    import warnings

    told = lambda n: {"maxRecordCount": 7, "count": n}
    fetch = lambda at, size: [{"a": i} for i in range(at, min(at + size, 20))]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert sorted(r["a"] for r in paged.read_service(spark, lambda: told(20), fetch, "a int").collect()) == list(range(20))
    with pytest.warns(UserWarning, match="received 20 rows of 23"):
        assert paged.read_service(spark, lambda: told(23), fetch, "a int", name="paged_short").count() == 20
