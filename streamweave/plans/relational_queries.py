"""Queries on the relational core: joins, classes, versions, reports, encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streamweave.functions.scalar import either_prefix, flags, name_key, title_case, unzigzag, zigzag
from streamweave.operators import checks, codec, names, permits, ranking, regional, series
from streamweave.plans.inputs import HEAP, MONTHLY, heap, monthly, varint_sql
from streamweave.plans.series_queries import MK, _records
from streamweave.sources import tables
from streamweave.sources.tables import table

Q, SQL = {}, {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINE = "l_orderkey, l_linenumber, l_linestatus, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_linestatus, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_linestatus DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""")
def best_version(spark, d):
    then = [F.col(c) for c in "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_shipdate".split()]
    got = series.best_version(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_linestatus", *then)
    return got.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_linestatus", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT key, arg_min(l_partkey, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_partkey, arg_min(l_suppkey, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_suppkey,
  count(*) AS multiplicity FROM (SELECT *, l_orderkey || '-' || coalesce(CAST(nullif(l_linenumber, 0) AS VARCHAR), 'x') AS key FROM lineitem) GROUP BY key""")
def dedup_multiplicity(spark, d):
    code = F.coalesce(F.nullif(F.col("l_linenumber"), F.lit(0)).cast("string"), F.lit("x"))
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), code)
    got = series.dedup_with_count(table(spark, d, "lineitem"), key, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_partkey", "l_suppkey"])
    return got


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01')
  AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def pending_codes(spark, d):
    """Not collected yet, and not tried yet: two anti joins; the date range reaches the scan."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    in_year = o.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    tried = c.where("c_acctbal < 0").select("c_custkey")
    return c.join(in_year.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").join(tried, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT DISTINCT upper(n_name) AS key FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def uncovered_keys(spark, d):
    n = table(spark, d, "nation").withColumn("key", name_key(F.col("n_name")))
    need = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("key").distinct()
    have = table(spark, d, "supplier").where("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("key")
    return permits.uncovered(need, have, "key")


@query("""SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS nation, 'customer' AS origin FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, CAST(s_nationkey AS BIGINT), 'supplier' FROM supplier""")
def ragged_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("origin"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("long").alias("nation"), F.lit("supplier").alias("origin"))
    return tables.ragged_union(c, s)


@query("""SELECT o_custkey AS code, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def append_union(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus <> 'F'")).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH held AS (SELECT DISTINCT o_custkey AS code FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), new AS (SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT code FROM held))
SELECT code, 'held' AS origin, NULL::VARCHAR AS name FROM held UNION ALL SELECT code, 'new', name FROM new""")
def append_new_keys(spark, d):
    """What is held already, and below it the rows of another table whose keys aren't."""
    held = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select(F.col("o_custkey").alias("code")).distinct()
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name")).join(held, "code", "left_anti")
    return held.withColumn("origin", F.lit("held")).unionByName(new.withColumn("origin", F.lit("new")), allowMissingColumns=True)


CLASS = """CASE WHEN p_type IN ('STANDARD','PROMO') OR regexp_matches(p_name, '(?i)\\b(green|blue\\w*)\\b') THEN 'sewage' WHEN regexp_matches(p_type, '(?i)econ') OR p_size > 40 THEN 'industry' ELSE 'other' END"""


def _class():
    sewage = F.col("p_type").isin("STANDARD", "PROMO") | permits.matches(F.col("p_name"), r"\b(green|blue\w*)\b")
    return permits.classify([(sewage, "sewage"), (permits.matches(F.col("p_type"), "econ") | (F.col("p_size") > 40), "industry")], "other")


@query(f"SELECT p_partkey, {CLASS} AS class FROM part")
def classify_case(spark, d):
    return table(spark, d, "part").select("p_partkey", _class().alias("class"))


@query(f"""SELECT class, n, round(total, 2) AS total, round(total / sum(total) OVER () * 100, 3) AS share FROM (SELECT {CLASS} AS class, count(*) AS n, sum(p_retailprice) AS total FROM part GROUP BY 1)""")
def class_counts(spark, d):
    g = table(spark, d, "part").groupBy(_class().alias("class")).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("total"))
    return g.select("class", "n", F.round("total", 2).alias("total"), F.round(F.col("total") / F.sum("total").over(Window.partitionBy()) * 100, 3).alias("share"))


@query("""SELECT o_orderkey, CASE WHEN p = '' THEN NULL WHEN contains(p, 'urgent') THEN 'Active' WHEN contains(p, 'high') OR contains(p, 'medium') THEN 'Building' WHEN contains(p, 'low') THEN 'Planned' ELSE 'Unknown' END AS status
  FROM (SELECT o_orderkey, lower(trim(o_orderpriority)) AS p FROM orders)""")
def status_normalise(spark, d):
    p = F.lower(F.trim("o_orderpriority"))
    has = lambda *w: F.greatest(*[F.contains(p, F.lit(x)) for x in w]) if len(w) > 1 else F.contains(p, F.lit(w[0]))
    status = F.when(p == "", F.lit(None)).when(has("urgent"), "Active").when(has("high", "medium"), "Building").when(has("low"), "Planned").otherwise("Unknown")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query("""SELECT p_partkey, round(p_size * 1000 / p_retailprice, 4) AS q FROM part WHERE p_size >= 5 AND p_retailprice > 0 AND p_size * 1000 / p_retailprice BETWEEN 0.05 AND 30""")
def specific_discharge_filter(spark, d):
    q = regional.specific_discharge(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return table(spark, d, "part").where((F.col("p_size") >= 5) & (F.col("p_retailprice") > 0) & q.between(0.05, 30)).select("p_partkey", F.round(q, 4).alias("q"))


SUSPECT = """loads AS (SELECT c_nationkey AS key, sum(o_totalprice) / 1e6 AS load FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
ceil_ AS (SELECT s_nationkey AS key, sum(s_acctbal) / 1e4 AS ceiling FROM supplier GROUP BY 1), capt AS (SELECT c_nationkey AS key, sum(c_acctbal) / 1e4 AS captured FROM customer GROUP BY 1),
sus AS (SELECT key, load, ceiling, coalesce(captured, 0) AS captured FROM loads JOIN ceil_ USING (key) LEFT JOIN capt USING (key)
  WHERE load > greatest(3 * ceiling, 0.05) AND coalesce(captured, 0) >= 0.3 * load)"""


def _suspects(spark, d):
    o, c, s = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "supplier")
    loads = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("key")).agg((F.sum("o_totalprice") / 1e6).alias("load"))
    ceilings = s.groupBy(F.col("s_nationkey").alias("key")).agg((F.sum("s_acctbal") / 1e4).alias("ceiling"))
    captured = c.groupBy(F.col("c_nationkey").alias("key")).agg((F.sum("c_acctbal") / 1e4).alias("captured"))
    return permits.over_ceiling(loads, ceilings, captured, "key")


@query(f"WITH {SUSPECT} SELECT CAST(key AS BIGINT) AS key, round(load, 3) AS load, round(ceiling, 3) AS ceiling, round(captured, 3) AS captured FROM sus")
def ceiling_suspects(spark, d):
    return _suspects(spark, d).select(F.col("key").cast("long").alias("key"), *[F.round(c, 3).alias(c) for c in ("load", "ceiling", "captured")])


@query(f"""WITH {SUSPECT}, p AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'O' AND key IS NOT NULL THEN 'passes through' ELSE CASE WHEN o_orderstatus = 'O' THEN 'sewage' ELSE 'other' END END AS class
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN sus ON c_nationkey = key) SELECT o_orderkey, class FROM p ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def relabel_suspects(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.select("o_orderkey", "o_totalprice", F.col("c_nationkey").alias("key"), F.when(F.col("o_orderstatus") == "O", "sewage").otherwise("other").alias("class"))
    return permits.relabel(p, _suspects(spark, d), "key", "class", "sewage", "passes through").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "class")


@query("""SELECT l_partkey, round(least(greatest(sum(coalesce(l_quantity, 0) / 3600.0) / greatest(max(l_discount) / 10, 1e-6), 0.0), 3.0), 5) AS fraction FROM lineitem GROUP BY 1""")
def unit_fraction_clip(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(permits.flow_m3s(F.col("l_quantity"))).alias("load"), (F.max("l_discount") / 10).alias("flow"))
    return g.select("l_partkey", F.round(permits.share_of_flow(F.col("load"), F.col("flow"), 3), 5).alias("fraction"))


EDGES = [-1000.0, -25.0, -10.0, -5.0, 0.0, 5.0, 10.0, 1000.0]


@query(f"""WITH {MK}, c AS (SELECT CASE {" ".join(f"WHEN pct > {a} AND pct <= {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))} END AS class, s_acctbal FROM (SELECT code, round(pct, 6) AS pct FROM records) JOIN supplier ON code = s_suppkey)
SELECT CAST(class AS BIGINT) AS class, round(sum(s_acctbal), 2) AS km, count(*) AS n FROM c GROUP BY 1""")
def trend_classes_km(spark, d):
    r = _records(spark, d).join(table(spark, d, "supplier"), F.col("code") == F.col("s_suppkey"))
    return r.groupBy(checks.half_open_bin(F.round("pct_decade", 6), EDGES).alias("class")).agg(F.round(F.sum("s_acctbal"), 2).alias("km"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 3) AS p10, round(median(l_extendedprice), 3) AS p50, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90,
  round(quantile_cont(l_extendedprice, 0.99), 3) AS p99, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1""")
def quantile_report(spark, d):
    li = table(spark, d, "lineitem")
    q = ranking.quantiles(li, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9, 0.99])
    counts = li.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("c")).groupBy("l_returnflag").agg(F.count("*").alias("parts"), F.sum("c").alias("n"))
    return q.join(counts, "l_returnflag").select("l_returnflag", *[F.round(F.col("q")[i], 3).alias(c) for i, c in enumerate(("p10", "p50", "p90", "p99"))], "parts", "n")


@query(f"""WITH {HEAP}, s AS (SELECT id, id % 50 AS grp, id // 4096 AS block FROM heap)
SELECT CAST(grp AS BIGINT) AS grp, CAST(block AS BIGINT) AS block, string_agg(CAST(id - coalesce(prev, 0) AS VARCHAR), ',' ORDER BY id) AS deltas
FROM (SELECT *, lag(id) OVER (PARTITION BY grp, block ORDER BY id) AS prev FROM s) GROUP BY ALL""")
def index_deltas(spark, d):
    """Sorted keys as differences, a block of keys to a row; each block starts anew."""
    g = codec.in_blocks(heap(spark, d), F.col("id") % 50, "id", F.col("id"))
    return g.select("grp", "block", F.array_join(F.transform(codec.deltas(F.col("values")), lambda v: v.cast("string")), ",").alias("deltas"))


@query("""SELECT p_name AS name, row_number() OVER (ORDER BY min(p_partkey), p_name) - 1 AS code FROM part GROUP BY p_name""")
def dictionary_encode(spark, d):
    return codec.dictionary(table(spark, d, "part").withColumnRenamed("p_name", "name"), "name", "p_partkey")


@query("""SELECT p_brand, CAST(p_partkey // 4096 AS BIGINT) AS block, string_agg(CAST(p_size % 10 AS VARCHAR), '' ORDER BY p_partkey) AS digits FROM part GROUP BY ALL""")
def packed_digits(spark, d):
    g = codec.in_blocks(table(spark, d, "part"), F.col("p_brand"), "p_partkey", (F.col("p_size") % 10).cast("string"))
    return g.select(F.col("grp").alias("p_brand"), "block", F.array_join("values", "").alias("digits"))


@query("""SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(strip_accents(p_name)), 'green') """)
def river_search(spark, d):
    hits = checks.search_names(table(spark, d, "part"), "p_name", "Grëen")
    return hits.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")


def _named(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"), "c_acctbal")


@query("""WITH named AS (SELECT c_custkey, c_mktsegment || ' ' || c_name AS name, c_acctbal FROM customer),
wanted AS (SELECT DISTINCT right(c_name, 3) AS search FROM customer UNION SELECT DISTINCT substr(c_mktsegment, 3, 4) FROM customer UNION SELECT DISTINCT substr(c_name, 9, 8) FROM customer UNION SELECT DISTINCT substr(c_mktsegment, 2, 2) FROM customer UNION SELECT DISTINCT p_name FROM part)
SELECT search, count(*) AS hits, max(c_acctbal) AS best FROM wanted JOIN named ON contains(lower(strip_accents(name)), lower(strip_accents(search))) GROUP BY 1""")
def name_index_searches(spark, d):
    """Many searches of two or more letters at once, by the postings of their rarest grams."""
    c = table(spark, d, "customer")
    parts = [F.right("c_name", F.lit(3)), F.substring("c_mktsegment", 3, 4), F.substring("c_name", 9, 8), F.substring("c_mktsegment", 2, 2)]
    wanted = c.select(F.explode(F.array(*parts)).alias("search")).union(table(spark, d, "part").select("p_name")).distinct()
    index = names.build(_named(spark, d), "name")
    return names.search_all(index, wanted, "search").groupBy("search").agg(F.count("*").alias("hits"), F.max("c_acctbal").alias("best"))


@query("""SELECT c_custkey, c_mktsegment || ' ' || c_name AS name FROM customer WHERE contains(lower(strip_accents(c_mktsegment || ' ' || c_name)), 'ture customer#0000000')""")
def name_index_lookup(spark, d):
    """One search: only the postings of its rarest grams are read."""
    index = names.build(_named(spark, d), "name")
    return names.lookup(index, " TÚRE Customer#0000000 ").select("c_custkey", "name")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 1200.5")
def min_flow(spark, d):
    return table(spark, d, "part").where(F.col("p_retailprice") >= 1200.5).select("p_partkey")


@query(f"""WITH {MK} SELECT CAST(cut AS BIGINT) AS cut, count(*) FILTER (WHERE round(pct, 6) <= cut) AS n, round(coalesce(sum(s_acctbal) FILTER (WHERE round(pct, 6) <= cut), 0), 2) AS km
FROM records JOIN supplier ON code = s_suppkey CROSS JOIN (VALUES (-25), (-10), (0), (10)) t(cut) GROUP BY 1""")
def trend_filter(spark, d):
    r = _records(spark, d).join(table(spark, d, "supplier"), F.col("code") == F.col("s_suppkey"))
    cuts = r.withColumn("cut", F.explode(F.array(*[F.lit(c).cast("long") for c in (-25, -10, 0, 10)])))
    hit = F.round("pct_decade", 6) <= F.col("cut")
    return cuts.groupBy("cut").agg(F.count_if(hit).alias("n"), F.round(F.coalesce(F.sum(F.when(hit, F.col("s_acctbal"))), F.lit(0.0)), 2).alias("km"))


@query("""SELECT CAST(greatest(0, least(6, floor((log10(l_extendedprice) - log10(0.5)) / (log10(120000.0) - log10(0.5)) * 7))) AS BIGINT) AS class, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1""")
def legend_bins(spark, d):
    li = table(spark, d, "lineitem").where("l_extendedprice > 0")
    return li.groupBy(checks.log_bin(F.col("l_extendedprice"), 0.5, 120000.0, 7).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE l_quantity / 50 >= 0.5) AS over_half, count(*) FILTER (WHERE l_quantity / 50 >= 1) AS over_one, count(*) FILTER (WHERE l_quantity / 50 >= 0.01) AS over_cent FROM lineitem")
def threshold_counts(spark, d):
    f = F.col("l_quantity") / 50
    return table(spark, d, "lineitem").agg(F.count_if(f >= 0.5).alias("over_half"), F.count_if(f >= 1).alias("over_one"), F.count_if(f >= 0.01).alias("over_cent"))


@query("""SELECT coalesce(a.k, b.k) AS key, a.v AS left_value, b.v AS right_value FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_partkey % 11 <> 3) a
  FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 1 THEN p_retailprice + 1 ELSE p_retailprice END AS v FROM part WHERE p_partkey % 17 <> 5) b ON a.k = b.k WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 0""")
def guard_mismatch(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("v"))
    other = p.where("key % 17 <> 5").withColumn("v", F.when(F.col("key") % 13 == 1, F.col("v") + 1).otherwise(F.col("v")))
    return checks.mismatches(p.where("key % 11 <> 3"), other, "key", "v")


@query("""SELECT s_suppkey AS code, nullif(trim(s_name), '') AS name, TRY_CAST(substr(s_name, 10) AS DOUBLE) AS number, CAST(CASE WHEN s_acctbal < 1000 THEN 0.001 WHEN s_acctbal < 5000 THEN 0.003 ELSE 0.01 END AS DOUBLE) AS tolerance,
  nullif(CASE WHEN s_acctbal > 0 THEN 'T' ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN 'Q' ELSE '' END, '') AS flags FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey <> 3""")
def project_cast_filter(spark, d):
    s = table(spark, d, "supplier").withColumn("tail", F.expr("substring(s_name, 10)")).where(F.col("s_acctbal").isNotNull() & (F.col("s_nationkey") != 3))
    tolerance = F.when(F.col("s_acctbal") < 1000, 0.001).when(F.col("s_acctbal") < 5000, 0.003).otherwise(0.01)
    marks = flags(T=F.col("s_acctbal") > 0, S=F.col("s_suppkey") % 2 == 0, Q=F.col("s_suppkey") % 3 == 0)
    return s.select(F.col("s_suppkey").alias("code"), F.nullif(F.trim("s_name"), F.lit("")).alias("name"), tables.lenient("tail", "double", "number"), tolerance.alias("tolerance"), marks.alias("flags"))


@query(f"WITH {MONTHLY} SELECT code, s_name AS name, count(*) AS months, round(sum(value), 3) AS total FROM monthly JOIN supplier ON CAST(code AS VARCHAR) = CAST(s_suppkey AS VARCHAR) GROUP BY ALL")
def join_inner(spark, d):
    """Keys are forced to text, as codes are; the aggregate comes before the join."""
    m = monthly(spark, d).groupBy("code").agg(F.count("*").alias("months"), F.round(F.sum("value"), 3).alias("total")).withColumn("k", F.col("code").cast("string"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("name"))
    return m.join(s, "k").drop("k")


@query("SELECT CAST(regionkey AS BIGINT) AS regionkey, n_name, r_name FROM (SELECT n_regionkey AS regionkey, n_name FROM nation) JOIN (SELECT r_regionkey AS regionkey, r_name FROM region) USING (regionkey)")
def join_using(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("regionkey"), "n_name")
    return n.join(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("regionkey"), "r_name"), "regionkey")


@query(f"WITH {MK} SELECT code, round(greatest(pct, -25.0), 3) AS pct, years, CAST(first AS BIGINT) AS ini, CAST(last AS BIGINT) AS fim FROM records WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def member_filter(spark, d):
    shown = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"))
    r = _records(spark, d).join(shown, "code", "left_semi")
    return r.select("code", F.round(F.greatest("pct_decade", F.lit(-25.0)), 3).alias("pct"), "years", F.col("first").cast("long").alias("ini"), F.col("last").cast("long").alias("fim"))


@query("""WITH a AS (SELECT upper(n_name) || '|' || upper(r_name) AS key, sum(c_acctbal) AS captured FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
b AS (SELECT upper(n_name) || '|' || upper(r_name) AS key, sum(s_acctbal) AS ceiling FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT key, round(coalesce(captured, 0), 2) AS captured, round(ceiling, 2) AS ceiling, starts_with(key, 'I') OR starts_with('I', key) AS agrees FROM (SELECT DISTINCT upper(n_name) || '|' || upper(r_name) AS key FROM nation JOIN region ON n_regionkey = r_regionkey) k LEFT JOIN a USING (key) LEFT JOIN b USING (key)""")
def key_ceiling_capture(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", name_key(F.col("n_name"), F.col("r_name"), separator="|").alias("key"))
    a = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("key").agg(F.sum("c_acctbal").alias("captured"))
    b = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("key").agg(F.sum("s_acctbal").alias("ceiling"))
    k = n.select("key").distinct().join(a, "key", "left").join(b, "key", "left")
    return k.select("key", F.round(F.coalesce("captured", F.lit(0.0)), 2).alias("captured"), F.round("ceiling", 2).alias("ceiling"), either_prefix(F.col("key"), F.lit("I")).alias("agrees"))


@query("SELECT l_partkey AS reach, l_returnflag AS class, round(sum(l_quantity / 3600), 5) AS load, count(*) AS n FROM lineitem GROUP BY ALL")
def load_by_reach(spark, d):
    g = permits.load_by_class(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", permits.flow_m3s(F.col("l_quantity")))
    return g.select(F.col("l_partkey").alias("reach"), F.col("l_returnflag").alias("class"), F.round("load", 5).alias("load"), "n")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount >= 0.05 AND l_tax > 0) AS discounted, CAST(min(year(l_shipdate)) AS BIGINT) AS first_year, CAST(max(year(l_shipdate)) AS BIGINT) AS last_year FROM lineitem""")
def kpi_counts(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if((F.col("l_discount") >= 0.05) & (F.col("l_tax") > 0)).alias("discounted"), F.year(F.min("l_shipdate")).cast("long").alias("first_year"), F.year(F.max("l_shipdate")).cast("long").alias("last_year"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def multi_sort_topk(spark, d):
    """Top of each key first (a window group limit), then the top of all."""
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    r = table(spark, d, "orders").withColumn("rn", best).where("rn = 1")
    return r.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_custkey", "o_orderkey", "o_totalprice", "rn")


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_keys(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("""SELECT p_partkey, round(p_retailprice / 7, 3) AS r, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z, v AS back, round(sqrt(abs(v)) + exp(-abs(v)) + sign(v), 6) AS m, CASE WHEN v > 0 THEN round(log10(v), 6) END AS lg
  FROM (SELECT *, 100 - p_partkey AS v FROM part)""")
def round_math_bits(spark, d):
    v = (F.lit(100) - F.col("p_partkey")).cast("long")
    m = F.sqrt(F.abs(v)) + F.exp(-F.abs(v)) + F.signum(v)
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 3).alias("r"), zigzag(v).alias("z"), unzigzag(zigzag(v)).alias("back"), F.round(m, 6).alias("m"), F.when(v > 0, F.round(F.log10(v), 6)).alias("lg"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, user_id AS back_user, event_type AS back_type FROM events""")
def json_struct_roundtrip(spark, d):
    e = table(spark, d, "events")
    packed = e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("user_id", "event_type")).alias("j"))
    back = packed.withColumn("s", F.from_json("j", "user_id long, event_type string"))
    return back.select("event_id", "k", F.col("s.user_id").alias("back_user"), F.col("s.event_type").alias("back_type"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM embeddings")
def xy_extract(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), F.round(F.col("embedding")[1].cast("double"), 6).alias("y"))


@query("SELECT s_suppkey AS code, CAST(NULL AS DOUBLE) AS load FROM supplier")
def optional_layer(spark, d):
    """A layer whose file is missing is empty, and the rest goes on."""
    layer = tables.optional(spark, f"{d}/no_such_layer.parquet", "code long, load double")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("code")).join(layer, "code", "left")


@query(f"""WITH {HEAP}, s AS (SELECT id, id % 40 AS grp, id // 4096 AS block, id * 7 - 900 AS v FROM heap), df AS (SELECT grp, block, id, v - coalesce(lag(v) OVER (PARTITION BY grp, block ORDER BY id), 0) AS delta FROM s)
SELECT CAST(grp AS BIGINT) AS grp, CAST(block AS BIGINT) AS block, string_agg({varint_sql("delta")}, '' ORDER BY id) AS text, true AS same FROM df GROUP BY ALL""")
def varint_roundtrip(spark, d):
    """Values to text and back, block by block; `same` must hold on every row."""
    g = codec.in_blocks(heap(spark, d), F.col("id") % 40, "id", (F.col("id") * 7 - 900).cast("long"))
    packed = g.withColumn("text", codec.encode_varint(codec.deltas(F.col("values"))))
    back = packed.withColumn("back", codec.running_sum(codec.decode_varint(F.col("text"))))
    return back.select("grp", "block", "text", (F.col("back") == F.col("values")).alias("same"))


@query("""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_mktsegment || '-' || lower(c_name), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS name FROM customer""")
def title_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", title_case(F.concat("c_mktsegment", F.lit("-"), F.lower("c_name"))).alias("name"))


REACHES = "reaches AS (SELECT p_partkey // 4 AS river, p_name AS name, p_retailprice AS flow, CASE WHEN p_size > 5 THEN substr(p_brand, 7) END AS state FROM part)"


def _reaches(spark, d):
    p = table(spark, d, "part")
    return p.select(F.expr("p_partkey div 4").alias("river"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("flow"), F.when(F.col("p_size") > 5, F.expr("substring(p_brand, 7)")).alias("state"))


@query(f"""WITH {REACHES}, hits AS (SELECT * FROM reaches WHERE contains(lower(strip_accents(name)), 'green')), found AS (SELECT river, min(name) AS name, max(flow) AS flow FROM hits GROUP BY 1),
per AS (SELECT river, state, count(*) AS c FROM hits WHERE state IS NOT NULL GROUP BY 1, 2), top AS (SELECT river, state FROM (SELECT *, row_number() OVER (PARTITION BY river ORDER BY c DESC, state) AS rn FROM per) WHERE rn <= 2),
labels AS (SELECT river, string_agg(state, '/' ORDER BY state) AS states FROM top GROUP BY 1)
SELECT found.river, name, flow, coalesce(states, '') AS states FROM found LEFT JOIN labels USING (river)""")
def river_hits(spark, d):
    """A hit per river id with the states it lies in."""
    return checks.search_rivers(_reaches(spark, d), "river", "name", "flow", "state", " GRÉEN ").orderBy(F.desc("flow"), "river")


@query(f"""WITH {REACHES}, best AS (SELECT river, max(flow) AS flow, min(name) AS name FROM reaches GROUP BY 1 HAVING min(name) LIKE '%e%' AND NOT regexp_matches(min(name), '\\b(ring|gear)\\b'))
SELECT river, name, flow FROM best ORDER BY flow DESC, river LIMIT 20""")
def top_named_rivers(spark, d):
    """The twenty largest rivers of a kind of name, without excluded labels."""
    best = _reaches(spark, d).groupBy("river").agg(F.max("flow").alias("flow"), F.min("name").alias("name"))
    named = best.where(F.col("name").contains("e") & ~permits.matches(F.col("name"), r"\b(ring|gear)\b"))
    return named.orderBy(F.desc("flow"), "river").limit(20).select("river", "name", "flow")


@query("""SELECT 'head' AS side, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL
SELECT 'tail', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 5)""")
def ranking_ends(spark, d):
    """Head and tail of a ranking: two bounded top-k, no full sort."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    head = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.lit("head").alias("side"), "*")
    tail = o.orderBy("o_totalprice", F.desc("o_orderkey")).limit(5).select(F.lit("tail").alias("side"), "*")
    return head.unionByName(tail)


@query("""SELECT count(*) FILTER (WHERE s_suppkey IS NOT NULL) AS matched, count(*) FILTER (WHERE s_suppkey IS NULL) AS orphans, count(*) FILTER (WHERE s_suppkey IS NOT NULL AND coalesce(s_nationkey % 5 = c_nationkey % 5, false)) AS agrees
FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey""")
def match_counters(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_nationkey")
    m = table(spark, d, "customer").join(s, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return checks.match_quality(m, F.col("s_suppkey").isNotNull(), F.coalesce(F.col("s_nationkey") % 5 == F.col("c_nationkey") % 5, F.lit(False)))
