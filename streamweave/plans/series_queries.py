"""Queries on time series and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streamweave.functions.scalar import alphanumeric_key, name_key
from streamweave.operators import permits as permit_ops
from streamweave.operators import series, spatial, trend
from streamweave.operators.spatial import first_per
from streamweave.plans.inputs import ANNUAL, DAILY, MONTHLY, STATIONS, WINDOWS, annual, daily, monthly, stations
from streamweave.sources.tables import table

Q, SQL = {}, {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MK = ANNUAL + """,
pairs AS (SELECT a.code, b.year - a.year AS dx, b.value - a.value AS dy FROM annual a JOIN annual b ON a.code = b.code AND a.year < b.year),
sums AS (SELECT code, sum(sign(dy)) AS s, median(dy / dx) AS slope FROM pairs GROUP BY code),
ties AS (SELECT code, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT code, value, count(*) AS t FROM annual GROUP BY ALL) GROUP BY code),
mk AS (SELECT code, n, s, slope, CASE WHEN var > 0 AND s <> 0 THEN (s - sign(s)) / sqrt(var) ELSE 0.0 END AS z
  FROM (SELECT *, CAST(n * (n - 1) * (2 * n + 5) - tied AS DOUBLE) / 18 AS var FROM ties JOIN sums USING (code))),
stats AS (SELECT code, count(*) AS years, max(year) AS last, min(year) AS first, avg(value) AS mean FROM annual GROUP BY code),
records AS (SELECT code, CAST(years AS BIGINT) AS years, first, last, mean, z, slope, slope * 10 / mean * 100 AS pct
  FROM stats JOIN mk USING (code) WHERE years >= 5 AND last >= 2000 AND mean > 0)"""
ERFC = """greatest(0.0, 1.0 - 1.1283791670955126 * exp(-x * x) * list_sum(list_transform(range(0, 120),
  lambda k: exp(coalesce(k * ln(nullif(2 * x * x, 0)), CASE WHEN k = 0 THEN 0.0 ELSE -745.0 END) - list_sum(list_transform(range(0, k + 1), lambda m: ln(2 * m + 1)))))) * x)"""


def _records(spark, d):
    return trend.trend_records(annual(spark, d), "code", "year", "value", min_years=5, last_year=2000)


@query(f"WITH {MK} SELECT code, years, round(z, 4) AS z, round(slope, 4) AS slope, round(pct, 4) AS pct_decade FROM records")
def trend_sen_mk(spark, d):
    r = _records(spark, d)
    return r.select("code", "years", F.round("z", 4).alias("z"), F.round("slope", 4).alias("slope"), F.round("pct_decade", 4).alias("pct_decade"))


@query(f"""WITH {ANNUAL}, stats AS (SELECT code, count(*) AS years, max(year) AS last, avg(value) AS mean FROM annual GROUP BY code)
SELECT CASE WHEN years < 7 THEN 'short' WHEN last < 2001 THEN 'ended' WHEN s_suppkey IS NULL THEN 'unknown' WHEN NOT mean > 25.5 THEN 'no flow' ELSE 'eligible' END AS reason,
  count(*) AS n FROM stats LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON code = s_suppkey GROUP BY 1""")
def trend_reject_reasons(spark, d):
    stats = annual(spark, d).groupBy("code").agg(F.count("*").alias("years"), F.max("year").alias("last"), F.avg("value").alias("mean"))
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), F.lit(True).alias("known"))
    rows = stats.join(known, "code", "left")
    reason = trend.reject_reason(F.col("years"), F.col("last"), F.coalesce("known", F.lit(False)), F.col("mean") - 25.5, 7, 2001)
    return rows.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {MK}, p AS (SELECT code, z, abs(z) / sqrt(2.0) AS x FROM records) SELECT code, round(z, 4) AS z, round({ERFC}, 6) AS p FROM p")
def trend_pvalue(spark, d):
    r = _records(spark, d).withColumn("p", F.round(trend.p_value(F.col("z")), 6))
    return r.select("code", F.round("z", 4).alias("z"), "p")


@query(f"""WITH {MK}, x AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM records), p AS (SELECT code, years, {ERFC} AS p FROM x),
r AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), code) AS rk, count(*) OVER () AS m FROM p),
q AS (SELECT *, least(1.0, min(round(p, 9) * m / rk) OVER (ORDER BY rk DESC)) AS q FROM r)
SELECT code, CAST(rk AS BIGINT) AS rank, round(q, 6) AS q, q < 0.5 AS sig, regexp_matches(s_name, '(?i)0[0-4]\\b') AS works,
  q < 0.5 AND NOT regexp_matches(s_name, '(?i)0[0-4]\\b') AND years >= 7 AS ranked FROM q JOIN supplier ON code = s_suppkey""")
def trend_fdr_rank(spark, d):
    r = _records(spark, d).select("code", "years", F.round(trend.p_value(F.col("z")), 9).alias("p"))
    q = trend.benjamini_hochberg(r, "p", "code")
    named = q.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_name"), "code")
    works = permit_ops.matches(F.col("s_name"), r"0[0-4]\b")
    sig = F.col("q") < 0.5
    return named.select("code", F.col("rank").cast("long").alias("rank"), F.round("q", 6).alias("q"), sig.alias("sig"), works.alias("works"), (sig & ~works & (F.col("years") >= 7)).alias("ranked"))


PLACE = """(s_suppkey * 37 % 90)::DOUBLE / 10 AS lat, (s_suppkey * 53 % 110)::DOUBLE / 10 AS lon"""
_RAIN = """rain AS (SELECT c_nationkey AS gauge, year(o_orderdate) AS year, round(sum(o_totalprice) / 1e6, 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
gauges AS (SELECT n_nationkey AS gauge, (n_nationkey * 29 % 90)::DOUBLE / 10 AS glat, (n_nationkey * 31 % 110)::DOUBLE / 10 AS glon FROM nation)"""


NEAR = f"""{_RAIN}, st AS (SELECT s_suppkey AS code, {PLACE} FROM supplier),
d AS (SELECT code, gauge, sqrt(power(radians(glon - lon) * cos(radians((lat + glat) / 2)), 2) + power(radians(glat - lat), 2)) * 6371.0 AS km FROM st CROSS JOIN gauges),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(km, 9), gauge) AS rn FROM d) WHERE rn <= 5 AND km <= 250),
span AS (SELECT code, min(year) AS ini, max(year) AS fim FROM annual GROUP BY code)"""
PAIRED = f"""{NEAR}, able AS (SELECT gauge FROM rain GROUP BY gauge HAVING count(*) >= 5), kk AS (SELECT code, gauge FROM k SEMI JOIN able USING (gauge)), n AS (SELECT code, count(*) AS n FROM kk GROUP BY code),
means AS (SELECT kk.code, r.year, count(*) AS gauges, avg(total) AS total FROM kk JOIN rain r USING (gauge) JOIN span ON kk.code = span.code AND r.year BETWEEN ini AND fim JOIN n ON n.code = kk.code
GROUP BY kk.code, r.year, n.n HAVING count(*) >= greatest(1, n.n // 2))"""


def _paired(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    rain = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("gauge"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice") / 1e6, 4).alias("total"))
    gauges = table(spark, d, "nation").select(F.col("n_nationkey").alias("gauge"), ((F.col("n_nationkey") * 29 % 90).cast("double") / 10).alias("slat"), ((F.col("n_nationkey") * 31 % 110).cast("double") / 10).alias("slon"))
    sites = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), ((F.col("s_suppkey") * 37 % 90).cast("double") / 10).alias("lat"), ((F.col("s_suppkey") * 53 % 110).cast("double") / 10).alias("lon"))
    near = spatial.nearest_within_km(sites, gauges, "code", "gauge", 5, 250.0)
    span = annual(spark, d).groupBy("code").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    return trend.rain_means(near, rain, span, "code", "gauge", "year", "total", min_years=5)


@query(f"WITH {ANNUAL}, {PAIRED} SELECT code, CAST(year AS BIGINT) AS year, gauges, round(total, 6) AS rain FROM means")
def rain_pairing(spark, d):
    """K nearest gauges first, the radius second; yearly mean where enough measured; the flow series' years."""
    return _paired(spark, d).select("code", F.col("year").cast("long").alias("year"), "gauges", F.round("total", 6).alias("rain"))


@query(f"""WITH {ANNUAL}, {PAIRED}, pr AS (SELECT a.code, b.year - a.year AS dx, b.total - a.total AS dy FROM means a JOIN means b ON a.code = b.code AND a.year < b.year),
sums AS (SELECT code, sum(sign(dy)) AS s, median(dy / dx) AS slope FROM pr GROUP BY code), ties AS (SELECT code, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT code, total, count(*) AS t FROM means GROUP BY ALL) GROUP BY code),
st2 AS (SELECT code, count(*) AS n, avg(total) AS mean FROM means GROUP BY code HAVING count(*) >= 5), zz AS (SELECT *, CASE WHEN var > 0 AND s <> 0 THEN (s - sign(s)) / sqrt(var) ELSE 0.0 END AS z
FROM (SELECT *, CAST(n * (n - 1) * (2 * n + 5) - tied AS DOUBLE) / 18 AS var FROM st2 JOIN sums USING (code) JOIN ties USING (code))), p AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM zz)
SELECT code, n, round(mean, 4) AS mean, round(z, 4) AS z, round({ERFC}, 6) AS p, round(slope * 10 / mean * 100, 3) AS pct_decade FROM p""")
def rain_trend(spark, d):
    """The trend of the rain that belongs to each flow series."""
    r = trend.rain_trend(_paired(spark, d), "code", "year", "total", min_years=5)
    return r.select("code", "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), F.round("pct_decade", 3).alias("pct_decade"))


@query(f"""WITH {STATIONS}, {MONTHLY}, mlt AS (SELECT code, avg(value) AS q FROM monthly GROUP BY code),
per AS (SELECT upper(strip_accents(trim(n_name))) || '/' || upper(r_name) AS key, sum(o_totalprice) / 1e6 AS m3s, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT code, key, round(coalesce(m3s, 0), 3) AS m3s, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(m3s, 0) / q * 100, 3) AS pct
FROM (SELECT code, upper(strip_accents(trim(state))) || '/' || upper(basin) AS key FROM stations) s LEFT JOIN per USING (key) JOIN mlt USING (code)""")
def permit_pressure(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    place = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    permits = table(spark, d, "orders").join(place, F.col("o_custkey") == F.col("c_custkey"))
    per = permits.groupBy(name_key(F.col("n_name"), F.col("r_name")).alias("key")).agg((F.sum("o_totalprice") / 1e6).alias("m3s"), F.count("*").alias("n"))
    mlt = monthly(spark, d).groupBy("code").agg(F.avg("value").alias("q"))
    s = stations(spark, d).select("code", name_key(F.col("state"), F.col("basin")).alias("key"))
    m3s = F.coalesce("m3s", F.lit(0.0))
    return s.join(per, "key", "left").join(mlt, "code").select("code", "key", F.round(m3s, 3).alias("m3s"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(m3s / F.col("q") * 100, 3).alias("pct"))


@query(f"""WITH {MONTHLY} SELECT code, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS greatest, count(*) AS n_months,
  min(year * 100 + month) AS first_month, max(year * 100 + month) AS last_month FROM monthly GROUP BY code HAVING count(*) >= 60""")
def climatology(spark, d):
    m = monthly(spark, d).withColumn("ym", (F.col("year") * 100 + F.col("month")).cast("long"))
    c = series.climatology(m, "code", "ym", "value")
    return c.select("code", *[F.round(x, 4).alias(x) for x in ("mean", "least", "greatest")], "n_months", "first_month", "last_month")


@query(f"""WITH {MONTHLY}, m AS (SELECT code, month, round(avg(value), 6) AS m FROM monthly GROUP BY ALL)
SELECT code, CASE WHEN count(*) = 12 THEN array_to_string(list(CAST(CAST(round(m * 1000000) AS BIGINT) AS VARCHAR) ORDER BY month), ',') END AS regime FROM m GROUP BY code""")
def monthly_regime(spark, d):
    r = series.regime(monthly(spark, d), "code", "month", "value", digits=6)
    return r.select("code", F.array_join(F.transform("regime", lambda v: F.round(v * 1000000).cast("long").cast("string")), ",").alias("regime"))


@query(f"WITH {ANNUAL} SELECT code, CAST(year AS BIGINT) AS year, value FROM annual")
def annual_mean_complete(spark, d):
    return annual(spark, d).select("code", F.col("year").cast("long").alias("year"), "value")


@query("""WITH m AS (SELECT c_nationkey AS gauge, year(o_orderdate) AS year, month(o_orderdate) AS month, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT CAST(gauge AS BIGINT) AS gauge, CAST(year AS BIGINT) AS year, round(sum(total), 2) AS total FROM m GROUP BY gauge, year HAVING count(*) = 12""")
def annual_sum_complete(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("c_nationkey").cast("long").alias("gauge"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return series.complete_periods(m, ["gauge", "year"], F.round(F.sum("total"), 2).alias("total"), 12, exact=True).drop("n")


DRY = f"""{DAILY}, ever AS (SELECT DISTINCT code FROM daily WHERE dry),
panel AS (SELECT code, year(day) AS year, count(*) FILTER (WHERE dry) AS dry_days, count(*) AS days FROM daily SEMI JOIN ever USING (code) GROUP BY ALL HAVING count(*) >= 30)"""


def _panel(spark, d):
    return series.dry_panel(daily(spark, d), "code", "day", F.col("dry"), min_days=30)


@query(f"WITH {DRY} SELECT code, CAST(year AS BIGINT) AS year, dry_days, days FROM panel")
def dry_panel(spark, d):
    return _panel(spark, d).select("code", F.col("year").cast("long").alias("year"), "dry_days", "days")


@query(f"WITH {DRY} SELECT CAST(year AS BIGINT) AS year, CAST(sum(dry_days) AS BIGINT) AS dry_days, count(DISTINCT code) AS stations FROM panel WHERE dry_days > 0 GROUP BY year")
def dry_by_year(spark, d):
    return series.dry_by_year(_panel(spark, d), "code").select(F.col("year").cast("long").alias("year"), "dry_days", "stations")


@query(f"""WITH {MONTHLY}, w AS (SELECT *, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'before' WHEN year BETWEEN 1999 AND 2001 THEN 'after' END AS win FROM monthly),
m AS (SELECT code, win, month, avg(value) AS mean, count(DISTINCT year) AS years FROM w WHERE win IS NOT NULL GROUP BY ALL),
f AS (SELECT code, win, min(years) AS years, sum(mean * cos((month - 1) * 2 * pi() / 12)) AS c, sum(mean * sin((month - 1) * 2 * pi() / 12)) AS s FROM m GROUP BY code, win HAVING count(*) = 12 AND min(years) >= 2),
g AS (SELECT *, ((atan2(s, c) / (2 * pi()) * 12) + 24) % 12 + 1 AS mm FROM f)
SELECT a.code, round(a.mm, 4) AS month_before, round(b.mm, 4) AS month_after, round((b.mm - a.mm + 6 + 24) % 12 - 6, 4) AS shift
FROM g a JOIN g b ON a.code = b.code AND a.win = 'before' AND b.win = 'after'""")
def season_shift(spark, d):
    s = series.season_shift(monthly(spark, d), "code", "year", "month", "value", WINDOWS, min_years=2)
    return s.select("code", F.round("mean_month_before", 4).alias("month_before"), F.round("mean_month_after", 4).alias("month_after"), F.round("shift", 4).alias("shift"))


@query(f"""WITH {DAILY}, r AS (SELECT code, year(day) AS year, avg(value) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7,
  count(*) OVER (PARTITION BY code, year(day)) AS days FROM daily),
m AS (SELECT code, year, min(m7) AS least FROM r WHERE days >= 60 GROUP BY ALL),
w AS (SELECT code, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'before' WHEN year BETWEEN 1999 AND 2001 THEN 'after' END AS win, least FROM m),
s AS (SELECT code, win, quantile_cont(least, 0.1) AS q, median(least) AS med, count(*) AS years FROM w WHERE win IS NOT NULL GROUP BY code, win HAVING count(*) >= 2)
SELECT a.code, round(a.q, 4) AS q_before, round(b.q, 4) AS q_after, round(a.med, 4) AS med_before, round(b.med, 4) AS med_after,
  round(CASE WHEN a.q > 0 THEN (b.q - a.q) / a.q * 100 END, 5) AS change, a.q > 0 AND b.q <= 0 AS became_zero
FROM s a JOIN s b ON a.code = b.code AND a.win = 'before' AND b.win = 'after'""")
def low_flow_q710(spark, d):
    s = series.low_flow(daily(spark, d), "code", "day", "value", WINDOWS, min_days=60, min_years=2)
    return s.select("code", *[F.round(c, 4).alias(c) for c in ("q_before", "q_after", "med_before", "med_after")], F.round("change", 5).alias("change"), "became_zero")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"""WITH {STATIONS}, {MONTHLY}, j AS (SELECT m.year, coalesce(nullif(trim(s.basin), ''), 'none') AS basin, m.code FROM monthly m LEFT JOIN stations s USING (code))
SELECT CAST(year AS BIGINT) AS year, {", ".join(f"count(DISTINCT code) FILTER (WHERE basin = '{r}') AS {r.lower().replace(' ', '_')}" for r in REGIONS)} FROM j GROUP BY year""")
def network_size_pivot(spark, d):
    basin = F.coalesce(F.nullif(F.trim("basin"), F.lit("")), F.lit("none"))
    j = monthly(spark, d).join(stations(spark, d), "code", "left").select(F.col("year").cast("long").alias("year"), basin.alias("basin"), "code")
    m = series.presence_matrix(j, "year", "basin", "code", REGIONS)
    return m.select("year", *[F.col(r).alias(r.lower().replace(" ", "_")) for r in REGIONS])


@query("""SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(DISTINCT l_suppkey) AS stations, count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'F') AS consistent,
  count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS raw, (SELECT coalesce(max(year(l_shipdate)), 0) FROM lineitem WHERE l_linestatus = 'F') AS last_consistent FROM lineitem GROUP BY 1""")
def network_consistency(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    # Two levels instead of three distinct counts: one row per station and year first.
    per = li.groupBy("year", "l_suppkey").agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("f"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("o"))
    years = per.groupBy("year").agg(F.count("*").alias("stations"), F.sum("f").alias("consistent"), F.sum("o").alias("raw"))
    last = per.agg(F.coalesce(F.max(F.when(F.col("f") == 1, F.col("year"))), F.lit(0)).cast("long").alias("last_consistent"))
    return years.join(F.broadcast(last), F.lit(True))


@query("""WITH op AS (SELECT s_name AS name, avg(l_quantity) AS turbined, avg(l_discount) AS spilled, count(*) AS days FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name HAVING count(*) > 365)
SELECT s_suppkey AS code, round(turbined, 4) AS turbined, round(spilled, 4) AS spilled, days FROM supplier LEFT JOIN op ON regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(name), '[^A-Z0-9]', '', 'g')""")
def reservoir_stats(spark, d):
    """Points left-joined with daily aggregates on a normalised name; the last duplicate wins."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    op = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.avg("l_quantity").alias("turbined"), F.avg("l_discount").alias("spilled"), F.count("*").alias("days")).where("days > 365")
    op = op.withColumn("key", alphanumeric_key("s_name"))
    op = first_per(op, "key", F.col("s_name").desc())
    return s.withColumn("key", alphanumeric_key("s_name")).join(op.drop("s_name"), "key", "left").select(F.col("s_suppkey").alias("code"), F.round("turbined", 4).alias("turbined"), F.round("spilled", 4).alias("spilled"), "days")
