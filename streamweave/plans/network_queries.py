"""Queries on forests and on space."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamweave.operators import codec, forest, nearest, overlay, permits, regional, spatial
from streamweave.plans.inputs import DANGLING, DEEP, DISTANCE, HEAP, POINTS, PROJECT, REACHES, SEGMENTS, dangling, deep, heap, points, reaches, segments, varint_sql
from streamweave.sources.tables import table

Q, SQL = {}, {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def closure(source: str, stop: str = "false") -> str:
    """Recursive CTE: (id, at) for each node and every node downstream, itself included."""
    return f"up(id, here) AS (SELECT id, id FROM {source} UNION ALL SELECT up.id, s.down FROM up JOIN {source} s ON s.id = up.here WHERE s.down IS NOT NULL AND NOT ({stop}))"


@query(f"WITH {HEAP} SELECT h.id, round(greatest(h.area - coalesce(c.a, 0), 0), 3) AS own_area FROM heap h LEFT JOIN (SELECT down, sum(area) AS a FROM heap GROUP BY 1) c ON c.down = h.id")
def own_area(spark, d):
    return forest.own_area(heap(spark, d), "id", "down", "area").select("id", F.round("own_area", 3).alias("own_area"))


def _acc(nodes, value):
    return forest.accumulate(nodes, "id", "down", [value])


@query(f"WITH RECURSIVE {HEAP}, {closure('heap')} SELECT here AS id, round(sum(area), 2) AS total, count(*) AS n FROM up JOIN heap USING (id) GROUP BY here")
def accumulate_plain(spark, d):
    t = forest.accumulate(heap(spark, d).withColumn("one", F.lit(1).cast("long")), "id", "down", ["area", "one"])
    return t.select("id", F.round("area", 2).alias("total"), F.col("one").alias("n"))


@query(f"""WITH RECURSIVE {HEAP}, cutheap AS (SELECT id, CASE WHEN down % 97 <> 5 THEN down END AS down, CASE WHEN id % 97 = 5 THEN area * 10 ELSE size END AS src FROM heap), {closure('cutheap')}
SELECT here AS id, round(sum(src), 2) AS total FROM up JOIN cutheap USING (id) GROUP BY here""")
def accumulate_anchored(spark, d):
    nodes = heap(spark, d).withColumn("observed", F.when(F.col("id") % 97 == 5, F.col("area") * 10)).withColumn("local", F.col("size").cast("double"))
    return forest.accumulate_anchored(nodes, "id", "down", "local", "observed").select("id", F.round("total", 2).alias("total"))


@query(f"WITH RECURSIVE {DEEP}, {closure('deep')} SELECT here AS id, count(*) AS n FROM up GROUP BY here")
def accumulate_deep(spark, d):
    return _acc(deep(spark, d).withColumn("n", F.lit(1).cast("long")), "n")


@query(f"WITH RECURSIVE {HEAP}, {closure('heap')} SELECT id, min(here) AS root FROM up GROUP BY id")
def forest_root(spark, d):
    return forest.roots(heap(spark, d), "id", "down")


@query(f"""WITH RECURSIVE {HEAP}, f AS (SELECT *, id % 5 = 1 OR id = 1 AS fo FROM heap), {closure('heap')},
inside AS (SELECT a.id, CASE WHEN b.fo THEN NULL ELSE a.down END AS down FROM f a LEFT JOIN f b ON a.down = b.id),
up2(id, here) AS (SELECT id, id FROM inside UNION ALL SELECT up2.id, s.down FROM up2 JOIN inside s ON s.id = up2.here WHERE s.down IS NOT NULL),
r1 AS (SELECT id, min(here) AS root FROM up GROUP BY id), r2 AS (SELECT id, min(here) AS root FROM up2 GROUP BY id)
SELECT r1.id, CASE WHEN t.fo THEN r2.root ELSE r1.root END AS root FROM r1 JOIN r2 USING (id) JOIN f t ON t.id = r1.root""")
def reroot_foreign(spark, d):
    nodes = heap(spark, d).withColumn("foreign", (F.col("id") % 5 == 1) | (F.col("id") == 1))
    return forest.reroot_foreign(nodes, "id", "down", "foreign")


CUT_ID = "id BETWEEN 32 AND 63"


@query(f"""WITH RECURSIVE {HEAP}, cutheap AS (SELECT id, CASE WHEN NOT ({CUT_ID}) THEN down END AS down, area FROM heap), {closure('cutheap')}, r AS (SELECT id, min(here) AS root FROM up GROUP BY id),
g AS (SELECT root, sum(area) AS km FROM r JOIN cutheap USING (id) GROUP BY root), top AS (SELECT * FROM g ORDER BY round(km, 4) DESC, root LIMIT 24)
SELECT root, round(km, 2) AS km, p_name AS name, dense_rank() OVER (ORDER BY p_name) AS basin FROM top JOIN part ON p_partkey = root""")
def basin_topn(spark, d):
    from pyspark.sql import Window

    nodes = heap(spark, d).withColumn("down", F.when(~F.expr(CUT_ID), F.col("down")))
    km = forest.roots(nodes, "id", "down").join(nodes.select("id", "area"), "id").groupBy("root").agg(F.sum("area").alias("km"))
    top = km.orderBy(F.round("km", 4).desc(), "root").limit(24)
    named = top.join(table(spark, d, "part").select(F.col("p_partkey").alias("root"), F.col("p_name").alias("name")), "root")
    return named.select("root", F.round("km", 2).alias("km"), "name", F.dense_rank().over(Window.orderBy("name")).cast("long").alias("basin"))


@query(f"""WITH RECURSIVE {DEEP}, n AS (SELECT id, down, id // 40 % 7 AS nm FROM deep), same AS (SELECT a.id, CASE WHEN a.nm = b.nm THEN a.down END AS down FROM n a LEFT JOIN n b ON a.down = b.id), {closure('same')}
SELECT id, min(here) AS river FROM up GROUP BY id""")
def river_identity(spark, d):
    nodes = deep(spark, d).withColumn("name", F.expr("cast(id div 40 % 7 as string)"))
    return forest.same_name_components(nodes, "id", "down", "name")


OWNER = f"""{HEAP}, {closure('heap', 'up.here % 97 = 5')}, o AS (SELECT id, min(here) AS last FROM up GROUP BY id), own AS (SELECT id, CASE WHEN last % 97 = 5 THEN last END AS owner FROM o)"""


@query(f"WITH RECURSIVE {OWNER} SELECT id, owner FROM own")
def nearest_downstream_owner(spark, d):
    return forest.nearest_anchor_downstream(heap(spark, d), "id", "down", F.col("id") % 97 == 5)


@query(f"WITH RECURSIVE {OWNER} SELECT own.id, owner FROM own JOIN heap a USING (id) JOIN heap b ON b.id = owner WHERE a.size / b.area >= 0.02 OR own.id = owner")
def owner_floor(spark, d):
    h = heap(spark, d)
    own = forest.nearest_anchor_downstream(h, "id", "down", F.col("id") % 97 == 5)
    flows = own.join(h.select("id", "size"), "id").join(h.select(F.col("id").alias("owner"), "area"), "owner")
    return flows.where((F.col("size") / F.col("area") >= 0.02) | (F.col("id") == F.col("owner"))).select("id", "owner")


def _knn_inputs(spark, d):
    p = points(spark, d)
    gauges = p.where("id % 4 = 0").select(F.col("id").alias("gauge"), F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("label") + 1.0).alias("q"))
    return p.where("id % 4 <> 0"), gauges


KNN = f"""{POINTS}, nn AS (SELECT * FROM (SELECT p.id, g.id AS gauge, g.label + 1.0 AS q, sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)) AS dist,
  row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), g.id) AS nth FROM points p, points g WHERE p.id % 4 <> 0 AND g.id % 4 = 0) WHERE nth <= 8)"""


@query(f"WITH {KNN} SELECT id, gauge, round(dist, 6) AS distance, nth FROM nn")
def knn8(spark, d):
    p, g = _knn_inputs(spark, d)
    return nearest.nearest_k(p, g, "id", "gauge", 8).select("id", "gauge", F.round("distance", 6).alias("distance"), F.col("nth").cast("long").alias("nth"))


@query(f"WITH {KNN} SELECT id, round(exp(sum(ln(q) / power(greatest(dist, 1e-4), 2)) / sum(1 / power(greatest(dist, 1e-4), 2))), 5) AS estimate FROM nn GROUP BY id")
def idw_geometric(spark, d):
    p, g = _knn_inputs(spark, d)
    return regional.interpolate(p, g, "id", "gauge", "q", 8).select("id", F.round("estimate", 5).alias("estimate"))


@query(f"""WITH {POINTS}, nn AS (SELECT * FROM (SELECT p.id, p.label + 1.0 AS obs, g.label + 1.0 AS q, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS dist,
  row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), g.id) AS nth FROM points p JOIN points g ON p.id % 5 <> g.id % 5) WHERE nth <= 8),
e AS (SELECT id, obs, exp(sum(ln(q) / power(greatest(dist, 1e-4), 2)) / sum(1 / power(greatest(dist, 1e-4), 2))) / obs AS r FROM nn GROUP BY id, obs)
SELECT count(*) AS n, round(avg(CASE WHEN r BETWEEN 0.5 AND 2 THEN 100.0 ELSE 0 END), 3) AS within_2x, round(avg(CASE WHEN r BETWEEN 1 / 1.5::DOUBLE AND 1.5 THEN 100.0 ELSE 0 END), 3) AS within_15x, round(power(10, median(log10(r))), 4) AS bias FROM e""")
def cross_validation_idw(spark, d):
    s = points(spark, d).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("label") + 1.0).alias("q"))
    r = regional.validation_report(regional.cross_validate(s, "id", "q", 5, 8))
    return r.select("n", F.round("within_2x", 3).alias("within_2x"), F.round("within_15x", 3).alias("within_15x"), F.round("bias", 4).alias("bias"))


TOLERANCE = 0.05
BRUTE = f"""{SEGMENTS}, dd AS (SELECT id, line, label, {DISTANCE} AS distance FROM (SELECT *, {PROJECT} FROM points, segments)), near AS (SELECT * FROM dd WHERE distance < {TOLERANCE})"""


def _spots(spark, d):
    return points(spark, d).withColumn("code", F.col("id").cast("string"))


def _lines(spark, d):
    return segments(spark, d).withColumn("line_code", F.col("line").cast("string")).withColumn("line_area", (F.col("line") % 7 + 1).cast("double"))


STATION = f"""{BRUTE}, sc AS (SELECT id, line, distance, abs(ln((label + 1.0) / (line % 7 + 1))) AS lr FROM near), best AS (SELECT *, lr + 10 * distance AS score FROM sc WHERE lr <= 0.35),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, line) AS rn FROM best) WHERE rn = 1)"""


def _snapped(spark, d):
    p = _spots(spark, d).withColumn("point_area", F.col("label") + 1.0)
    return spatial.snap_station(p, _lines(spark, d), "id", "line", "point_area", "line_area", TOLERANCE, 0.35)


@query(f"WITH {STATION} SELECT id, line, round(score, 6) AS score FROM snap")
def snap_station(spark, d):
    return _snapped(spark, d).select("id", "line", F.round("score", 6).alias("score"))


@query(f"WITH {STATION} SELECT id, line FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score, id) AS k FROM snap) WHERE k = 1")
def snap_mutual(spark, d):
    return spatial.mutual_best(_snapped(spark, d), "id", "line").select("id", "line")


@query(f"""WITH {BRUTE}, a AS (SELECT *, starts_with(CAST(id AS VARCHAR), CAST(line AS VARCHAR)) OR starts_with(CAST(line AS VARCHAR), CAST(id AS VARCHAR)) AS agrees FROM near)
SELECT id, line, agrees, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY agrees DESC, distance, line) AS rn FROM a) WHERE rn = 1""")
def snap_prefix_override(spark, d):
    s = spatial.snap_prefix(_spots(spark, d), _lines(spark, d), "id", "line", "code", "line_code", TOLERANCE)
    return s.select("id", "line", "agrees", F.round("distance", 6).alias("distance"))


@query(f"WITH {BRUTE} SELECT id, line, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, line) AS rn FROM near) WHERE rn = 1")
def snap_plain(spark, d):
    return spatial.snap_plain(_spots(spark, d), segments(spark, d), "id", "line", TOLERANCE).select("id", "line", F.round("distance", 6).alias("distance"))


RINGS = [(0, [(-0.2, -0.2), (0.2, -0.15), (0.1, 0.2), (-0.1, 0.05), (-0.25, 0.2)]), (1, [(0.05, 0.0), (0.3, 0.1), (0.15, 0.3)])]
EDGES = [(r, *a, *b) for r, ring in RINGS for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]


@query(f"""WITH {POINTS}, e(ring, x1, y1, x2, y2) AS (VALUES {", ".join(str(tuple([e[0]] + [float(v) for v in e[1:]])).replace("'", "") for e in EDGES)}),
h AS (SELECT id, ring, count(*) AS n FROM points, e WHERE (y1::DOUBLE > y) <> (y2::DOUBLE > y) AND x < (x2::DOUBLE - x1) * (y - y1) / (y2::DOUBLE - y1) + x1 GROUP BY ALL)
SELECT p.id, coalesce(bool_or(h.n % 2 = 1), false) AS inside FROM points p LEFT JOIN h USING (id) GROUP BY p.id""")
def point_in_polygon(spark, d):
    edges = spark.createDataFrame(EDGES, "ring int, x1 double, y1 double, x2 double, y2 double")
    return overlay.in_polygon(points(spark, d), edges, "id", 0.1)


def _paths(spark, d):
    """Lines of up to five consecutive points."""
    at = F.struct("id", "x", "y")
    g = points(spark, d).groupBy(F.expr("id div 5").alias("line")).agg(F.array_sort(F.collect_list(at)).alias("p"))
    return g.select("line", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


@query(f"WITH {SEGMENTS} SELECT line, round((x1 + x2) / 2, 5) AS x, round((y1 + y2) / 2, 5) AS y FROM segments")
def line_midpoint(spark, d):
    pts = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    m = segments(spark, d).select("line", spatial.line_midpoint(pts).alias("m"))
    return m.select("line", F.round("m.x", 5).alias("x"), F.round("m.y", 5).alias("y"))


@query(f"WITH {SEGMENTS} SELECT id, line, round({DISTANCE}, 6) AS distance FROM (SELECT *, {PROJECT} FROM points JOIN segments ON line = id - id % 2 + 2)")
def point_line_distance(spark, d):
    s = segments(spark, d)
    p = points(spark, d).withColumn("line", F.col("id") - F.col("id") % 2 + 2)
    c = F.col
    return p.join(s, "line").select("id", "line", F.round(spatial.segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")), 6).alias("distance"))


@query(f"""WITH {SEGMENTS}, q AS (SELECT line, CAST(round(x1 * 20) AS BIGINT) AS a, CAST(round(y1 * 20) AS BIGINT) AS b, CAST(round(x2 * 20) AS BIGINT) AS c, CAST(round(y2 * 20) AS BIGINT) AS e FROM segments)
SELECT line, CASE WHEN a = c AND b = e THEN concat(a, ' ', b, ',', a + 1, ' ', b) ELSE concat(a, ' ', b, ',', c, ' ', e) END AS cells FROM q""")
def quantise_line(spark, d):
    pts = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    q = segments(spark, d).select("line", spatial.quantise_line(pts, 20.0).alias("q"))
    return q.select("line", F.array_join(F.transform("q", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("cells"))


PATHS = f"""{POINTS}, pp AS (SELECT id // 5 AS line, row_number() OVER (PARTITION BY id // 5 ORDER BY id) AS k, x, y FROM points), ll AS (SELECT line, count(*) AS n FROM pp GROUP BY line)"""
OFF = """sqrt(power(p.x - (a.x + t * (b.x - a.x)), 2) + power(p.y - (a.y + t * (b.y - a.y)), 2))"""


@query(f"""WITH RECURSIVE {PATHS}, tri AS (SELECT a.line, a.k AS i, b.k AS j, p.k, {OFF.replace("t *", "greatest(0.0, least(1.0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))) *")} AS d
  FROM pp a JOIN pp b ON a.line = b.line AND b.k > a.k + 1 JOIN pp p ON p.line = a.line AND p.k > a.k AND p.k < b.k),
tol AS (SELECT line, n, CASE WHEN line % 3 = 0 THEN 0.0015 WHEN line % 3 = 1 THEN 0.05 ELSE 0.3 END AS t FROM ll),
cut AS (SELECT tri.line, i, j, arg_max(k, d) AS k FROM tri JOIN tol USING (line) GROUP BY tri.line, i, j, t HAVING max(d) > t),
walk(line, i, j) AS (SELECT line, 1, n FROM ll UNION ALL SELECT w.line, CASE WHEN s.half = 0 THEN w.i ELSE c.k END, CASE WHEN s.half = 0 THEN c.k ELSE w.j END FROM walk w JOIN cut c ON c.line = w.line AND c.i = w.i AND c.j = w.j CROSS JOIN (VALUES (0), (1)) s(half))
SELECT ll.line, CAST(n AS INT) AS before, CAST(CASE WHEN n < 2 THEN n ELSE 2 + coalesce(c, 0) END AS INT) AS after FROM ll LEFT JOIN (SELECT w.line, count(*) AS c FROM walk w JOIN cut USING (line, i, j) GROUP BY 1) USING (line)""")
def simplify_line(spark, d):
    """Lines simplified within a tolerance of their own."""
    tolerance = F.when(F.col("line") % 3 == 0, 0.0015).when(F.col("line") % 3 == 1, 0.05).otherwise(0.3)
    s = codec.simplify_lines(_paths(spark, d), "points", tolerance)
    return s.select("line", F.size("points").alias("before"), F.size("simplified").alias("after"))


@query("SELECT p_partkey, CAST(CASE WHEN p_retailprice * p_size >= 50000 THEN 0.0002 WHEN p_retailprice * p_size >= 5000 THEN 0.0003 WHEN p_retailprice * p_size >= 500 THEN 0.0007 WHEN p_retailprice * p_size >= 50 THEN 0.0015 ELSE 0.0032 END AS DOUBLE) AS tolerance FROM part")
def tolerance_by_area(spark, d):
    return table(spark, d, "part").select("p_partkey", codec.tolerance_of(F.col("p_retailprice") * F.col("p_size")).alias("tolerance"))


@query(f"""WITH {PATHS}, g AS (SELECT line, k, CAST(round(x * 1000) AS BIGINT) AS gx, CAST(round(y * 1000) AS BIGINT) AS gy FROM pp),
kept AS (SELECT * FROM (SELECT *, lag(gx) OVER w AS px, lag(gy) OVER w AS py FROM g WINDOW w AS (PARTITION BY line ORDER BY k)) WHERE px IS NULL OR px <> gx OR py <> gy),
whole AS (SELECT line, k, gx, gy FROM kept UNION ALL SELECT line, min(k) + 1, min(gx) + 1, min(gy) FROM kept GROUP BY line HAVING count(*) = 1),
df AS (SELECT line, k, gx - coalesce(lag(gx) OVER w, 0) AS dx, gy - coalesce(lag(gy) OVER w, 0) AS dy FROM whole WINDOW w AS (PARTITION BY line ORDER BY k))
SELECT line, string_agg({varint_sql("dx")}, '' ORDER BY k) AS tx, string_agg({varint_sql("dy")}, '' ORDER BY k) AS ty, true AS same FROM df GROUP BY line""")
def rebuild_lines(spark, d):
    """Quantised lines to packed delta text and back; `same` must hold on every row."""
    q = _paths(spark, d).select("line", spatial.quantise_line(F.col("points"), 1000.0).alias("q"))
    axis = lambda f: F.transform("q", lambda p: p[f])
    packed = q.select("line", axis("x").alias("x"), axis("y").alias("y")).withColumn("tx", codec.encode_varint(codec.deltas(F.col("x")))).withColumn("ty", codec.encode_varint(codec.deltas(F.col("y"))))
    back = lambda c: codec.running_sum(codec.decode_varint(F.col(c)))
    return packed.withColumn("bx", back("tx")).withColumn("by", back("ty")).select("line", "tx", "ty", ((F.col("bx") == F.col("x")) & (F.col("by") == F.col("y"))).alias("same"))


@query(f"WITH RECURSIVE {DANGLING}, {closure('dangling')} SELECT here AS id, count(*) AS n, round(sum(area), 2) AS total FROM up JOIN dangling USING (id) GROUP BY here")
def accumulate_dangling(spark, d):
    """Nodes whose downstream key has no row end there and keep what reaches them."""
    got = forest.accumulate(dangling(spark, d).withColumn("n", F.lit(1).cast("long")), "id", "down", ["n", "area"])
    return got.select("id", "n", F.round("area", 2).alias("total"))


@query(f"WITH RECURSIVE {DANGLING}, {closure('dangling')} SELECT id, min(here) AS root FROM up GROUP BY id")
def roots_dangling(spark, d):
    return forest.roots(dangling(spark, d), "id", "down")


@query(f"WITH RECURSIVE {HEAP}, {closure('heap')} SELECT here AS id, round(greatest(0, least(1, sum(h.size) / greatest(max(o.area) * 5, 1e-6))), 6) AS load FROM up JOIN heap h ON h.id = up.id JOIN heap o ON o.id = here GROUP BY here")
def accumulated_fraction(spark, d):
    """What has gathered from upstream as a share of the flow, at most 1."""
    nodes = heap(spark, d).select("id", "down", F.col("size").cast("double").alias("load"), (F.col("area") * 5).alias("flow"))
    return permits.accumulated_share(nodes, "id", "down", ["load"], "flow", 1.0).select("id", F.round("load", 6).alias("load"))


NETWORK = f"""{REACHES}, posts AS (SELECT id, x AS sx, y AS sy, own_area * 2.0 AS q, size + 1.0 AS specific, (id // 97) % 5 AS fold FROM reaches WHERE id % 97 = 5), folds AS (SELECT DISTINCT fold AS fo FROM posts),
nn AS (SELECT * FROM (SELECT r.id, fo, specific, sqrt((r.x - sx) * (r.x - sx) + (r.y - sy) * (r.y - sy)) AS dist, row_number() OVER (PARTITION BY r.id, fo ORDER BY sqrt((r.x - sx) * (r.x - sx) + (r.y - sy) * (r.y - sy)), p.id) AS nth
  FROM reaches r CROSS JOIN folds JOIN posts p ON p.fold <> fo) WHERE nth <= 4),
est AS (SELECT id, fo, exp(sum(ln(specific) / power(greatest(dist, 1e-4), 2)) / sum(1 / power(greatest(dist, 1e-4), 2))) AS sp FROM nn GROUP BY id, fo),
net AS (SELECT r.id, fo, CASE WHEN b.id IS NULL OR b.fold = fo THEN r.down END AS down, CASE WHEN a.id IS NOT NULL AND a.fold <> fo THEN a.q ELSE coalesce(sp, 0) * own_area / 1000 END AS src
  FROM reaches r CROSS JOIN folds LEFT JOIN est USING (id, fo) LEFT JOIN posts a ON a.id = r.id LEFT JOIN posts b ON b.id = r.down),
up(id, fo, here) AS (SELECT id, fo, id FROM net UNION ALL SELECT up.id, up.fo, s.down FROM up JOIN net s ON s.id = up.here AND s.fo = up.fo WHERE s.down IS NOT NULL),
tot AS (SELECT here AS id, up.fo, sum(src) AS q FROM up JOIN net ON net.id = up.id AND net.fo = up.fo GROUP BY ALL), val AS (SELECT p.id, p.fold, p.q AS observed, tot.q AS estimate FROM posts p JOIN tot ON tot.id = p.id AND tot.fo = p.fold)"""


def _validated(spark, d):
    r = reaches(spark, d)
    posts = r.where("id % 97 = 5").select(F.col("id").alias("station"), "id", F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("own_area") * 2.0).alias("q"), (F.col("size") + 1.0).alias("specific"), F.expr("id div 97 % 5").alias("fold"))
    return regional.validate_network(r, posts, "id", "down", "station", "fold", 4)


@query(f"WITH RECURSIVE {NETWORK} SELECT id AS station, CAST(fold AS BIGINT) AS fold, round(observed, 4) AS observed, round(estimate, 4) AS estimate FROM val")
def network_validation(spark, d):
    """The network estimated anew without each fold's stations, compared where they measure."""
    return _validated(spark, d).select("station", F.col("fold").cast("long").alias("fold"), F.round("observed", 4).alias("observed"), F.round("estimate", 4).alias("estimate"))


@query(f"""WITH RECURSIVE {NETWORK}, e AS (SELECT estimate / observed AS r FROM val WHERE estimate > 0 AND observed > 0)
SELECT count(*) AS n, round(avg(CASE WHEN r BETWEEN 0.5 AND 2 THEN 100.0 ELSE 0 END), 3) AS within_2x, round(avg(CASE WHEN r BETWEEN 1 / 1.5::DOUBLE AND 1.5 THEN 100.0 ELSE 0 END), 3) AS within_15x, round(power(10, median(log10(r))), 4) AS bias FROM e""")
def network_validation_report(spark, d):
    r = regional.validation_report(_validated(spark, d))
    return r.select("n", F.round("within_2x", 3).alias("within_2x"), F.round("within_15x", 3).alias("within_15x"), F.round("bias", 4).alias("bias"))


@query(f"""WITH RECURSIVE {HEAP}, cutheap AS (SELECT id, CASE WHEN NOT ({CUT_ID}) THEN down END AS down, area FROM heap), {closure('cutheap')}, r AS (SELECT id, min(here) AS root FROM up GROUP BY id),
g AS (SELECT root, round(sum(area), 6) AS km FROM r JOIN cutheap USING (id) GROUP BY root), top AS (SELECT * FROM g ORDER BY km DESC, root LIMIT 24),
named AS (SELECT root, CASE WHEN p_name = 'red widget' THEN 'Crimson' ELSE p_name END AS name FROM top JOIN part ON p_partkey = root WHERE root % 5 <> 0), numbers AS (SELECT name, row_number() OVER (ORDER BY name) AS basin FROM (SELECT DISTINCT name FROM named))
SELECT id, CAST(coalesce(basin, 0) AS INT) AS basin FROM r LEFT JOIN (SELECT root, basin FROM named JOIN numbers USING (name)) USING (root)""")
def basin_bucket(spark, d):
    """Every node's basin: the 24 longest by (renamed) official name, the rest in 0."""
    nodes = heap(spark, d).withColumn("down", F.when(~F.expr(CUT_ID), F.col("down")))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("root"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).otherwise(F.lit("")).alias("name"))
    return forest.basin_index(forest.roots(nodes, "id", "down"), "id", nodes.select("id", F.col("area").alias("km")), names, {"red widget": "Crimson"})[1]


@query(f"""WITH {SEGMENTS}, mid AS (SELECT line AS id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM segments), e(ring, ex1, ey1, ex2, ey2) AS (VALUES {", ".join(str(tuple([e[0]] + [float(v) for v in e[1:]])).replace("'", "") for e in EDGES)}),
h AS (SELECT id, ring, count(*) AS n FROM mid, e WHERE (ey1::DOUBLE > y) <> (ey2::DOUBLE > y) AND x < (ex2::DOUBLE - ex1) * (y - ey1) / (ey2::DOUBLE - ey1) + ex1 GROUP BY ALL)
SELECT mid.id AS line, coalesce(bool_or(h.n % 2 = 1), false) AS inside FROM mid LEFT JOIN h USING (id) GROUP BY mid.id""")
def reach_inside(spark, d):
    """Whether a reach lies in the country, by its midpoint."""
    pts = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    mid = segments(spark, d).select("line", spatial.line_midpoint(pts).alias("m")).select("line", "m.x", "m.y")
    edges = spark.createDataFrame(EDGES, "ring int, x1 double, y1 double, x2 double, y2 double")
    return overlay.in_polygon(mid, edges, "line", 0.1)


@query(f"WITH {POINTS}, p AS (SELECT id, CASE WHEN id % 7 = 0 THEN 0.0 WHEN id % 11 <> 0 THEN x END AS lat, CASE WHEN id % 14 = 0 THEN 0.0 ELSE y END AS lon FROM points) SELECT id, lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AS placed FROM p")
def valid_places(spark, d):
    """Points with coordinates; (0, 0) counts as missing."""
    lat = F.when(F.col("id") % 7 == 0, 0.0).when(F.col("id") % 11 != 0, F.col("x"))
    lon = F.when(F.col("id") % 14 == 0, 0.0).otherwise(F.col("y"))
    return points(spark, d).select("id", spatial.has_place(lat, lon).alias("placed"))


@query("""SELECT CAST(p_partkey % 100 AS BIGINT) AS key, CAST(p_size % 4 AS INT) AS ring, CAST(count(*) AS INT) AS points FROM part GROUP BY ALL HAVING count(*) >= 6""")
def polygon_rings(spark, d):
    """Rings of polygons with enough points: exterior and interior ones alike."""
    spot = F.struct(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    rings = table(spark, d, "part").groupBy((F.col("p_partkey") % 100).alias("key"), (F.col("p_size") % 4).alias("r")).agg(F.array_sort(F.collect_list(spot)).alias("pts"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    polygons = rings.groupBy("key").agg(*[F.max(F.when(F.col("r") == i, F.col("pts"))).alias(f"r{i}") for i in range(4)]).select("key", F.array(*[F.coalesce(f"r{i}", none) for i in range(4)]).alias("rings"))
    got = spatial.rings_of(polygons, "key", "rings", 6)
    return got.select("key", "ring", F.size("points").alias("points"))


@query(f"""WITH {POINTS}, g AS (SELECT id, x * 100 AS lon, y * 100 AS lat FROM points), t AS (SELECT id, CAST(floor((lon + 180) / 360 * 256) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256) AS BIGINT) AS ty FROM g)
SELECT id, tx, ty, round(tx / 256 * 360 - 180, 6) AS lon, round(degrees(atan((exp(pi() * (1 - 2 * ty / 256)) - exp(-pi() * (1 - 2 * ty / 256))) / 2)), 6) AS lat FROM t""")
def tiles(spark, d):
    """Web-Mercator tile of each place at zoom 8, and the tile's corner back in degrees."""
    tx, ty = spatial.tile_of(F.col("x") * 100, F.col("y") * 100, 8)
    lon, lat = spatial.place_of(F.col("tx"), F.col("ty"), 8)
    return points(spark, d).select("id", tx.alias("tx"), ty.alias("ty")).select("id", "tx", "ty", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""WITH {BRUTE} SELECT line, count(DISTINCT id) AS points FROM near WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5) GROUP BY line""")
def no_data_flag(spark, d):
    """Points without cover (anti join), snapped to the lines that they leave without data."""
    p = points(spark, d)
    bare = permits.uncovered(p, p.where("label < 5").select("id"), "id")
    return spatial.count_near(bare, segments(spark, d), "line", TOLERANCE)
