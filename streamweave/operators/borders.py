"""Simplification of neighbouring polygons that keeps their borders common and uncrossed.

Rings are cut into arcs at the places where borders part, so a border of two
polygons is one arc and is simplified once: no gap and no overlap opens between
neighbours.  Each point has a worth, the tolerance from which Douglas-Peucker drops it;
an arc keeps the points worth more than the tolerance.  Where the shortened lines
meet elsewhere than at their ends, the most worthy dropped point of each comes
back, round by round, until none meet: at the latest when all points are back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.operators.lineage import Tables, spread
from streamweave.operators.overlay import cell_size, meetings

POINT = "array<struct<x:double,y:double>>"


def worth(line: np.ndarray) -> np.ndarray:
    """For each point of (n, 2) the tolerance from which it goes; infinite for the ends.

    A point is never worth more than the one whose removal it depends on.  Of a closed line
    (first and last point alike) the two best points between are kept whatever the tolerance, so it stays a ring.
    """
    n = len(line)
    out = np.full(n, np.inf)
    work = [(0, n - 1, np.inf)]
    while work:
        a, b, most = work.pop()
        if b - a < 2:
            continue
        to, p = line[b] - line[a], line[a + 1 : b] - line[a]
        length = to @ to
        t = np.clip(p @ to / length, 0.0, 1.0) if length else np.zeros(len(p))
        d = np.hypot(*(p - t[:, None] * to).T)
        at = int(d.argmax())
        here = min(most, float(d[at]))
        out[a + 1 + at] = here
        work += [(a, a + 1 + at, here), (a + 1 + at, b, here)]
    if n > 3 and (line[0] == line[-1]).all():
        out[1 + np.argsort(-out[1:-1], kind="stable")[:2]] = np.inf
    return out


def worths(xy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`worth` of the points of many lines that follow one another; lines of up to three points all at once."""
    out, starts = np.full(len(xy), np.inf), sizes.cumsum() - sizes
    three = starts[sizes == 3]
    to, p = xy[three + 2] - xy[three], xy[three + 1] - xy[three]
    length = (to * to).sum(axis=1)
    t = np.divide((p * to).sum(axis=1), length, out=np.zeros(len(three)), where=length > 0).clip(0.0, 1.0)
    out[three + 1] = np.hypot(*(p - t[:, None] * to).T)
    for s, n in zip(starts[sizes > 3], sizes[sizes > 3], strict=True):
        out[s : s + n] = worth(xy[s : s + n])
    return out


def _valued(arcs: DataFrame) -> DataFrame:
    """Add `worth`, an array beside `points`."""
    ship_package(arcs.sparkSession)

    @F.arrow_udf("array<double>")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from streamweave.operators.borders import worths

        for lines in batches:
            flat, sizes = lines.flatten(), np.asarray(lines.value_lengths()).astype(np.int64)
            xy = np.stack([np.asarray(flat.field("x")), np.asarray(flat.field("y"))], axis=1) if len(flat) else np.zeros((0, 2))
            yield pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), pa.array(worths(xy, sizes)))

    return arcs.withColumn("worth", value("points"))


def _made(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column out of a generator, so that what reads it often doesn't work it out again each time."""
    return df.withColumn(name, F.explode(F.array(value)))


def _parting(rings: DataFrame, tables: Tables) -> DataFrame:
    """(row, at): where borders part on the rings (row, p): places that don't have just two neighbours, the same for all rings there."""
    c = F.col
    n = F.size("p")
    steps = F.transform("p", lambda p, i: F.struct(p.alias("a"), F.get("p", (i + n - 1) % n).alias("b"), F.get("p", (i + 1) % n).alias("c")))
    visits = rings.select("row", F.posexplode(steps).alias("at", "v")).select("row", "at", "v.a", "v.b", "v.c")
    low, high = F.least("b", "c"), F.greatest("b", "c")
    visits = visits.select("row", "at", c("a.x").alias("x"), c("a.y").alias("y"), low["x"].alias("lx"), low["y"].alias("ly"), high["x"].alias("hx"), high["y"].alias("hy"))
    here = Window.partitionBy("x", "y")
    back = (c("lx") == c("hx")) & (c("ly") == c("hy"))  # a ring that turns back on itself
    same = [F.min(v).over(here) == F.max(v).over(here) for v in ("lx", "ly", "hx", "hy")]
    told = visits.withColumns({"back": F.max(back).over(here), "same": same[0] & same[1] & same[2] & same[3]}).where("back or not same")
    told = tables.write(told.select("row", "at", "back", *[F.when(c("back"), c(v)).alias(v) for v in ("x", "y", "lx", "ly", "hx", "hy")]))
    turned = told.where("back")
    if not turned.limit(1).count():
        return told.select("row", "at")
    ends = turned.select("row", "at", "x", "y", F.explode(F.array(F.struct(c("lx").alias("x"), c("ly").alias("y")), F.struct(c("hx").alias("x"), c("hy").alias("y")))).alias("to"))
    owned = ends.groupBy("x", "y", "to").agg(F.array_sort(F.collect_set("row")).alias("owners"))
    parts = owned.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("owners").alias("one"), F.max("owners").alias("other")).where("n <> 2 or one <> other")
    return told.where("not back").select("row", "at").unionByName(turned.join(parts.select("x", "y"), ["x", "y"], "left_semi").select("row", "at"))


def arcs_of(rings: DataFrame, key: str, ring: str, points: str, digits: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(arcs (arc, points), parts (row, key, ring, part, arc, backwards)) of rings given as arrays of (x, y)."""
    c = F.col
    n = F.size("p")
    # A row grows to many, and few files may hold all of them.
    given = spread(rings.where(F.size(points) >= 3).select(c(key).alias("key"), c(ring).alias("ring"), c(points).alias("p")))
    given = _made(given, "p", F.transform("p", lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))))
    given = _made(given, "p", F.filter("p", lambda p, i: (i == 0) | (p != F.get("p", i - 1))))
    given = _made(given, "p", F.when((n > 1) & (F.get("p", F.lit(0)) == F.element_at("p", -1)), F.slice("p", 1, n - 1)).otherwise(c("p"))).where(n >= 3)
    given = tables.write(given.withColumn("row", F.monotonically_increasing_id()))
    cuts = _parting(given, tables).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("cuts"))
    # A ring where nothing parts begins at its least point, in whichever polygon it stands.
    cut = _made(given.join(cuts, "row", "left"), "least", F.when(c("cuts").isNull(), F.array_min("p")))
    cut = _made(cut, "cuts", F.coalesce("cuts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("p", i) == c("least"))))
    to = lambda i, j: F.when(j + 1 < F.size("cuts"), F.slice("p", i + 1, F.get("cuts", j + 1) - i + 1)).otherwise(F.concat(F.slice("p", i + 1, n - i), F.slice("p", F.lit(1), F.get("cuts", F.lit(0)) + 1)))
    lines = cut.select("row", "key", "ring", F.posexplode(F.transform("cuts", to)).alias("part", "points"))
    front, back = F.struct(F.get("points", F.lit(0)).alias("end"), F.get("points", F.lit(1)).alias("next")), F.struct(F.element_at("points", -1).alias("end"), F.element_at("points", -2).alias("next"))
    told = _made(lines, "way", F.struct(F.least(front, back).alias("arc"), (back < front).alias("backwards")))
    spots = [c(f"way.arc.{end}.{v}").alias(f"{end}_{v}") for end in ("end", "next") for v in ("x", "y")]
    told = told.select("row", "key", "ring", "part", c("way.backwards").alias("backwards"), F.when(c("way.backwards"), F.reverse("points")).otherwise(c("points")).alias("points"), *spots)
    # An arc is known by the ring and part that has it (its least points, should they differ), and its points stand there alone.
    alike = Window.partitionBy("end_x", "end_y", "next_x", "next_y").orderBy("points", "row", "part")
    told = told.withColumns({"arc": F.struct(F.first("row").over(alike).alias("row"), F.first("part").over(alike).alias("part")), "nth": F.row_number().over(alike)})
    told = tables.write(told.select("row", "key", "ring", "part", "arc", "backwards", F.when(c("nth") == 1, c("points")).alias("points")))
    return told.where("points is not null").select("arc", "points"), told.drop("points")


def _lines(arcs: DataFrame) -> DataFrame:
    """(arc, i, j, x1, y1, x2, y2): the lines between neighbouring kept points."""
    step = lambda i, n: F.struct(i.alias("i"), F.get("kept", n + 1).alias("j"), F.get("points", i).alias("a"), F.get("points", F.get("kept", n + 1)).alias("b"))
    steps = arcs.select("arc", F.explode(F.filter(F.transform("kept", step), lambda s: s["j"].isNotNull())).alias("s"))
    return steps.select("arc", "s.i", "s.j", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def simplify_shared(rings: DataFrame, tolerance: float, key: str = "key", ring: str = "ring", points: str = "points", digits: int = 9) -> DataFrame:
    """(key, ring, points): the rings simplified within the tolerance, their topology kept.

    Rings may be closed or not; they are returned open, from a place where borders
    part.  Equal borders must have equal points.  Rings of fewer than three points are left out.  Rounds
    end when no line meets another but at common ends, or none that does has
    points left to take back (then the given rings met there already).
    """
    tables = Tables(rings.sparkSession)
    arcs, parts = arcs_of(rings, key, ring, points, digits, tables)
    numbered = F.sequence(F.lit(0), F.size("points") - 1)
    kept = F.filter(numbered, lambda i: F.get("worth", i) > tolerance)
    state = tables.write(_valued(arcs).withColumn("kept", kept))
    c = F.col
    while True:
        # Only a line that leaves out points can give one back, so only pairs with such a line are looked at.
        lines = tables.write(_lines(state).withColumns({"key": F.lit(0), "edge": F.monotonically_increasing_id(), "short": c("j") > c("i") + 1}))
        inner = meetings(lines, cell_size(lines), digits, asked="short").select("edge").distinct().join(lines, "edge").select("arc", "i", "j")
        one, two = F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y"))
        same = lines.select("arc", "i", "j", "short", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
        double = same.where("short").join(same.groupBy("a", "b").count().where("count > 1").select("a", "b"), ["a", "b"], "left_semi").select("arc", "i", "j")
        wrong = tables.write(inner.unionByName(double).distinct())
        if not wrong.limit(1).count():
            break
        back = wrong.groupBy("arc").agg(F.collect_list(F.struct("i", "j")).alias("wrong"))  # lines of one arc
        between = lambda s: F.slice("worth", s["i"] + 2, s["j"] - s["i"] - 1)
        best = F.transform("wrong", lambda s: s["i"] + F.array_position(between(s), F.array_max(between(s))).cast("int"))
        more = F.when(c("wrong").isNull(), c("kept")).otherwise(F.array_sort(F.array_union("kept", F.coalesce(best, F.array().cast("array<int>")))))
        before, state = state, tables.write(state.join(back, "arc", "left").select("arc", "points", "worth", more.alias("kept")))
        tables.drop(before, lines, wrong)
    short = state.select("arc", F.transform("kept", lambda i: F.get("points", i)).alias("line"))
    own = parts.join(short, "arc").withColumn("line", F.when(c("backwards"), F.reverse("line")).otherwise(c("line")))
    own = own.select("row", "key", "ring", F.struct("part", F.slice("line", 1, F.size("line") - 1).alias("line")).alias("piece"))
    made = own.groupBy("row", "key", "ring").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    out = tables.write(made.select(c("key").alias(key), c("ring").alias(ring), F.flatten(F.transform("pieces", lambda p: p["line"])).alias(points)))
    tables.drop_all_but(out)
    return out
