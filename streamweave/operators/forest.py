"""Operators on directed forests: every node has one downstream node or none.

A downstream key that no row has ends the forest there, as null does.  Keys must be
unique; a cycle is an error.

Totals and roots come from one contraction.  In a round all leaves are folded into
their downstream nodes, and of the nodes with a single upstream node those are
bridged whose hash is below both neighbours' (about a third of a chain, never two in
a row).  At least half of all nodes are of these kinds, so each round leaves a fixed share
fewer, and the rows of all rounds together are a small multiple of the nodes, however
deep the forest.  What a removed node needs later (what it held, which node it
followed) stays in the round's table, and the rounds are gone through backwards to
give each node its answer.  Once no more than FINISH nodes are left a single task
solves those; tests run with 0 as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.operators.lineage import Tables, cut_lineage

#: Nodes that one task solves: some 100 bytes each.
FINISH = 1 << 17


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def solve_small(rows: list[dict], values: Sequence[str], gates: Mapping[str, str] | None = None) -> list[dict]:
    """(node, root, values): roots and totals of a forest held in memory; nodes on cycles are left out."""
    ways = [(gates or {}).get(v) for v in values]
    key = lambda k: tuple(k.items()) if isinstance(k, dict) else k
    at = {key(r["node"]): i for i, r in enumerate(rows)}
    to = [None if r["to"] is None else at[key(r["to"])] for r in rows]
    above = [0] * len(rows)
    for t in to:
        if t is not None:
            above[t] += 1
    totals = [[r[v] for v in values] for r in rows]
    order = [i for i, n in enumerate(above) if not n]
    for i in order:
        t = to[i]
        if t is not None:
            sent = [b if g is None or rows[i][g] else None for b, g in zip(totals[i], ways, strict=True)]
            totals[t] = [b if a is None else a if b is None else a + b for a, b in zip(totals[t], sent, strict=True)]
            above[t] -= 1
            if not above[t]:
                order.append(t)
    root: dict[int, int] = {}
    for i in reversed(order):
        if to[i] is None or to[i] in root:  # else it drains into a cycle
            root[i] = i if to[i] is None else root[to[i]]
    return [{"node": rows[i]["node"], "root": rows[r]["node"], **dict(zip(values, totals[i], strict=True))} for i, r in root.items()]


def _solved(state: DataFrame, values: Sequence[str], gates: Mapping[str, str]) -> DataFrame:
    """(node, root, values) of a forest of at most FINISH nodes, in one task."""
    ship_package(state.sparkSession)
    out = state.select("node", F.col("node").alias("root"), *values).schema

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from streamweave.operators.forest import solve_small

        held = list(batches)
        if held:
            rows = solve_small([r for b in held for r in b.to_pylist()], values, gates)
            kinds = held[0].schema
            yield pa.RecordBatch.from_pylist(rows, pa.schema([pa.field("node", kinds.field("node").type), pa.field("root", kinds.field("node").type), *[kinds.field(v) for v in values]]))

    return state.select("node", "to", *values, *gates.values()).repartition(1).mapInArrow(solve, out)


def contract(nodes: DataFrame, node: str, down: str, values: Sequence[str] = (), rooted: bool = True, finish: int | None = None, sizes: list[int] | None = None, gates: Mapping[str, str] | None = None) -> DataFrame:
    """(node, root, values): the terminal node that each node drains to, and the sum of each value over it and all upstream.

    Without `rooted` roots aren't expanded (they are null).  The rows that each round
    began with are appended to `sizes`.  `gates` names a boolean column of its own for
    some of the values: where it is false the value doesn't flow on from that node.
    """
    gates = dict(gates or {})
    shut = list(gates.values())
    held_back = lambda v, c: F.when(F.col(gates[v]), c) if v in gates else c
    finish = FINISH if finish is None else finish
    tables = Tables(nodes.sparkSession)
    given = nodes.select(F.col(node).alias("node"), F.col(down).alias("to"), *values, *shut)
    ends = nodes.select(F.col(node).alias("to"), F.col(down).alias("__next"), F.lit(True).alias("__is"))
    some = ends.where("__next is not null").join(nodes.select(F.col(node).alias("__next"), F.lit(True).alias("__on")), "__next", "left")
    ends = some.select("to", "__is", F.col("__on").isNull().alias("last")).unionByName(ends.where("__next is null").select("to", "__is", F.lit(True).alias("last")))
    known_to = given.where("to is not null").join(ends, "to", "left")
    start = known_to.select("node", F.when(F.col("__is"), F.col("to")).alias("to"), F.coalesce("last", F.lit(False)).alias("last"), *values, *shut)
    state = tables.write(start.unionByName(given.where("to is null").select("node", "to", F.lit(False).alias("last"), *values, *shut)))
    left = total = state.count()
    done: list[tuple[DataFrame, DataFrame]] = []
    sizes = [] if sizes is None else sizes
    add = lambda v: F.when(F.col(f"__{v}").isNull(), F.col(v)).when(F.col(v).isNull(), F.col(f"__{v}")).otherwise(F.col(v) + F.col(f"__{v}")).alias(v)
    most = 4 * max(1, total).bit_length() + 8
    while left > max(finish, 0):
        sizes.append(left)
        if len(sizes) > most:
            raise ValueError("the downstream keys hold a cycle")
        upstream = state.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.lit(True).alias("inner"))
        marked = tables.write(state.join(upstream, "node", "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
        leaves = marked.where("not inner").drop("inner")
        gains = marked.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.count(F.when(F.col("inner"), 1)).alias("__inner"), F.max(F.when(F.col("inner"), F.col("node"))).alias("__only"), *[F.sum(F.when(~F.col("inner"), held_back(v, F.col(v)))).alias(f"__{v}") for v in values], *[F.max(F.when(F.col("inner"), F.col(g))).alias(f"__only_{g}") for g in shut])
        rest = marked.where("inner").join(gains, "node").select("node", "to", "last", F.when(F.col("__inner") == 1, F.col("__only")).alias("only"), *[add(v) for v in values], *shut, *[f"__only_{g}" for g in shut])
        draw = lambda c: F.xxhash64(F.lit(len(sizes)), F.col(c))  # noqa: E731, B023
        bridged = F.col("only").isNotNull() & F.col("to").isNotNull() & (draw("node") < draw("only")) & (draw("node") < draw("to"))
        rest = tables.write(rest.withColumn("bridged", F.coalesce(bridged, F.lit(False))))
        over = rest.where("bridged").drop("bridged")
        held = over.groupBy(F.col("to").alias("node")).agg(*[F.sum(held_back(v, F.col(v))).alias(f"__{v}") for v in values]) if values else None
        onward = over.select(F.col("only").alias("node"), F.col("to").alias("__to"), F.col("last").alias("__last"), F.lit(True).alias("__new"), *[F.col(g).alias(f"__{g}") for g in shut])
        after = rest.where("not bridged").join(onward, "node", "left")
        after = after.join(held, "node", "left") if values else after
        new = F.col("__new").isNotNull()
        before, state = state, tables.write(after.select("node", F.when(new, F.col("__to")).otherwise(F.col("to")).alias("to"), F.when(new, F.col("__last")).otherwise(F.col("last")).alias("last"), *[add(v) for v in values], *[(F.col(g) & F.coalesce(f"__{g}", F.lit(True))).alias(g) for g in shut]))
        tables.drop(before)
        done.append((leaves, over))
        left = state.count()
    columns = ["node", "root", *values]
    nowhere = F.lit(None).cast(dict(state.select("node").dtypes)["node"]).alias("root")
    known = [tables.write(_solved(state, values, gates))] if left else []
    if known and known[0].count() < left:
        raise ValueError("the downstream keys hold a cycle")
    for leaves, over in reversed(done):
        if not known:  # nothing is left after the last round: its leaves are terminal, or drain to one that it bridged
            later = over.select("node", nowhere, *values).limit(0)
        else:
            later = _union(known)
        arrive = lambda c: [F.when(F.col(f"__only_{gates[v]}"), F.col(f"__{v}")).alias(f"__{v}") if v in gates else F.col(f"__{v}") for v in c]
        reach = over.join(later.select(F.col("node").alias("only"), *[F.col(v).alias(f"__{v}") for v in values], F.col("root").alias("root")), "only").select("node", "root", *values, *arrive(values)).select("node", "root", *[add(v) for v in values])
        known.append(tables.write(reach))
        if not rooted:
            known.append(leaves.select("node", nowhere, *values))
            continue
        near = leaves.where("to is null or last").select("node", F.coalesce("to", "node").alias("root"), *values)
        far = leaves.where("to is not null and not last").join(_union([later, known[-1]]).select(F.col("node").alias("to"), "root"), "to").select("node", "root", *values)
        known.append(tables.write(near.unionByName(far).select(*columns)))
    if not known:
        return state.select("node", nowhere, *values)
    out = tables.write(_union(known).select(*columns)) if len(known) > 1 else known[0]
    tables.drop_all_but(out)
    return out


def own_area(nodes: DataFrame, node: str, down: str, area: str) -> DataFrame:
    """Area less that of the nodes directly upstream, at least 0."""
    above = nodes.where(F.col(down).isNotNull()).groupBy(F.col(down).alias(node)).agg(F.sum(area).alias("__above"))
    return nodes.join(above, node, "left").withColumn("own_area", F.greatest(F.col(area) - F.coalesce("__above", F.lit(0.0)), F.lit(0.0))).drop("__above")


def cut_at(nodes: DataFrame, node: str, down: str, stop: Column) -> DataFrame:
    """The forest without the edges that enter nodes where `stop` holds."""
    stops = nodes.where(stop).select(F.col(node).alias("__stop"))
    ends = nodes.where(F.col(down).isNull())  # kept out of the join: null is no key
    cut = nodes.where(F.col(down).isNotNull()).join(stops, F.col(down) == F.col("__stop"), "left")
    return cut.withColumn(down, F.when(F.col("__stop").isNull(), F.col(down))).drop("__stop").unionByName(ends)


def accumulate(nodes: DataFrame, node: str, down: str, values: Sequence[str]) -> DataFrame:
    """Sum of each value over a node and all nodes upstream of it; nulls count as nothing."""
    held = nodes.select(node, down, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
    return contract(held, node, down, values, rooted=False).select(F.col("node").alias(node), *values)


def accumulate_anchored(nodes: DataFrame, node: str, down: str, local: str, observed: str) -> DataFrame:
    """Accumulation in which an observation replaces what arrives, and flows on.

    Where `observed` isn't null the node's total is the observation: what comes
    from upstream stops there, and the observation is what it sends on.
    """
    anchored = F.col(observed).isNotNull()
    source = F.coalesce(F.col(observed), F.col(local)).cast("double")
    cut = cut_at(nodes, node, down, anchored)
    return accumulate(cut.withColumn("total", source), node, down, ["total"])


def accumulate_anchored_each(nodes: DataFrame, node: str, down: str, cases: Mapping[str, tuple[Column, Column]], observed: str) -> DataFrame:
    """`accumulate_anchored` for several cases in one pass over the forest.

    A case is (what a node adds itself, whether its observation holds); the result has
    a column of totals for each.  The forest is one: where an observation holds, only
    that case's flow stops before it.
    """
    own = {c: (local, F.coalesce(holds, F.lit(False)) & F.col(observed).isNotNull()) for c, (local, holds) in cases.items()}
    marked = nodes.select(F.col(node).alias("node"), F.col(down).alias("down"), *[F.when(holds, F.col(observed)).otherwise(local).cast("double").alias(c) for c, (local, holds) in own.items()], *[holds.alias(f"__held_{c}") for c, (_, holds) in own.items()])
    anchors = marked.where(reduce(Column.__or__, [F.col(f"__held_{c}") for c in own])).select(F.col("node").alias("down"), *[F.col(f"__held_{c}").alias(f"__stop_{c}") for c in own])
    totals = [F.coalesce(c, F.lit(0.0)).alias(c) for c in own]
    open_ = [(~F.coalesce(f"__stop_{c}", F.lit(False))).alias(f"gate_{c}") for c in own]
    inner = marked.where("down is not null").join(anchors, "down", "left").select("node", "down", *totals, *open_)
    ends = marked.where("down is null").select("node", "down", *totals, *[F.lit(True).alias(f"gate_{c}") for c in own])  # null is no key
    done = contract(inner.unionByName(ends), "node", "down", list(own), rooted=False, gates={c: f"gate_{c}" for c in own})
    return done.select(F.col("node").alias(node), *own)


def roots(nodes: DataFrame, node: str, down: str, name: str = "root") -> DataFrame:
    """The terminal node that each node drains to (itself if it is one)."""
    return contract(nodes, node, down).select(F.col("node").alias(node), F.col("root").alias(name))


def ring_positions(nodes: DataFrame, node: str, follows: str) -> DataFrame:
    """(node, ring, position): nodes that lie on rings (each is followed by one, and follows one).

    A ring is known by its least node, from which positions count from 0.  The least
    is found by doubling what each node looks ahead, then the ring is cut before it
    and the nodes behind are counted by contraction.
    """
    tables = Tables(nodes.sparkSession)
    state = tables.write(nodes.select(F.col(node).alias("node"), F.col(follows).alias("to"), F.col(node).alias("least")))
    while True:
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("least").alias("__least"))
        after = tables.write(state.join(ahead, "to").select("node", F.col("further").alias("to"), F.least("least", "__least").alias("least"), (F.col("__least") < F.col("least")).alias("moved")))
        tables.drop(state)
        state = after
        if not state.where("moved").limit(1).count():
            break
    rings = nodes.select(F.col(node).alias("node"), F.col(follows).alias("to")).join(state.select("node", "least"), "node")
    cut = tables.write(rings.select("node", F.when(F.col("to") != F.col("least"), F.col("to")).alias("to"), F.col("least").alias("ring"), F.lit(1).cast("long").alias("n")))
    behind = contract(cut, "node", "to", ["n"], rooted=False)
    out = tables.write(cut.select("node", "ring").join(behind.select("node", (F.col("n") - 1).alias("position")), "node"))
    tables.drop_all_but(out)
    return out.select(F.col("node").alias(node), "ring", "position")


def reroot_foreign(nodes: DataFrame, node: str, down: str, foreign: str) -> DataFrame:
    """Roots; groups that end in a foreign node are re-rooted where they leave the country."""
    plain = roots(nodes, node, down)
    inside = roots(cut_at(nodes, node, down, F.col(foreign)), node, down, "inner_root")
    abroad = nodes.where(F.col(foreign)).select(F.col(node).alias("root"), F.lit(True).alias("__abroad"))
    ended = cut_lineage(plain.select("root").distinct().join(abroad, "root"))  # foreign terminals only
    both = plain.join(inside, node).join(ended, "root", "left")
    return both.select(node, F.when(F.col("__abroad"), F.col("inner_root")).otherwise(F.col("root")).alias("root"))


def same_name_components(nodes: DataFrame, node: str, down: str, name: str) -> DataFrame:
    """Connected runs of equal names: root of the forest that keeps such edges only."""
    ends = nodes.select(F.col(node).alias("__end"), F.col(name).alias("__name"))
    kept = nodes.join(ends, F.col(down) == F.col("__end"), "left")
    same = F.when((F.col("__name") == F.col(name)) & (F.length(name) > 0), F.col(down))
    return roots(kept.select(node, same.alias(down)), node, down, "river")


def nearest_anchor_downstream(nodes: DataFrame, node: str, down: str, anchor: Column) -> DataFrame:
    """The first anchor from each node downstream, itself included; null if none."""
    marked = nodes.select(F.col(node).alias("node"), F.col(down).alias("down"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    end = roots(marked.select("node", F.when(~F.col("anchor"), F.col("down")).alias("down")), "node", "down")
    anchors = marked.where("anchor").select(F.col("node").alias("root"), F.lit(True).alias("__is"))
    return end.join(anchors, "root", "left").select(F.col("node").alias(node), F.when(F.col("__is"), F.col("root")).alias("owner"))


def basin_index(root_of: DataFrame, node: str, length: DataFrame, names: DataFrame, renames: dict[str, str], top: int = 24, other: str = "Other") -> tuple[DataFrame, DataFrame]:
    """(basins (basin, name), nodes (node, basin)): the longest basins by name, the rest is 0.

    `root_of` is (node, root), `length` (node, km), `names` (root, name).  Roots
    without a name belong to the rest; two roots of one name are one basin, and
    names are numbered in their order from 1.
    """
    km = root_of.join(length, node).groupBy("root").agg(F.round(F.sum("km"), 6).alias("km"))
    longest = km.orderBy(F.desc("km"), "root").limit(top)
    given = F.nullif(F.trim("name"), F.lit(""))
    renamed = reduce(lambda c, kv: F.when(given == kv[0], kv[1]).otherwise(c), renames.items(), given)
    named = cut_lineage(longest.join(names, "root").select("root", renamed.alias("name")).where("name is not null"))  # at most `top` rows
    order = sorted({r["name"] for r in named.select("name").collect()})
    spark = root_of.sparkSession
    basins = spark.createDataFrame([(0, other), *enumerate(order, 1)], "basin int, name string")
    number = named.join(basins.where("basin > 0"), "name").select("root", "basin")
    return basins, root_of.join(F.broadcast(number), "root", "left").select(node, F.coalesce("basin", F.lit(0)).alias("basin"))
