"""Groups of similar documents by SimHash, verified by exact Jaccard similarity.

At a Jaccard similarity of 0.8 two 64-bit SimHashes differ in 9 bits on average
and in up to some 20, far beyond what equal segments can find.  They are taken
over the distinct shingles, as the similarity is, so repeats don't move them.  Here candidates
share a seed, a pair of min-wise shingles (8 seeds a document: a pair at 0.8
shares none with a probability of 0.0003); pigeonring chains and the full Hamming
test prune them (but for short texts, whose SimHashes stray), and exact similarity
of the shingle sets decides.

Only what joins groups is compared.  Equal word sequences are one class.  First
each seed's classes meet one of them, its leader, in chunks of bounded size; in
seeds of many classes those that stay apart meet further leaders.  A seed whose
classes are then in one group is done.  In the others classes of different
groups are compared with each other, block against block, of which there are at
most 16 to a seed; where a seed has too many classes for that, they are
dealt again by more and more further minima (16 sets of three, 24 of five, ...: a
pair at 0.8 shares none with a probability below 0.0001) until the parts are small
or, at the last level, compared block against block.  Shingle sets move only for pairs that the SimHashes allow.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, cut, fresh, parts, shuffles_go
from streamweave.functions.shipping import ship_package
from streamweave.llm.components import connected_components
from streamweave.llm.simhash import SEED, majority, pigeonring, shingles, words

SEEDS = 8
#: Leaders that a seed of many classes has, one after the other.
STARS = 2
#: Blocks of a seed that are compared with each other; seeds of more are dealt again.
MANY = 16
#: Sets of minima at each level of dealing such seeds again; level k takes 1 + 2 k minima a set.
BANDS = (16, 24, 40, 64)
#: Levels in all; at the last one the rest is compared block against block.
LEVELS = 1 + len(BANDS)
#: Most documents of one seed in one block; a task compares two blocks at most.
BLOCK = 1024
#: Ring segments of 8 bits, and the Hamming radius that similarity 0.8 stays within.
SEGMENTS, RADIUS = 8, 22
#: Texts of at most so many distinct shingles aren't pruned by SimHash: ties move their bits.
SHORT = 16
#: Shingles of other sets that one set meets at a time.
SHINGLES_AT_ONCE = 1 << 20

_rng = np.random.default_rng(20240817)
_MULTIPLIERS = _rng.integers(1, 1 << 62, 2 * SEEDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)
_BUDGET = np.arange(1, SEGMENTS + 1) * RADIUS // SEGMENTS


def sketch(text: str | None, size: int) -> tuple[int, int, list[int], bytes]:
    """(class of the word sequence, SimHash, seeds, sorted 32-bit shingle hashes)."""
    w = words(text)
    whole = xxhash.xxh3_64_intdigest(b" ".join(w))
    runs = shingles(w, size)
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, len(runs))
    if not len(h):
        return whole, 0, [], b""
    distinct = np.unique(h)
    least = np.array([int((distinct * m >> np.uint64(3)).min()) for m in _MULTIPLIERS], np.uint64)
    seeds = least[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ least[1::2]
    return whole, majority(distinct), seeds.view(np.int64).tolist(), np.unique(h.astype(np.uint32)).astype("<u4").tobytes()


def chains_hold(difference: np.ndarray) -> np.ndarray:
    """Pigeonring test of each 64-bit difference: some chain keeps all its budgets."""
    boxes = _POPCOUNT[difference.astype("<u8").view(np.uint8).reshape(-1, SEGMENTS)]
    ring = np.concatenate([boxes, boxes[:, :-1]], axis=1)
    sums = np.concatenate([np.zeros((len(boxes), 1), np.int64), ring.cumsum(axis=1)], axis=1)
    out = np.zeros(len(boxes), bool)
    for start in range(SEGMENTS):
        out |= (sums[:, start + 1 : start + 1 + SEGMENTS] - sums[:, start : start + 1] <= _BUDGET).all(axis=1)
    return out


def within_radius(difference: np.ndarray) -> np.ndarray:
    ok = chains_hold(difference)
    ok[ok] = np.bitwise_count(difference[ok]) <= RADIUS
    return ok


def deeper_seeds(members: bytes, level: int) -> list[int]:
    """Keys of further minima of a shingle set, others at each level."""
    rng = np.random.default_rng([20240817, level])
    h = np.frombuffer(members, "<u4").astype(np.uint64)
    if not len(h):
        return []
    minima, bands = 1 + 2 * level, BANDS[level - 1]
    shift, by = (rng.integers(1, 1 << 62, bands * minima, dtype=np.int64).astype(np.uint64) for _ in range(2))
    least = [int(((h ^ s) * (m * np.uint64(2) + np.uint64(1)) >> np.uint64(3)).min()) for s, m in zip(shift, by, strict=True)]
    keys = [xxhash.xxh64_intdigest(repr((i, least[minima * i : minima * (i + 1)])).encode(), level) for i in range(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar_rows(sets, i: int, others: np.ndarray, similarity: float, marked: np.ndarray) -> list[int]:
    """Those of `others` whose sets are similar enough to that of row `i`.

    `marked` is an all-false table, of 2^k entries, for the low bits of the shingles
    of `i`: counting what falls on its marks bounds an intersection from above, for
    many sets at once; only the sets that the bound lets pass are intersected.
    """
    mine, mask, out = sets[i], np.uint32(len(marked) - 1), []
    marked[mine & mask] = True
    size = np.array([len(sets[j]) for j in others], np.int64)
    piece = size.cumsum() // SHINGLES_AT_ONCE
    for k in np.unique(piece):
        here, n = others[piece == k], size[piece == k]
        sums = np.concatenate([[0], marked[np.concatenate([sets[j] for j in here]) & mask].cumsum()])
        ends = n.cumsum()
        enough = similarity * (n + len(mine)) / (1 + similarity)
        for j in here[sums[ends] - sums[ends - n] >= enough - 1e-6]:
            common = len(np.intersect1d(mine, sets[j], assume_unique=True))
            if common >= similarity * (len(mine) + len(sets[j]) - common):
                out.append(int(j))
    marked[mine & mask] = False
    return out


def linking_pairs(nodes, prints, sets, left, right, similarity: float, group=None) -> list[tuple[int, int]]:
    """Links between `left` and `right` rows (the same indexes, or disjoint ones) that join groups.

    `group` numbers the groups that rows are in already.
    """
    group = np.arange(len(nodes)) if group is None else group.copy()
    size = np.array([len(x) for x in sets], np.int64)
    short = size <= SHORT
    marked = np.zeros(1 << max(16, int(size.max(initial=0)).bit_length() + 4), bool)
    seen = np.zeros(len(nodes), bool)
    right, out = np.asarray(right), []
    for i in left:
        seen[i] = True
        others = right[~seen[right] & (group[right] != group[i]) & (nodes[right] != nodes[i])]
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])]
        others = others[short[i] | short[others] | within_radius(prints[others] ^ prints[i])]
        if not len(others):
            continue
        for j in similar_rows(sets, i, others, similarity, marked):
            if group[j] != group[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
    return out


def promising(prints, short, left, right, group) -> np.ndarray:
    """Rows with another of a different group that their SimHashes allow."""
    out, right, seen = np.zeros(len(prints), bool), np.asarray(right), np.zeros(len(prints), bool)
    for i in left:
        seen[i] = True
        others = right[~seen[right] & (group[right] != group[i])]
        others = others[short[i] | short[others] | within_radius(prints[others] ^ prints[i])]
        out[others] = True
        out[i] |= len(others) > 0
    return out


def _by_key(batches, keys: tuple[str, ...]):
    """(key, lists of columns) of each run of equal keys in sorted batches."""
    key, held = None, {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for row, now in enumerate(zip(*(columns[k] for k in keys), strict=True)):
            if now != key:
                if key is not None:
                    yield key, held
                key, held = now, {n: [] for n in columns}
            for n, values in columns.items():
                held[n].append(values[row])
    if key is not None:
        yield key, held


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _star_links(similarity: float):
    """Links of leaders (the first row of each chunk) with the rows after them."""

    def links(batches):
        for (a, _), held in _by_key(batches, ("a", "chunk")):
            sets = [np.frombuffer(x, "<u4") for x in held["members"]]
            if held["role"][0] == 0:
                lead, found = sets[0], []
                for b, x in zip(held["node"][1:], sets[1:], strict=True):
                    n, m = len(lead), len(x)
                    if min(n, m) >= similarity * max(n, m):
                        common = len(np.intersect1d(lead, x, assume_unique=True))
                        if common >= similarity * (n + m - common):
                            found.append((a, b))
                yield _pairs(found)

    return links


def _sides(held, key):
    """Indexes of the rows of the first and the second block of a meeting."""
    block = np.array(held["block"])
    left = np.nonzero(block == key[1])[0]
    return left, left if key[1] == key[2] else np.nonzero(block != key[1])[0]


def _prints(held) -> np.ndarray:
    return np.array(held["print"], np.int64).view(np.uint64)


def _groups(held) -> np.ndarray:
    return np.unique(np.array(held["grp"], np.int64), return_inverse=True)[1]


def _promising_rows(batches):
    for key, held in _by_key(batches, ("seed", "i", "j")):
        good = promising(_prints(held), np.array(held["short"], bool), *_sides(held, key), _groups(held))
        at = np.nonzero(good)[0].tolist()
        yield pa.RecordBatch.from_pydict({n: pa.array([held[n][k] for k in at], t) for n, t in (("seed", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("print", pa.int64()), ("grp", pa.int64()))})


def _links(similarity: float):
    def links(batches):
        for key, held in _by_key(batches, ("seed", "i", "j")):
            sets = [np.frombuffer(x, "<u4") for x in held["members"]]
            yield _pairs(linking_pairs(np.array(held["node"], np.int64), _prints(held), sets, *_sides(held, key), similarity, _groups(held)))

    return links


def _with_groups(shared: DataFrame, component: DataFrame) -> DataFrame:
    """(seed, node, print, short, grp, n) of the seeds whose classes aren't in one group yet."""
    held = shared.join(component.select("node", "component"), "node", "left").select("seed", "node", "print", "short", F.coalesce("component", "node").alias("grp"))
    apart = held.groupBy("seed").agg(F.count("*").alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("seed", "n")
    return held.join(apart, "seed")


def _allowed(x: str, y: str):
    """What the SimHashes of two rows allow: pigeonring chains, then the full test."""
    difference = F.col(f"{x}.print").bitwiseXOR(F.col(f"{y}.print"))
    return F.col(f"{x}.short") | F.col(f"{y}.short") | (pigeonring(difference, RADIUS, SEGMENTS) & (F.bit_count(difference) <= RADIUS))


def _star(held: DataFrame, classes: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Links of each seed's leader with the classes of other groups in it."""
    spark = held.sparkSession
    lead = held.groupBy("seed").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "print", "short", "grp")).alias("l")).select("seed", "l.*")
    edges = held.alias("x").join(lead.alias("y"), (F.col("x.seed") == F.col("y.seed")) & (F.col("x.grp") != F.col("y.grp"))).where(_allowed("x", "y"))
    edges = cut(edges.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct())
    chunks = edges.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    placed = edges.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    rows = placed.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("node"))
    leaders = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("a").alias("node"))
    full = rows.unionByName(leaders).join(classes.select("node", "members"), "node").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "node")
    return cut(full.mapInArrow(_star_links(similarity), "a long, b long"))


def _meet(held: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links between the groups of each seed; above BLOCK classes block against block."""
    spark = held.sparkSession
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = held.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("seed", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "print", "short", "grp")
    ordered = met.repartition(2 * parts(spark), "seed", "i", "j").sortWithinPartitions("seed", "i", "j", "node")
    kept = ordered.mapInArrow(_promising_rows, "seed long, i int, j int, block int, node long, print long, grp long")
    full = cut(kept).join(classes.select("node", "members"), "node").repartition(2 * parts(spark), "seed", "i", "j").sortWithinPartitions("seed", "i", "j", "node")
    return cut(full.mapInArrow(_links(similarity), "a long, b long"))


def _deal(held: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """The classes of seeds dealt again by further minima; parts of one group or class are dropped."""
    spark = held.sparkSession

    def keys(batches):
        for members in batches:
            yield pa.array([deeper_seeds(x, level) for x in members.to_pylist()], pa.list_(pa.int64()))

    deep = classes.join(held.select("node").distinct(), "node", "left_semi").select("node", arrow_udf(spark, keys, "array<long>")(F.col("members")).alias("keys"))
    # Keys of their own: a class has as many, however many of its seeds are dealt.
    own = held.select("node", "print", "short", "grp").distinct()
    dealt = cut(own.join(deep, "node").select(F.explode("keys").alias("seed"), "node", "print", "short", "grp").distinct())
    apart = dealt.groupBy("seed").agg(F.count("*").alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("seed", "n")
    return cut(dealt.join(apart, "seed"))


def similar_groups(df: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, group_id): a row per input row; digest is xxhash64 of the text.

    Rows of one group_id are linked by Jaccard similarities of at least
    `similarity` between their sets of `size`-word shingles (lower-cased words;
    shorter texts are one shingle).  Rows with equal word sequences are one class.
    Null, empty and blank texts are one class and similar to nothing else.  Null
    ids are kept; an empty table gives an empty result; extra columns are left out.
    """
    with shuffles_go(df.sparkSession):
        return _similar_groups(df, size, similarity, id_col, text_col)


def _similar_groups(df: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    kind = pa.struct([("class", pa.int64()), ("print", pa.int64()), ("seeds", pa.list_(pa.int64())), ("members", pa.binary())])

    def sketches(batches):
        for texts in batches:
            got = [sketch(t, size) for t in texts.to_pylist()]
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            yield pa.StructArray.from_arrays([signed([g[0] for g in got]), signed([g[1] for g in got]), pa.array([g[2] for g in got], pa.list_(pa.int64())), pa.array([g[3] for g in got], pa.binary())], fields=list(kind))

    udf = arrow_udf(spark, sketches, "struct<class:long,print:long,seeds:array<long>,members:binary>")
    rows = cut(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), udf(F.col(text_col)).alias("s")).select("doc_id", "digest", "s.*"))
    ship_package(spark)
    # One row per class; its sketch is the same in every row of it.
    short = (F.octet_length("members") <= 4 * SHORT).alias("short")
    seeded = rows.select(F.col("class").alias("node"), "print", short, F.posexplode("seeds").alias("band", "low")).withColumn("seed", F.xxhash64("band", "low")).drop("band", "low").distinct()
    sizes = seeded.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(seeded.join(sizes.select("seed"), "seed"))
    classes = cut(rows.select(F.col("class").alias("node"), "members").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    held = shared.withColumn("grp", F.col("node"))
    links = [_star(held, classes, similarity, 0)]
    component = connected_components(links[0])
    held = cut(_with_groups(shared, component))
    for turn in range(1, STARS):
        many = held.where(F.col("n") > BLOCK)
        if not many.limit(1).count():
            break
        links = [_stars(component), _star(many.drop("n"), classes, similarity, turn)]
        component = connected_components(_union(links))
        held = cut(_with_groups(held.drop("grp", "n"), component))
    links = [_stars(component)]
    for level in range(1, LEVELS + 1):
        many = held.where(F.col("n") > MANY * BLOCK)
        last = level == LEVELS or not many.limit(1).count()
        links.append(_meet(held if last else held.where(F.col("n") <= MANY * BLOCK), classes, similarity))
        if last:
            break
        held = _deal(many, classes, level)
    component = connected_components(_union(links))
    ids = rows.select("doc_id", "digest", F.col("class").alias("node"))
    return ids.join(component, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("group_id"))


def _stars(component: DataFrame) -> DataFrame:
    """Components as links of their nodes with the smallest one: what is settled isn't found again."""
    return component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def keep_one(df: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of similar ones: the smallest id (nulls last), then digest.

    Rows equal in id and text count once.  All columns are kept, whatever their names.
    """
    groups = similar_groups(df, size, similarity, id_col, text_col)
    kept = groups.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best"))
    digest, kept_id, kept_digest = fresh(df, "digest", "kept_id", "kept_digest")
    kept = kept.select(F.col("best.doc_id").alias(kept_id), F.col("best.digest").alias(kept_digest))
    rows = df.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = rows.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    return found.dropDuplicates([id_col, digest]).drop(digest)
