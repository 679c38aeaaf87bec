"""SimHash near-duplicate detection with pigeonring filtering (operator 4).

Fingerprints are compared by class: equal fingerprints are one class.  A pair of
classes can only differ in `radius` bits or fewer if, with the 64 bits cut into
m segments laid on a ring, some segment starts a chain in which the first l
segments together differ in at most l * radius / m bits, for every l.  With
m > radius the first segment of that chain must be equal, so it serves as the
join key; the rest of the chain prunes candidates before the full Hamming test.

A key with many classes is never paired off.  Its members are dealt out again by
three pieces of their remaining bits (again two differences can't touch all
three), until groups are small; bits run out before that fails, as classes are
distinct.  So no link is lost and no group is enumerated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, cut, table
from streamweave.llm.components import connected_components

SEED = 42
BITS = 64
#: Classes per key that are compared directly; beyond it the key is refined.
DIRECT = 48


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased, split at ASCII white space only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of `size` words; fewer words give the whole sequence."""
    if len(tokens) <= size:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(size)), strict=False)))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    runs = shingles(words(text), size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in runs), np.uint64, len(runs))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    little = hashes.astype("<u8", copy=False)
    for at in range(0, len(little), 1 << 16):
        bits = np.unpackbits(little[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint_udf(spark: SparkSession, size: int):
    def fingerprints(batches):
        for texts in batches:
            prints = [majority(shingle_hashes(t, size)) for t in texts.to_pylist()]
            yield pa.array(np.array(prints, np.uint64).view(np.int64))

    return arrow_udf(spark, fingerprints, "long")


def with_fingerprint(df: DataFrame, text_col: str = "text", size: int = 3, name: str = "fingerprint") -> DataFrame:
    """Add the 64-bit SimHash of a text's word shingles as a (signed) long.

    Null, empty and blank texts have fingerprint zero.
    """
    return df.withColumn(name, fingerprint_udf(df.sparkSession, size)(F.col(text_col)))


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def segments(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of m nearly equal segments."""
    marks = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(marks, marks[1:], strict=False)]


def part_of(value: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < BITS else -1))


def chain_holds(difference: Column, start: int, radius: int, m: int) -> Column:
    """Pigeonring test of the chain that begins at segment `start`."""
    parts = segments(m)
    holds, total = F.lit(True), F.lit(0)
    for l in range(1, m):
        total = total + F.bit_count(part_of(difference, *parts[(start + l - 1) % m]))
        holds = holds & (total <= F.lit(l * radius // m))
    return holds


def pigeonring(difference: Column, radius: int, m: int) -> Column:
    """Some chain holds: necessary for at most `radius` differing bits."""
    out = F.lit(False)
    for start in range(m):
        out = out | chain_holds(difference, start, radius, m)
    return out


def _masked_pieces(mask: int, n: int) -> list[int]:
    """The set bits of a mask cut into n runs, as masks."""
    ones = [i for i in range(BITS) if mask >> i & 1]
    marks = [len(ones) * i // n for i in range(n + 1)]
    return [sum(1 << i for i in ones[a:b]) for a, b in zip(marks, marks[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_links(classes: DataFrame, radius: int = 2, direct: int = DIRECT) -> DataFrame:
    """Links (a, b), a < b, between nodes whose fingerprints differ in 1..radius bits.

    `classes` has a row (node, fingerprint) for each distinct fingerprint.  Every
    pair within the radius is linked at least through one key; nothing is capped.
    """
    m = radius + 1
    full = (1 << BITS) - 1
    keyed = classes.select(
        "node",
        "fingerprint",
        F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(_signed(((1 << n) - 1) << a)).alias("mask")) for i, (a, n) in enumerate(segments(m))])).alias("k"),
    ).select("node", "fingerprint", "k.start", "k.mask", F.col("fingerprint").bitwiseAND(F.col("k.mask")).alias("key"))
    masks = {_signed(((1 << n) - 1) << a): full ^ (((1 << n) - 1) << a) for a, n in segments(m)}  # fixed bits -> free bits
    found: list[DataFrame] = []
    first = True
    while True:
        by = ["start", "mask", "key"] if first else ["mask", "key"]
        sizes = keyed.groupBy(*by).agg(F.count("*").alias("n"))
        few = keyed.join(sizes.where(F.col("n").between(2, direct)).select(*by), by)
        difference = F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))
        if first:  # the key is the chain's first segment; test the chain that it starts
            chain = F.lit(False)
            for i in range(m):
                chain = chain | ((F.col("x.start") == i) & chain_holds(difference, i, radius, m))
        else:
            chain = pigeonring(difference, radius, m)
        on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in by]
        pairs = few.alias("x").join(few.alias("y"), [*on, F.col("x.node") < F.col("y.node"), chain, F.bit_count(difference) <= radius])
        found.append(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        many = keyed.join(sizes.where(F.col("n") > direct).select(*by), by)
        kinds = [r[0] for r in many.select("mask").distinct().collect()]  # masks in use: at most (radius + 1) ** depth
        if not kinds:
            break
        finer, nextmasks = [], {}
        for mask in kinds:
            free = masks[mask]
            for piece in _masked_pieces(free, m):
                fixed = _signed((full ^ free) | piece)
                nextmasks[fixed] = free & ~piece & full
                finer.append((mask, fixed))
        choice = F.lit(None).cast("array<long>")
        for mask in kinds:
            choice = F.when(F.col("mask") == F.lit(mask), F.array(*[F.lit(f) for o, f in finer if o == mask])).otherwise(choice)
        keyed = cut(
            many.select("node", "fingerprint", F.explode(choice).alias("mask"))
            .distinct()
            .select("node", "fingerprint", F.lit(0).alias("start"), "mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"))
        )
        masks, first = nextmasks, False
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(df: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each input row.

    component_id is the smallest id that links of at most `radius` differing
    bits reach, the row's own included.  Texts without words (null, empty,
    blank) have fingerprint zero and link like any other.  Rows with a null id
    belong to their fingerprint's component (null if it has no other id); equal
    rows are kept; an empty table gives an empty result; extra columns are left
    out.
    """
    prints = cut(with_fingerprint(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", size).select("doc_id", "fingerprint"))
    classes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")))
    component = connected_components(near_links(classes.where("node is not null"), radius))
    labelled = classes.join(component, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, "fingerprint").select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=2, size=3)
