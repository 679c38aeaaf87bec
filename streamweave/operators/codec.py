"""Compact encodings: varint text, deltas, dictionaries, and line simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.functions.scalar import bound as _bound
from streamweave.functions.scalar import unzigzag, zigzag
from streamweave.functions.shipping import ship_package
from streamweave.operators.ranking import numbered

#: The 64 digits of the encoding (fixed value of the format).
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
#: Tolerance of a line by the area that it drains: (least area, tolerance), and the rest (fixed values).
TOLERANCES = [(50000, 0.0002), (5000, 0.0003), (500, 0.0007), (50, 0.0015)]
COARSE = 0.0032
#: Keys per block of a packed list: a block is written and read on its own.
BLOCK = 4096


def encode_varint(values: Column) -> Column:
    """Array of longs to text: zig-zag, then groups of 5 bits, low first, 32 marks "more"."""
    digit = lambda v: F.substring(F.lit(DIGITS), v.cast("int") + 1, F.lit(1))
    group = lambda z, k: F.shiftrightunsigned(z, 5 * k)

    def one(v):
        z = zigzag(v)
        parts = [F.when(group(z, 0) < 0, digit(F.lit(32) + z.bitwiseAND(F.lit(31)))).otherwise(digit(z.bitwiseAND(F.lit(31)) + F.when(group(z, 1) != 0, 32).otherwise(0)))]
        for k in range(1, 13):
            g = group(z, k)
            parts.append(F.when(g != 0, digit(g.bitwiseAND(F.lit(31)) + (F.when(group(z, k + 1) != 0, 32).otherwise(0) if k < 12 else F.lit(0)))).otherwise(F.lit("")))
        return F.concat(*parts)

    return F.array_join(F.transform(values, one), "")


def decode_varint(text: Column) -> Column:
    """The inverse of encode_varint, in time linear in the text."""
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.position(c, F.lit(DIGITS)) - 1).cast("bigint"))

    def numbers(d):
        return _bound(F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: F.get(d, i) < 32), lambda ends: F.transform(ends, lambda e, k: number(d, F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(F.lit(0)), e)))

    def number(d, first, last):
        bits = F.transform(F.slice(d, first + 1, last - first + 1), lambda x, j: F.call_function("shiftleft", x.bitwiseAND(F.lit(31).cast("bigint")), j * 5))
        return _bound(F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)), unzigzag)

    return _bound(digits, lambda d: F.when(F.size(d) == 0, F.array().cast("array<bigint>")).otherwise(numbers(d)))


def deltas(values: Column) -> Column:
    """Each value less the one before it (the first less 0)."""
    return _bound(values, lambda vs: F.transform(vs, lambda v, i: v - F.when(i > 0, F.get(vs, i - 1)).otherwise(F.lit(0))))


def running_sum(values: Column, chunk: int = 64) -> Column:
    """The inverse of deltas: sums within chunks of the array, shifted by the chunks before."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def sums(vs):
        part = lambda c, n: F.slice(vs, c * chunk + 1, n)
        chunks = F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / F.lit(chunk)).cast("int"))
        shifted = lambda totals, c: _bound(total(F.slice(totals, F.lit(1), c)), lambda o: F.transform(part(c, F.lit(chunk)), lambda x, j: o + total(part(c, j + 1))))
        return _bound(F.transform(chunks, lambda c: total(part(c, F.lit(chunk)))), lambda totals: F.flatten(F.transform(chunks, lambda c: shifted(totals, c))))

    return _bound(values, lambda vs: F.when(F.size(vs) == 0, F.array().cast("array<bigint>")).otherwise(sums(vs)))


def in_blocks(rows: DataFrame, group: Column, key: str, value: Column, block: int = BLOCK) -> DataFrame:
    """(grp, block, values): values in the order of their keys, `block` keys to a row.

    A block is a range of keys, so its size is bounded whatever the group's, and
    blocks are built (and later read) independently.
    """
    at = F.floor(F.col(key) / F.lit(block)).cast("long")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
    packed = rows.groupBy(group.alias("grp"), at.alias("block")).agg(pairs.alias("__p"))
    return packed.select("grp", "block", F.transform("__p", lambda p: p["v"]).alias("values"))


def dictionary(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(name, code): dense codes by first appearance; a row per distinct name."""
    first = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("__first"))
    return numbered(first, "__first", name, name="code").select(name, F.col("code").cast("long").alias("code"))


def tolerance_of(area: Column) -> Column:
    """How far a simplified line may stray, by the area that it drains."""
    out = None
    for least, tolerance in TOLERANCES:
        out = F.when(area >= least, tolerance) if out is None else out.when(area >= least, tolerance)
    return out.otherwise(COARSE)


def simplify_lines(lines: DataFrame, points: str, tolerance: float | Column, name: str = "simplified") -> DataFrame:
    """Douglas-Peucker per line; the tolerance is a number or a column.

    Depends on the whole line, so it is a pandas UDF (Arrow batches of lines).
    """
    ship_package(lines.sparkSession)

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def simplify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from streamweave.operators.codec import douglas_peucker

        for column, far in batches:
            out = []
            for line, t in zip(column, far, strict=True):
                if line is None:
                    out.append(None)
                    continue
                xy = np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)
                out.append([line[i] for i in douglas_peucker(xy, t)])
            yield pd.Series(out, dtype=object)

    return lines.withColumn(name, simplify(F.col(points), tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))))


def douglas_peucker(line: np.ndarray, tolerance: float) -> list[int]:
    """Positions of the points (n, 2) that stay within the tolerance; both ends always stay."""
    n = len(line)
    if n < 3:
        return list(range(n))
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    work = [(0, n - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        to, p = line[b] - line[a], line[a + 1 : b] - line[a]
        length = to @ to
        t = np.clip(p @ to / length, 0.0, 1.0) if length else np.zeros(len(p))
        d = np.hypot(*(p - t[:, None] * to).T)
        at = int(d.argmax())
        if d[at] > tolerance:
            keep[a + 1 + at] = True
            work += [(a, a + 1 + at), (a + 1 + at, b)]
    return np.nonzero(keep)[0].tolist()
