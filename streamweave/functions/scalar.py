"""Scalar expressions that Spark has no single function for."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marks() -> tuple[str, str, str]:
    """(marked letters, what they are without marks, the combining marks), by Unicode's own decomposition.

    Letters of the Basic Multilingual Plane whose decomposition is one character and marks.
    """
    marked, plain, marks = [], [], []
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0xFFFE)]):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFKD", c)
        bare = [x for x in parts if not unicodedata.combining(x)]
        if parts != c and len(bare) == 1 and c.isalpha():
            marked.append(c)
            plain.append(bare[0])
    return "".join(marked), "".join(plain), "".join(marks)


MARKED, PLAIN, MARKS = _marks()


def _ligatures() -> dict[str, str]:
    """Letters that decompose into several, by Unicode's own decomposition; Hangul syllables are left as they are."""
    out = {}
    for c in map(chr, [*range(0xA0, 0xAC00), *range(0xF900, 0xFFFE)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c.isalpha() and len(bare) > 1:
            out[c] = bare
    return out


LIGATURES = _ligatures()


def without_accents(text: Column) -> Column:
    """Letters without their marks, whether composed or followed by combining marks; ligatures as their letters."""
    plain = F.translate(text, MARKED + MARKS, PLAIN)
    joined = F.lit("".join(LIGATURES))
    parts = F.map_from_arrays(F.split(joined, ""), F.split(F.lit("\n".join(LIGATURES.values())), "\n"))
    spelt = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(parts, c), c)), "")
    return F.when(F.length(F.translate(plain, "".join(LIGATURES), "")) < F.length(plain), spelt).otherwise(plain)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first and the rest small."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def name_key(*parts: Column, separator: str = "/") -> Column:
    """Key of names: trimmed, upper case, without accents; null if a part is."""
    cleaned = [F.upper(without_accents(F.trim(p))) for p in parts]
    key = cleaned[0]
    for p in cleaned[1:]:
        key = F.concat(key, F.lit(separator), p)
    return key


def alphanumeric_key(text: Column) -> Column:
    """Upper-case letters and digits only (accented letters stay)."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def either_prefix(a: Column, b: Column) -> Column:
    """One non-empty code begins with the other."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, b) | F.startswith(b, a))


def erfc(x: Column, terms: int = 120) -> Column:
    """Complementary error function for x >= 0 by a series without alternating terms."""
    start = F.struct(F.lit(0.0).alias("sum"), x.cast("double").alias("term"))
    step = lambda acc, n: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * 2.0 * x * x / (2.0 * n + 3.0)).alias("term"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: acc["sum"])
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * total)


def shortest_turn(difference: Column, period: float = 12.0) -> Column:
    """A signed difference on a circle, in [-period/2, period/2)."""
    return F.pmod(difference + F.lit(period / 2), F.lit(period)) - F.lit(period / 2)


def percent_change(before: Column, after: Column) -> Column:
    """Null where the base isn't positive."""
    return F.when(before > 0, (after - before) / before * 100)


def zigzag(value: Column) -> Column:
    value = value.cast("long")
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-(value.bitwiseAND(F.lit(1).cast("long"))))


def flags(**conditions: Column) -> Column:
    """Letters of the conditions that hold, null if none does."""
    return F.nullif(F.concat(*[F.when(c, F.lit(k)).otherwise(F.lit("")) for k, c in conditions.items()]), F.lit(""))
