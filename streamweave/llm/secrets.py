"""Secret scanning by sliding-window entropy (operator 13).

Three patterns find assigned secrets, access keys and hex runs.  Beside them every
candidate, a maximal run of a class's characters, is read by a window of WINDOW
characters: the window's Shannon entropy is kept up to date by taking one count
down and another up for each step.  Where it reaches the class's threshold the
window is taken; windows that touch are one span of kind `entropy`.  An allow-list
suppresses what is random but no secret: ids in the form of UUIDs, runs in order
of the alphabet, numbers, strings with a word that marks an example, and names and
paths made of words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, drop_clashing, fresh, table

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns; A-Z and a-z are alike in the words of the first one.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

#: Characters of a window.
WINDOW = 20
#: 2**SCALE times c * log2(c), in whole numbers: the counts' sum is the same however it was come by.
SCALE = 32


def _table(window: int) -> list[int]:
    return [0] + [round(c * math.log2(c) * (1 << SCALE)) for c in range(1, window + 1)]


class Class:
    """A character class: its runs, and the entropy in bits that a window of random ones reaches."""

    def __init__(self, name: str, letters: str, bits: float, needs: tuple[str, ...]):
        self.name, self.bits, self.needs = name, bits, [re.compile(n) for n in needs]
        self.runs = re.compile(f"[{letters}]{{{WINDOW},}}")


#: A window of 20 random characters has 3.2 bits on average for hex, 3.9 for letters and digits, 4.0 with marks.
CLASSES = (
    Class("hex", "0-9A-Fa-f", 2.9, ("[0-9]", "[A-Fa-f]")),
    Class("alnum", "0-9A-Za-z", 3.6, ("[0-9]", "[A-Za-z]")),
    Class("base64", "0-9A-Za-z+/=_-", 3.7, ("[0-9]", "[a-z]", "[A-Z]")),
)

UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
EXAMPLE = re.compile(r"example|sample|dummy|placeholder|redacted|changeme|your[_-]?(?:key|token|secret|password)|xxxx", re.IGNORECASE | re.ASCII)
#: Places where lower case, capitals and digits change; a word's own capital and what follows a mark are none.
CHANGES = re.compile(r"(?<=[a-z])[^a-z]|(?<=[0-9])[^0-9]|(?<=[A-Z])[^A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, leftmost and not overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def windows(run: str, bits: float, table: list[int]) -> list[tuple[int, int]]:
    """Stretches of `run` covered by windows whose entropy is `bits` or more.

    With counts c of n characters it is log2(n) - sum(c log2 c) / n.
    """
    n = len(table) - 1
    most = table[n] - round(bits * n * (1 << SCALE))  # the sum may be so large
    counts: dict[str, int] = {}
    total, out = 0, []
    for i, into in enumerate(run):
        if i >= n:
            gone = run[i - n]
            c = counts[gone]
            counts[gone] = c - 1
            total += table[c - 1] - table[c]
        c = counts.get(into, 0)
        counts[into] = c + 1
        total += table[c + 1] - table[c]
        if i >= n - 1 and total <= most:
            start = i - n + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def in_order(text: str) -> bool:
    """Over half of the steps go to the same or a neighbouring character: 0123..., abcd..., aaaa..."""
    near = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(text, text[1:], strict=False))
    return 2 * near > len(text) - 1


def of_words(text: str) -> bool:
    """Under one change of class in four characters: words, camel-case names and paths, where random ones have two."""
    return 4 * len(CHANGES.findall(text)) < len(text)


def covers(spans: list[tuple[int, int]]):
    """A function that tells whether (start, end) lies within one of the spans, by start."""
    starts = [a for a, _ in spans]
    furthest = list(accumulate((b for _, b in spans), max))

    def within(start: int, end: int) -> bool:
        k = bisect_right(starts, start)
        return k > 0 and furthest[k - 1] >= end

    return within


def allowed(text: str, start: int, end: int, in_uuid) -> bool:
    """Whether the allow-list clears a stretch."""
    found = text[start:end]
    if in_uuid(start, end):
        return True
    return bool(EXAMPLE.search(found)) or in_order(found) or of_words(found)


TABLE = _table(WINDOW)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Stretches of high entropy of all classes that the allow-list doesn't clear, overlapping ones joined."""
    found, in_uuid = [], None
    for kind in CLASSES:
        for m in kind.runs.finditer(text):
            run, at = m[0], m.start()
            if not all(n.search(run) for n in kind.needs):
                continue
            for a, b in windows(run, kind.bits, TABLE):
                stretch = run[a:b]
                if not all(n.search(stretch) for n in kind.needs):
                    continue
                in_uuid = in_uuid or covers([m.span() for m in UUID.finditer(text)])
                if not allowed(text, at + a, at + b, in_uuid):
                    found.append((at + a, at + b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and entropy spans that don't lie within one of them, by start and kind."""
    base = base_spans(text)
    known = covers([(a, b) for a, _, b in base])
    return sorted(base + [(a, 3, b) for a, b in entropy_spans(text) if not known(a, b)])


SPAN = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(df: DataFrame, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """Add an array of spans (kind, start, end) in code points, end exclusive, by start, then kind.

    Whole texts are read, however long; null and empty ones have no spans.  Each
    row is read by itself, so repeated rows and ids, null ids and extra columns
    don't matter; a column of that name is replaced.  An empty table gives an
    empty result.  No shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans(batches):
        for texts in batches:
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t)] if t else [] for t in texts.to_pylist()], kind)

    udf = arrow_udf(df.sparkSession, spans, SPAN)
    (text,) = fresh(df, "text")
    kept = drop_clashing(df.withColumn(text, F.col(text_col)), [name])
    return kept.withColumn(name, udf(F.col(text))).drop(text)


def masked(df: DataFrame, spans_col: str = "secrets", text_col: str = "text") -> DataFrame:
    """The text with each secret replaced by its kind in brackets; overlapping spans are one (the first's kind).

    Null texts stay null, texts without secrets as they are.
    """
    from streamweave.llm.pii import redact

    def replaced(batches):
        for rows in batches:
            texts, spans = rows.field(0).to_pylist(), rows.field(1).to_pylist()
            yield pa.array([None if t is None else redact(t, [(s["kind"], s["start"], s["end"]) for s in x or []]) for t, x in zip(texts, spans, strict=True)], pa.string())

    udf = arrow_udf(df.sparkSession, replaced, "string")
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, udf(F.struct(text_col, spans_col))).otherwise(F.col(text_col)))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base patterns' counts and digest, and all spans with those that entropy adds."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown(F.filter("secrets", lambda s: s["kind"] != "entropy")).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("secrets")).alias("spans"),
        number("entropy").alias("n_entropy"),
    )
