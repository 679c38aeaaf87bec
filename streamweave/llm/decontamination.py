"""Benchmark decontamination: rare seeds, exact bounds, then Smith-Waterman (operator 7).

The benchmark is the query set and is taken in blocks of a bounded number of
words, each against all documents.  A leak is a local alignment of an item with
a passage whose score reaches a threshold; what is sorted out before the
alignment can't reach it:

* Seeds.  A score of s needs s matched words of the item.  So of its n words any
  n - s + 1 must hold a matched one; the rarest of the block are taken.  (Edits
  may stand between any two words, so longer n-grams would miss copies.)
* Words.  At least s places of the item must have words that the document has.
* Windows.  A passage that reaches s is at most n + 2 (n - s) words long.  Windows of
  that length count each word at most as often as the item has it; where fewer
  than s count, no passage ends.
* Islands.  Words that the item hasn't cost a passage at least half a point
  each.  Where the running sum of points, begun anew whenever it falls to zero,
  stays below s, no passage reaches s; an alignment lies within one such run.

What is left is aligned with the item, word by word; edits, gaps and insertions
lower the score without breaking the match.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from streamweave.llm.common import arrow_udf, drop_clashing, fresh, table
from streamweave.operators.lineage import Tables

#: Alignment: scores per word, and the share of the perfect score that is a leak.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
THRESHOLD = 0.5
#: However short the item, so many words (or all of it) must match.
SHORTEST = 3
#: Benchmark words handled at a time (what is broadcast is a few MB at most; larger benchmarks are read block after block).
BLOCK_WORDS = 400_000
#: Words times items whose points are summed at once.
TOGETHER = 1_000_000

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8; ASCII punctuation and white space separate them."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Seeds:
    """A block of benchmark items as word codes, with the words to look for."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD):
        found = [(i, words(t)) for i, t in items]
        found = [(i, w) for i, w in found if w]
        self.ids = [i for i, _ in found]
        self.code: dict[bytes, int] = {}
        self.coded = [np.array([self.code.setdefault(x, len(self.code)) for x in w], np.int64) for _, w in found]
        self.length = np.array([len(c) for c in self.coded], np.int64)
        #: The score that makes a leak, and the matches that it takes at least.
        self.score = np.maximum(threshold * self.length, np.minimum(self.length, SHORTEST)) - 1e-9
        self.need = np.ceil(self.score / MATCH).astype(np.int64)
        kinds = [np.unique(c) for c in self.coded]
        held = np.bincount(np.concatenate(kinds), minlength=len(self.code)) if kinds else np.zeros(0, np.int64)
        seeds = [np.unique(c[np.lexsort((c, held[c]))[: len(c) - m + 1]]) for c, m in zip(self.coded, self.need, strict=True)]
        # The items of each seed word, and the items' words one after the other.
        word = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        order = np.argsort(word, kind="stable")
        self.item_of = item[order]
        self.starts = np.searchsorted(word[order], np.arange(len(self.code) + 1))
        self.flat = np.concatenate(self.coded) if self.coded else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self._present: np.ndarray | None = None

    def encode(self, text: str | None) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.code.get, w, repeat(-1)), np.int64, len(w))

    def candidates(self, known: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Items with a seed among a text's (distinct) words and enough places whose word it has."""
        lo, n = self.starts[known], self.starts[known + 1] - self.starts[known]
        items = np.unique(self.item_of[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)])
        if not len(items):
            return items
        n, at = self._places(items)
        held = present[self.flat[at]] >= 0
        return items[np.add.reduceat(held.astype(np.int64), np.cumsum(n) - n) >= self.need[items]]

    def _places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each item, and where they stand in `flat`, one item after the other."""
        n = self.length[items]
        ends = np.cumsum(n)
        return n, np.arange(ends[-1]) + np.repeat(self.begin[items] - (ends - n), n)

    def islands(self, coded: np.ndarray):
        """(item, parts of the text that may hold a passage of its score), by points per word alone."""
        words_of, inverse = np.unique(coded, return_inverse=True)
        if self._present is None:
            self._present = np.full(len(self.code), -1, np.int64)
        known = words_of[words_of >= 0]
        self._present[known] = np.nonzero(words_of >= 0)[0]
        try:
            items = self.candidates(known, self._present)
            together = max(1, TOGETHER // max(1, len(coded)))
            for first in range(0, len(items), together):
                some = items[first : first + together]
                n, at = self._places(some)
                row, place = np.repeat(np.arange(len(some)), n), self._present[self.flat[at]]
                member = np.zeros((len(some), len(words_of)), bool)
                member[row[place >= 0], place[place >= 0]] = True
                total = np.where(member[:, inverse], MATCH, max(MISMATCH, GAP)).cumsum(axis=1)
                run = total - np.minimum.accumulate(np.minimum(total, 0.0), axis=1)
                for k in np.nonzero(run.max(axis=1) >= self.score[some])[0]:
                    over = np.flatnonzero(np.diff(np.r_[False, run[k] > 1e-12, False]))
                    parts = [(a, b) for a, b in zip(over[::2].tolist(), over[1::2].tolist(), strict=True) if run[k, a:b].max() >= self.score[some[k]]]
                    yield int(some[k]), parts
        finally:
            self._present[known] = -1

    def passages(self, coded: np.ndarray, i: int, parts: list[tuple[int, int]]):
        """The parts' windows in which enough words stand, each counted no more often than in the item."""
        kinds, counts = np.unique(self.coded[i], return_counts=True)
        n, need = len(self.coded[i]), int(self.need[i])
        longest = int(n + (MATCH * n - self.score[i]) / -max(MISMATCH, GAP)) + 1
        for a, b in parts:
            part = coded[a:b]
            at = np.searchsorted(kinds, part)
            at[at == len(kinds)] = 0
            x = np.flatnonzero(kinds[at] == part)
            order = np.lexsort((x, part[x]))
            x, kind = x[order], at[x[order]]
            # A word counts in windows that end after it, while as many later ones as the item has aren't in them.
            later = np.arange(len(x)) + counts[kind]
            same = later < len(x)
            same[same] = kind[later[same]] == kind[same]
            upto = np.minimum(x + longest, len(part))
            upto[same] = np.minimum(upto[same], x[later[same]])
            step = np.bincount(x + 1, minlength=len(part) + 2) - np.bincount(upto + 1, minlength=len(part) + 2)
            ends = np.flatnonzero(np.cumsum(step)[: len(part) + 1] >= need)
            for run in np.split(ends, np.flatnonzero(np.diff(ends) > longest) + 1) if len(ends) else ():
                yield a + max(0, int(run[0]) - longest), a + int(run[-1])

    def alignments(self, coded: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, share of the perfect score, first word, end word) of the best passage of each item that leaks."""
        if not len(coded) or not self.ids:
            return []
        out, raw = [], coded.tobytes()
        for i, parts in self.islands(coded):
            item = self.coded[i]
            n, best = len(item), (0.0, 0, 0)
            at = raw.find(item.tobytes())
            while at >= 0 and at % 8:
                at = raw.find(item.tobytes(), at + 1)
            if at >= 0:  # a verbatim copy: no alignment scores more
                out.append((i, 1.0, at // 8, at // 8 + n))
                continue
            for a, b in self.passages(coded, i, parts):
                value, end = smith_waterman(coded[a:b], item)
                if value > best[0]:
                    best = (value, a, a + end)
            if best[0] >= self.score[i]:
                start = smith_waterman(coded[best[1] : best[2]][::-1], item[::-1])[1]
                out.append((i, best[0] / (MATCH * n), best[2] - start, best[2]))
        return out


def smith_waterman(passage: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """Best local alignment score and the passage position where it ends.

    Row by row over the passage; the gap along a row is a running maximum, so a
    row costs a few vector operations.
    """
    n = len(item)
    row = np.zeros(n + 1)
    along = -GAP * np.arange(n + 1)
    best, end = 0.0, 0
    for i, word in enumerate(passage):
        step = np.maximum(row[:-1] + np.where(item == word, MATCH, MISMATCH), row[1:] + GAP)
        new = np.concatenate(([0.0], np.maximum(step, 0.0)))
        row = np.maximum.accumulate(new + along) - along
        top = row.max()
        if top > best + 1e-9:
            best, end = float(top), i + 1
    return best, end


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of at most BLOCK_WORDS words (or one item), streamed in."""
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(words(text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, name: str = "leaks") -> DataFrame:
    """Add an array of (item_id, score, first_word, end_word), one for each item that leaks.

    score is the alignment's share of the item's perfect one (1: a verbatim
    copy).  Listed are alignments of `threshold` or more whose score is at least
    that of three matched words (of an item shorter than that: of all its words).
    Positions count the document's words.  Null texts have no words; items with
    null id or text or without words aren't searched for; repeated items are
    listed each; item ids keep their type.  A column of that name is replaced,
    all others are kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text, key, own = fresh(docs, "text", "digest", "own")
    id_type = benchmark.schema[item_col].dataType
    leaks = f"array<struct<item_id:{id_type.simpleString()},score:double,first_word:long,end_word:long>>"
    kind = pa.struct([("item_id", to_arrow_type(id_type)), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def search(block):
        shared = spark.sparkContext.broadcast(Seeds(block, threshold))

        def aligned(batches):
            seeds = shared.value
            for texts in batches:
                rows, found = [0], []
                for t in texts.to_pylist():
                    found += seeds.alignments(seeds.encode(t))
                    rows.append(len(found))
                item, score, first, end = zip(*found, strict=True) if found else ((), (), (), ())
                columns = [pa.array([seeds.ids[i] for i in item], kind[0].type), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
                yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))

        return shared, arrow_udf(spark, aligned, leaks)

    out = drop_clashing(docs.withColumn(text, F.col(text_col)), [name])
    blocks = _blocks(benchmark, item_col, item_text_col)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return out.withColumn(name, F.array().cast(leaks)).drop(text)
    if after is None:
        return out.withColumn(name, F.concat(F.array().cast(leaks), search(block)[1](F.col(text)))).drop(text)
    # Block after block: what a block finds is written by the text's digest, then its seeds go.
    tables, parts = Tables(spark), []
    digested = docs.select(F.sha2(F.col(text_col).cast("binary"), 256).alias(key), F.col(text_col).alias(text)).where(F.col(text).isNotNull())
    for block in chain([block, after], blocks):
        shared, udf = search(block)
        found = digested.select(key, udf(F.col(text)).alias(own)).where(F.size(own) > 0)
        parts.append(tables.write(found.groupBy(key).agg(F.struct(F.lit(len(parts)).alias("block"), F.first(own).alias("leaks")).alias(own))))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array_sort(F.collect_list(own)).alias(own))
    both = out.withColumn(key, F.sha2(F.col(text).cast("binary"), 256)).join(every, key, "left")
    joined = F.flatten(F.transform(own, lambda p: p["leaks"]))
    return both.withColumn(name, F.coalesce(joined, F.array().cast(leaks))).drop(text, key, own)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **more) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): a row per document and item that leaks.

    As `with_leaks`; a null document id is kept, repeated documents give rows
    each, and empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_leaks(rows, benchmark, threshold=threshold, **more)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"))
