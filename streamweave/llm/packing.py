"""Best-fit-decreasing packing of tokenised documents (operator 2).

Best fit decreasing only ever looks at lengths, so pieces of one length are
interchangeable.  The job therefore counts the pieces of each length (at most
`capacity` rows, whatever the corpus), packs that histogram on the driver and
joins the resulting plan back to the pieces by length and rank.  The packing is
the one that best fit decreasing gives for the whole corpus: there is no
per-partition packing and no waste at partition borders.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamweave.llm import bpe
from streamweave.llm.common import arrow_udf, cut, parts, table
from streamweave.llm.tokens import shipped

#: Id that ends every document (fixed value of the contract).
END_ID = 2
PLAN = "length int, rank_from long, rank_to long, per_bin long, first_bin long, offset int"


class CapacityTree:
    """Segment tree over remaining capacities: how many groups of open bins each has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, by: int) -> None:
        node = self.size + remaining
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that some open bin has."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack n pieces of each length; the result has a row for each run of equal bins.

    A row (length, rank_from, rank_to, per_bin, first_bin, offset) places the
    pieces of that length with rank r in [rank_from, rank_to) into bin
    first_bin + (r - rank_from) // per_bin at
    offset + (r - rank_from) % per_bin * length.  After a piece has gone into the
    tightest bin, that bin, while it still has room, is again the tightest, so
    each bin takes as many of the length as it holds before the next one is
    looked at; that is what lets whole runs be placed at once.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    plan, bins = [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -1)
            each = room // length
            full, over = divmod(left, each)
            if full >= n:
                full, over = n, 0
            offset = capacity - room
            if full:
                plan.append((length, rank, rank + full * each, each, first, offset))
                leave(room - each * length, first, full)
            if over:
                plan.append((length, rank + full * each, left + rank, over, first + full, offset))
                leave(room - over * length, first + full, 1)
            leave(room, first + full + bool(over), n - full - bool(over))
            rank, left = rank + full * each + over, left - full * each - over
    return plan


def cut_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, longer ones cut.

    A document longer than the capacity gives full pieces and, first, what is
    left over.  Only positions and checksums leave the task, never the ids.
    """
    shared = shipped(df.sparkSession, tokenizer_path)
    fields = list(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def pieces(batches):
        config, whole = shared.value
        ids = bpe.encoder(config, whole).ids
        end = END_ID.to_bytes(4, "little")
        for texts in batches:
            rows, numbers, starts, lengths, sums = [0], [], [], [], []
            for text in texts.to_pylist():
                raw = ids(text) + end
                n = len(raw) >> 2
                if n <= capacity:
                    numbers.append(0), starts.append(0), lengths.append(n), sums.append(zlib.crc32(raw))
                else:
                    view, marks = memoryview(raw), [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
                        numbers.append(i), starts.append(a), lengths.append(b - a), sums.append(zlib.crc32(view[4 * a : 4 * b]))
                rows.append(len(numbers))
            columns = [pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))

    udf = arrow_udf(df.sparkSession, pieces, "array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    return df.select(F.col(id_col).alias("doc_id"), F.explode(udf(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def pack(df: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.  Null and empty texts are the end id alone.  Ids may be
    null or repeat: each row is packed, and rows that are equal in all of id,
    piece and checksum are told apart by a row number.  Extra columns are left
    out (join them back by id).  An empty table gives an empty result.
    """
    spark = df.sparkSession
    n = parts(spark)
    cut_up = cut_pieces(df, id_col, text_col, capacity, tokenizer_path)
    # Ranks within a length, without gathering a length anywhere: rows are dealt
    # to buckets by their own hash, numbered there, and shifted by the counts of
    # the buckets before (a row per bucket and length).
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int")
    pieces = cut(cut_up.withColumn("bucket", bucket))
    counts = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit_decreasing(histogram, capacity), PLAN)
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(shifts, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    # The plan has at most a run for each pair of a length and an open capacity.
    at = ranked.alias("r").join(
        F.broadcast(plan).alias("p"),
        (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.rank_from")) & (F.col("r.rank") < F.col("p.rank_to")),
    )
    nth = F.col("r.rank") - F.col("p.rank_from")
    return at.select(
        "r.doc_id",
        "r.piece",
        "r.start",
        F.col("r.length").alias("length"),
        "r.ids_crc32",
        (F.col("p.first_bin") + F.expr("(r.rank - p.rank_from) div p.per_bin")).alias("sequence_id"),
        (F.col("p.offset") + nth % F.col("p.per_bin") * F.col("r.length")).cast("long").alias("offset"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
