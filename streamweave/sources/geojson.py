"""Features of GeoJSON documents of any size, read in splits wherever a split falls.

The text is read by Spark's own reader as pieces that end with a closing brace, so
any file system and any split size will do; nothing is assumed of spacing, key
order or what properties hold.  A split alone can't tell whether it begins within a
string or how deep.  So a first pass sums up each split under both readings (begun
in a string or not): how much deeper it ends, how shallow it gets, whether it opens
the list `features`.  The summaries, one short row a split, are put together in order
on the driver, which gives each split its true beginning; a second pass then cuts the
features.  Parts of a feature that lies across splits are joined by a shuffle on the
split it begins in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package

#: A whole string, one that the piece doesn't end, or a bracket.
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}\[\]]', re.S)
#: What is left of a string that an earlier piece began.
REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: The key that a list of features stands under.
KEY = re.compile(r'(?<!\\)"features"\s*:\s*\Z')

SUMMARY = "path string, block long, inside boolean, ends_inside boolean, deeper int, lowest int, opens array<struct<depth:int,closed:boolean>>"
PIECE = "path string, owner long, block long, part long, whole boolean, text string"


def brackets(piece: str, inside: bool) -> Iterator[tuple[str | None, int]]:
    """(bracket, its place) outside strings; at the end (None, 1 if the piece ends inside a string)."""
    at = 0
    if inside:
        rest = REST.match(piece)
        if rest is None:
            yield None, 1
            return
        at = rest.end()
    for token in TOKEN.finditer(piece, at):
        text = token.group()
        if text[0] != '"':
            yield text, token.start()
        elif len(text) < 2 or not REST.fullmatch(text, 1):
            yield None, 1
            return
    yield None, 0


class Summary:
    """What one split does to the depth, read as begun inside a string or outside."""

    def __init__(self, inside: bool):
        self.inside = self.ends_inside = inside
        self.depth = self.lowest = 0
        self.opens: dict[int, bool] = {}

    def add(self, piece: str) -> None:
        for sign, at in brackets(piece, self.ends_inside):
            if sign is None:
                self.ends_inside = bool(at)
            elif sign in "{[":
                # At one depth the first list of this name counts: the document's own is the only one at its depth.
                if sign == "[" and self.depth not in self.opens and KEY.search(piece, 0, at):
                    self.opens[self.depth] = False
                self.depth += 1
            else:
                self.depth -= 1
                self.lowest = min(self.lowest, self.depth)
                if self.depth in self.opens:
                    self.opens[self.depth] = True

    def row(self, path: str, block: int) -> dict:
        opens = [{"depth": d, "closed": c} for d, c in self.opens.items()]
        return {"path": path, "block": block, "inside": self.inside, "ends_inside": self.ends_inside, "deeper": self.depth, "lowest": self.lowest, "opens": opens}


def beginnings(summaries: Iterable[dict]) -> list[tuple[str, int, bool, int, bool, int]]:
    """(path, block, inside, depth, listed, owner) of each split, in order.

    `listed`: it begins within the list of features; `owner`: the split that the
    feature it begins within was begun in, else -1.
    """
    by = {(s["path"], s["block"], s["inside"]): s for s in summaries}
    out, path = [], None
    for p, block in sorted({(p, b) for p, b, _ in by}):
        if p != path:
            path, inside, depth, listed, owner = p, False, 0, False, -1
        out.append((p, block, inside, depth, listed, owner))
        s = by[p, block, inside]
        opened = {o["depth"]: o["closed"] for o in s["opens"]}
        begun = not listed and 1 - depth in opened
        renewed = begun or (listed and depth + s["lowest"] <= 2)
        listed = not opened[1 - depth] if begun else listed and depth + s["lowest"] > 1
        depth, inside = depth + s["deeper"], s["ends_inside"]
        owner = -1 if not listed or depth < 3 else block if renewed else owner
    return out


class Cutter:
    """Cuts the features of one split whose true beginning is known."""

    def __init__(self, path: str, block: int, inside: bool, depth: int, listed: bool, owner: int):
        self.path, self.block, self.inside, self.depth, self.listed, self.owner = path, block, inside, depth, listed, owner
        self.held: list[str] = []
        self.begun = owner < 0  # what is held began in this split
        self.part = 0

    def _row(self, whole: bool) -> dict:
        text, self.held = "".join(self.held), []
        self.part += 1
        return {"path": self.path, "owner": self.block if self.begun else self.owner, "block": self.block, "part": self.part, "whole": whole, "text": text}

    def add(self, piece: str) -> Iterator[dict]:
        start = 0 if self.listed and self.depth >= 3 else None
        for sign, at in brackets(piece, self.inside):
            if sign is None:
                self.inside = bool(at)
            elif sign in "{[":
                if sign == "[" and self.depth == 1 and KEY.search(piece, 0, at):
                    self.listed = True
                elif self.listed and self.depth == 2:
                    start = at
                self.depth += 1
            else:
                self.depth -= 1
                if self.listed and self.depth == 2 and start is not None:
                    self.held.append(piece[start : at + 1])
                    yield self._row(self.begun)
                    self.begun, start = True, None
                elif self.depth == 1:
                    self.listed = False
        if start is not None:
            self.held.append(piece[start:])

    def rest(self) -> Iterator[dict]:
        if self.held:
            yield self._row(False)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("value"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from streamweave.sources.geojson import SUMMARIES, Summary

    now, both = None, []
    for batch in batches:
        for p, b, value in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (p, b) != now:
                if both:
                    yield pa.RecordBatch.from_pylist([s.row(*now) for s in both], SUMMARIES)
                now, both = (p, b), [Summary(False), Summary(True)]
            for s in both:
                s.add(value)
    if both:
        yield pa.RecordBatch.from_pylist([s.row(*now) for s in both], SUMMARIES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from streamweave.sources.geojson import PIECES, Cutter

    now, cutter = None, None
    for batch in batches:
        out: list[dict] = []
        for p, b, value, known, *begin in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            if (p, b) != now:
                if known is None:
                    raise ValueError(f"{p} was split otherwise when it was summed up: keep spark.sql.files.* as it was")
                out += cutter.rest() if cutter else []
                now, cutter = (p, b), Cutter(p, b, *begin)
            out += cutter.add(value)
        yield pa.RecordBatch.from_pylist(out, PIECES)
    if cutter:
        yield pa.RecordBatch.from_pylist(list(cutter.rest()), PIECES)


SUMMARIES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("deeper", pa.int32()), ("lowest", pa.int32()), ("opens", pa.list_(pa.struct([("depth", pa.int32()), ("closed", pa.bool_())])))])
PIECES = pa.schema([("path", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the JSON of each feature of the documents at a path.

    A feature is held whole by one task; documents, and how many features they
    have, are of any size.  Documents without a list `features` have none, and what
    isn't an object in the list is left out.  A cut-off document gives its whole
    features and the rest of the last one, which no reader parses.
    """
    ship_package(spark)
    pieces = _pieces(spark, path)
    summaries = pieces.mapInArrow(_summed, SUMMARY).collect()  # two short rows a split
    begin = spark.createDataFrame(beginnings(r.asDict(recursive=True) for r in summaries), "path string, block long, inside boolean, depth int, listed boolean, owner long")
    begin = begin.select("path", "block", F.lit(True).alias("known"), "inside", "depth", "listed", "owner")
    told = pieces.join(F.broadcast(begin), ["path", "block"], "left")  # one row a split; the order of pieces stays
    cut = told.select("path", "block", "value", "known", "inside", "depth", "listed", "owner").mapInArrow(_cut, PIECE)
    parts = cut.where("not whole").groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("parts"))
    joined = parts.select("path", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return cut.where("whole").select("path", "text").unionByName(joined).where("text like '{%'")


def features(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>") -> DataFrame:
    """As `tables.geojson_features`, for documents of any size and form."""
    schema = f"properties struct<{properties}>, geometry struct<type:string,coordinates:{coordinates}>"
    parsed = feature_texts(spark, path).select(F.from_json("text", schema).alias("f"))
    return parsed.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
