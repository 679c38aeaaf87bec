"""Writers: Parquet, CSV, JSON documents, GeoJSON, and embedding into a page."""

from __future__ import annotations

import base64
import gzip
import re
import zlib
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamweave.functions.shipping import ship_package
from streamweave.operators.ranking import numbered


def parquet(df: DataFrame, path: str, codec: str = "zstd", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("error").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", "true").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """A compact JSON object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("error").text(path)


def geojson_lines(df: DataFrame, path: str, coordinates: str, geometry_type: str = "LineString") -> None:
    """A GeoJSON feature per row, line by line (newline-delimited GeoJSON)."""
    df.select(F.to_json(_feature(df, coordinates, geometry_type)).alias("value")).write.mode("error").text(path)


def _feature(df: DataFrame, coordinates: str, geometry_type: str) -> Column:
    properties = F.struct(*[c for c in df.columns if c != coordinates])
    geometry = F.struct(F.lit(geometry_type).alias("type"), F.col(coordinates).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))


def geojson_collections(df: DataFrame, path: str, coordinates: str, geometry_type: str = "LineString") -> None:
    """A complete FeatureCollection per output file, written by the tasks in parallel."""
    feature = F.to_json(_feature(df, coordinates, geometry_type)).alias("value")

    def documents(batches):
        head, before = '{"type":"FeatureCollection","features":[', ""
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(head + before + text)
                head, before = "", ","
            if lines:
                yield pa.RecordBatch.from_pydict({"value": lines})
        yield pa.RecordBatch.from_pydict({"value": [head + "]}"]})

    df.select(feature).mapInArrow(documents, "value string").write.mode("error").text(path)


def new_version(df: DataFrame, columns: dict, path: str) -> None:
    """Add or replace columns and write a new version; the input is never overwritten."""
    df.withColumns(columns).write.mode("error").parquet(path)


def embed(template: str, **documents: str | None) -> str:
    """Put gzip + base64 documents at their markers (`{{name}}`); absent ones are left empty."""
    for name, text in documents.items():
        packed = base64.b64encode(gzip.compress(text.encode(), 9, mtime=0)).decode() if text is not None else ""
        template = template.replace("{{" + name + "}}", packed)
    return template


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose length is a multiple of three, so that base64 texts of members can be joined.

    The name that its header may hold fills it up.
    """
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x08" + bytes(4) + b"\x02\xff"  # deflate, a name follows, no time
    name = b"-" * (-(len(head) + 1 + len(body)) % 3) + b"\0"
    return head + name + body


def packed_pieces(rows: DataFrame, *order: str, value: str = "value", size: int = 1 << 20) -> DataFrame:
    """(piece, text): a JSON array of the texts in `value`, in a total order, as base64 of gzip members.

    The tasks compress, a member for about `size` characters; in the order of their numbers
    the pieces' texts are one base64 text of one gzip file.  No rows give no pieces.
    """
    ship_package(rows.sparkSession)
    ranked = numbered(rows, *order, name="__nth", total="__total").select("__nth", "__total", F.col(value).alias("v"))
    ordered = ranked.repartitionByRange("__nth").sortWithinPartitions("__nth")

    def pack(batches):
        from streamweave.sources.sinks import gzip_member

        first, held, length = None, [], 0
        made = lambda: pa.RecordBatch.from_pydict({"piece": pa.array([first], pa.int64()), "text": [base64.b64encode(gzip_member("".join(held).encode())).decode()]})
        for batch in batches:
            for rank, total, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = rank if first is None else first
                held.append(("," if rank else "[") + (text or "null") + ("]" if rank + 1 == total else ""))
                length += len(held[-1])
                if length >= size:
                    yield made()
                    first, held, length = None, [], 0
        if held:
            yield made()

    return ordered.mapInArrow(pack, "piece long, text string")


def write_page(template: str, out: TextIO, **layers: DataFrame | str | None) -> None:
    """Write the template with each marker (`{{name}}`) replaced: by the pieces of a layer, a text, or nothing.

    Pieces come to the driver one partition at a time and go straight to the page.
    """
    for i, part in enumerate(re.split(r"\{\{(\w+)\}\}", template)):
        if i % 2 == 0:
            out.write(part)
        elif part not in layers:
            out.write("{{" + part + "}}")
        elif isinstance(layers[part], str):
            out.write(layers[part])
        elif layers[part] is not None:
            for row in layers[part].orderBy("piece").toLocalIterator():
                out.write(row["text"])
