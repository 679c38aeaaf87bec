"""Readers, writers and the streaming append, with temporary files."""

import json

from pyspark.sql import functions as F

from streamweave.sources import paged, sinks, tables
from streamweave.streaming import append


def test_csv_json_geojson_xml(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,value\n1,2.5\n2,NULL\n3,x\n")
    assert [r["value"] for r in tables.csv(spark, str(tmp_path / "a.csv"), "code int, value double").orderBy("code").collect()] == [2.5, None, None]
    doc = {"type": "FeatureCollection", "features": [{"properties": {"id": 7}, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    row = tables.geojson_features(spark, str(tmp_path / "g.json"), "id: long").first()
    assert row["id"] == 7 and row["coordinates"] == [[0.0, 1.0], [2.0, 3.0]]
    (tmp_path / "x.xml").write_text("<all><row><a>1</a></row><row><a>2</a></row></all>")
    assert tables.xml_rows(spark, str(tmp_path / "x.xml"), "row", "a int").count() == 2
    assert tables.optional(spark, str(tmp_path / "none.parquet"), "a int").count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    sinks.parquet(df, str(tmp_path / "p"))
    assert tables.lake(spark, str(tmp_path / "p")).count() == 2
    assert tables.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "p")).count() == 2
    sinks.csv(df, str(tmp_path / "c"))
    sinks.json_lines(df, str(tmp_path / "j"))
    assert tables.ndjson(spark, str(tmp_path / "j"), "id int, name string").orderBy("id").collect() == df.collect()
    sinks.new_version(df, {"twice": F.col("id") * 2}, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).agg(F.sum("twice")).first()[0] == 6
    assert "{{x}}" not in sinks.embed("<p>{{x}}{{y}}</p>", x="hello", y=None)


def _fetch(offset, size):
    return [{"id": i, "name": f"n{i}"} for i in range(offset, offset + size)]


def test_paged_source(spark):
    df = paged.read_pages(spark, lambda offset, size: [{"id": i, "name": f"n{i}"} for i in range(offset, offset + size)], 25, 10, "id int, name string")
    assert df.count() == 25 and df.where("id = 24").first()["name"] == "n24"
    calls = []

    def fails_once(offset, size):
        calls.append(offset)
        if len(calls) == 1:
            raise OSError("again")
        return _fetch(offset, size)

    assert len(paged.fetch_with_retry(fails_once, 0, 3, 3, 0.0)) == 3


def test_streaming_append(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (2,), (3,)], "code int").write.json(str(tmp_path / "in"))
    known = spark.createDataFrame([(1,)], "code int")
    stream = spark.readStream.schema("code int").json(str(tmp_path / "in"))
    append.start(append.append_new(stream, known, "code"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_a_page_of_parallel_pieces(spark):
    import base64
    import gzip
    import io

    rows = spark.range(5_000).select("id", F.to_json(F.struct("id", F.sha2(F.col("id").cast("string"), 256).alias("name"))).alias("value"))
    pieces = sinks.packed_pieces(rows.repartition(3), "id", size=20_000)
    assert pieces.count() > 10 and pieces.where("length(text) % 4 <> 0 or text like '%=%'").count() == 0
    page = io.StringIO()
    sinks.write_page("<a>{{layer}}</a><b>{{none}}</b><c>{{font}}</c>{{other}}", page, layer=pieces, none=None, font="F")
    text = page.getvalue()
    assert text.startswith("<a>") and text.endswith("</a><b></b><c>F</c>{{other}}")
    packed = text[3 : text.index("</a>")]
    held = json.loads(gzip.decompress(base64.b64decode(packed, validate=True)))
    assert [r["id"] for r in held] == list(range(5_000)) and held == [json.loads(r["value"]) for r in rows.orderBy("id").collect()]
    assert sinks.packed_pieces(rows.limit(0), "id").count() == 0
    assert all(len(sinks.gzip_member(b"x" * n)) % 3 == 0 and gzip.decompress(sinks.gzip_member(b"x" * n)) == b"x" * n for n in range(9))
