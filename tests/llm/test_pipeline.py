"""The pipeline's stages, each on its own input and all together."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_simhash import jaccard

from streamweave.llm import decontamination

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, sf).cache()
    assert kept.columns == COLUMNS
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    assert kept.join(labels.where("quality = 1"), "doc_id", "left_semi").count() >= 0.97 * good
    assert kept.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 0.5 * labels.where("quality = 0").count() + 1

    one = corpus_pipeline.drop_near_duplicates(spark, kept, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    gone = [r for r in kept.collect() if r["doc_id"] not in texts]
    for r in gone:  # a copy stays for each that went
        assert any(jaccard(r["text"], t) >= 0.5 for t in texts.values())
    ids = sorted(texts)
    assert not any(jaccard(texts[a], texts[b]) >= 0.8 for i, a in enumerate(ids) for b in ids[:i])

    clean = corpus_pipeline.drop_benchmark_leaks(spark, one, sf).cache()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    for i, t in texts.items():
        verbatim = any(b" ".join(decontamination.words(x)) in b" ".join(decontamination.words(t)) for x in items)
        assert (i not in left) or not verbatim
    assert len(left) >= 0.8 * len(texts)

    redacted = corpus_pipeline.redact_personal_data(spark, clean, sf).cache()
    assert redacted.columns == COLUMNS and redacted.count() == clean.count()
    assert redacted.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9]+\.com")).count() == 0
    assert redacted.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.pack_sequences(spark, redacted, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_stages_take_odd_rows(spark, sf):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))
    rows = [(None, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (1, None, None, None, None), (2, "", "en", None, 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "write to a@b.co or c@d.org now", None, "s", 30), (5, " \t", "de", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("predicted", F.lit("x")).withColumn("Score", F.lit(1)).withColumn("leaks", F.lit(2)).withColumn("found", F.lit(3)).withColumn("component", F.lit(4))
    given = sorted(map(str, docs.select(*COLUMNS).collect()))
    scored = corpus_pipeline.quality_filter(spark, docs, sf)
    assert scored.columns == COLUMNS and set(map(str, scored.collect())) <= set(given)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert one.columns == COLUMNS and sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 3, 4]
    leaks = corpus_pipeline.drop_benchmark_leaks(spark, docs, sf)
    assert leaks.columns == COLUMNS and sorted(map(str, leaks.collect())) == given
    private = corpus_pipeline.redact_personal_data(spark, docs, sf)
    assert private.columns == COLUMNS and private.count() == len(rows)
    assert [tuple(r) for r in private.where("doc_id = 4").collect()] == [(4, "write to <EMAIL> or <EMAIL> now", None, "s", 31)]
    assert private.where("text is null").count() == 1
    packed = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert packed.where("piece = 0").count() == len(rows)


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
