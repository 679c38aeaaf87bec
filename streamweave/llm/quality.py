"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm.common import arrow_udf, crc_mod, drop_clashing, fresh, hash_share, table

#: Labelled rows that are learned from, at most about.
TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 3, 32, 0.2, 10, 1.0
THRESHOLD = 0.3

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        (_BYTES >= 128),
        np.isin(_BYTES, [9, 10, 11, 12, 13, 32]),
        np.isin(_BYTES, [10, 13]),
        np.isin(_BYTES, list(b".,;:'\"()-?")),
        np.isin(_BYTES, list(b"!")),
        np.isin(_BYTES, list(b"#$%&*+=@^~")),
        np.isin(_BYTES, list(b"<>[]{}|/\\_`")),
    ]
).astype(np.float64)
FEATURES = 10 + 14


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one text; an empty one has zeros."""
    out = np.zeros(FEATURES)
    raw = text.encode("utf-8", "replace") if text else b""
    if not raw:
        return out
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out[:10] = _CLASSES @ histogram / n
    shares = histogram[histogram > 0] / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = histogram[46] + histogram[33] + histogram[63]
    w = max(1, len(words))
    distinct = set(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    longest = max(map(len, words), default=0)
    letters = out[0] + out[1] + out[3]
    out[10:] = (
        np.log1p(n),
        np.log1p(len(words)),
        n / w,
        len(distinct) / w,
        pairs / max(1, len(words) - 1),
        longest,
        np.log1p(len(lines)),
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        len(words) / (1.0 + sentences),
        -(shares * np.log2(shares)).sum(),
        out[0] / (letters + 1e-9),
        histogram[124] / w,
        histogram[33] / w,
    )
    return out


def statistics_of(texts: list[str | None]) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, FEATURES))


class BoostedTrees:
    """Binary classifier; all trees are complete and flattened into arrays."""

    def __init__(self, prior: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.prior, self.feature, self.threshold, self.value = prior, feature, threshold, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Second-order boosting of the logistic loss on quantile-binned features."""
        n, m = x.shape
        rate = (y.sum() + 1.0) / (n + 2.0)
        prior = float(np.log(rate / (1 - rate)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if m else np.zeros((n, 0), int)
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        feature = np.zeros((TREES, inner), np.int64)
        threshold = np.full((TREES, inner), np.inf)
        value = np.zeros((TREES, leaves))
        margin = np.full(n, prior)
        for t in range(TREES if n else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for depth in range(DEPTH):
                first, width = (1 << depth) - 1, 1 << depth
                best = np.full(width, 1e-9)
                split_bin = np.full(width, BINS)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = node * (BINS + 1) + binned[:, j]
                    shape = (width, BINS + 1)
                    sums = [np.bincount(key, v, width * (BINS + 1)).reshape(shape).cumsum(axis=1) for v in (g, h, np.ones(n))]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    ga, ha, na = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                    gain[(nl < LEAST) | (na - nl < LEAST)] = 0
                    gain[:, len(c) :] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for k in np.nonzero(top > best)[0]:
                        best[k], split_bin[k] = top[k], at[k]
                        feature[t, first + k], threshold[t, first + k] = j, c[at[k]]
                chosen = feature[t, first + node]
                node = 2 * node + (binned[np.arange(n), chosen] > split_bin[node])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            value[t] = -RATE * gs / (hs + RIDGE)
            margin += value[t, node]
        return cls(prior, feature, threshold, value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; every tree is walked for all rows at once."""
        margin = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> BoostedTrees:
    """Fit on a bounded sample of labelled documents, drawn by the hash of id and text.

    `learn` says (over the id column) which rows may be learned from.  About
    `rows` rows at most are drawn whatever the number of labels or of documents
    with one id; their statistics, not their texts, come to the driver.  Equal
    rows count once; an id with several labels has the largest.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull())
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    share = hash_share("__id", F.lit(6))
    n = known.count()
    drawn = known.where(share * F.lit(n) < rows)  # a fixed bound, so it may be broadcast

    def features(batches):
        for texts in batches:
            x = statistics_of(texts.to_pylist())
            yield pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), pa.array(x.ravel()))

    udf = arrow_udf(docs.sparkSession, features, "array<double>")
    found = docs.where(learn).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(drawn), F.col("__doc") == F.col("__id"))
    found = found.withColumn("__hash", F.xxhash64("__doc", F.coalesce("__text", F.lit(""))))
    # Ids may repeat: thin by row as well, so that what is drawn stays bounded.
    m = found.agg(F.approx_count_distinct("__hash")).first()[0]
    thin = found.where(hash_share("__hash") * F.lit(m) < rows).select("__hash", "__y", udf(F.col("__text")).alias("x"))
    got = thin.dropDuplicates(["__hash"]).toPandas().sort_values("__hash", kind="stable")
    x = np.stack(got["x"].to_numpy()).astype(float) if len(got) else np.zeros((0, FEATURES))
    return BoostedTrees.fit(x, (got["__y"].to_numpy(float) > 0).astype(float))


def score(df: DataFrame, model: BoostedTrees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts have the statistics zero and are scored like any
    other; if nothing was learned every score is 0.5.  Columns of the two names
    are replaced.  A map-only job; the model is a few kilobytes.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.prior, model.feature, model.threshold, model.value))

    def scores(batches):
        trees = BoostedTrees(*shared.value)
        for texts in batches:
            yield pa.array(trees.scores(statistics_of(texts.to_pylist())), pa.float64())

    udf = arrow_udf(df.sparkSession, scores, "double")
    (text,) = fresh(df, "text")
    kept = drop_clashing(df.withColumn(text, F.col(text_col)), ["score", "predicted"])
    return kept.withColumn("score", udf(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(text)


def not_held_out(id_col):
    return F.coalesce(crc_mod(id_col, 5) != 0, F.lit(False))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), not_held_out(F.col("doc_id")))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
