"""Document fingerprints by consistent weighted sampling (operator 9), all native.

Terms are the words of a text, weighted by how often they occur.  For each of K
samples a term's hash gives r, c ~ Gamma(2, 1) and beta ~ U(0, 1); with weight w

    t = floor(ln w / r + beta),   ln a = ln c - r (t - beta) - r,

and the sample is the (term, t) with the smallest ln a.  Two texts agree on a
sample with a probability equal to the generalised Jaccard similarity of their
weighted terms (sum of smaller weights over sum of larger ones).

Everything is DataFrame functions.  A sample is carried as one long: the
quantised ln a in the high bits, a hash of (term, t) in the low 28 bits, so that
the smallest is a plain `min` that hash aggregation does without sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamweave.llm.common import parts, table

SAMPLES = 24
LOW = 28
#: ln a is kept to 2**-26 between -64 and 64.
FINE, SPAN = 1 << 26, 64.0
#: Runs of neighbouring ids at most (tasks of the job; longer runs spill, nothing is left out).
MOST_RUNS = 16_384
#: ASCII white space between words.
SPACE = "[\\x20\\x09-\\x0D]+"


def _uniform(bits: Column, first: int) -> Column:
    """(0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(bits, first).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 21))


def sample_parameters(term: Column, k: int) -> tuple[Column, Column, Column, Column]:
    """r, ln c, beta and a hash of a term for sample k: a function of its own hash alone."""
    one, two = (F.xxhash64(term, F.lit(2 * k + j)) for j in range(2))
    r = -F.ln(_uniform(one, 0) * _uniform(one, 21))
    ln_c = F.ln(-F.ln(_uniform(two, 0) * _uniform(two, 21)))
    return r, ln_c, _uniform(one, 42), two


def packed_sample(ln_w: Column, r: Column, ln_c: Column, beta: Column, own: Column) -> Column:
    t = F.floor(ln_w / r + beta)
    ln_a = F.least(F.greatest(ln_c - r * (t - beta) - r, F.lit(-SPAN)), F.lit(SPAN - 1))
    quantised = ((ln_a + F.lit(SPAN)) * F.lit(float(FINE))).cast("long")
    # t is mixed into the term's bits by exclusive or: another t of the term is another value.
    value = F.shiftleft(quantised, LOW).bitwiseOR(F.shiftrightunsigned(own, 36).bitwiseXOR(t).bitwiseAND(F.lit((1 << LOW) - 1)))
    return F.when(ln_w.isNotNull(), value)


def bounds_of(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """Ids that start n nearly equal runs of the documents by ascending id.

    The rank error is a quarter of a run, so the quantile sketch and what reaches
    the driver have a size in proportion to n, whatever the number of documents.
    """
    marks = docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", [i / n for i in range(n)], 0.25 / n)
    rough = sorted({int(m) for m in marks})
    # The ids that really come first (doubles can't tell very large ids apart): a row per run.
    runs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), run_of(F.col(id_col), rough).alias("run"))
    exact = runs.groupBy("run").agg(F.min("id").alias("first"))
    return sorted(r["first"] for r in exact.collect())


def run_of(id_col: Column, bounds: list[int]) -> Column:
    """The run an id belongs to, by a two-level search of the bounds."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b).cast("long") for b in bounds[::width]])
    rows = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + width]]) for i in range(0, len(bounds), width)])
    below = lambda values: F.size(F.filter(values, lambda b: b <= id_col))
    row = F.greatest(below(heads) - 1, F.lit(0))
    return (row * width + F.greatest(below(F.get(rows, row)) - 1, F.lit(0))).cast("int")


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """(run, last, doc_id, text, next_text): each document with the one after it.

    Documents are dealt to runs of neighbouring ids.  Each run also gets a copy
    of the row that follows its last one (`last` is true there), so no window
    spans more than a run.  After the last document comes the first.
    """
    bounds = bounds_of(docs, "doc_id", n)
    own = docs.withColumn("run", run_of(F.col("doc_id"), bounds)).withColumn("last", F.lit(False))
    # A bound is an id of the table, so the row after run i starts run i + 1.
    starts = docs.where(F.col("doc_id").isin(bounds)) if bounds else docs.limit(0)
    one = starts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    before = F.pmod(run_of(F.col("doc_id"), bounds) - 1, F.lit(max(1, len(bounds)))).cast("int")
    borrowed = one.select("doc_id", "text", before.alias("run"), F.lit(True).alias("last"))
    order = Window.partitionBy("run").orderBy("last", "doc_id", "text")
    both = own.select("doc_id", "text", "run", "last").unionByName(borrowed).repartition(n, "run")
    return both.withColumn("next_text", F.lead("text").over(order)).withColumn("row", F.row_number().over(order))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint each text and its edited text, and compare neighbours.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by ascending id.  Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; the last two are the share of equal samples.

    Null texts count as empty; texts without words have the fingerprint of no
    terms (all samples `f...f`), alike only to each other.  Rows with a null id
    sort first, but what follows the last document is the first id that isn't
    null (nothing, if there is none).  Rows of equal id are ordered by text, each with its own row;
    where such rows meet a run's border the smallest text counts as the next.
    Extra columns are left out.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    n = min(4 * parts(spark), MOST_RUNS)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(docs, n)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    texts = pairs.withColumn("edited", F.when(~F.col("last"), edited))
    # One row per word; the side says which text it stands in.  What else is known of
    # the document rides along as a few "words" of a third side, `kind:value`, so the
    # texts are shuffled and sorted once.  The rows of a run stay where the run is:
    # none of the groupings below shuffles.
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    facts = [F.col("doc_id"), F.length("text").cast("long"), F.col("last").cast("int"), *[F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10) for i in range(4)]]
    told = F.concat_ws(" ", *[F.concat(F.lit(f"{i}:"), v.cast("string")) for i, v in enumerate(facts, 1)])
    side = lambda i, t: F.struct(F.lit(i).alias("side"), t.alias("t"))
    sides = texts.select("run", "row", F.explode(F.array(side(0, F.col("text")), side(1, F.col("edited")), side(2, told))).alias("s"))
    terms = sides.select("run", "row", "s.side", F.explode(F.split("s.t", SPACE)).alias("word")).where("word <> ''")
    fact = F.col("side") == 2
    kind = F.when(fact, F.substring_index("word", ":", 1).cast("int")).otherwise(F.lit(0))
    w0 = F.when(fact, F.substring_index("word", ":", -1).cast("long")).otherwise(F.when(F.col("side") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    w1 = F.when(F.col("side") == 1, F.lit(1)).otherwise(F.lit(0)).cast("long")
    weights = terms.groupBy("run", "row", kind.alias("kind"), F.xxhash64("word").alias("term")).agg(F.sum(w0).alias("w0"), F.sum(w1).alias("w1"))
    of_word = lambda w: F.when((F.col("kind") == 0) & (F.col(w) > 0), F.ln(w))
    logs = weights.select("run", "row", "kind", "w0", "term", of_word("w0").alias("l0"), of_word("w1").alias("l1"))
    least = []
    for k in range(samples):
        r, ln_c, beta, own = sample_parameters(F.col("term"), k)
        for i in (0, 1):
            least.append(F.min(packed_sample(F.col(f"l{i}"), r, ln_c, beta, own)).alias(f"m{i}_{k}"))
    known = [F.max(F.when(F.col("kind") == i, F.col("w0"))).alias(c) for i, c in enumerate(("doc_id", "n_chars", "last", "s0", "s1", "s2", "s3"), 1)]
    mins = logs.groupBy("run", "row").agg(*known, *least)
    mask = F.lit((1 << LOW) - 1)
    sample = lambda c: F.coalesce(F.col(c).bitwiseAND(mask), F.lit(-1))
    joined = mins.select(
        "run",
        "row",
        (F.col("last") == 1).alias("last"),
        "doc_id",
        "n_chars",
        F.concat(*[F.lower(F.lpad(F.hex(f"s{i}"), 16, "0")) for i in range(4)]).alias("edited_sha256"),
        F.array(*[sample(f"m0_{k}") for k in range(samples)]).alias("own"),
        F.array(*[sample(f"m1_{k}") for k in range(samples)]).alias("other"),
    )
    following = F.lead("own").over(Window.partitionBy("run").orderBy("row"))
    equal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(samples))
    alike = lambda a, b: F.when(b.isNotNull(), equal(a, b)).otherwise(F.lit(0.0))
    shown = lambda a: F.concat_ws("", F.transform(a, lambda x: F.when(x < 0, F.lit("f" * 8)).otherwise(F.lower(F.lpad(F.hex(x), 8, "0")))))
    return (
        joined.withColumn("next", following)
        .where(~F.col("last"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            shown(F.col("own")).alias("fingerprint"),
            shown(F.col("other")).alias("edited_fingerprint"),
            alike(F.col("own"), F.col("other")).alias("near_edited"),
            alike(F.col("own"), F.col("next")).alias("near_next"),
        )
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
