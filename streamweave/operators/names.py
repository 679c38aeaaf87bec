"""Search of names by parts of them: an index of grams of some lengths.

The index is built once and written below the shared folder: each different folded
name once, a posting for each gram that it holds, and how many names hold each gram.
Postings lie in PARTS folders by their gram and in order of gram, so a search reads
only those of its own grams, of the greatest length that it has, and of these only the RAREST: names that hold them all
are candidates, and the exact test follows, so the answer is the scan's.  A search as long as a gram is read as
one, so its postings are its hits: the more a search tells, the fewer it reads.

Names that differ only in case or accents share an entry.  Null names are no entry,
the empty name is one that nothing finds.  Searches are trimmed; null ones and
those shorter than two letters find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamweave.functions.scalar import bound, without_accents
from streamweave.operators.lineage import Tables

#: Folders of the postings; parts that a gram's postings are spread over when written.
PARTS, SPREAD = 64, 8
#: Lengths of grams, ascending from the shortest search that finds something.
LENGTHS = (2, 3, 4, 8, 16)
#: Grams of a search whose postings are read.
RAREST = 3
#: Grams of all searches together up to which they are sent to the postings; more are joined by a shuffle.
SENT = 100_000


def folded(name: Column) -> Column:
    return F.lower(without_accents(name))


def grams(text: Column) -> Column:
    """Each run of LENGTHS letters that a text holds, once."""
    def runs(t: Column, n: int) -> Column:
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))

    return bound(text, lambda t: F.array_distinct(F.concat(*[runs(t, n) for n in LENGTHS])))


def asked(text: Column) -> Column:
    """The grams that a search needs: those of the greatest length that it has."""
    longest = lambda t: F.coalesce(*[F.when(F.length(t) >= n, n) for n in LENGTHS[::-1]])
    return bound(text, lambda t: F.filter(grams(t), lambda g: F.length(g) == longest(t)))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


@dataclass
class NameIndex:
    """`rows` (entry, all columns), `names` (entry, folded), `postings` (part, gram, entry), `counts` (gram, n)."""

    tables: Tables
    rows: DataFrame
    names: DataFrame
    postings: DataFrame
    counts: DataFrame

    def drop(self) -> None:
        self.tables.drop_all_but()


def build(rows: DataFrame, name: str) -> NameIndex:
    """Index the names of a table; `entry` is a hash of the folded name, two names that share one are told apart by the exact test."""
    tables = Tables(rows.sparkSession)
    kept = tables.write(rows.where(F.col(name).isNotNull()).withColumn("__folded", folded(F.col(name))).withColumn("__entry", F.xxhash64("__folded")))
    names = tables.write(kept.select(F.col("__entry").alias("entry"), F.col("__folded").alias("folded")).distinct())
    # Two entries of one hash are one posting; which of them is meant the exact test decides.
    held = names.select("entry", F.explode(grams(F.col("folded"))).alias("gram")).withColumn("part", _part(F.col("gram")))
    spread = held.repartition("part", F.pmod("entry", F.lit(SPREAD))).sortWithinPartitions("part", "gram")
    postings = tables.write(spread, "part")
    counts = tables.write(postings.groupBy("gram").agg(F.count("*").alias("n")))
    return NameIndex(tables, kept, names, postings, counts)


def needed(index: NameIndex, searches: DataFrame, search: str) -> DataFrame:
    """(search, wanted, gram, n, need): the rarest grams of each search, the postings of which are read.

    A search that asks for a gram which no name holds is left out.
    """
    wanted = searches.select(F.col(search).alias("search")).where("search is not null").distinct().withColumn("wanted", folded(F.trim("search"))).where("length(wanted) >= 2")
    each = wanted.withColumn("__grams", asked(F.col("wanted"))).select("search", "wanted", F.size("__grams").alias("asked"), F.explode("__grams").alias("gram"))
    known = each.join(index.counts, "gram")
    least = F.row_number().over(Window.partitionBy("search").orderBy("n", "gram"))
    all_known = F.count("*").over(Window.partitionBy("search")) == F.col("asked")
    ranked = known.withColumns({"__nth": least, "__all": all_known}).where(F.col("__all") & (F.col("__nth") <= RAREST))
    return ranked.select("search", "wanted", "gram", "n", F.least("asked", F.lit(RAREST)).alias("need"))


def search_all(index: NameIndex, searches: DataFrame, search: str) -> DataFrame:
    """(search, the rows' columns): every row whose name holds the search, for a table of searches of any size."""
    chosen = index.tables.write(needed(index, searches, search))
    few = chosen.count() <= SENT
    wanted = chosen.select("search", "wanted").distinct()
    keys = chosen.select("search", "gram", "need", _part(F.col("gram")).alias("part"))
    met = index.postings.join(F.broadcast(keys) if few else keys, ["part", "gram"])
    candidates = met.groupBy("search", "entry").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("search", "entry")
    tested = candidates.join(index.names, "entry").join(wanted, "search").where(F.contains("folded", "wanted"))
    found = tested.select("search", F.col("entry").alias("__entry"), F.col("folded").alias("__folded"))
    return found.join(index.rows, ["__entry", "__folded"]).drop("__entry", "__folded")


def lookup(index: NameIndex, wanted: str) -> DataFrame:
    """Rows whose name holds one search: the filters on folder and gram reach the scan of the postings."""
    spark = index.rows.sparkSession
    one = needed(index, spark.createDataFrame([(wanted,)], "search string"), "search").collect()  # at most RAREST rows
    if not one:
        return index.rows.limit(0).drop("__entry", "__folded")
    keys = [r["gram"] for r in one]
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in keys], "gram string").select(_part(F.col("gram"))).collect()]
    read = index.postings.where(F.col("part").isin(parts) & F.col("gram").isin(keys))
    candidates = read.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") == len(keys)).select(F.col("entry").alias("__entry"))
    return index.rows.join(candidates, "__entry", "left_semi").where(F.contains("__folded", F.lit(one[0]["wanted"]))).drop("__entry", "__folded")
