"""Minimizers of sequences, and minimizer lists of contigs as an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .reads import spread


def of_sequences(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(read_id, mate, p, kmer): the least k-mer, by its MD5, of each window of w neighbouring k-mers; the first one at
    ties. A sequence with fewer than w k-mers is one window. k-mers with N take part in no window's minimum."""
    r = spread(reads).select("read_id", "mate", S.kmers(F.col("seq"), k).alias("km"))
    r = r.withColumn("n", F.size("km")).filter("n > 0")
    marked = F.transform("km", lambda x, i: F.when(S.is_acgt(x), F.struct(F.md5(x).alias("h"), (i + 1).alias("p"), x.alias("kmer"))))
    r = r.withColumn("marked", marked)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - w + 1)), lambda i: F.array_min(F.slice("marked", i, w)))
    r = r.select("read_id", "mate", F.explode(F.array_distinct(windows)).alias("m")).filter("m is not null")
    return r.select("read_id", "mate", F.col("m.p").alias("p"), F.col("m.kmer").alias("kmer"))


def index(entries: DataFrame) -> DataFrame:
    """(mm, edge, p, n): each minimizer with its first place (least edge, then position) and how many places it has.
    ``entries`` has edge, p, mm; rows without position or mm are none, repeated rows count once."""
    e = entries.filter("p is not null and mm is not null").select("edge", "p", "mm").dropDuplicates()
    e = e.groupBy("mm").agg(F.min(F.struct("edge", "p")).alias("f"), F.count(F.lit(1)).alias("n"))
    return e.select("mm", F.col("f.edge").alias("edge"), F.col("f.p").alias("p"), "n")


def index_stats(entries: DataFrame) -> DataFrame:
    """(singles, repeated): minimizers with one place and with more."""
    return index(entries).agg(F.count(F.when(F.col("n") == 1, 1)).alias("singles"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))


def leading_hits(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, edge, hits): matches of each query list up to its first minimizer that is absent from the index or has
    several places there; later entries of the list count no more. Ordered by position, then mm."""
    idx = index(entries).select("mm", F.col("edge").alias("hit"), F.col("n").alias("places"))
    q = queries.filter("p is not null and mm is not null").select(F.col("edge").alias("query"), "p", "mm").dropDuplicates()
    q = q.join(idx, "mm", "left").withColumn("good", F.coalesce(F.col("places") == 1, F.lit(False)))
    run = Window.partitionBy("query").orderBy("p", "mm").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("run", F.min("good").over(run)).filter("run")
    return q.groupBy("query", F.col("hit").alias("edge")).agg(F.count(F.lit(1)).alias("hits"))


def best_edges(queries: DataFrame, entries: DataFrame, least: int = 2) -> DataFrame:
    """(query, edge, hits): the edge that shares most single-place minimizers with a query list; a query whose maximum
    isn't unique or is below ``least`` is dropped."""
    idx = index(entries).filter("n = 1").select("mm", "edge")
    q = queries.filter("p is not null and mm is not null").select(F.col("edge").alias("query"), "p", "mm").dropDuplicates()
    h = q.join(idx, "mm").groupBy("query", "edge").agg(F.count(F.lit(1)).alias("hits"))
    top = h.groupBy("query").agg(F.max("hits").alias("hits"))
    best = h.join(top, ["query", "hits"]).groupBy("query", "hits").agg(F.min("edge").alias("edge"), F.count(F.lit(1)).alias("ties"))
    return best.filter((F.col("ties") == 1) & (F.col("hits") >= least)).select("query", "edge", "hits")


def runs(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, edge, start, stop, n): unbroken runs of neighbouring entries of a list that hit the same edge."""
    idx = index(entries).filter("n = 1").select("mm", F.col("edge").alias("hit"))
    q = queries.filter("p is not null and mm is not null").select(F.col("edge").alias("query"), "p", "mm").dropDuplicates().join(idx, "mm", "left")
    order = Window.partitionBy("query").orderBy("p", "mm")
    q = q.withColumn("new", (~F.col("hit").eqNullSafe(F.lag("hit").over(order))).cast("int"))
    q = q.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    q = q.filter("hit is not null").groupBy("query", "run", F.col("hit").alias("edge"))
    return q.agg(F.min("p").alias("start"), F.max("p").alias("stop"), F.count(F.lit(1)).alias("n")).drop("run")
