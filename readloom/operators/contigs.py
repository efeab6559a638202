"""Measures of contigs: lengths with holes, coverage, length classes, N50."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = {"global": 45, "local": 31}
LONG, SHORT, MIN_COVERAGE, HEAD = 4000, 100, 0.15, 5000


def distinct(contigs: DataFrame) -> DataFrame:
    """Contigs without repeated loads."""
    return contigs.dropDuplicates()


def hole_sum() -> Column:
    return F.aggregate("holes", F.lit(0), lambda a, h: a + h["len"])


def lengths(contigs: DataFrame) -> DataFrame:
    """(edge_id, full_len, head_hole): length with all holes, and hole bases of holes that start within the first 5000.
    A null hole list has no holes."""
    c = distinct(contigs.select("edge_id", "seq_len", "holes"))
    head = F.aggregate("holes", F.lit(0), lambda a, h: a + F.when(h["pos"] < HEAD, h["len"]).otherwise(0))
    return c.select("edge_id", (F.col("seq_len") + F.coalesce(hole_sum(), F.lit(0))).alias("full_len"), F.coalesce(head, F.lit(0)).alias("head_hole"))


def with_coverage(contigs: DataFrame) -> DataFrame:
    """Distinct contigs with k, cov and full_len; cov is null where cnt is null or no k-mer fits beside the holes."""
    k = F.when(F.col("graph") == "global", K["global"]).otherwise(K["local"])
    n_holes = F.coalesce(F.size("holes"), F.lit(0))
    room = F.col("seq_len") - (n_holes + 1) * k
    cov = F.when((room > 0), F.col("cnt") / room)
    return distinct(contigs).withColumn("k", k).withColumn("cov", cov).withColumn("full_len", F.col("seq_len") + F.coalesce(hole_sum(), F.lit(0)))


def coverage(contigs: DataFrame) -> DataFrame:
    return with_coverage(contigs).select("edge_id", F.round("cov", 6).alias("cov"))


def units(contigs: DataFrame, least: int = 1000) -> DataFrame:
    """(graph, longest_cov, mean_cov): the coverage of the longest contig, the least id at ties, and the mean of
    floor(coverage) weighted by length over full lengths of ``least`` or more. Contigs without coverage take no part."""
    c = with_coverage(contigs).filter("cov is not null")
    far = F.col("full_len") >= least
    cov = F.floor("cov")
    mean = F.sum(F.when(far, F.col("seq_len") * cov)) / F.sum(F.when(far, F.col("seq_len")))
    return c.groupBy("graph").agg(F.round(F.max_by("cov", F.struct("seq_len", -F.col("edge_id"))), 6).alias("longest_cov"), F.round(mean, 6).alias("mean_cov"))


def copy_range(ratio: Column) -> Column:
    """Copies that a coverage ratio may stand for: (i, i) below a fraction of .25, (i, i + 1) up to .75, else (i + 1, i + 1)."""
    whole = F.floor(ratio)
    part = ratio - whole
    return F.struct((whole + F.when(part > 0.75, 1).otherwise(0)).alias("low"), (whole + F.when(part >= 0.25, 1).otherwise(0)).alias("high"))


def copies(contigs: DataFrame) -> DataFrame:
    """(edge_id, low, high): the range of copy numbers by coverage over the unit coverage of the contig's graph."""
    unit = units(contigs).select("graph", F.col("longest_cov").alias("unit"))  # one row per graph
    c = with_coverage(contigs).filter("cov is not null").join(F.broadcast(unit), "graph")
    return c.withColumn("r", copy_range(F.col("cov") / F.col("unit"))).select("edge_id", "r.low", "r.high")


def classes(contigs: DataFrame) -> DataFrame:
    """(edge_id, size_class, keep, is_repeat): long, short or tiny; keep is false where coverage is below 0.15 of the
    unit, is_repeat true above 1.2 of it; both null without coverage."""
    unit = units(contigs).select("graph", F.col("longest_cov").alias("unit"))
    c = with_coverage(contigs).join(F.broadcast(unit), "graph", "left")
    size = F.when(F.col("seq_len") >= LONG, "long").when(F.col("seq_len") >= SHORT, "short").otherwise("tiny")
    return c.select("edge_id", size.alias("size_class"), (F.col("cov") >= MIN_COVERAGE * F.col("unit")).alias("keep"), (F.col("cov") > 1.2 * F.col("unit")).alias("is_repeat"))


def n50(contigs: DataFrame, width: int = 1024) -> DataFrame:
    """(graph, total, largest, n50, l50) over one strand of each contig pair (least id).

    Running sums go over bins of lengths first and over the contigs of the one bin that holds the middle after that,
    so no window orders all contigs."""
    one = distinct(contigs).filter(F.col("rc_id").isNull() | (F.col("edge_id") <= F.col("rc_id"))).select("graph", "edge_id", F.col("seq_len").cast("long").alias("len"))
    one = one.withColumn("bin", F.floor(F.col("len") / width))
    bins = one.groupBy("graph", "bin").agg(F.sum("len").alias("bases"), F.count(F.lit(1)).alias("n"), F.max("len").alias("top"))
    down = Window.partitionBy("graph").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("graph")
    bins = bins.select("graph", "bin", "bases", F.sum("bases").over(down).alias("upto"), F.sum("n").over(down).alias("count"), "n", F.sum("bases").over(whole).alias("total"), F.max("top").over(whole).alias("largest"))
    mid = bins.filter((F.col("upto") * 2 >= F.col("total")) & ((F.col("upto") - F.col("bases")) * 2 < F.col("total")))
    mid = mid.select("graph", "bin", "total", "largest", (F.col("upto") - F.col("bases")).alias("before"), (F.col("count") - F.col("n")).alias("before_n"))
    order = Window.partitionBy("graph").orderBy(F.desc("len"), "edge_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = one.join(mid, ["graph", "bin"]).withColumn("upto", F.col("before") + F.sum("len").over(order)).withColumn("rank", F.col("before_n") + F.count(F.lit(1)).over(order))
    inside = inside.filter(F.col("upto") * 2 >= F.col("total"))
    return inside.groupBy("graph", "total", "largest").agg(F.max("len").alias("n50"), F.min("rank").alias("l50"))


def length_histogram(contigs: DataFrame, width: int = 10_000, bins: int = 35) -> DataFrame:
    """(bin, n): contigs per length bin, the last bin open."""
    c = distinct(contigs.select("edge_id", "seq_len"))
    return c.groupBy(F.least(F.floor(F.col("seq_len") / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def estimated_counts(contigs: DataFrame) -> DataFrame:
    """(edge_id, n): coverage times the length with holes, rounded down: the count that a viewer shows for a contig; null
    without coverage."""
    c = with_coverage(contigs)
    return c.select("edge_id", F.floor(F.col("cov") * F.col("full_len")).alias("n"))


def neighbour_coverage(contigs: DataFrame, apart: float = 3.0, alike: float = 0.8) -> DataFrame:
    """(e1, e2, too_different, similar): contigs that meet at a node, end to start: whether one has more than ``apart``
    times the other's coverage, and whether the lesser has ``alike`` of the greater. Both need a coverage."""
    c = with_coverage(contigs).filter("cov is not null").select("edge_id", "node_from", "node_to", "cov")
    j = c.select(F.col("edge_id").alias("e1"), F.col("node_to").alias("node"), F.col("cov").alias("a")).join(c.select(F.col("edge_id").alias("e2"), F.col("node_from").alias("node"), F.col("cov").alias("b")), "node").filter("e1 <> e2")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return j.select("e1", "e2", (low * apart < high).alias("too_different"), (low >= alike * high).alias("similar"))


def dead_ends(contigs: DataFrame) -> DataFrame:
    """(edge_id, no_before, no_after): contigs that nothing comes before or nothing follows."""
    e = distinct(contigs).select("edge_id", "node_from", "node_to")
    ends, starts = e.select(F.col("node_to").alias("node_from"), F.lit(1).alias("b")).distinct(), e.select(F.col("node_from").alias("node_to"), F.lit(1).alias("a")).distinct()
    j = e.join(ends, "node_from", "left").join(starts, "node_to", "left")
    return j.filter("b is null or a is null").select("edge_id", F.col("b").isNull().alias("no_before"), F.col("a").isNull().alias("no_after"))
