"""Scaffolds: greedy joining of contig ends by link strength, and their summary.

A link u -> v joins the far end of u to the near end of v, which is the far end of v's reverse complement. With ends
named by the contig that leaves through them, it is the undirected pair {u, rc(v)}, and its mirror is the same pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import graph, links

GAP = 100


def twins(contigs: DataFrame) -> DataFrame:
    """(edge_id, rc_id) in both directions: a null rc_id is known where the other strand names it."""
    rc = contigs.select("edge_id", "rc_id").filter("rc_id is not null and edge_id is not null")
    return rc.unionByName(rc.select(F.col("rc_id").alias("edge_id"), F.col("edge_id").alias("rc_id"))).distinct()


def end_pairs(scored: DataFrame, contigs: DataFrame) -> DataFrame:
    """(a, b, n), a < b: links (v, u, n) as pairs of contig ends, the stronger of both mirrors. Links to contigs without
    reverse complement, to the own strand and from a contig to itself are left out."""
    rc = twins(contigs)
    p = scored.join(rc.toDF("u", "u_rc"), "u").join(rc.toDF("v", "v_rc"), "v").filter("v <> u and v <> u_rc")
    return p.select(F.least("v", "u_rc").alias("a"), F.greatest("v", "u_rc").alias("b"), "n").groupBy("a", "b").agg(F.max("n").alias("n"))


def greedy(pairs: DataFrame) -> DataFrame:
    """(a, b, n): the pairs that taking the strongest first would take, each end used once; least ids at ties.

    Round by round all pairs are taken that are the strongest at both their ends. Any of them would also be taken by
    the sequential rule before a rival, so the result is the same, in few rounds instead of one pair at a time."""
    open_pairs = cut(pairs)
    taken = open_pairs.limit(0)
    rank = F.struct("n", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
    while not open_pairs.isEmpty():
        ends = open_pairs.select(F.explode(F.array("a", "b")).alias("end"), rank.alias("r")).groupBy("end").agg(F.max("r").alias("r"))
        both = ends.groupBy("r").agg(F.count(F.lit(1)).alias("c")).filter("c = 2")
        new = cut(both.select((-F.col("r.x")).alias("a"), (-F.col("r.y")).alias("b"), F.col("r.n").alias("n")))
        taken = taken.unionByName(new)
        used = new.select(F.explode(F.array("a", "b")).alias("end"))
        open_pairs = cut(open_pairs.join(used.withColumnRenamed("end", "a"), "a", "left_anti").join(used.withColumnRenamed("end", "b"), "b", "left_anti").select("a", "b", "n"))
    return taken


def paths(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaffold, pos, edge_id): contigs in order. Every contig with a reverse complement is in one scaffold, named by
    the lesser of both strands' heads; a ring is opened at its weakest join. Contigs without links stand alone."""
    rc = cut(twins(contigs))
    joined = cut(greedy(pairs))
    rings = graph.list_positions(_follows(joined, rc)).filter("is_cycle").select("id", "head")
    rings = cut(rings)
    other = rings.toDF("rc_id", "rc_head").join(rc, "rc_id").select(F.col("edge_id").alias("id"), "rc_head")
    rings = rings.join(other, "id").select("id", F.least("head", "rc_head").alias("head"))  # both strands are one ring
    weakest = joined.join(rings, joined["a"] == rings["id"]).groupBy("head").agg(F.min(F.struct("n", "a", "b")).alias("w")).select("w.a", "w.b")
    joined = cut(joined.join(weakest, ["a", "b"], "left_anti"))
    pos = graph.list_positions(_follows(joined, rc)).filter("not is_cycle")
    tail = pos.groupBy("head").agg(F.max(F.struct("pos", "id")).alias("t")).select("head", F.col("t.id").alias("edge_id")).join(rc, "edge_id").select("head", F.col("rc_id").alias("other"))
    return pos.join(tail, "head").filter("head <= other").select(F.col("head").alias("scaffold"), "pos", F.col("id").alias("edge_id"))


def _follows(joined: DataFrame, rc: DataFrame) -> DataFrame:
    """(id, prev) on both strands: a pair {a, b} puts rc(b) after a and rc(a) after b."""
    ends = joined.select(F.col("a").alias("prev"), F.col("b").alias("end")).unionByName(joined.select(F.col("b").alias("prev"), F.col("a").alias("end")))
    after = ends.join(rc.toDF("end", "id"), "end").select("id", "prev")
    return rc.select(F.col("edge_id").alias("id")).join(after, "id", "left").select("id", "prev")


def scaffolds(link_rows: DataFrame, contigs: DataFrame, least: int = 4) -> DataFrame:
    """``paths`` of the links with ``least`` read pairs or more, counted with their mirrors."""
    scored = links.mirrored(link_rows, contigs).filter(F.col("n") >= least)
    return paths(end_pairs(scored, contigs), contigs)


def summary(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaffold, n_contigs, bases, gap_bases): sizes with 100 N between contigs."""
    size = contigs.select("edge_id", "seq_len").dropDuplicates()
    s = placed.join(size, "edge_id").groupBy("scaffold").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum("seq_len").alias("bases"))
    return s.withColumn("gap_bases", (F.col("n_contigs") - 1) * GAP)


def bridges(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaffold, pos, src, des, state, inserted): how the gap after each contig closes on the graph: ``adjacent`` where
    both meet at a node, ``path`` where short contigs lead over, with the bases they insert, else ``gap``."""
    order = Window.partitionBy("scaffold").orderBy("pos")
    pairs = placed.select("scaffold", "pos", F.col("edge_id").alias("src"), F.lead("edge_id").over(order).alias("des")).filter("des is not null")
    found = graph.shortest_paths(contigs, anchors=0, starts=pairs.select("src").distinct())
    j = pairs.join(found, ["src", "des"], "left")
    state = F.when(F.col("n_middle") == 0, "adjacent").when(F.col("n_middle") > 0, "path").otherwise("gap")
    return j.select("scaffold", "pos", "src", "des", state.alias("state"), F.coalesce("inserted", F.lit(GAP).cast("long")).alias("inserted"))


def cover(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """(edge_id, n): in how many places a contig stands in scaffolds, either strand, by its lesser id."""
    rc = twins(contigs)
    return placed.join(rc, "edge_id").groupBy(F.least("edge_id", "rc_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n"))


def totals(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """(n_scaffolds, bases, largest, n50): over ``summary`` with its gaps; n50 is the least length such that scaffolds of it
    or more have half of all bases. Equal lengths are added up first, so the window runs over lengths."""
    s = summary(placed, contigs).select((F.col("bases") + F.col("gap_bases")).alias("len"))
    by = s.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    x = by.select("len", "n", F.sum(F.col("len") * F.col("n")).over(down).alias("upto"), F.sum(F.col("len") * F.col("n")).over(every).alias("bases"), F.sum("n").over(every).alias("n_scaffolds"), F.max("len").over(every).alias("largest"))
    return x.filter(F.col("upto") * 2 >= F.col("bases")).groupBy("n_scaffolds", "bases", "largest").agg(F.max("len").alias("n50"))


def marks(contigs: DataFrame, most: int = 3) -> DataFrame:
    """(edge_id, copies): how often a contig may stand in scaffolds: its coverage over the unit of its graph, rounded, one
    at least and ``most`` at most; one without coverage."""
    from .contigs import units, with_coverage

    unit = units(contigs).select("graph", F.col("longest_cov").alias("unit"))
    ratio = F.floor(F.col("cov") / F.col("unit") + 0.5)
    return with_coverage(contigs).join(F.broadcast(unit), "graph", "left").select("edge_id", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(most), ratio)), F.lit(1)).cast("int").alias("copies")).distinct()


def adaptive_best(scored: DataFrame, part: float = 5.0) -> DataFrame:
    """(u, v, score): the best partner of each contig by score, the least id at ties, where it has a ``part``-th of the
    mean score of all pairs or more."""
    both = scored.select(F.col("e1").alias("u"), F.col("e2").alias("v"), "score").unionByName(scored.select(F.col("e2").alias("u"), F.col("e1").alias("v"), "score"))
    mean = scored.agg(F.avg("score").alias("mean"))  # one row
    best = both.groupBy("u").agg(F.max(F.struct("score", (-F.col("v")).alias("i"))).alias("m")).select("u", (-F.col("m.i")).alias("v"), "m.score")
    return best.join(F.broadcast(mean), F.col("score") >= F.col("mean") / part).select("u", "v", "score")


def refined(placed: DataFrame, scored: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaffold, pos, edge_id, flipped): a contig between two others is turned to its other strand where the links
    ``scored(v, u, n)`` to both neighbours are then stronger. Scaffolds are gone through in order and the one after a turned
    contig stays, so of neighbours that would all turn the first, third and so on do."""
    rc = twins(contigs)
    order = Window.partitionBy("scaffold").orderBy("pos")
    x = placed.withColumn("left", F.lag("edge_id").over(order)).withColumn("right", F.lead("edge_id").over(order)).join(rc, "edge_id", "left")
    n = scored.groupBy("v", "u").agg(F.max("n").alias("n"))
    for name, a, b in (("n1", "left", "edge_id"), ("n2", "edge_id", "right"), ("r1", "left", "rc_id"), ("r2", "rc_id", "right")):
        x = x.join(n.select(F.col("v").alias(a), F.col("u").alias(b), F.col("n").alias(name)), [a, b], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    better = F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("rc_id").isNotNull() & (zero("r1") + zero("r2") > zero("n1") + zero("n2"))
    x = x.withColumn("better", better).withColumn("run", F.row_number().over(order) - F.row_number().over(Window.partitionBy("scaffold", "better").orderBy("pos")))
    turn = F.col("better") & (F.row_number().over(Window.partitionBy("scaffold", "better", "run").orderBy("pos")) % 2 == 1)
    return x.select("scaffold", "pos", F.when(turn, F.col("rc_id")).otherwise(F.col("edge_id")).alias("edge_id"), turn.alias("flipped"))
