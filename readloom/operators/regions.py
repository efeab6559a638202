"""Complex bulges: what is reached from a node alone, and the contigs in there that no way out needs.

The set of a source grows as in a topological order: a node joins once all contigs that end at it start in the set. All
sources grow at once, a round of joins per step; a node joins a set once, so every round is about new nodes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_width
from . import graph


def _short(contigs: DataFrame, longest: int) -> DataFrame:
    return graph.edges(contigs).filter(F.col("seq_len") < longest).select("edge_id", "rc_id", "u", "v", "cov", "seq_len")


def dominated(contigs: DataFrame, longest: int = 1000) -> DataFrame:
    """(source, node, step): nodes that only lead from ``source``: every contig that ends there starts at the source or at a
    node of its set, over contigs below ``longest``. Sources have two contigs or more after them; the source itself is
    step 0. A contig of ``longest`` or more that ends at a node keeps it out."""
    e = cut(_short(contigs, longest))
    n_in = graph.degrees(contigs).select("node", "n_in")
    start = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("u").alias("source"))
    new = cut(start.select("source", F.col("source").alias("node")))
    found, waiting, step = new.withColumn("step", F.lit(0)), None, 0
    while not new.isEmpty():
        step += 1
        came = new.join(e.select(F.col("u").alias("node"), F.col("v").alias("to")), "node").select("source", F.col("to").alias("node")).filter("node <> source")
        came = came.groupBy("source", "node").agg(F.count(F.lit(1)).alias("c"))
        waiting = came if waiting is None else waiting.unionByName(came).groupBy("source", "node").agg(F.sum("c").alias("c"))
        waiting = cut(waiting.join(n_in, "node"))
        new = cut(waiting.filter("c = n_in").select("source", "node"))
        waiting = waiting.filter("c < n_in").select("source", "node", "c")
        found = found.unionByName(new.withColumn("step", F.lit(step)))
        if step % 8 == 0:  # else the union has more and more parts
            found = cut(found.coalesce(shuffle_width(e.sparkSession)))
    return found.select("source", "node", "step")


def inner(contigs: DataFrame, sets: DataFrame, longest: int = 1000) -> DataFrame:
    """(source, edge_id, rc_id, u, v, cov, step): contigs with both ends in the set of a source; ``step`` is that of u."""
    e = _short(contigs, longest)
    return e.join(sets.select("source", F.col("node").alias("u"), "step"), "u").join(sets.select("source", F.col("node").alias("v")), ["source", "v"]).select("source", "edge_id", "rc_id", "u", "v", "cov", "step")


def summary(contigs: DataFrame, longest: int = 1000) -> DataFrame:
    """(source, n_nodes, n_edges, n_sinks, is_tree, is_complex) of sets with a contig inside. A sink has no contig to another
    node of the set. A tree has one contig at most to each node; complex sets hold a contig and its reverse complement or
    one from a node to itself, and are left alone."""
    sets = cut(dominated(contigs, longest))
    x = cut(inner(contigs, sets, longest))
    sizes = sets.groupBy("source").agg(F.count(F.lit(1)).alias("n_nodes"))
    twin = x.join(x.select("source", F.col("edge_id").alias("rc_id")), ["source", "rc_id"], "left_semi").select("source").distinct().withColumn("twin", F.lit(True))
    per = x.groupBy("source").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("v").alias("heads"), F.count_distinct("u").alias("tails"), F.max((F.col("u") == F.col("v")).cast("int")).alias("own"))
    out = per.join(sizes, "source").join(twin, "source", "left")
    return out.select("source", "n_nodes", "n_edges", (F.col("n_nodes") - F.col("tails")).alias("n_sinks"), (F.col("n_edges") == F.col("heads")).alias("is_tree"), ((F.col("own") == 1) | F.col("twin").isNotNull()).alias("is_complex"))


def removals(contigs: DataFrame, longest: int = 1000) -> DataFrame:
    """(source, edge_id): contigs inside a set that its sinks don't need. To each node the contig from the earliest step
    leads, the best covered one and then the least id at ties; kept are those on the ways from the source to the sinks.
    Sets that are trees or complex have none. Of sets that share nodes only that of the least source counts."""
    sets = cut(dominated(contigs, longest))
    whole = summary(contigs, longest).filter("not is_tree and not is_complex").select("source")
    sets = sets.join(whole, "source")
    first = sets.groupBy("node").agg(F.min("source").alias("source"))
    beaten = sets.join(first.withColumnRenamed("source", "least"), "node").filter("source <> least").select("source").distinct()
    sets = cut(sets.join(beaten, "source", "left_anti"))
    x = cut(inner(contigs, sets, longest))
    order = Window.partitionBy("source", "v").orderBy("step", F.desc(F.coalesce("cov", F.lit(0.0))), "edge_id")
    lead = cut(x.withColumn("r", F.row_number().over(order)).filter("r = 1").select("source", "edge_id", "u", "v"))
    at = cut(sets.select("source", "node").join(x.select("source", F.col("u").alias("node")).distinct(), ["source", "node"], "left_anti"))
    kept, n = None, 0
    while not at.isEmpty():  # back from the sinks
        step = cut(lead.join(at.select("source", F.col("node").alias("v")), ["source", "v"]).select("source", "edge_id", "u"))
        seen = step.select("source", "edge_id")
        kept = seen if kept is None else kept.unionByName(seen)
        at = cut(step.select("source", F.col("u").alias("node")).distinct())
        if (n := n + 1) % 8 == 0:
            kept = cut(kept.distinct().coalesce(shuffle_width(x.sparkSession)))
    return x.select("source", "edge_id") if kept is None else x.select("source", "edge_id").join(kept, ["source", "edge_id"], "left_anti")


def without_complex_bulges(contigs: DataFrame, longest: int = 1000) -> DataFrame:
    """The graph without ``removals`` and their reverse complements, until none is left."""
    now = cut(contigs.dropDuplicates())
    while True:
        gone = cut(removals(now, longest).select("edge_id").distinct())
        gone = cut(gone.unionByName(now.join(gone, "edge_id").filter("rc_id is not null").select(F.col("rc_id").alias("edge_id"))).distinct())
        if gone.isEmpty():
            return now
        now = cut(now.join(gone, "edge_id", "left_anti"))
