"""Ways through the contig graph, listed: bounded search with the way as an array, and what is read off the lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_width
from . import graph, links


def listed(contigs: DataFrame, anchors: int = 4000, middle: int = 3000, most: int = 4000, uses: int = 1, starts: DataFrame | None = None) -> DataFrame:
    """(src, des, path, inserted, n_middle): all ways from contigs of ``anchors`` or more (those in ``starts(src)``, if
    given) to other ones over contigs shorter than ``middle`` and longer than k, each at most ``uses`` times, within
    ``most`` inserted bases. Every middle contig inserts a base at least, so the bases end the search."""
    e = cut(graph.edges(contigs).select("edge_id", "rc_id", "u", "v", "seq_len", "k"))
    far = e.filter(F.col("seq_len") >= anchors)
    inner = e.filter((F.col("seq_len") < middle) & (F.col("seq_len") > F.col("k"))).select("u", F.col("v").alias("to"), F.col("edge_id").alias("via"), (F.col("seq_len") - F.col("k")).cast("long").alias("add"))
    first = far.select(F.col("edge_id").alias("src"), F.col("rc_id").alias("src_rc"), F.col("v").alias("u"), F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("long").alias("inserted"))
    way = cut(first if starts is None else first.join(starts, "src", "left_semi"))
    found, n = way, 0
    while not way.isEmpty():
        n += 1
        step = way.join(inner, "u").withColumn("inserted", F.col("inserted") + F.col("add")).filter(F.col("inserted") <= most)
        step = step.filter(F.size(F.filter("path", lambda x: x == F.col("via"))) < uses)
        way = cut(step.select("src", "src_rc", F.col("to").alias("u"), F.concat("path", F.array("via")).alias("path"), "inserted"))
        found = found.unionByName(way)
        if n % 8 == 0:  # else the union has more and more parts
            found = cut(found.coalesce(shuffle_width(e.sparkSession)))
    to = found.join(far.select("u", F.col("edge_id").alias("des")), "u").filter("des <> src and not (des <=> src_rc)")
    return to.select("src", "des", "path", "inserted", F.size("path").alias("n_middle"))


def shortest(paths: DataFrame) -> DataFrame:
    """(src, des, path, inserted): the way with fewest inserted bases, then fewest contigs, then the least ids."""
    return paths.groupBy("src", "des").agg(F.min(F.struct("inserted", "n_middle", "path")).alias("m")).select("src", "des", "m.path", "m.inserted")


def ranked(paths: DataFrame) -> DataFrame:
    """(src, des, rank, path): ways in the order of ``shortest``; the n-th one is the row of that rank."""
    order = Window.partitionBy("src", "des").orderBy("inserted", "n_middle", "path")
    return paths.select("src", "des", F.row_number().over(order).alias("rank"), "path")


def kinds(paths: DataFrame) -> DataFrame:
    """(src, des, n_paths, kind): ``adjacent``, ``simple`` where one way leads over contigs, ``complex`` where several do."""
    g = paths.groupBy("src", "des").agg(F.count(F.lit(1)).alias("n_paths"), F.max("n_middle").alias("m"))
    return g.select("src", "des", "n_paths", F.when(F.col("n_paths") > 1, "complex").when(F.col("m") == 0, "adjacent").otherwise("simple").alias("kind"))


def on_paths(paths: DataFrame) -> DataFrame:
    """(src, des, edge_id, n_paths): contigs that lie on ways between two anchors, and on how many."""
    return paths.select("src", "des", F.explode(F.array_distinct("path")).alias("edge_id")).groupBy("src", "des", "edge_id").agg(F.count(F.lit(1)).alias("n_paths"))


def best_middle(paths: DataFrame, contigs: DataFrame) -> DataFrame:
    """(src, des, edge_id, seq_len): the longest contig on any way between two anchors, the least id at ties."""
    size = contigs.select("edge_id", "seq_len").dropDuplicates(["edge_id"])
    x = on_paths(paths).join(size, "edge_id").groupBy("src", "des").agg(F.max(F.struct("seq_len", (-F.col("edge_id")).alias("i"))).alias("m"))
    return x.select("src", "des", (-F.col("m.i")).alias("edge_id"), "m.seq_len")


def best_supported(paths: DataFrame, link_rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """(src, des, path, pairs): the way whose neighbouring contigs are joined by most read pairs, then the one of fewest
    inserted bases, fewest contigs and least ids."""
    n = links.mirrored(link_rows, contigs).select(F.col("v").alias("x"), F.col("u").alias("y"), F.col("n").alias("w"))
    whole = paths.withColumn("all", F.concat(F.array("src"), "path", F.array("des")))
    steps = whole.select("src", "des", "path", "inserted", "n_middle", F.explode(F.expr("transform(sequence(1, size(all) - 1), i -> struct(all[i - 1] as x, all[i] as y))")).alias("s")).select("src", "des", "path", "inserted", "n_middle", "s.*")
    summed = steps.join(n, ["x", "y"], "left").groupBy("src", "des", "path", "inserted", "n_middle").agg(F.sum(F.coalesce("w", F.lit(0))).cast("long").alias("pairs"))
    best = summed.groupBy("src", "des").agg(F.min(F.struct((-F.col("pairs")).alias("less"), "inserted", "n_middle", "path")).alias("m"))
    return best.select("src", "des", "m.path", (-F.col("m.less")).alias("pairs"))


def longest(contigs: DataFrame) -> DataFrame:
    """(edge_id, n_after): contigs on no ring and on no way to one, with the most contigs that can follow one another from
    it on. Rounds peel contigs whose followers are all known."""
    e = cut(graph.edges(contigs).select("edge_id", "u", "v"))
    done, open_edges, level = None, e, 0
    while True:
        # an edge is known once no open edge starts at its end
        known = cut(open_edges.join(open_edges.select(F.col("u").alias("v")).distinct(), "v", "left_anti").select("edge_id"))
        if known.isEmpty():
            break
        known = known.withColumn("n_after", F.lit(level).cast("long"))
        done = known if done is None else done.unionByName(known)
        level += 1
        if level % 8 == 0:
            done = cut(done.coalesce(shuffle_width(e.sparkSession)))
        open_edges = cut(open_edges.join(known, "edge_id", "left_anti"))
    return done if done is not None else e.select("edge_id", F.lit(0).cast("long").alias("n_after")).limit(0)


def plain_regions(contigs: DataFrame) -> DataFrame:
    """(root, n_edges): components with one contig that nothing comes before and one that nothing follows, without a ring
    and with no contig besides its reverse complement; more than one contig."""
    e = cut(graph.edges(contigs).select("edge_id", "rc_id", "u", "v"))
    at = e.select("edge_id", F.explode(F.array("u", "v")).alias("node"))
    pairs = at.join(at.groupBy("node").agg(F.min("edge_id").alias("b")), "node").select(F.col("edge_id").alias("a"), "b")
    c = cut(graph.connected(pairs).select(F.col("id").alias("edge_id"), "root"))
    d = graph.degrees(contigs)
    x = e.join(c, "edge_id").join(d.select(F.col("node").alias("u"), F.col("n_in").alias("before")), "u").join(d.select(F.col("node").alias("v"), F.col("n_out").alias("after")), "v")
    ring = graph.cyclic_core(contigs).join(c, "edge_id").select("root").distinct()
    twin = e.join(c, "edge_id").select("edge_id", "rc_id", "root").join(c.select(F.col("edge_id").alias("rc_id"), F.col("root").alias("other")), "rc_id").filter("root = other").select("root").distinct()
    g = x.groupBy("root").agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(F.col("before") == 0, 1)).alias("first"), F.count(F.when(F.col("after") == 0, 1)).alias("last"))
    return g.filter("n_edges > 1 and first = 1 and last = 1").select("root", "n_edges").join(ring, "root", "left_anti").join(twin, "root", "left_anti")


def extended(link_rows: DataFrame, contigs: DataFrame, unit: float = 1.3) -> DataFrame:
    """(edge_id, head, pos): contigs put one after another by read pairs. A contig is followed by its ``next_candidate`` if
    no other one claims that, and not where the follower is a repeat, covered above ``unit`` times the graph's unit."""
    from .contigs import classes

    n = links.next_candidate(link_rows, contigs).select("v", "u")
    once = n.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("u")
    repeat = classes(contigs).filter("is_repeat").select(F.col("edge_id").alias("u"))
    follows = n.join(once, "u").join(repeat, "u", "left_anti").select(F.col("u").alias("id"), F.col("v").alias("prev"))
    ids = contigs.select(F.col("edge_id").alias("id")).distinct()
    return graph.list_positions(ids.join(follows, "id", "left").select("id", "prev")).select(F.col("id").alias("edge_id"), "head", "pos")


def barcode_lines(contigs: DataFrame, pieces: DataFrame, shortest_len: int = 500) -> DataFrame:
    """(key, e1, e2): contigs of one barcode that follow one another within two steps of the graph, where neither has
    another one so near in that barcode: the joints of its line. Contigs below ``shortest_len`` take no part."""
    e = cut(graph.edges(contigs).select("edge_id", "u", "v", "seq_len"))
    step = e.select(F.col("edge_id").alias("a"), F.col("v").alias("u")).join(e.select("u", F.col("edge_id").alias("b")), "u").select("a", "b").distinct()
    two = step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    near = step.unionByName(two).filter("a <> b").distinct()
    m = links.members(pieces, "L1").select("edge", "key").join(e.filter(F.col("seq_len") >= shortest_len).select(F.col("edge_id").alias("edge")), "edge", "left_semi")
    j = cut(m.withColumnRenamed("edge", "a").join(near, "a").join(m.toDF("b", "key"), ["b", "key"]).select("key", "a", "b"))
    one = lambda c: j.groupBy("key", c).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("key", c)
    return j.join(one("a"), ["key", "a"]).join(one("b"), ["key", "b"]).select("key", F.col("a").alias("e1"), F.col("b").alias("e2"))


def linked_on_graph(link_rows: DataFrame, contigs: DataFrame, least: int = 1) -> DataFrame:
    """(src, des, n, inserted): read-pair links between long contigs that a way through the graph confirms."""
    n = links.mirrored(link_rows, contigs).filter(F.col("n") >= least).select(F.col("v").alias("src"), F.col("u").alias("des"), "n")
    return graph.shortest_paths(contigs).join(n, ["src", "des"]).select("src", "des", "n", "inserted")


def without_detours(paths: DataFrame) -> DataFrame:
    """(src, des) of shortest ways, without those that another link of the same start makes redundant: its target lies on
    the way."""
    s = cut(shortest(paths))
    on = s.select("src", F.col("des").alias("far"), F.explode("path").alias("des"))
    redundant = s.select("src", "des").join(on, ["src", "des"], "left_semi")
    far = on.join(redundant, ["src", "des"], "left_semi").select("src", F.col("far").alias("des")).distinct()
    return s.select("src", "des").join(far, ["src", "des"], "left_anti")
