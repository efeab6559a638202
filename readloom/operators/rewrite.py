"""Rewriting the contig graph: chains condensed, repeats split, loops unrolled, branches and bulges removed.

A rewrite finds matches by joins, keeps those that no other match disturbs, and applies them by anti-joins and unions;
ids of merged contigs follow from their parts, so both strands agree without a counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import graph, links


def chain_map(contigs: DataFrame) -> DataFrame:
    """(edge_id, head, pos, is_cycle): the chain that each contig becomes part of and its place there; -1 in rings."""
    return graph.list_positions(graph.chain_links(contigs)).withColumnRenamed("id", "edge_id")


def condensed(contigs: DataFrame) -> DataFrame:
    """Contigs with unbranched chains as one: (edge_id, rc_id, node_from, node_to, graph, seq_len, cnt, n_edges[, seq]).

    A chain has the id of its first contig, and its reverse complement is the chain that starts with the reverse
    complement of its last one; lengths and sequences overlap by k, counts add up. A ring starts and ends before its
    least id. ``seq`` is there if ``contigs`` has it."""
    m = cut(chain_map(contigs))
    e = graph.edges(contigs)
    has_seq = "seq" in contigs.columns
    if has_seq:
        e = e.join(contigs.select("edge_id", "seq").dropDuplicates(["edge_id"]), "edge_id")
    x = m.join(e, "edge_id")
    at = F.when(F.col("is_cycle"), (F.col("edge_id") != F.col("head")).cast("long")).otherwise(F.col("pos"))
    x = x.withColumn("at", at)
    joints = F.count(F.lit(1)) - F.when(F.first("is_cycle"), 0).otherwise(1)
    cols = [
        F.min(F.struct("at", "u"))["u"].alias("node_from"), F.max(F.struct("at", "v"))["v"].alias("last_to"), F.max(F.struct("at", "rc_id"))["rc_id"].alias("last_rc"), F.min("rc_id").alias("ring_rc"), F.min("graph").alias("graph"),
        (F.sum("seq_len") - joints * F.max("k")).cast("long").alias("seq_len"), F.sum(F.coalesce("cnt", F.lit(0))).cast("long").alias("cnt"), F.count(F.lit(1)).alias("n_edges"),
    ]
    if has_seq:
        part = F.struct("at", F.when(F.col("at") == 0, F.col("seq")).otherwise(F.expr("substring(seq, k + 1)")).alias("s"))
        cols.append(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"]), "").alias("seq"))
    g = x.groupBy("head", "is_cycle").agg(*cols)
    ring = F.col("is_cycle")
    out = ["node_from", F.when(ring, F.col("node_from")).otherwise(F.col("last_to")).alias("node_to"), "graph", "seq_len", "cnt", "n_edges"]
    return g.select(F.col("head").alias("edge_id"), F.when(ring, F.col("ring_rc")).otherwise(F.col("last_rc")).alias("rc_id"), *out, *(["seq"] if has_seq else []))


def condensed_sets(contigs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(edge_id, kind, n): barcodes of the condensed contigs: the union of the sets of their parts."""
    m = chain_map(contigs).select(F.col("edge_id").alias("edge"), "head")
    return links.members(pieces).join(m, "edge").select(F.col("head").alias("edge_id"), "kind", "key").distinct().groupBy("edge_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def coverage_pairs(contigs: DataFrame) -> DataFrame:
    """(mid, e_in, e_out): legs of two-in two-out repeats that coverage tells apart: high goes on as high, low as low."""
    x = graph.crossings(contigs).filter("resolved")
    pair = lambda a: F.struct(F.col(f"in_{a}").alias("e_in"), F.col(f"out_{a}").alias("e_out"))
    return x.select(F.col("edge_id").alias("mid"), F.explode(F.array(pair("high"), pair("low"))).alias("p")).select("mid", "p.*")


def leg_support(contigs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(edge_id, in_high, in_low, out_high, out_low, hh, hl, lh, ll): shared barcodes of the legs of each repeat; hl is
    high in, low out."""
    x = graph.crossings(contigs)
    legs = F.array(*[F.struct(F.col(f"in_{a}").alias("e1"), F.col(f"out_{b}").alias("e2"), F.lit(a[0] + b[0]).alias("w")) for a in ("high", "low") for b in ("high", "low")])
    pairs = x.select("edge_id", F.explode(legs).alias("p")).select("edge_id", "p.*")
    n = links.at_pairs(pairs, links.members(pieces, "L1").select("edge", "key"))
    got = pairs.join(n, ["e1", "e2"]).groupBy("edge_id").agg(*[F.sum(F.when(F.col("w") == w, F.col("n")).otherwise(0)).alias(w) for w in ("hh", "hl", "lh", "ll")])
    return x.drop("resolved").join(got, "edge_id")


def strict_bridges(contigs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(edge_id, high, medium, low): how two-in two-out repeats split at three levels of strictness, ``straight`` (high with
    high), ``crossed`` or null.

    A pairing is superior at a leg if it shares more than twice what the other one does. High: superior at all four
    legs; medium: at one leg at least, and the other pairing shares more nowhere; low: both its pairs share barcodes and
    no pair of the other does."""
    n = leg_support(contigs, pieces)

    def levels(a: str, b: str, c: str, d: str):  # own pairs a, b; c, d are the others
        sides = [(a, c), (a, d), (b, c), (b, d)]
        above = [F.col(x) > 2 * F.col(y) for x, y in sides]
        high = above[0] & above[1] & above[2] & above[3]
        medium = (above[0] | above[1] | above[2] | above[3]) & (F.greatest(c, d) <= F.least(a, b))
        low = (F.least(a, b) > 0) & (F.greatest(c, d) == 0)
        return high, medium, low

    straight, crossed = levels("hh", "ll", "hl", "lh"), levels("hl", "lh", "hh", "ll")
    named = [F.when(s & ~c, "straight").when(c & ~s, "crossed").alias(name) for s, c, name in zip(straight, crossed, ("high", "medium", "low"))]
    return n.select("edge_id", *named)


def barcode_pairs(contigs: DataFrame, pieces: DataFrame, level: str = "high") -> DataFrame:
    """(mid, e_in, e_out) of the repeats that barcodes split at a level of ``strict_bridges``."""
    x = graph.crossings(contigs).join(strict_bridges(contigs, pieces).select("edge_id", F.col(level).alias("way")), "edge_id").filter("way is not null")
    same = F.col("way") == "straight"
    low, high = F.when(same, F.col("out_low")).otherwise(F.col("out_high")), F.when(same, F.col("out_high")).otherwise(F.col("out_low"))
    pairs = F.explode(F.array(F.struct(F.col("in_high").alias("e_in"), high.alias("e_out")), F.struct(F.col("in_low").alias("e_in"), low.alias("e_out")))).alias("p")
    return x.select(F.col("edge_id").alias("mid"), pairs).select("mid", "p.*")


def split_repeats(contigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(edge_id, rc_id, node_from, node_to, graph, seq_len, cnt[, seq]): the graph in which each (mid, e_in, e_out) is one
    contig from e_in over mid to e_out.

    A repeat is split if none of its contigs belongs to another repeat of ``pairs`` and its reverse complement is split as
    well; others wait for a next round. The merged contig keeps the id of its first part, its reverse complement that of
    its last part's. mid's count goes to both by the coverage of their first parts, rounded down."""
    e = graph.edges(contigs)
    if "seq" in contigs.columns:
        e = e.join(contigs.select("edge_id", "seq").dropDuplicates(["edge_id"]), "edge_id")
    e = cut(e.drop("holes"))
    p = cut(pairs.distinct())
    parts = p.select("mid", F.explode(F.array("mid", "e_in", "e_out")).alias("part")).distinct()
    twice = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    free = p.join(parts.join(twice, "part").select("mid").distinct(), "mid", "left_anti")
    twin = e.select(F.col("edge_id").alias("mid"), F.col("rc_id").alias("mid_rc"))
    mids = free.select("mid").distinct().join(twin, "mid")
    both = mids.join(mids.select(F.col("mid").alias("mid_rc")), "mid_rc", "left_semi").filter("mid <> mid_rc").select("mid")
    p = cut(free.join(both, "mid"))
    side = lambda c, key: e.select(*[F.col(x).alias(f"{c}_{x}") for x in e.columns]).withColumnRenamed(f"{c}_edge_id", key)
    j = p.join(side("m", "mid"), "mid").join(side("a", "e_in"), "e_in").join(side("b", "e_out"), "e_out")
    share = F.try_divide(F.coalesce("a_cov", F.lit(0.0)), F.sum(F.coalesce("a_cov", F.lit(0.0))).over(_by_mid()))
    cnt = F.coalesce("a_cnt", F.lit(0)) + F.coalesce("b_cnt", F.lit(0)) + F.floor(F.coalesce("m_cnt", F.lit(0)) * F.coalesce(share, F.lit(0.5)))
    cols = [F.col("e_in").alias("edge_id"), F.col("b_rc_id").alias("rc_id"), F.col("a_u").alias("node_from"), F.col("b_v").alias("node_to"), F.col("a_graph").alias("graph"), (F.col("a_seq_len") + F.col("m_seq_len") + F.col("b_seq_len") - 2 * F.col("m_k")).cast("long").alias("seq_len"), cnt.cast("long").alias("cnt")]
    if "seq" in e.columns:
        cols.append(F.concat("a_seq", F.expr("substring(m_seq, m_k + 1)"), F.expr("substring(b_seq, m_k + 1)")).alias("seq"))
    made = cut(j.select(*cols))
    gone = p.select(F.explode(F.array("mid", "e_in", "e_out")).alias("edge_id")).distinct()
    kept = e.join(gone, "edge_id", "left_anti")
    kept = kept.select("edge_id", "rc_id", F.col("u").alias("node_from"), F.col("v").alias("node_to"), "graph", F.col("seq_len").cast("long"), "cnt", *(["seq"] if "seq" in e.columns else []))
    return kept.unionByName(made)


def _by_mid():
    from pyspark.sql import Window

    return Window.partitionBy("mid")


def resolve_repeats(contigs: DataFrame, find) -> DataFrame:
    """``split_repeats`` of what ``find(contigs)`` gives, until nothing splits any more."""
    now, n = cut(contigs.dropDuplicates()), None
    while True:
        holes = F.array().cast("array<struct<pos:int,len:int>>").alias("holes")
        new = cut(split_repeats(now, find(now)).select("*", holes))
        left = new.count()
        if left == (now.count() if n is None else n):
            return now
        now, n = new, left


def many_to_many(contigs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(edge_id, e_in, e_out, n): at repeats with several contigs before or after, pairs of legs that share most barcodes
    for both of them, without a tie."""
    e = cut(graph.edges(contigs).select("edge_id", "rc_id", "u", "v"))
    d = graph.degrees(contigs)
    mid = e.join(d.select(F.col("node").alias("u"), F.col("n_in").alias("before")), "u").join(d.select(F.col("node").alias("v"), F.col("n_out").alias("after")), "v")
    mid = mid.filter("before >= 1 and after >= 1 and before + after > 2").select("edge_id", "rc_id", "u", "v")
    legs = mid.join(e.select(F.col("v").alias("u"), F.col("edge_id").alias("e_in")), "u").join(e.select(F.col("u").alias("v"), F.col("edge_id").alias("e_out")), "v")
    legs = cut(legs.filter("e_in <> edge_id and e_out <> edge_id and e_in <> e_out").select("edge_id", "e_in", "e_out"))
    return _reciprocal(legs, pieces, "edge_id")


def at_nodes(contigs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(node, e_in, e_out, n): the same where contigs meet at a node with several before or after it."""
    e = cut(graph.edges(contigs).select("edge_id", "u", "v"))
    d = graph.degrees(contigs).filter("n_in >= 1 and n_out >= 1 and n_in + n_out > 2").select("node")
    legs = d.join(e.select(F.col("v").alias("node"), F.col("edge_id").alias("e_in")), "node").join(e.select(F.col("u").alias("node"), F.col("edge_id").alias("e_out")), "node").filter("e_in <> e_out")
    return _reciprocal(cut(legs), pieces, "node")


def _reciprocal(legs: DataFrame, pieces: DataFrame, at: str) -> DataFrame:
    n = links.at_pairs(legs.select(F.col("e_in").alias("e1"), F.col("e_out").alias("e2")), links.members(pieces, "L1").select("edge", "key"))
    x = cut(legs.join(n.toDF("e_in", "e_out", "n"), ["e_in", "e_out"]).filter("n > 0"))
    best = lambda side, name: x.groupBy(at, side).agg(F.max("n").alias(name)).join(x, [at, side]).filter(F.col("n") == F.col(name)).groupBy(at, side).agg(F.count(F.lit(1)).alias("c"), F.max(name).alias(name)).filter("c = 1").drop("c")
    both = x.join(best("e_in", "top_in"), [at, "e_in"]).join(best("e_out", "top_out"), [at, "e_out"])
    return both.filter("n = top_in and n = top_out").select(at, "e_in", "e_out", "n")


def unrolled(contigs: DataFrame, longest: int = 2000) -> DataFrame:
    """(edge_id, before, after, times, seq_len): loops from a node to itself with one other contig in and one out. The loop
    is passed as often as its coverage over the mean of both neighbours says, once at least, until ``longest`` bases are
    reached; ``seq_len`` is the length of before, loop and after as one."""
    e = cut(graph.edges(contigs).select("edge_id", "u", "v", "seq_len", "cov", "k"))
    own = e.filter("u = v").join(graph.degrees(contigs).filter("n_in = 2 and n_out = 2").select(F.col("node").alias("u")), "u")
    other = e.filter("u <> v")
    j = own.join(other.select(F.col("v").alias("u"), F.col("edge_id").alias("before"), F.col("seq_len").alias("l1"), F.col("cov").alias("c1")), "u").join(other.select("u", F.col("edge_id").alias("after"), F.col("seq_len").alias("l2"), F.col("cov").alias("c2")), "u")
    step = F.greatest(F.lit(1), F.col("seq_len") - F.col("k"))
    times = F.greatest(F.lit(1), F.least(F.floor(F.coalesce(2 * F.col("cov") / (F.col("c1") + F.col("c2")), F.lit(1.0)) + 0.5), F.ceil(F.lit(longest) / step))).cast("int")
    return j.select("edge_id", "before", "after", times.alias("times"), (F.col("l1") + times * (F.col("seq_len") - F.col("k")) + F.col("l2") - F.col("k")).cast("long").alias("seq_len"))


def diamonds(contigs: DataFrame) -> DataFrame:
    """(edge_id, kept): the less covered one of two contigs between the same nodes, the greater id at ties."""
    e = graph.edges(contigs).filter("cov is not null")
    g = e.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("cov", (-F.col("edge_id")).alias("i"))).alias("a"), F.min(F.struct("cov", (-F.col("edge_id")).alias("i"))).alias("b"))
    return g.filter("n = 2").select((-F.col("b.i")).alias("edge_id"), (-F.col("a.i")).alias("kept"))


def without_bulges(contigs: DataFrame) -> DataFrame:
    """The graph without the contigs of ``graph.bulges``, until none is left. In a round a contig goes if no other bulge
    of its start and end nodes has less coverage; its reverse complement goes with it."""
    now = cut(contigs.dropDuplicates())
    while True:
        b = graph.bulges(now).select("edge_id").join(graph.edges(now), "edge_id")
        ends = b.select(F.explode(F.array("u", "v")).alias("node"), F.struct(F.coalesce("cov", F.lit(0.0)).alias("cov"), "edge_id").alias("r"))
        first = ends.groupBy("node").agg(F.min("r").alias("r"))
        gone = cut(first.groupBy("r").agg(F.count(F.lit(1)).alias("c")).filter("c = 2").select(F.col("r.edge_id").alias("edge_id")))
        gone = cut(gone.unionByName(now.join(gone, "edge_id").filter("rc_id is not null").select(F.col("rc_id").alias("edge_id"))).distinct())
        if gone.isEmpty():
            return now
        now = cut(now.join(gone, "edge_id", "left_anti"))


def short_components(contigs: DataFrame, longest: int = 1500) -> DataFrame:
    """(edge_id, root): components of the graph of contigs shorter than ``longest``."""
    return graph.components(contigs.filter(F.col("seq_len") < longest))


def region_legs(contigs: DataFrame, longest: int = 1500) -> DataFrame:
    """(root, edge_id, side): longer contigs that lead into (``in``) or out of (``out``) a component of short ones."""
    e = cut(graph.edges(contigs).select("edge_id", "u", "v", "seq_len"))
    c = short_components(contigs, longest).join(e, "edge_id").select("root", F.explode(F.array("u", "v")).alias("node")).distinct()
    far = e.filter(F.col("seq_len") >= longest)
    legs = far.select("edge_id", F.col("v").alias("node"), F.lit("in").alias("side")).unionByName(far.select("edge_id", F.col("u").alias("node"), F.lit("out").alias("side")))
    return legs.join(c, "node").select("root", "edge_id", "side").distinct()


def region_pairs(contigs: DataFrame, pieces: DataFrame, longest: int = 1500) -> DataFrame:
    """(root, e_in, e_out, n): legs of a component that share most barcodes for both of them, without a tie."""
    legs = cut(region_legs(contigs, longest))
    rc = graph.edges(contigs).select(F.col("edge_id").alias("e_in"), "rc_id")
    pairs = legs.filter("side = 'in'").select("root", F.col("edge_id").alias("e_in")).join(legs.filter("side = 'out'").select("root", F.col("edge_id").alias("e_out")), "root")
    pairs = pairs.join(rc, "e_in").filter("e_in <> e_out and not (e_out <=> rc_id)").select("root", "e_in", "e_out")
    return _reciprocal(cut(pairs), pieces, "root")
