"""The bidirected contig graph: invariants, components, chains, patterns and bounded paths.

A contig is a directed edge node_from -> node_to with a reverse complement rc_id. Loops run on the driver, their rounds
on Spark: each round is a join, cut off from its history by ``session.cut``, and the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shuffle_width, shuffled
from .contigs import with_coverage


def edges(contigs: DataFrame) -> DataFrame:
    """(edge_id, rc_id, u, v, graph, seq_len, cnt, cov, k, holes) of distinct contigs."""
    return with_coverage(contigs).select("edge_id", "rc_id", F.col("node_from").alias("u"), F.col("node_to").alias("v"), "graph", "seq_len", "cnt", "cov", "k", "holes")


def invariants(contigs: DataFrame) -> DataFrame:
    """(rule, violations): rc(rc(e)) = e, the nodes of both strands mirror each other, equal lengths and counts, holes
    mirrored, ids unique. A contig with a null rc_id can't violate a rule about strands."""
    e = edges(contigs)
    twin = e.select(*[F.col(c).alias(f"_{c}") for c in ("edge_id", "rc_id", "u", "v", "seq_len", "cnt", "holes")])
    j = e.filter("rc_id is not null").join(twin, F.col("rc_id") == F.col("_edge_id"), "left")
    mirror = F.transform(F.reverse("_holes"), lambda h: F.struct((F.col("_seq_len") - h["pos"]).alias("pos"), h["len"].alias("len")))
    nodes = e.select(F.col("u").alias("n"), "edge_id").unionByName(e.select(F.col("v").alias("n"), "edge_id"))
    n = lambda c: F.count(F.when(c, 1))
    rules = j.agg(
        n(F.col("_edge_id").isNull()).alias("rc_exists"), n(~F.col("_rc_id").eqNullSafe(F.col("edge_id")) & F.col("_rc_id").isNotNull()).alias("rc_of_rc"),
        n(F.col("_seq_len") != F.col("seq_len")).alias("rc_length"), n(F.col("_cnt") != F.col("cnt")).alias("rc_count"), n(F.size("holes") != F.size("_holes")).alias("rc_holes"),
    )
    unique = e.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).agg(n(F.col("n") > 1).alias("unique_id"), F.lit(0).cast("long").alias("null_node"))
    names = ["rc_exists", "rc_of_rc", "rc_length", "rc_count", "rc_holes"]
    rows = lambda df, cs: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cs]), F.array(*cs))).alias("rule", "violations"))
    return rows(rules, names).unionByName(rows(unique.select("unique_id"), ["unique_id"])).unionByName(rows(nodes.agg(n(F.col("n").isNull()).alias("null_node")), ["null_node"]))


def degrees(contigs: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of every node."""
    e = edges(contigs)
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def connected(pairs: DataFrame) -> DataFrame:
    """(id, root) for undirected ``pairs(a, b)``: root is the least id of the component.

    Alternating stars: every round links each id to the least of its neighbours, first for larger ones and then for
    smaller ones; the number of rounds grows with the logarithm of the longest path. Nothing is collected."""
    both = lambda p: p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last = None
    while True:
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m", "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def components(contigs: DataFrame) -> DataFrame:
    """(edge_id, root): components over contigs that meet at a node, both strands together; root is the least edge id."""
    e = edges(contigs)
    at = e.select("edge_id", F.explode(F.array("u", "v")).alias("node"))
    first = at.groupBy("node").agg(F.min("edge_id").alias("b"))
    pairs = at.join(first, "node").select(F.col("edge_id").alias("a"), "b").unionByName(e.filter("rc_id is not null").select(F.col("edge_id").alias("a"), F.col("rc_id").alias("b")))
    return connected(pairs).join(e.select(F.col("edge_id").alias("id")), "id", "left_semi").select(F.col("id").alias("edge_id"), "root")


def component_sizes(contigs: DataFrame) -> DataFrame:
    """(root, n_edges, bases): contigs and half of all bases of both strands per component."""
    c = components(contigs).join(edges(contigs).select("edge_id", "seq_len"), "edge_id")
    return c.groupBy("root").agg(F.count(F.lit(1)).alias("n_edges"), F.floor(F.sum("seq_len") / 2).alias("bases"))


def list_positions(follows: DataFrame) -> DataFrame:
    """(id, head, pos, is_cycle) for lists given by ``follows(id, prev)``, prev null at a head, one prev and one next at
    most per id. Pointer doubling: after round r every id knows who stands 2^r places before it; an id that has reached
    its head leaves the rounds. An id on a cycle has the cycle's least id as head and no place (pos -1)."""
    now = cut(follows.select("id", F.col("prev").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.coalesce(F.least("id", "prev"), F.col("id")).alias("low"), F.coalesce("prev", "id").alias("head")))
    done = last = None
    rounds = 0
    while True:
        ended = now.filter("jump is null")
        open_ids = now.filter("jump is not null")
        # each round ends some open list as long as there is one; then the least ids of rings still have to settle
        left = open_ids.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()
        known = ended.select("id", "head", "pos")
        done = known if done is None else done.unionByName(known)
        if (rounds := rounds + 1) % 4 == 0:  # else the union has more and more parts
            done = cut(done.coalesce(shuffle_width(done.sparkSession)))
        if not left[0] or left == last:
            break
        last = left
        # an open id's target is open, or it ended in this round or the one before, as both moved in step
        to = now.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("pos").alias("pos2"), F.col("low").alias("low2"), F.col("head").alias("head2"))
        far = done.select(F.col("id").alias("jump"), F.col("pos").alias("pos3"), F.col("head").alias("head3"))
        step = open_ids.join(shuffled(to), "jump", "left").join(shuffled(far), "jump", "left")
        now = cut(step.select("id", F.col("jump2").alias("jump"), (F.col("pos") + F.coalesce("pos2", "pos3", F.lit(0))).alias("pos"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.coalesce("head2", "head3", "head").alias("head")))
    rings = open_ids.select("id", F.col("low").alias("head"), F.lit(-1).cast("long").alias("pos"), F.lit(True).alias("is_cycle"))
    return done.select("id", "head", "pos", F.lit(False).alias("is_cycle")).unionByName(rings)


def chain_links(contigs: DataFrame) -> DataFrame:
    """(id, prev): each contig and the one before it across a node with one edge in and one out, else null. A contig
    doesn't follow itself or its own reverse complement."""
    e = edges(contigs).select("edge_id", "rc_id", "u", "v")
    through = degrees(contigs).filter("n_in = 1 and n_out = 1").select("node")
    before = e.join(through, e["v"] == through["node"]).select(F.col("node").alias("u"), F.col("edge_id").alias("prev"), F.col("rc_id").alias("prev_rc"))
    j = e.join(before, "u", "left")
    ok = (F.col("prev") != F.col("edge_id")) & ~F.col("prev_rc").eqNullSafe(F.col("edge_id"))
    return j.select(F.col("edge_id").alias("id"), F.when(ok, F.col("prev")).alias("prev"))


def condense(contigs: DataFrame) -> DataFrame:
    """(head, n_edges, seq_len, cnt, is_cycle): maximal unbranched chains. Lengths overlap by k at every joint; counts
    add up, a null one adding nothing. Chains that close into a ring are kept and marked."""
    pos = list_positions(chain_links(contigs))
    e = edges(contigs).select(F.col("edge_id").alias("id"), "seq_len", "cnt", "k")
    g = pos.join(e, "id").groupBy("head", "is_cycle").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("seq_len").alias("len"), F.max("k").alias("k"), F.sum(F.coalesce("cnt", F.lit(0))).cast("long").alias("cnt"))
    joints = F.col("n_edges") - F.when(F.col("is_cycle"), 0).otherwise(1)
    return g.select("head", "n_edges", (F.col("len") - joints * F.col("k")).cast("long").alias("seq_len"), "cnt", "is_cycle")


def _neighbour_coverage(contigs: DataFrame) -> DataFrame:
    """Edges with max_side (greatest coverage of edges that start at u or end at v), n_before, n_after, max_before,
    max_after: coverage and number of edges before u and after v."""
    e = edges(contigs)
    starts = e.groupBy("u").agg(F.count(F.lit(1)).alias("n_start"), F.max("cov").alias("cov_start"))
    stops = e.groupBy("v").agg(F.count(F.lit(1)).alias("n_stop"), F.max("cov").alias("cov_stop"))
    e = e.join(starts.toDF("u", "n_out_u", "cov_out_u"), "u", "left").join(stops.toDF("v", "n_in_v", "cov_in_v"), "v", "left")
    e = e.join(stops.toDF("u", "n_before", "max_before"), "u", "left").join(starts.toDF("v", "n_after", "max_after"), "v", "left")
    return e.na.fill({"n_before": 0, "n_after": 0})


def tips(contigs: DataFrame, ratio: float = 0.1, max_cov: float = 10.0, short: int = 150, leg: int = 200) -> DataFrame:
    """(edge_id): dead ends to be removed: nothing before or nothing after, coverage below the greatest one of the
    edges beside it, and either shorter than ``short`` or shorter than ``leg`` with less than ``ratio`` of that, or
    coverage below ``max_cov`` and ``ratio``. Edges without coverage stay."""
    e = _neighbour_coverage(contigs)
    beside = F.greatest("cov_out_u", "cov_in_v")
    dead = (F.col("n_before") == 0) | (F.col("n_after") == 0)
    joined = (F.col("n_out_u") > 1) | (F.col("n_in_v") > 1)
    weak = F.col("cov") < ratio * beside
    return e.filter(dead & joined & (F.col("cov") < beside) & ((F.col("seq_len") < short) | ((F.col("seq_len") < leg) & weak) | ((F.col("cov") < max_cov) & weak))).select("edge_id")


def chimeric(contigs: DataFrame, ratio: float = 0.1, longest: int = 200, most: float = 15.0) -> DataFrame:
    """(edge_id): short edges between well covered neighbours on both sides: coverage below ``ratio`` of the lesser of
    both sides' greatest coverage and below ``most``."""
    e = _neighbour_coverage(contigs)
    sides = F.least(F.greatest("cov_out_u", "max_before"), F.greatest("cov_in_v", "max_after"))
    return e.filter((F.col("seq_len") < longest) & (F.col("cov") < ratio * sides) & (F.col("cov") < most) & (F.col("n_before") > 0) & (F.col("n_after") > 0)).select("edge_id")


def loops(contigs: DataFrame) -> DataFrame:
    """(edge_id, kind): self loops, loops onto the own reverse complement's start, and pairs that go to and fro."""
    e = edges(contigs).select("edge_id", "rc_id", "u", "v")
    own = e.filter("u = v").select("edge_id", F.lit("self").alias("kind"))
    twin = e.select(F.col("edge_id").alias("rc_id"), F.col("u").alias("ru"), F.col("v").alias("rv"))
    rc = e.join(twin, "rc_id").filter("v = ru and u <> v").select("edge_id", F.lit("rc").alias("kind"))
    back = e.filter("u <> v").alias("a").join(e.alias("b"), (F.col("a.v") == F.col("b.u")) & (F.col("a.u") == F.col("b.v"))).select(F.col("a.edge_id").alias("edge_id"), F.lit("two").alias("kind"))
    return own.unionByName(rc).unionByName(back).distinct()


def bubbles(contigs: DataFrame) -> DataFrame:
    """(u, v, kept, n, cnt): parallel edges, the longest of which is kept (least id at ties) with all their counts."""
    g = edges(contigs).groupBy("u", "v").agg(F.max(F.struct("seq_len", (-F.col("edge_id")).alias("i"))).alias("top"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cnt", F.lit(0))).cast("long").alias("cnt"))
    return g.filter("n > 1").select("u", "v", (-F.col("top.i")).alias("kept"), "n", "cnt")


def crossings(contigs: DataFrame, imbalance: float = 1.7, match: float = 0.8) -> DataFrame:
    """(edge_id, in_high, in_low, out_high, out_low, resolved): repeats with two edges in and two out. ``resolved``
    where both sides are uneven by more than ``imbalance`` and like meets like within ``match``."""
    e = edges(contigs).filter("cov is not null").select("edge_id", "u", "v", "cov")
    d = degrees(contigs)
    mid = e.join(d.filter("n_in = 2 and n_out = 1").select(F.col("node").alias("u")), "u", "left_semi").join(d.filter("n_in = 1 and n_out = 2").select(F.col("node").alias("v")), "v", "left_semi")
    side = lambda key, name: e.groupBy(F.col(key).alias("node")).agg(F.max(F.struct("cov", (-F.col("edge_id")).alias("i"))).alias(f"{name}_a"), F.min(F.struct("cov", (-F.col("edge_id")).alias("i"))).alias(f"{name}_b"), F.count(F.lit(1)).alias(f"{name}_n"))
    j = mid.join(side("v", "in").withColumnRenamed("node", "u"), "u").join(side("u", "out").withColumnRenamed("node", "v"), "v").filter("in_n = 2 and out_n = 2")
    even = lambda a, b: F.least(a, b) >= match * F.greatest(a, b)
    ok = (F.col("in_a.cov") > imbalance * F.col("in_b.cov")) & (F.col("out_a.cov") > imbalance * F.col("out_b.cov")) & even(F.col("in_a.cov"), F.col("out_a.cov")) & even(F.col("in_b.cov"), F.col("out_b.cov"))
    return j.select("edge_id", *[(-F.col(f"{s}_{x}.i")).alias(f"{s}_{n}") for s in ("in", "out") for x, n in (("a", "high"), ("b", "low"))], ok.alias("resolved"))


def bfs(contigs: DataFrame) -> DataFrame:
    """(graph, edge_id, level): all edges reached from each graph's longest contig (least id at ties) and the least
    number of steps to them. Each round joins the new edges only, until there are none."""
    e = cut(edges(contigs).select("edge_id", "graph", "u", "v", "seq_len"))
    start = e.groupBy("graph").agg(F.max(F.struct("seq_len", (-F.col("edge_id")).alias("i"))).alias("m")).select("graph", (-F.col("m.i")).alias("edge_id"))
    front = cut(start)
    seen = front.select("graph", "edge_id", F.lit(0).alias("level"))
    level = 0
    while not front.isEmpty():
        level += 1
        ends = front.join(e.select("edge_id", F.col("v").alias("u")), "edge_id").select("graph", "u").distinct()
        new = ends.join(e.select("u", "edge_id"), "u").select("graph", "edge_id").distinct()
        front = cut(new.join(seen, ["graph", "edge_id"], "left_anti"))
        seen = seen.unionByName(front.select("graph", "edge_id", F.lit(level).alias("level")))
        if level % 8 == 0:  # else the union has more and more parts
            seen = cut(seen.coalesce(shuffle_width(e.sparkSession)))
    return seen


def neighbourhood(contigs: DataFrame) -> DataFrame:
    """(edge_id, n1, n2): how many edges are one and two steps ahead, each counted once at its least distance."""
    e = edges(contigs).select("edge_id", "u", "v")
    step = e.select("edge_id", F.col("v").alias("u")).join(e.select("u", F.col("edge_id").alias("to")), "u").select("edge_id", "to").distinct()
    two = step.join(step.select(F.col("edge_id").alias("to"), F.col("to").alias("to2")), "to").select("edge_id", F.col("to2").alias("to")).distinct()
    both = step.withColumn("d", F.lit(1)).unionByName(two.withColumn("d", F.lit(2))).groupBy("edge_id", "to").agg(F.min("d").alias("d")).filter("edge_id <> to")
    return both.groupBy("edge_id").agg(F.count(F.when(F.col("d") == 1, 1)).alias("n1"), F.count(F.when(F.col("d") == 2, 1)).alias("n2"))


def shortest_paths(contigs: DataFrame, anchors: int = 4000, middle: int = 3000, most: int = 4000, starts: DataFrame | None = None) -> DataFrame:
    """(src, des, inserted, n_middle): from each contig of ``anchors`` or more (of those in ``starts(src)``, if given) to
    each other one, the least number of bases put between them through contigs shorter than ``middle`` and longer than
    k, k-overlaps taken off, up to ``most``; fewest contigs at ties. Frontier joins that keep the best per (start,
    node), until no best one changes."""
    e = cut(edges(contigs).select("edge_id", "rc_id", "u", "v", "seq_len", "k"))
    far = e.filter(F.col("seq_len") >= anchors)
    inner = e.filter((F.col("seq_len") < middle) & (F.col("seq_len") > F.col("k"))).select("u", F.col("v").alias("v2"), (F.col("seq_len") - F.col("k")).cast("long").alias("add"))
    first = far.select(F.col("edge_id").alias("src"), F.col("rc_id").alias("src_rc"), F.col("v").alias("u"), F.struct(F.lit(0).cast("long").alias("inserted"), F.lit(0).alias("n_middle")).alias("m"))
    reach = best = cut(first if starts is None else first.join(starts, "src", "left_semi"))
    while not reach.isEmpty():
        step = reach.join(inner, "u").select("src", "src_rc", F.col("v2").alias("u"), F.struct((F.col("m.inserted") + F.col("add")).alias("inserted"), (F.col("m.n_middle") + 1).alias("n_middle")).alias("m"))
        step = step.filter(F.col("m.inserted") <= most).groupBy("src", "src_rc", "u").agg(F.min("m").alias("m"))
        known = best.select("src", "u", F.col("m").alias("known"))
        reach = cut(step.join(known, ["src", "u"], "left").filter(F.col("known").isNull() | (F.col("m") < F.col("known"))).select("src", "src_rc", "u", "m"))
        best = cut(best.unionByName(reach).groupBy("src", "src_rc", "u").agg(F.min("m").alias("m")))
    to = best.join(far.select("u", F.col("edge_id").alias("des")), "u").filter("des <> src and not (des <=> src_rc)")
    least = to.groupBy("src", "des").agg(F.min("m").alias("m"))
    return least.select("src", "des", F.col("m.inserted").alias("inserted"), F.col("m.n_middle").alias("n_middle"))


def simplify(contigs: DataFrame) -> DataFrame:
    """Distinct contigs without tips, chimeric edges and all but the longest of parallel edges, to a fixpoint. A removed
    edge takes its reverse complement with it, and what is left of a branch whose start is gone goes as well."""
    now = cut(contigs.dropDuplicates())
    fed = cut(edges(now).select(F.col("v").alias("u")).distinct())
    while True:
        e, reach = edges(now), downstream_reach(now, 251)
        weaker = e.join(bubbles(now), ["u", "v"]).filter("edge_id <> kept").select("edge_id")
        cut_off = e.join(fed, "u", "left_semi").join(e.select(F.col("v").alias("u")), "u", "left_anti").join(reach.filter("reach <= 250"), "edge_id").select("edge_id")
        gone = tips(now).unionByName(topological_tips(now, reach=reach)).unionByName(chimeric(now)).unionByName(weaker).unionByName(cut_off).distinct()
        gone = cut(gone.unionByName(now.join(gone, "edge_id").filter("rc_id is not null").select(F.col("rc_id").alias("edge_id"))).distinct())
        if gone.isEmpty():
            break
        now = cut(now.join(gone, "edge_id", "left_anti"))
    return now


def path_counts(contigs: DataFrame, anchors: int = 4000, middle: int = 3000, hops: int = 30, most: int = 4000) -> DataFrame:
    """(src, des, n_paths): different ways over at most ``hops`` contigs (the reference's 30) shorter than ``middle``
    between contigs of ``anchors`` or more, within ``most`` inserted bases. Ways that put in equally many bases over equally many contigs
    and end at the same node are added up round by round, so paths are counted without being listed."""
    e = cut(edges(contigs).select("edge_id", "rc_id", "u", "v", "seq_len", "k"))
    far = e.filter(F.col("seq_len") >= anchors)
    inner = e.filter(F.col("seq_len") < middle).select("u", F.col("v").alias("v2"), (F.col("seq_len") - F.col("k")).cast("long").alias("add"))
    reach = far.select(F.col("edge_id").alias("src"), F.col("rc_id").alias("src_rc"), F.col("v").alias("u"), F.lit(0).cast("long").alias("inserted"), F.lit(1).cast("long").alias("n"))
    found = reach
    for _ in range(hops):
        step = reach.join(inner, "u").withColumn("inserted", F.col("inserted") + F.col("add")).filter(F.col("inserted") <= most)
        reach = cut(step.groupBy("src", "src_rc", F.col("v2").alias("u"), "inserted").agg(F.sum("n").alias("n")))
        if reach.isEmpty():
            break
        found = found.unionByName(reach)
    to = found.join(far.select("u", F.col("edge_id").alias("des")), "u").filter("des <> src and not (des <=> src_rc)")
    return to.groupBy("src", "des").agg(F.sum("n").alias("n_paths"))


def bulges(contigs: DataFrame, longest: int = 1000, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """(edge_id, n_edges, length): edges up to ``longest`` beside another way of two or more edges between the same
    nodes whose length, overlaps taken off, is ``low`` to ``high`` times theirs; the way with fewest edges, then the
    shortest. The other way doesn't use the edge itself. An edge whose way is found leaves the search, and equal
    lengths at one node go on once, so the length ends it."""
    e = cut(edges(contigs).select("edge_id", "u", "v", "seq_len", "k"))
    x = e.filter(F.col("seq_len") <= longest).select(F.col("edge_id").alias("x"), F.col("u").alias("xu"), F.col("v").alias("xv"), F.col("seq_len").alias("xl"))
    short = e.filter((F.col("seq_len") <= high * longest) & (F.col("seq_len") > F.col("k")))
    nxt = short.select(F.col("u").alias("at"), F.col("v").alias("to"), "edge_id", (F.col("seq_len") - F.col("k")).alias("add"))
    way = x.join(short, x["xu"] == short["u"]).filter("edge_id <> x").select("x", "xv", "xl", F.col("v").alias("at"), F.col("seq_len").cast("long").alias("length"))
    way = cut(way.filter(F.col("length") <= high * F.col("xl")).distinct())
    found, n = None, 1
    while found is None or not way.isEmpty():
        n += 1
        way = way.join(nxt, "at").filter("edge_id <> x").select("x", "xv", "xl", F.col("to").alias("at"), (F.col("length") + F.col("add")).alias("length")).filter(F.col("length") <= high * F.col("xl"))
        way = cut(way.distinct())
        hit = way.filter((F.col("at") == F.col("xv")) & (F.col("length") >= low * F.col("xl"))).groupBy("x").agg(F.min("length").alias("length"))
        hit = cut(hit.select("x", F.lit(n).alias("n_edges"), "length"))
        way = way.join(hit, "x", "left_anti")
        found = hit if found is None else found.unionByName(hit)
        if n % 8 == 0:  # else the union has more and more parts
            found = cut(found.coalesce(shuffle_width(e.sparkSession)))
    return found.select(F.col("x").alias("edge_id"), "n_edges", "length")


def downstream_reach(contigs: DataFrame, cap: int = 1000) -> DataFrame:
    """(edge_id, reach): the most bases that an edge and all that follow it span, overlaps taken off, at most ``cap``.
    Small values mark dead ends that a look at one edge doesn't show. Rounds go on until no reach changes; if that takes
    more than 16, edges on rings and between them get ``cap``, as a ring goes on for ever. An edge no longer than k adds
    nothing."""
    top = F.lit(cap).cast("long")
    e = cut(edges(contigs).select("edge_id", "u", "v", F.greatest(F.lit(0), F.col("seq_len") - F.col("k")).cast("long").alias("own")))
    reach = e.select("u", "v", "edge_id", "own", F.least(top, "own").alias("reach"))
    last, rounds = None, 0
    while last != (last := reach.agg(F.sum("reach")).first()[0]):
        if (rounds := rounds + 1) == 16:
            core = cyclic_core(contigs).distinct().withColumn("core", F.lit(True))
            e = cut(e.join(core, "edge_id", "left").withColumn("own", F.when(F.col("core"), top).otherwise(F.col("own"))).drop("core"))
        ahead = reach.groupBy(F.col("u").alias("v")).agg(F.max("reach").alias("more"))
        reach = cut(e.join(ahead, "v", "left").select("u", "v", "edge_id", "own", F.least(top, F.col("own") + F.coalesce("more", F.lit(0).cast("long"))).alias("reach")))
    return reach.select("edge_id", "reach")


def topological_tips(contigs: DataFrame, longest: int = 250, ratio: float = 0.1, reach: DataFrame | None = None) -> DataFrame:
    """(edge_id): first edges of dead-end branches of any number of edges: what follows from the edge on spans at most
    ``longest`` bases while another edge of its start goes on for more, and its coverage is below ``ratio`` of the
    greatest one there. With the reverse complements, branches that come out of nowhere are found as well."""
    r = downstream_reach(contigs, longest + 1) if reach is None else reach
    e = edges(contigs).select("edge_id", "u", "cov").join(r, "edge_id")
    best = e.groupBy("u").agg(F.max("reach").alias("far"), F.max("cov").alias("top"))
    return e.join(best, "u").filter((F.col("reach") <= longest) & (F.col("far") > longest) & (F.col("cov") < ratio * F.col("top"))).select("edge_id")


def cyclic_core(contigs: DataFrame) -> DataFrame:
    """(edge_id): edges left when nodes without edges in or without edges out are peeled off until none is: all edges on
    rings and on ways from ring to ring. An empty result means that the graph has an order."""
    e = cut(edges(contigs).select("edge_id", "u", "v"))
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("edge_id", "u", "v"))
        e = cut(e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("edge_id", "u", "v"))
        last, n = n, e.count()
        if n == last:
            break
    return e.select("edge_id")
