"""Links between contigs from shared barcodes and read pairs, and filters on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shuffle_width

LEVELS = ((200, None), (500, "L0"), (3000, "L1"))


def members(pieces: DataFrame, kind: str | None = None, least: int = 1) -> DataFrame:
    """(edge, kind, key, cnt): barcodes of dumped table pieces, distinct, with the greatest count that a piece gives.
    -1 is an empty slot; null arrays hold nothing; a key without a count has count 0."""
    p = pieces.filter(F.col("kind") == kind) if kind else pieces
    x = p.filter("edge is not null").select("edge", "kind", F.explode(F.arrays_zip("keys", "cnts")).alias("x")).filter("x.keys <> -1")
    m = x.groupBy("edge", "kind", F.col("x.keys").alias("key")).agg(F.max(F.coalesce("x.cnts", F.lit(0))).alias("cnt"))
    return m.filter(F.col("cnt") >= least) if least > 1 else m


def set_sizes(pieces: DataFrame) -> DataFrame:
    """(edge, kind, n): distinct barcodes per set; n_item of the dump isn't trusted."""
    return members(pieces).groupBy("edge", "kind").agg(F.count(F.lit(1)).alias("n"))


AT_ONCE = 1 << 22  # pairs of edges with a barcode in common that a task looks at together
IN_CELL = 1 << 20  # rows of a block of edges


def _in_cells(least: int):
    """Sorted rows (cell, side, edge, key) to (e1, e2, n): the barcodes that pairs of edges of both sides of a cell share,
    counted for a few edges of one side at a time. In a cell of one block (side 2) both sides are the same."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, edge, key = (t.column(c).to_numpy() for c in ("side", "edge", "key"))
        one, two = side != 1, side != 0
        order = np.argsort(edge[one], kind="stable")
        e1, k1 = edge[one][order], key[one][order]
        order = np.argsort(key[two], kind="stable")
        k2, (names, e2) = key[two][order], np.unique(edge[two][order], return_inverse=True)
        start = np.searchsorted(k2, k1)
        size = np.searchsorted(k2, k1, side="right") - start
        first = np.flatnonzero(np.r_[True, np.diff(e1) != 0]) if len(e1) else np.zeros(0, np.int64)
        upto = np.r_[0, np.cumsum(size)]
        bounds, i = np.r_[first, len(e1)], 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(upto[bounds], upto[bounds[i]] + AT_ONCE, side="right")) - 1)
            lo, hi = bounds[i], bounds[j]
            s, places = size[lo:hi], start[lo:hi]
            partner = e2[np.repeat(places - np.r_[0, np.cumsum(s)[:-1]], s) + np.arange(s.sum())]
            code = np.sort(np.repeat(np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1])), s) * len(names) + partner)
            at = np.flatnonzero(np.r_[True, np.diff(code) != 0]) if len(code) else np.zeros(0, np.int64)
            n = np.diff(np.r_[at, len(code)])
            at, n = at[n >= least], n[n >= least]
            a, b = e1[first[i:j]][code[at] // max(1, len(names))], names[code[at] % max(1, len(names))]
            if side[0] == 2:
                a, b, n = (x[a < b] for x in (a, b, n))
            for k in range(0, len(a), 100_000):
                x, y = a[k : k + 100_000], b[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n[k : k + 100_000])], ["e1", "e2", "n"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, now = [], None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            at = np.flatnonzero(np.diff(cell) != 0) + 1
            for i, j in zip(np.r_[0, at], np.r_[at, len(cell)]):
                if i == j:
                    continue
                if cell[i] != now and waiting:
                    yield from pairs(pa.Table.from_batches(waiting))
                    waiting = []
                now = cell[i]
                waiting.append(batch.slice(i, j - i))
        if waiting:
            yield from pairs(pa.Table.from_batches(waiting))

    return run


def _counted_in_cells(shared: DataFrame, least: int, blocks: int) -> DataFrame:
    """(e1, e2, n) by pairs of blocks of edges: a row goes to each cell of its block, pairs don't move."""
    b, x = F.pmod(F.xxhash64("edge"), F.lit(blocks)), F.col("x")
    rows = shared.select("edge", "key", b.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("x"))
    cell = (F.least("b", x) * blocks + F.greatest("b", x)).alias("cell")
    side = F.when(F.col("b") == x, 2).when(F.col("b") < x, 0).otherwise(1).cast("int").alias("side")
    n = shuffle_width(shared.sparkSession)
    return rows.select(cell, side, "edge", "key").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_in_cells(least), "e1 long, e2 long, n long")


def shared_counts(m: DataFrame, least: int, block: int = 1000) -> DataFrame:
    """(e1, e2, n), e1 < e2: pairs of edges that share ``least`` barcodes or more, exactly counted.

    Barcodes are ordered from rare to common. A pair that shares ``least`` has one of them among the first
    n - least + 1 of both its edges, so only these are paired, and what pairs share of the commonest ones is counted at
    the pairs that met. The holders of a barcode are paired in blocks of about ``block``, so one that nearly all edges
    hold is spread over many tasks. ``m`` has distinct (edge, key).

    Where that would move more pairs than there are rows of barcodes in all pairs of blocks of edges, those are moved, and
    pairs are counted where they come up."""
    m = m.select("edge", "key")
    holders = m.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    order = Window.partitionBy("edge").orderBy("holders", "key")
    shared = m.join(holders, "key").withColumn("place", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("edge")))
    shared = cut(shared.filter(F.col("shared") >= least).withColumn("head", F.col("place") <= F.col("shared") - least + 1).withColumn("blocks", F.ceil(F.col("holders") / block).cast("int")))
    part, every = F.pmod(F.xxhash64("edge"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    head = shared.filter("head")
    sizes = head.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("h")).agg(F.sum(F.expr("h * (h - 1) / 2"))).first()[0] or 0
    rows = shared.count()
    cells = max(math.ceil((8 * shuffle_width(m.sparkSession)) ** 0.5), -(-rows // IN_CELL))
    if sizes * (2 * least - 1) > rows * cells:
        return _counted_in_cells(shared.select("edge", "key"), least, cells)
    one = head.select("key", F.col("edge").alias("e1"), part.alias("b1"), every.alias("b2"))
    two = head.select("key", F.col("edge").alias("e2"), part.alias("b2"), every.alias("b1"))
    met = one.join(two, ["key", "b1", "b2"]).filter("e1 < e2").groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    if least > 1:  # a common barcode beyond the head of either edge was not paired
        met = cut(met)
        tail = shared.filter("not head").select("edge", "key")
        of_1 = met.select("e1", "e2").join(tail.toDF("e1", "key"), "e1")
        of_2 = met.select("e1", "e2").join(tail.toDF("e2", "key"), "e2")
        rest = of_1.join(shared.select(F.col("edge").alias("e2"), "key"), ["e2", "key"]).unionByName(of_2.join(head.select(F.col("edge").alias("e1"), "key"), ["e1", "key"]))
        met = met.join(rest.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("more")), ["e1", "e2"], "left").select("e1", "e2", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return met.select("e1", "e2", F.col("n").cast("long").alias("n")).filter(F.col("n") >= least)


def similarity(m: DataFrame, least: int) -> DataFrame:
    """(e1, e2, n, score): shared over the smaller set for pairs that share ``least`` or more; 0 where a set has fewer
    than ``least`` barcodes."""
    m = m.select("edge", "key").distinct()
    size = m.groupBy("edge").agg(F.count(F.lit(1)).alias("size"))
    s = shared_counts(m, least).join(size.withColumnsRenamed({"edge": "e1", "size": "s1"}), "e1").join(size.withColumnsRenamed({"edge": "e2", "size": "s2"}), "e2")
    small = F.least("s1", "s2")
    return s.select("e1", "e2", "n", F.when(small < least, F.lit(0.0)).otherwise(F.round(F.col("n") / small, 6)).alias("score"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("e1").alias("u"), F.col("e2").alias("v"), "n").unionByName(pairs.select(F.col("e2").alias("u"), F.col("e1").alias("v"), "n"))


def top_two(pairs: DataFrame) -> DataFrame:
    """(u, best, n1, n2, state): best partner of each edge and its lead. state is ``clear`` where the best shares more
    than twice what the second does, ``greater`` where it shares more, else ``tie``; least partner id at ties. The two
    best come by an aggregate, not by ordering all partners of an edge."""
    two = _both_ways(pairs).groupBy("u").agg(F.max(F.struct("n", (-F.col("v")).alias("v"))).alias("a"))
    rest = _both_ways(pairs).join(two, "u").filter(F.col("v") != -F.col("a.v")).groupBy("u").agg(F.max("n").alias("n2"))
    out = two.join(rest, "u", "left").select("u", (-F.col("a.v")).alias("best"), F.col("a.n").alias("n1"), F.coalesce("n2", F.lit(0).cast("long")).alias("n2"))
    state = F.when(F.col("n1") > 2 * F.col("n2"), "clear").when(F.col("n1") > F.col("n2"), "greater").otherwise("tie")
    return out.withColumn("state", state)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """(e1, e2, n): pairs that are each other's clear or greater best."""
    t = top_two(pairs).filter("state <> 'tie'")
    return t.alias("a").join(t.alias("b"), (F.col("a.u") == F.col("b.best")) & (F.col("a.best") == F.col("b.u")) & (F.col("a.u") < F.col("b.u"))).select(F.col("a.u").alias("e1"), F.col("b.u").alias("e2"), F.col("a.n1").alias("n"))


def candidates(scored: DataFrame, top: int = 11, drop: float = 0.5) -> DataFrame:
    """(u, v, score, rank): per edge the ``top`` best partners up to the first whose score is 0 or below ``drop`` times
    the one before. The partner list of one edge is bounded by the ranking's limit before the window that cuts it."""
    both = scored.select(F.col("e1").alias("u"), F.col("e2").alias("v"), "score").unionByName(scored.select(F.col("e2").alias("u"), F.col("e1").alias("v"), "score"))
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    both = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    gap = (F.col("score") == 0) | (F.col("score") < drop * F.lag("score").over(order))
    both = both.withColumn("cut", F.max(F.coalesce(gap, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.filter(~F.col("cut")).select("u", "v", "score", "rank")


def latest_counts(links: DataFrame) -> DataFrame:
    """(e1, e2, n_read, n_pair): distinct link rows, counts added up per pair; null e2 and self links are left out."""
    d = links.dropDuplicates().filter("e2 is not null and e1 is not null and e1 <> e2")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return d.groupBy("e1", "e2").agg(total("n_read"), total("n_pair"))


def mirrored(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """(v, u, n): read-pair counts for a link and its mirror on the other strand. A link v -> u also counts for
    rc(u) -> rc(v); a link between an edge and its own reverse complement is skipped. Edges without a known reverse
    complement have no mirror."""
    rc = contigs.select("edge_id", "rc_id").filter("rc_id is not null").dropDuplicates()
    n = latest_counts(links).select(F.col("e1").alias("v"), F.col("e2").alias("u"), F.col("n_pair").alias("n"))
    n = n.join(rc.toDF("v", "v_rc"), "v", "left").join(rc.toDF("u", "u_rc"), "u", "left").filter("not (u <=> v_rc)")
    mirror = n.filter("u_rc is not null and v_rc is not null").select(F.col("u_rc").alias("v"), F.col("v_rc").alias("u"), "n")
    return n.select("v", "u", "n").unionByName(mirror).groupBy("v", "u").agg(F.sum("n").alias("n"))


def next_candidate(links: DataFrame, contigs: DataFrame, soft: int = 20, lead: float = 1.3) -> DataFrame:
    """(v, u, n, second): the next contig by read pairs where the best count exceeds ``lead`` * (second + ``soft`` / 2)
    and the candidate is at least 100 long; the least id at ties."""
    n = mirrored(links, contigs).filter("n > 0")
    best = n.groupBy("v").agg(F.max(F.struct("n", (-F.col("u")).alias("u"))).alias("a"))
    rest = n.join(best, "v").filter(F.col("u") != -F.col("a.u")).groupBy("v").agg(F.max("n").alias("second"))
    out = best.join(rest, "v", "left").select("v", (-F.col("a.u")).alias("u"), F.col("a.n").alias("n"), F.coalesce("second", F.lit(0).cast("long")).alias("second"))
    out = out.filter(F.col("n") > lead * (F.col("second") + soft / 2))
    size = contigs.select(F.col("edge_id").alias("u"), "seq_len").dropDuplicates()
    return out.join(size.filter("seq_len >= 100").select("u"), "u", "left_semi").select("v", "u", "n", "second")


def level_of(length: str = "seq_len") -> F.Column:
    """The barcode level that a contig's length asks for: none below 200, L0 below 500, L1 below 3000, else L2."""
    c = F.col(length)
    return F.when(c < 200, None).when(c < 500, "L0").when(c < 3000, "L1").otherwise("L2")


def level_sets(pieces: DataFrame, contigs: DataFrame) -> DataFrame:
    """(edge, level, n): the level chosen by length and how many distinct barcodes the set of that level, or of the
    next lower level that was dumped, holds; 0 where none was."""
    c = contigs.select(F.col("edge_id").alias("edge"), "seq_len").dropDuplicates().withColumn("level", level_of())
    rank = lambda x: F.when(F.col(x) == "L0", 0).when(F.col(x) == "L1", 1).when(F.col(x) == "L2", 2)
    s = set_sizes(pieces).filter("kind in ('L0', 'L1', 'L2')").withColumn("r", rank("kind"))
    c = c.filter("level is not null").withColumn("want", rank("level"))
    j = c.join(s, "edge", "left").withColumn("ok", F.col("r") <= F.col("want"))
    return j.groupBy("edge", "level").agg(F.coalesce(F.max(F.when(F.col("ok"), F.struct("r", "n")))["n"], F.lit(0).cast("long")).alias("n"))


def positive(pieces: DataFrame, links: DataFrame, contigs: DataFrame, ratio: float = 0.044) -> DataFrame:
    """(e1, e2, verdict): for each link whether the contigs share at least ``ratio`` of the smaller L1 set: 1 or 0, and
    null where a contig is shorter than 200 or unknown. Sets meet at the links only, never all against all."""
    m = members(pieces, "L1").select("edge", "key")
    size = m.groupBy("edge").agg(F.count(F.lit(1)).alias("s"))
    pairs = latest_counts(links).filter("e1 < e2").select("e1", "e2")
    length = contigs.select("edge_id", "seq_len").dropDuplicates()
    pairs = pairs.join(length.toDF("e1", "len1"), "e1", "left").join(length.toDF("e2", "len2"), "e2", "left")
    hits = pairs.select("e1", "e2").join(m.toDF("e1", "key"), "e1").join(m.toDF("e2", "key"), ["e2", "key"]).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.join(hits, ["e1", "e2"], "left").join(size.toDF("e1", "s1"), "e1", "left").join(size.toDF("e2", "s2"), "e2", "left")
    enough = F.coalesce("n", F.lit(0)) >= ratio * F.least(F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0)))
    known = (F.col("len1") >= 200) & (F.col("len2") >= 200)
    return p.select("e1", "e2", F.when(known, (enough & F.col("n").isNotNull()).cast("int")).alias("verdict"))


def set_operations(pieces: DataFrame, one: str = "L0", two: str = "L1") -> DataFrame:
    """(edge, n_both, n_one, n_two, n_any): intersection, both differences and union of two kinds of sets of an edge.
    One pass: memberships are grouped per key, no set meets another as a whole."""
    m = members(pieces).filter(F.col("kind").isin(one, two)).groupBy("edge", "key").agg(F.max(F.col("kind") == one).alias("a"), F.max(F.col("kind") == two).alias("b"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return m.groupBy("edge").agg(n(F.col("a") & F.col("b"), "n_both"), n(F.col("a") & ~F.col("b"), "n_one"), n(~F.col("a") & F.col("b"), "n_two"), F.count(F.lit(1)).alias("n_any"))


def dense(links: DataFrame, contigs: DataFrame, ratio: float = 0.005, window: int = 5000, shortest: int = 500) -> DataFrame:
    """(e1, e2, n, density): links between contigs of ``shortest`` or more with n_read per base of both contig ends (up
    to ``window`` bases each) at or above ``ratio``."""
    size = contigs.select("edge_id", "seq_len").dropDuplicates().filter(F.col("seq_len") >= shortest)
    l = latest_counts(links).join(size.toDF("e1", "l1"), "e1").join(size.toDF("e2", "l2"), "e2")
    room = F.least("l1", F.lit(window)) + F.least("l2", F.lit(window))
    return l.filter(F.col("n_read") >= ratio * room).select("e1", "e2", F.col("n_read").alias("n"), F.round(F.col("n_read") / room, 8).alias("density"))


def sparse_degree(pairs: DataFrame, most: int) -> DataFrame:
    """(u, v) links none of whose ends has more than ``most`` links, in and out counted together."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("x"), F.lit(1).alias("one"))
    crowded = ends.groupBy("x").agg(F.count("one").alias("deg")).filter(F.col("deg") > most).select("x")
    return pairs.join(crowded.withColumnRenamed("x", "u"), "u", "left_anti").join(crowded.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v")


def one_strand(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(u, v) links without those from a contig to its own reverse complement and without links of u to both strands
    of one contig."""
    rc = contigs.select("edge_id", "rc_id").filter("rc_id is not null").dropDuplicates()
    p = pairs.join(rc.toDF("v", "v_rc"), "v", "left")
    p = p.filter("not (u <=> v_rc)")
    other = pairs.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    return p.join(other, (p["u"] == F.col("_u")) & (p["v_rc"] == F.col("_v")), "left_anti").select("u", "v")


def without_triangles(pairs: DataFrame) -> DataFrame:
    """(u, v) links without those that a two-step path u -> w -> v makes redundant where u has just two links."""
    two = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("deg")).filter("deg = 2").select("u")
    a = pairs.join(two, "u", "left_semi")
    via = a.select("u", F.col("v").alias("w")).join(pairs.select(F.col("u").alias("w"), "v"), "w").select("u", "v").join(a, ["u", "v"], "left_semi").distinct()
    return pairs.join(via, ["u", "v"], "left_anti").select("u", "v")


def repeat_partners(links: DataFrame, repeats: DataFrame) -> DataFrame:
    """(edge_id, copies, n_edges, n_read): how many contigs link to each repeat contig and by how many reads. The
    repeat table is small and fixed; counts are combined before they leave a task."""
    d = latest_counts(links)
    r = repeats.select("edge_id", "copies").dropDuplicates()
    return d.join(r, d["e2"] == r["edge_id"]).groupBy("edge_id", "copies").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("n_read").alias("n_read"))


def barcode_hits(pieces: DataFrame, confident: float = 0.85) -> DataFrame:
    """(key, n_edges, n_hits, best, is_sure): contigs per barcode of the L1 sets. ``best`` has most counts, the least id
    at ties; it is sure where it has ``confident`` of all counts, or where there are at most two contigs."""
    m = members(pieces, "L1")
    g = m.groupBy("key").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("cnt").cast("long").alias("n_hits"), F.max(F.struct("cnt", (-F.col("edge")).alias("e"))).alias("top"))
    sure = (F.col("n_edges") <= 2) | (F.col("top.cnt") >= confident * F.col("n_hits"))
    return g.select("key", "n_edges", "n_hits", (-F.col("top.e")).alias("best"), sure.alias("is_sure"))


def at_pairs(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """``pairs(e1, e2)`` with n, the barcodes that both sets have. Sets meet at the given pairs only."""
    pairs = pairs.select("e1", "e2").distinct()
    hits = pairs.join(m.select(F.col("edge").alias("e1"), "key"), "e1").join(m.select(F.col("edge").alias("e2"), "key"), ["e2", "key"]).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(hits, ["e1", "e2"], "left").select("e1", "e2", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def adjacent_support(pieces: DataFrame, contigs: DataFrame) -> DataFrame:
    """(e1, e2, n): shared L1 barcodes of contigs that meet at a node, end to start."""
    e = contigs.select("edge_id", "node_from", "node_to").dropDuplicates()
    pairs = e.select(F.col("edge_id").alias("e1"), F.col("node_to").alias("node")).join(e.select(F.col("edge_id").alias("e2"), F.col("node_from").alias("node")), "node").filter("e1 <> e2")
    return at_pairs(pairs, members(pieces, "L1").select("edge", "key"))


def crossing_support(crossings: DataFrame, pieces: DataFrame) -> DataFrame:
    """(edge_id, straight, crossed, verdict): shared barcodes of the legs of a two-in two-out repeat, paired high with
    high and low with low, or high with low. The verdict needs more than twice the other pairing's on both legs
    together, else it is ``open``."""
    c = crossings.select("edge_id", F.explode(F.array(*[F.struct(F.col(f"in_{a}").alias("e1"), F.col(f"out_{b}").alias("e2"), F.lit(a == b).alias("straight")) for a in ("high", "low") for b in ("high", "low")])).alias("x")).select("edge_id", "x.*")
    n = at_pairs(c, members(pieces, "L1").select("edge", "key"))
    g = c.join(n, ["e1", "e2"]).groupBy("edge_id").agg(F.sum(F.when(F.col("straight"), F.col("n")).otherwise(0)).alias("straight"), F.sum(F.when(~F.col("straight"), F.col("n")).otherwise(0)).alias("crossed"))
    verdict = F.when(F.col("straight") > 2 * F.col("crossed"), "straight").when(F.col("crossed") > 2 * F.col("straight"), "crossed").otherwise("open")
    return g.withColumn("verdict", verdict)
