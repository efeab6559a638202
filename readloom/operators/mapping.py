"""Reads onto contigs with sequences: seeds that occur once, the contig of each read, and what pairs and barcodes add up to.

``graph`` is a contig table with ``seq`` on both strands (``unitigs.read_graph``), so k-mers are taken as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed
from ..functions import sequence as S
from ..session import cut, shuffle_width, shuffled
from . import kmers, reads

SEED = 31


def edge_kmers(graph: DataFrame, k: int) -> DataFrame:
    """(hi, lo, edge_id, pos): all k-mers of the contigs and their places from 0."""
    return graph.select("edge_id", "seq").mapInArrow(packed.placed(k, ("edge_id",)), "edge_id long, at int, hi long, lo long").select("hi", "lo", "edge_id", F.col("at").alias("pos"))


def unique_index(graph: DataFrame, k: int = SEED) -> DataFrame:
    """(hi, lo, edge_id, pos): the k-mers that occur once in all contigs."""
    g = edge_kmers(graph, k).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge_id"), F.min("pos").alias("pos"))
    return g.filter("n = 1").drop("n")


def seed_hits(read_rows: DataFrame, index: DataFrame, k: int = SEED) -> DataFrame:
    """(read_id, mate, at, edge_id, pos): seeds of the reads and where they stand in the contigs."""
    q = reads.spread(read_rows).mapInArrow(packed.placed(k, ("read_id", "mate")), "read_id long, mate int, at int, hi long, lo long")
    return q.join(index, ["hi", "lo"]).select("read_id", "mate", "at", "edge_id", "pos")


def read_edges(read_rows: DataFrame, graph: DataFrame, k: int = SEED) -> DataFrame:
    """(read_id, mate, edge_id, hits, start, stop): the contig that most seeds of a read hit, with the first and last place
    hit there; reads whose maximum isn't unique are dropped."""
    h = seed_hits(read_rows, unique_index(graph, k), k).groupBy("read_id", "mate", "edge_id").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("start"), F.max("pos").alias("stop"))
    top = h.groupBy("read_id", "mate").agg(F.max(F.struct("hits", "edge_id", "start", "stop")).alias("m"), F.max("hits").alias("hits"))
    ties = h.join(top.select("read_id", "mate", "hits"), ["read_id", "mate", "hits"]).groupBy("read_id", "mate").agg(F.count(F.lit(1)).alias("c")).filter("c = 1")
    return top.join(ties, ["read_id", "mate"]).select("read_id", "mate", "m.edge_id", "m.hits", "m.start", "m.stop")


def read_paths(read_rows: DataFrame, graph: DataFrame, k: int = SEED) -> DataFrame:
    """(read_id, mate, path, first_at, last_at): the contigs that a read's seeds hit, in the order of the read, neighbours
    on one contig as one; reads that hit more than one."""
    h = seed_hits(read_rows, unique_index(graph, k), k)
    order = Window.partitionBy("read_id", "mate").orderBy("at")
    new = h.withColumn("new", (~F.col("edge_id").eqNullSafe(F.lag("edge_id").over(order))).cast("int"))
    g = new.groupBy("read_id", "mate").agg(F.array_sort(F.collect_list(F.when(F.col("new") == 1, F.struct("at", "edge_id")))).alias("p"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return g.filter(F.size("p") > 1).select("read_id", "mate", F.col("p.edge_id").alias("path"), "first_at", "last_at")


def mapped_pairs(on: DataFrame, graph: DataFrame) -> DataFrame:
    """(e1, e2, n_pair): read pairs of ``read_edges`` whose mates lie on different contigs: from the contig of the first
    mate to the reverse complement of the second one's, as mates face one another."""
    rc = graph.select(F.col("edge_id").alias("m2"), F.col("rc_id").alias("e2"))
    side = lambda m: on.filter(F.col("mate") == m).select("read_id", F.col("edge_id").alias(f"m{m}"))
    p = side(1).join(side(2), "read_id").join(rc, "m2").select(F.col("m1").alias("e1"), "e2").filter("e1 <> e2")
    return p.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_pair"))


def mapped_barcodes(on: DataFrame, read_rows: DataFrame) -> DataFrame:
    """(edge_id, code, n): reads per contig and barcode."""
    tags = reads.barcode_tags(read_rows).filter("code is not null").select("read_id", "mate", "code")
    return on.join(tags, ["read_id", "mate"]).groupBy("edge_id", "code").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(read_rows: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(edge_id, cnt): how often the reads hold the (k+1)-mers of each contig, on either strand."""
    return kmers.held(read_rows, graph, k + 1, "edge_id").groupBy("edge_id").agg(F.sum("n").alias("cnt"))


def junctions(read_rows: DataFrame, graph: DataFrame, k: int, long_k: int) -> DataFrame:
    """(e1, e2, n_kmers, n_missing, longest): contigs that meet at a node, with the ``long_k``-mers that reach over the node
    into both, how many of them no read holds, and the longest run of those."""
    a = graph.select(F.col("edge_id").alias("e1"), F.col("node_to").alias("node"), F.expr(f"right(seq, {long_k - 1})").alias("s1"))
    b = graph.select(F.col("edge_id").alias("e2"), F.col("node_from").alias("node"), F.expr(f"substring(seq, {k + 1}, {long_k - k - 1})").alias("s2"))
    j = a.join(shuffled(b), "node").select("e1", "e2", F.concat("s1", "s2").alias("seq"))
    w = kmers.held(read_rows, j, long_k, "e1", "e2").select("e1", "e2", "at", (F.col("n") == 0).alias("gone"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("e1", "e2", "gone").orderBy("at"))
    islands = w.withColumn("run", run).groupBy("e1", "e2", "gone", "run").agg(F.count(F.lit(1)).alias("c"))
    return islands.groupBy("e1", "e2").agg(F.sum("c").alias("n_kmers"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("c"))), F.lit(0).cast("long")).alias("n_missing"), F.coalesce(F.max(F.when(F.col("gone"), F.col("c"))), F.lit(0).cast("long")).alias("longest"))


READS_OF_BLOCK, SETS_OF_BLOCK = 1 << 10, 1 << 12  # of one barcode
OF_TASK = 1 << 24  # rows of the result that a task makes
FEW = 200_000  # contigs or barcodes, counted before they are broadcast


def reads_of_pairs(read_rows: DataFrame, pairs: DataFrame, members: DataFrame, both: bool = False) -> DataFrame:
    """(e1, e2, read_id, mate, seq, qual): the reads themselves of ``reads.local_reads``, for a local assembly.

    A barcode that very many reads and pairs have makes their product. Its reads and its pairs meet in blocks, so many
    tasks share it, and reads that no pair asks for don't gather in one. Each read meets the list of a block's pairs: equal
    values follow one another, and a columnar file of the result stays small."""
    bx = S.tag(F.col("info"), "BX")
    r = read_rows.select("read_id", "mate", "info", "seq", "qual").filter(bx.rlike(r"^[ACGTN]{18}\z")).withColumn("key", S.base5(bx))
    pairs = cut(pairs.select("e1", "e2"))
    if 2 * pairs.count() <= FEW:
        members = members.join(F.broadcast(pairs.select(F.explode(F.array("e1", "e2")).alias("edge"))), "edge", "left_semi")
    m = members.select("edge", "key").distinct()
    sets = pairs.select("e1", "e2", F.explode(F.array("e1", "e2")).alias("edge")).join(m, "edge").groupBy("e1", "e2", "key").agg(F.count(F.lit(1)).alias("ends"))
    sets = cut((sets.filter("ends = 2") if both else sets).select("e1", "e2", "key"))
    per = r.groupBy("key").agg(F.count(F.lit(1)).alias("n_r")).join(shuffled(sets.groupBy("key").agg(F.count(F.lit(1)).alias("n_s"))), "key", "full").na.fill(0)
    met, hot = (F.col("n_r") > 0) & (F.col("n_s") > 0), (F.col("n_r") > READS_OF_BLOCK) | (F.col("n_s") > SETS_OF_BLOCK)
    per = cut(per.filter(met | hot))
    made, n_met, n_hot = per.agg(F.sum(F.col("n_r").cast("double") * F.col("n_s")), F.count_if(met), F.count_if(hot)).first()
    blocks = per.filter(met if n_met <= FEW else hot).select("key", F.ceil(F.col("n_r") / READS_OF_BLOCK).cast("int").alias("of_r"), F.ceil(F.col("n_s") / SETS_OF_BLOCK).cast("int").alias("of_s"))
    blocks, how = F.broadcast(blocks) if min(n_met, n_hot) <= FEW else blocks, "inner" if n_met <= FEW else "left"

    def in_blocks(rows: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        """Each row in a block of its own side, once for each block of the other side."""
        n = F.coalesce(other, F.lit(1))
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return rows.join(blocks, "key", how).select(*rows.columns, F.pmod(F.xxhash64(*by), F.coalesce(own, F.lit(1))).cast("int").alias(own), F.explode(every).alias(other))

    at = ["key", "of_r", "of_s"]
    n = max(shuffle_width(read_rows.sparkSession), int((made or 0) // OF_TASK) + 1)
    r = reads.clean(in_blocks(r, "of_r", "of_s", "read_id", "mate").repartition(n, *at))
    sets = in_blocks(sets, "of_s", "of_r", "e1", "e2").repartition(n, *at).groupBy(*at).agg(F.collect_list(F.struct("e1", "e2")).alias("of"))
    return r.join(shuffled(sets), at).select(F.inline("of"), "read_id", "mate", "seq", "qual")


def spliced(pairs: DataFrame, k: int, gap: int, fill: str, trim: int) -> DataFrame:
    """(read_id, overlapped, gapped, hole_pos, filled) of ``pairs(read_id, s1, s2)``: both texts as one with an overlap of k,
    with a gap of ``gap`` N whose place is ``hole_pos``, and with ``fill`` between them after ``trim`` bases are taken off
    both inner ends. Texts of k bases or fewer have no overlapped form."""
    both = (F.length("s1") > k) & (F.length("s2") > k)
    cut1, cut2 = F.expr(f"left(s1, greatest(0, length(s1) - {trim}))"), F.expr(f"substring(s2, {trim + 1})")
    return pairs.select(
        "read_id", F.when(both, S.joined(F.array("s1", "s2"), k)).alias("overlapped"), S.spaced(F.array("s1", "s2"), gap).alias("gapped"), F.length("s1").alias("hole_pos"), F.concat(cut1, F.lit(fill), cut2).alias("filled")
    )
