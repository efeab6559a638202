"""The compacted de Bruijn graph of reads: unitigs as contigs of a graph with sequences.

Oriented (k+1)-mers are pairs of integers, k odd and at most 61. A (k+1)-mer continues another one where the k-mer
between them has one before it and one after it. The runs come by pointer doubling over all (k+1)-mers at once, not by
walking from node to node; ids come by sorting, not by a counter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed
from ..functions import sequence as S
from ..session import cut, shuffle_width, shuffled
from . import kmers
from .graph import list_positions


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row in the order of ``by``. Rows are sorted by ranges; a range
    adds the sizes of those before it, so no task sees all rows. Values of ``by`` are distinct."""
    ranged = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    ranged = ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1 + F.col("_before")
    return ranged.withColumn(name, place.cast("long")).drop("_range", "_before")


PIECES = [(c, pa.int64()) for c in ("hi", "lo", "phi", "plo", "first_hi", "first_lo")] + [("body", pa.string()), ("n_ids", pa.int64()), ("n", pa.int64())]
PIECE = "hi long, lo long, phi long, plo long, first_hi long, first_lo long, body string, n_ids long, n long"


def _checked(k: int) -> None:
    if k % 2 == 0 or k >= packed.MOST:
        raise ValueError("k must be odd and below 62: an even k has k-mers that are their own reverse complement")


def _oriented(reads: DataFrame, k: int, least: int) -> DataFrame:
    """(id, a, b, n): (k+1)-mers of both strands seen ``least`` times and the k-mers at their ends, all as (hi, lo)."""
    _checked(k)
    both = cut(kmers.packed_counts(reads, k + 1, least).mapInArrow(packed.both_strands(k + 1), "hi long, lo long, n long"))
    ends = (f(F.col("hi"), F.col("lo"), k + 1) for f in (packed.without_last, packed.without_first))
    return both.select(F.struct("hi", "lo").alias("id"), *[F.struct(hi.alias("hi"), lo.alias("lo")).alias(c) for c, (hi, lo) in zip("ab", ends)], "n")


def _near(m: int):
    """Rows with the bucket of their m-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = packed.minimizers(batch.column("hi").to_numpy(), batch.column("lo").to_numpy(), m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], [*batch.schema.names, "bucket"])

    return run


def _chains(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, place) of each row by the row before it (-1 at a head). A ring opens at its first row."""
    prev = prev.copy()
    while True:
        jump, place, head, low = prev.copy(), (prev >= 0).astype(np.int64), np.arange(len(prev)), np.arange(len(prev))
        head = np.where(prev >= 0, prev, head)
        for _ in range(len(prev).bit_length() + 1):
            at = np.flatnonzero(jump >= 0)
            if not len(at):
                return head, place
            to = jump[at]
            low[at] = np.minimum(low[at], low[to])
            place[at] += place[to]
            head[at], jump[at] = np.where(jump[to] >= 0, jump[to], head[to]), jump[to]
        prev[np.unique(low[jump >= 0])] = -1


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs inside one partition: (hi, lo) of the last m-mer, that before the first one, the first one, the letters
    that the m-mers end with, their number and counts."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    hi, lo, n, phi, plo = (t[c].fill_null(-1).combine_chunks().to_numpy() for c in ("hi", "lo", "n", "phi", "plo"))
    prev = np.where(phi < 0, -1, pd.MultiIndex.from_arrays([hi, lo]).get_indexer(pd.MultiIndex.from_arrays([phi, plo])))
    yield _pieces(hi, lo, n, phi, plo, prev)


def _pieces(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, phi: np.ndarray, plo: np.ndarray, prev: np.ndarray) -> pa.RecordBatch:
    """The runs of m-mers by the row ``prev`` before each, -1 where (phi, plo) is elsewhere or -1 itself."""
    head, place = _chains(prev)
    order = np.lexsort((place, head))
    starts = np.flatnonzero(np.r_[True, np.diff(head[order]) != 0])
    ends = np.r_[starts[1:], len(order)]
    letters = np.frombuffer(b"ACGT", np.uint8)[lo[order] & 3].tobytes().decode()
    first, last = order[starts], order[ends - 1]
    open_start = phi[first] < 0
    before = [pa.array(x[first], pa.int64(), mask=open_start) for x in (phi, plo)]
    cols = [pa.array(hi[last]), pa.array(lo[last]), *before, pa.array(hi[first]), pa.array(lo[first]), pa.array([letters[i:j] for i, j in zip(starts, ends)], pa.string()), pa.array(ends - starts), pa.array(np.add.reduceat(n[order], starts))]
    return pa.RecordBatch.from_arrays(cols, ["hi", "lo", "phi", "plo", "first_hi", "first_lo", "body", "n_ids", "n"])


def _one_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) for the values that both have once; a and b are (hi, lo)."""
    hi, lo = (np.r_[x, y] for x, y in zip(a, b))
    of_b = np.r_[np.zeros(len(a[0]), np.int64), np.ones(len(b[0]), np.int64)]
    order = np.lexsort((of_b, lo, hi))
    hi, lo, of_b = hi[order], lo[order], of_b[order]
    first = np.flatnonzero(np.r_[True, (np.diff(hi) != 0) | (np.diff(lo) != 0)]) if len(hi) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(hi)])
    first = first[size == 2]
    first = first[(of_b[first] == 0) & (of_b[first + 1] == 1)]
    return order[first], order[first + 1] - len(a[0])


def _bucket_pieces(k: int, least: int):
    """The runs of oriented (k+1)-mers inside one bucket of k-mers. The bucket has all (k+1)-mers at its k-mers, so it
    knows what follows what across them; it lists those that start with one, and names what stands before."""

    def run(_, t):
        hi, lo, n, flags = packed.bucket_counts(zip(t.column("bases").to_pylist(), t.column("sizes").to_pylist()), k + 1)
        hi, lo, n, flags = (x[n >= least] for x in (hi, lo, n, flags))
        rhi, rlo = packed.reverse(hi, lo, k + 1)
        other = (rhi != hi) | (rlo != lo)
        turned = flags >> 1 | (flags & 1) << 1
        hi, lo, n, flags = (np.r_[x, y[other]] for x, y in ((hi, rhi), (lo, rlo), (n, n), (flags, turned)))
        own, ends = np.flatnonzero(flags & 1 == 0), np.flatnonzero(flags & 2 == 0)
        after, before = _one_each(packed.first_bases(hi[own], lo[own], k + 1), packed.last_bases(hi[ends], lo[ends], k + 1))
        before = ends[before]
        after, before = (x[own[after] != before] for x in (after, before))
        prev, phi, plo = (np.full(len(own), -1, np.int64) for _ in range(3))
        place = np.full(len(hi), -1, np.int64)
        place[own] = np.arange(len(own))
        prev[after], phi[after], plo[after] = place[before], hi[before], lo[before]
        return pa.Table.from_batches([_pieces(hi[own], lo[own], n[own], phi, plo, prev)] if len(own) else [], pa.schema(PIECES))

    return run


def _turned(m: int):
    """Rings as text from their least m-mer on; ``body`` has the letters that their m-mers end with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column("body").to_pylist():
                twice = body * (m // len(body) + 2)
                at = min(range(len(body)), key=lambda i: twice[i : i + m])
                out.append((twice + body)[at : at + len(body) + m - 1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("n_ids"), batch.column("n")], ["seq", "n_ids", "n"])

    return run


def _spelled(ids: DataFrame, follows: DataFrame, m: int) -> DataFrame:
    """(seq, n_ids, n, is_cycle): the runs of m-mers ``ids(id, n)`` by ``follows(id, prev)``. A ring opens at its least
    m-mer.

    Neighbours mostly share a minimizer, so runs are first put together inside partitions by minimizer, in one shuffle;
    the rounds that rank lists see only the pieces."""
    linked = ids.join(shuffled(follows), "id", "left").select("id.hi", "id.lo", "n", F.col("prev.hi").alias("phi"), F.col("prev.lo").alias("plo"))
    near = linked.mapInArrow(_near(m), "hi long, lo long, n long, phi long, plo long, bucket long").repartition(shuffle_width(ids.sparkSession), "bucket")
    return _put_together(near.mapInArrow(_segments, PIECE), m)


def _put_together(pieces: DataFrame, m: int) -> DataFrame:
    """(seq, n_ids, n, is_cycle) of ``pieces``: their runs, ranked round by round."""
    piece = cut(pieces.withColumn("num", F.monotonically_increasing_id()))  # the rounds move one integer for an id
    before = piece.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("num").alias("prev"))
    follows = piece.select(F.col("num").alias("id"), "phi", "plo").join(shuffled(before), ["phi", "plo"], "left").select("id", "prev")
    pos = cut(list_positions(follows).join(shuffled(piece.select(F.col("num").alias("id"), "first_hi", "first_lo", "body", "n_ids", "n")), "id"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "").alias("body")
    sums = [F.sum("n_ids").alias("n_ids"), F.sum("n").alias("n")]
    start = F.min(F.when(F.col("pos") == 0, F.struct("first_hi", "first_lo"))).alias("s")
    line = pos.filter("not is_cycle").groupBy("head").agg(body, start, *sums)
    line = line.select(F.concat(F.substring(packed.text(F.col("s.first_hi"), F.col("s.first_lo"), m), 1, m - 1), "body").alias("seq"), "n_ids", "n", F.lit(False).alias("is_cycle"))
    ring = pos.filter("is_cycle")
    opened = list_positions(ring.select("id", "head").join(shuffled(follows), "id").select("id", F.when(F.col("id") != F.col("head"), F.col("prev")).alias("prev")))
    ring = opened.select("id", "head", "pos").join(shuffled(ring.select("id", "body", "n_ids", "n")), "id").groupBy("head").agg(body, *sums).select("body", "n_ids", "n")
    return line.unionByName(ring.mapInArrow(_turned(m), "seq string, n_ids long, n long").withColumn("is_cycle", F.lit(True)))


def runs(reads: DataFrame, k: int, least: int) -> DataFrame:
    """(seq, n_ids, n, is_cycle): all maximal runs of oriented (k+1)-mers, on both strands, with their counts added up."""
    _checked(k)
    return _put_together(kmers.stretches(reads, k, joints=True).groupBy("bucket").applyInArrow(_bucket_pieces(k, least), PIECE), k + 1)


def read_graph(reads: DataFrame, k: int = 45, least: int = 2) -> DataFrame:
    """The graph as contigs with sequences: (edge_id, rc_id, node_from, node_to, graph, seq_len, cnt, holes, seq).

    Contigs are unitigs between k-mers that don't have one edge in and one out; both strands are rows of their own, a
    palindrome is its own reverse complement. ids follow the order of the sequences of the lesser strands: 2 i and
    2 i + 1 for its reverse complement; nodes are numbered in the order of their k-mers. ``cnt`` adds up the counts of
    the (k+1)-mers. Rings without a branch have no end and are left out."""
    rows = runs(reads, k, least).filter("not is_cycle").withColumn("rc", S.revcomp(F.col("seq")))
    one = numbered(rows.filter("seq <= rc").select("seq", "rc", F.col("n").alias("cnt")), "seq", "i")
    strand = F.explode(F.when(F.col("seq") == F.col("rc"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("s")
    e = cut(one.select("i", "cnt", "seq", "rc", strand))
    own = F.when(F.col("s") == 0, F.col("seq")).otherwise(F.col("rc"))
    twin = F.when(F.col("seq") == F.col("rc"), 2 * F.col("i")).otherwise(2 * F.col("i") + 1 - F.col("s"))
    e = e.select((2 * F.col("i") + F.col("s")).alias("edge_id"), twin.alias("rc_id"), own.alias("seq"), "cnt").withColumns({"_u": F.substring("seq", 1, k), "_v": F.expr(f"right(seq, {k})")})
    nodes = numbered(e.select(F.explode(F.array("_u", "_v")).alias("kmer")).distinct(), "kmer", "node")
    e = e.join(shuffled(nodes.select(F.col("kmer").alias("_u"), F.col("node").alias("node_from"))), "_u").join(shuffled(nodes.select(F.col("kmer").alias("_v"), F.col("node").alias("node_to"))), "_v")
    none = F.array().cast("array<struct<pos:int,len:int>>")
    return e.select("edge_id", "rc_id", "node_from", "node_to", F.lit("global" if k == 45 else "local").alias("graph"), F.length("seq").alias("seq_len"), "cnt", none.alias("holes"), "seq")


def unitigs(reads: DataFrame, k: int = 31, least: int = 2) -> DataFrame:
    """(seq, n_kmers, is_cycle): runs of k-mers that have one step in and one out, each once, as the lesser of both
    strands; ``least`` counts the (k+1)-mers of the steps. A ring is opened at its least k-mer and marked. k-mers without
    any step are no part of the graph; k-mers with N are left out."""
    step = cut(_oriented(reads, k, least).select("a", "b"))
    one_out = step.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).filter("n = 1").select("a", "b")
    one_in = step.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("b")
    bases = lambda c: packed.text(F.col(f"{c}.hi"), F.col(f"{c}.lo"), k)
    # a k-mer doesn't follow its own reverse complement: the run would turn into itself
    follows = one_out.join(shuffled(one_in), "b").filter("a <> b").filter(bases("b") != S.revcomp(bases("a"))).select(F.col("b").alias("id"), F.col("a").alias("prev"))
    ids = step.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("n", F.lit(1).cast("long"))
    rows = _spelled(ids, follows, k).select("seq", F.col("n_ids").alias("n_kmers"), "is_cycle")
    straight = rows.filter("not is_cycle").select(S.canonical(F.col("seq")).alias("seq"), "n_kmers", "is_cycle").distinct()
    rings = rows.filter("is_cycle")  # the other strand opens at another k-mer: keep the strand with the lesser start
    least_kmer = lambda c: F.array_min(F.transform(F.sequence(F.lit(1), F.col("n_kmers").cast("int")), lambda i: F.substring(c, i, F.lit(k))))
    rings = rings.filter(F.substring("seq", 1, k) <= least_kmer(S.revcomp(F.col("seq"))))
    return straight.unionByName(rings)
