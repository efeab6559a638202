"""K-mer counts of reads and k-mer tables. K-mers with a letter other than A, C, G, T are left out everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed
from ..functions import sequence as S
from ..session import shuffle_width
from .reads import spread

CAP = 999


def read_kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """(*keep, kmer): every k-mer of every distinct read row. Short, empty and null reads have none."""
    r = spread(reads)
    return r.select(*keep, F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).filter(S.is_acgt(F.col("kmer")))


def packed_counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(hi, lo, n): canonical k-mers of up to 62 bases as two integers (``functions.packed``), seen ``least`` times or
    more. Counts are combined before the shuffle, which moves two integers and a count per k-mer."""
    c = spread(reads).select("seq").mapInArrow(packed.counted(k), "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return c.filter(F.col("n") >= least) if least > 1 else c


def buckets(df: DataFrame) -> int:
    """Buckets of stretches: several in a partition, so that one is small in memory."""
    return 8 * shuffle_width(df.sparkSession)


def stretches(reads: DataFrame, k: int, joints: bool = False) -> DataFrame:
    """(bucket, bases, sizes): the reads cut into stretches by the minimizer of their k-mers (``packed.bucketed``). All that
    is known of a k-mer meets in one bucket, and neighbours move together, as a few bytes instead of a row each."""
    n = shuffle_width(reads.sparkSession)
    return spread(reads).select("seq").mapInArrow(packed.bucketed(k, buckets(reads), joints), "bucket long, bases binary, sizes binary").repartition(n, "bucket")


def _held(k: int, keep: tuple[str, ...]):
    """Per bucket: how often the reads hold each k-mer of the pieces of texts."""

    def run(_, reads, texts):
        pieces, at = texts.column("piece").to_pylist(), texts.column("at").to_numpy()
        size = np.array([len(p) - k + 1 for p in pieces], np.int64)
        if not len(size):
            return pa.table({**{c: pa.array([], pa.int64()) for c in keep}, "at": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        known = packed.bucket_counts(zip(reads.column("bases").to_pylist(), reads.column("sizes").to_pylist()), k)[:3]
        places = packed._flat(np.r_[0, np.cumsum(size + k - 1)[:-1]], size)
        n = packed.found_in(*known, *(x[places] for x in packed.canonical_windows(packed.codes_of("".join(pieces)), k)))
        row = np.repeat(np.arange(len(size)), size)
        return pa.table({**{c: texts.column(c).to_numpy()[row] for c in keep}, "at": packed._flat(at, size).astype(np.int32), "n": n})

    return run


def held(reads: DataFrame, texts: DataFrame, k: int, *keep: str) -> DataFrame:
    """(*keep, at, n): each k-mer of ``texts(*keep, seq)`` with its place from 0, and how often the reads hold it on either
    strand. ``keep`` are integers."""
    n = shuffle_width(reads.sparkSession)
    kept = "".join(f"{c} long, " for c in keep)
    t = texts.select(*keep, "seq").mapInArrow(packed.bucketed_texts(k, buckets(reads), keep), f"{kept}bucket long, at int, piece string").repartition(n, "bucket")
    return stretches(reads, k).groupBy("bucket").cogroup(t.groupBy("bucket")).applyInArrow(_held(k, keep), f"{kept}at int, n long")


def counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(kmer, n): canonical k-mers that occur ``least`` times or more."""
    return packed_counts(reads, k, least).select(packed.text(F.col("hi"), F.col("lo"), k).alias("kmer"), "n")


def spectrum(reads: DataFrame, k: int) -> DataFrame:
    """(n, kmers): how many canonical k-mers occur n times."""
    return packed_counts(reads, k).groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


def adjacency(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(kmer, mask, n): 8-bit neighbour masks from (k+1)-mers.

    Bit b of the low half: base b follows the canonical k-mer; bit b of the high half: base b follows its reverse
    complement. ``n`` is the number of (k+1)-mers that the k-mer is an end of."""
    pair = packed_counts(reads, k + 1).mapInArrow(packed.both_strands(k + 1), "hi long, lo long, n long")
    hi, lo = F.col("hi"), F.col("lo")
    # on either strand the first k bases are followed by the last one; a k-mer's reverse complement is the other strand's
    first, last = packed.without_last(hi, lo, k + 1), lo.bitwiseAND(F.lit(3)).cast("int")
    end = pair.select(first[0].alias("hi"), first[1].alias("lo"), last.alias("base"), "n")
    end = end.groupBy("hi", "lo").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("base"))).alias("out"), F.sum("n").alias("n")).mapInArrow(_canonical(k), "hi long, lo long, mask int, n long")
    g = end.groupBy("hi", "lo").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n")).filter(F.col("n") >= least)
    return g.select(packed.text(F.col("hi"), F.col("lo"), k).alias("kmer"), "mask", "n")


def _canonical(k: int):
    """Masks of oriented k-mers moved to the canonical strand: the low half for its own, the high half for the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, out = (batch.column(c).to_numpy() for c in ("hi", "lo", "out"))
            rhi, rlo = packed.reverse(hi, lo, k)
            swap = (rhi < hi) | ((rhi == hi) & (rlo < lo))
            mask = np.where(swap, out << 4, out).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, rhi, hi)), pa.array(np.where(swap, rlo, lo)), pa.array(mask), batch.column("n")], ["hi", "lo", "mask", "n"])

    return run


def table_kmers(slots: DataFrame, k: int = 31) -> DataFrame:
    """(key, kmer, adj, n_slots): distinct slots of a k-mer table with decoded k-mers and all their adjacency bits."""
    s = slots.dropDuplicates().filter(F.col("keys").isNotNull())
    s = s.groupBy(F.col("keys").alias("key")).agg(F.bit_or(F.coalesce("adjs", F.lit(0))).alias("adj"), F.count(F.lit(1)).alias("n_slots"))
    return s.select("key", S.from_two_bit(F.col("key"), k).alias("kmer"), "adj", "n_slots")


def branching(slots: DataFrame) -> DataFrame:
    """(key, n_out, n_in, kind): node kind by the degrees in the adjacency mask; ``pass`` has one edge on each side."""
    t = table_kmers(slots)
    n_out, n_in = F.bit_count(F.col("adj").bitwiseAND(15)), F.bit_count(F.col("adj").bitwiseAND(240))
    kind = F.when((n_out == 1) & (n_in == 1), "pass").when((n_out == 0) & (n_in == 0), "lone").when((n_out == 0) | (n_in == 0), "end").otherwise("branch")
    return t.select("key", n_out.cast("int").alias("n_out"), n_in.cast("int").alias("n_in"), kind.alias("kind"))


def support(reads: DataFrame, slots: DataFrame, k: int = 31) -> DataFrame:
    """(key, n): how often the reads hold each k-mer of the table on either strand, at most 999; 0 if never."""
    t = slots.select(F.col("keys").alias("key")).filter("key is not null").distinct().withColumn("kmer", S.canonical(S.from_two_bit(F.col("key"), k)))
    return t.join(counts(reads, k), "kmer", "left").select("key", F.least(F.coalesce("n", F.lit(0).cast("long")), F.lit(CAP)).alias("n"))


def missing(reads: DataFrame, slots: DataFrame, k: int = 31) -> DataFrame:
    """(key) of table k-mers that no read holds on either strand."""
    t = slots.select(F.col("keys").alias("key")).filter("key is not null").distinct().withColumn("kmer", S.canonical(S.from_two_bit(F.col("key"), k)))
    return t.join(counts(reads, k).select("kmer"), "kmer", "left_anti").select("key")


def mate_match(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, matches): size of the multiset intersection of both mates' canonical k-mers; pairs with one only."""
    c = read_kmers(reads, k, "read_id", "mate").groupBy("read_id", S.canonical(F.col("kmer")).alias("kmer"))
    c = c.agg(F.count(F.when(F.col("mate") == 1, 1)).alias("a"), F.count(F.when(F.col("mate") == 2, 1)).alias("b"))
    return c.groupBy("read_id").agg(F.sum(F.least("a", "b")).alias("matches")).filter("matches > 0")
