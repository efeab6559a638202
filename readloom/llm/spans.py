"""Long exact spans shared between records, by an FM-index per shard.

A record is an ordered list of entries. Its symbols are the steps between neighbouring entries, (value, gap, next
value), so a span of m entries is a run of m - 1 symbols and two spans are equal exactly if their symbols are.

Every window of m - 1 symbols goes to the shard of its least symbol (hash order), together with the stretch of the
record around it that has the same least symbol. Equal windows have the same least symbol, so they meet in one shard
although no shard sees more than its part of the corpus. A shard concatenates its stretches, builds the FM-index
(suffix array, Burrows-Wheeler transform, wavelet matrix with rank counts) and streams the stretches against it:
backward search gives, for each place, the longest match that also occurs in another record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = "shard long, edge long, p0 long, mm array<long>, gaps array<long>"


def pieces(entries: DataFrame, m: int, width: int = 4096) -> DataFrame:
    """(edge, own, run): sorted distinct entries of each record in blocks of ``width`` positions, each with the first
    m - 1 entries that follow it. A record of any length is thus split over tasks; only one row per block passes the
    window. ``entries`` has edge, p, mm; null p are no entries; of several mm at one p the order is by mm, null first.
    """
    e = entries.filter(F.col("p").isNotNull() & F.col("edge").isNotNull()).select("edge", F.col("p").cast("long").alias("p"), "mm")
    block = e.groupBy("edge", F.floor(F.col("p") / width).alias("block")).agg(F.array_sort(F.collect_set(F.struct("p", F.coalesce(F.col("mm").isNotNull(), F.lit(False)).alias("ok"), "mm"))).alias("own"))
    after = Window.partitionBy("edge").orderBy("block").rowsBetween(1, m - 1)
    tail = F.slice(F.flatten(F.collect_list(F.slice("own", 1, m - 1)).over(after)), 1, m - 1)
    return block.select("edge", F.concat("own", tail).alias("run"))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _lists(x: np.ndarray, first: np.ndarray, lens: np.ndarray) -> pa.Array:
    """x[first[i] : first[i] + lens[i]] as one list each."""
    ends = np.cumsum(lens)
    take = np.repeat(first - ends + lens, lens) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(x[take].astype(np.int64)))


def _stretches(m: int):
    w = m - 1  # symbols of a window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run")
            offsets = runs.offsets.to_numpy()
            flat = runs.flatten()
            shift = offsets[0]
            P = flat.field("p").to_numpy(zero_copy_only=False)
            ok = flat.field("ok").to_numpy(zero_copy_only=False)
            V = flat.field("mm").fill_null(0).to_numpy(zero_copy_only=False)
            edges = batch.column("edge").to_numpy()
            n = len(P)
            if n < m:
                continue
            new = np.zeros(n, bool)
            new[offsets[:-1][offsets[:-1] - shift < n] - shift] = True
            good = ok[:-1] & ok[1:] & ~new[1:]  # step i joins entries i and i + 1
            h = _mix(V[:-1].astype(np.uint64) ^ _mix(V[1:].astype(np.uint64) ^ _mix((P[1:] - P[:-1]).astype(np.uint64))))
            steps = len(h)
            if steps < w:
                continue
            view = np.lib.stride_tricks.sliding_window_view
            fit = view(good, w).all(axis=1)  # windows that are spans
            least = view(h, w).min(axis=1)
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            cut = np.r_[True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])]
            first = at[cut]
            last = at[np.r_[cut[1:], True]]
            owner = edges[np.searchsorted(offsets - shift, first, side="right") - 1]
            lens = last + m - first  # entries of the stretch
            yield pa.RecordBatch.from_arrays(
                [pa.array(least[first].view(np.int64)), pa.array(owner), pa.array(P[first]), _lists(V, first, lens), _lists(np.diff(P), first, lens - 1)], ["shard", "edge", "p0", "mm", "gaps"]
            )

    return run


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit vector per level, with a running count per 64-bit word."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.n, self.levels = len(seq), []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = (seq >> bit) & 1
            words = np.packbits(np.r_[b, np.zeros(-len(b) % 64 + 64, b.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))][:-1]
            self.levels.append((bit, words, counts, int(len(b) - b.sum())))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        word, part = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << part) - np.uint64(1)
        return counts[word] + np.bitwise_count(words[word] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """How often each c occurs before each i."""
        lo = np.zeros(len(c), np.int64)
        hi = i.astype(np.int64)
        for bit, words, counts, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = self._ones(words, counts, lo), self._ones(words, counts, hi)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By doubling: rank pairs until all differ."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])]
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


def shared_spans(docs: np.ndarray, lens: np.ndarray, mm: np.ndarray, gaps: np.ndarray, m: int) -> np.ndarray:
    """Which entries lie in a span of m or more that also occurs in another document.

    Stretch i has ``lens[i]`` entries and belongs to ``docs[i]``; ``mm`` are the entries one stretch after another,
    ``gaps`` the distance of each to its next one, anything for the last of a stretch.
    """
    n = len(mm)
    owner = np.repeat(docs, lens)
    inner = np.ones(n, bool)
    inner[np.cumsum(lens) - 1] = False  # the place of the last entry holds the separator, symbol 0
    at = np.flatnonzero(inner)
    if not len(at):
        return np.zeros(n, bool)
    step = np.zeros(n, np.int64)
    step[at] = pd.DataFrame({"a": mm[at], "g": gaps[at], "b": mm[at + 1]}).groupby(["a", "g", "b"], sort=False).ngroup().to_numpy() + 1
    sigma = int(step.max()) + 1
    sa = suffix_array(step)
    tree = WaveletMatrix(step[sa - 1], sigma)
    less = np.r_[0, np.cumsum(np.bincount(step, minlength=sigma))]
    change = np.flatnonzero(np.diff(owner[sa]) != 0) + 1
    other = np.r_[change, n + 1][np.searchsorted(change, np.arange(n), side="right")]  # next suffix of another document
    lo, hi, length = less[step[at]], less[step[at] + 1], 1
    alive = other[lo] < hi
    at, lo, hi = at[alive], lo[alive], hi[alive]
    cover = np.zeros(n + 2, np.int64)
    while len(at):  # matching statistics: extend to the left while another document has the match too
        c = np.where(at >= length, step[at - length], 0)
        below, above = less[c] + tree.rank(c, lo), less[c] + tree.rank(c, hi)
        go = (c > 0) & (below < above)
        go[go] = other[below[go]] < above[go]
        if length >= m - 1:
            np.add.at(cover, at[~go] - length + 1, 1)
            np.add.at(cover, at[~go] + 2, -1)
        at, lo, hi, length = at[go], below[go], above[go], length + 1
    return np.cumsum(cover[:n]) > 0


FLAGGED = "shard long, mm array<long>, gaps array<long>, hits array<boolean>"


def _index(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks()
        mms, gaps = t["mm"].chunk(0), t["gaps"].chunk(0)
        lens = mms.value_lengths().to_numpy().astype(np.int64)
        lo, hi = t["lo"].to_numpy(), t["hi"].to_numpy()
        several = lo != hi
        docs = np.where(several, -1 - np.arange(len(lens)), np.unique(lo, return_inverse=True)[1])
        ends = np.cumsum(lens)
        gap = np.zeros(ends[-1], np.int64)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        gap[inner] = gaps.flatten().to_numpy()
        hit = shared_spans(docs, lens, mms.flatten().to_numpy(), gap, m) | np.repeat(several, lens)
        keep = np.add.reduceat(hit, ends - lens) > 0
        hits = pa.ListArray.from_arrays(mms.offsets if mms.offset == 0 else pa.array(np.r_[0, ends].astype(np.int32)), pa.array(hit))
        out = pa.Table.from_arrays([t["shard"], t["mm"], t["gaps"], hits], ["shard", "mm", "gaps", "hits"]).filter(pa.array(keep))
        yield from out.to_batches(max_chunksize=10_000)

    return run


def shared_entries(entries: DataFrame, m: int = 12, stretches_per_shard: int = 200_000, hot: int = 100_000) -> DataFrame:
    """(edge, p): entries in a span of ``m`` or more neighbouring entries that occurs equal in another record.

    Equal stretches of several records are indexed once and joined back, so a passage in a third of all records is one
    document of the index. A least symbol with more than ``hot`` stretches doesn't fill one shard: its windows are
    spread by their own content, which still brings equal ones together. Entries with a null position or edge are
    none; a null mm ends a span; repeated rows count once; records shorter than m and empty tables give no rows.
    """
    from ..session import cut, shuffle_width

    st = cut(pieces(entries, m).mapInArrow(_stretches(m), STRETCH))
    counts = st.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    n, crowded = counts.agg(F.sum("n"), F.count(F.when(F.col("n") > hot, 1))).first()
    if crowded:
        st = st.join(counts.filter(F.col("n") > hot).select("shard", F.lit(True).alias("is_hot")), "shard", "left")
        window = st.filter("is_hot").select("edge", "p0", "mm", "gaps", F.explode(F.sequence(F.lit(0), F.size("mm") - m)).alias("i"))
        window = window.select(
            "edge", (F.col("p0") + F.aggregate(F.slice("gaps", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("p0"), F.slice("mm", F.col("i") + 1, m).alias("mm"), F.slice("gaps", F.col("i") + 1, m - 1).alias("gaps")
        )
        st = st.filter("is_hot is null").select("shard", "edge", "p0", "mm", "gaps").unionByName(window.withColumn("shard", F.xxhash64("mm", "gaps")))
    contents = st.groupBy("shard", "mm", "gaps").agg(F.min("edge").alias("lo"), F.max("edge").alias("hi"))
    shards = max(shuffle_width(st.sparkSession), -(-(n or 0) // stretches_per_shard))
    flagged = contents.repartition(shards, "shard").mapInArrow(_index(m), FLAGGED)
    found = st.join(flagged, ["shard", "mm", "gaps"])
    steps = F.concat(F.array(F.lit(0).cast("long")), F.col("gaps"))
    offset = F.transform(F.sequence(F.lit(1), F.size("mm")), lambda i: F.aggregate(F.slice(steps, 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    at = found.select("edge", F.explode(F.arrays_zip(F.transform(offset, lambda o: o + F.col("p0")).alias("p"), F.col("hits").alias("hit"))).alias("x"))
    return at.filter("x.hit").select("edge", F.col("x.p").cast("int").alias("p")).distinct()


def records(db: DataFrame, align: DataFrame) -> DataFrame:
    """The entries (edge, p, mm) of both minimizer tables."""
    return db.select("edge", "p", "mm").unionByName(align.select("edge", F.col("pos").alias("p"), "mm"))


def shared_share(entries: DataFrame, m: int = 12) -> DataFrame:
    """(edge, n_entries, n_shared): how much of each record is shared elsewhere; 0 where nothing is."""
    all_entries = entries.filter(F.col("p").isNotNull() & F.col("edge").isNotNull()).select("edge", "p", "mm").distinct().groupBy("edge").agg(F.count(F.lit(1)).alias("n_entries"))
    shared = shared_entries(entries, m).groupBy("edge").agg(F.count(F.lit(1)).alias("n_shared"))
    return all_entries.join(shared, "edge", "left").select("edge", "n_entries", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))
