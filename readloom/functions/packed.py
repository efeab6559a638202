"""K-mers of up to 62 bases as two integers, in numpy inside Arrow batches.

A k-mer is the pair (hi, lo): ``lo`` has the 2-bit codes of its last 31 bases, ``hi`` those before them (A C G T = 0..3,
first base most significant), so the order of pairs is the order of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import from_two_bit

LOW = 31  # bases of the second integer
MOST = 2 * LOW
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _pack(codes: np.ndarray, m: int) -> np.ndarray:
    """The code of the m bases from each place on, by joining codes of powers of two."""
    block, size = codes, 1
    out, done = None, 0
    while m - done:
        if m & size:
            piece = block[done : len(codes) - m + 1 + done]
            # pieces come from short to long; each one stands after those before it
            out = piece if out is None else (out << np.uint64(2 * size)) | piece
            done += size
        if 2 * size <= m:
            block = (block[: len(block) - size] << np.uint64(2 * size)) | block[size:]
        size *= 2
    return out


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the k-mer at each place of a run of base codes."""
    c = codes.astype(np.uint64)
    n = len(c) - k + 1
    if k <= LOW:
        return np.zeros(n, np.int64), _pack(c, k).view(np.int64)
    return _pack(c, k - LOW)[:n].view(np.int64), _pack(c, LOW)[k - LOW :].view(np.int64)


def _of_batch(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical k-mers of all sequences; those with a letter other than A, C, G, T are left out."""
    codes = _CODE[np.frombuffer("-".join(seqs).encode("latin-1", "replace"), np.uint8)]
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.r_[0, np.cumsum(codes > 3)]
    ok = bad[k:] == bad[:-k]
    bases = codes & 3
    hi, lo = (x[ok] for x in windows(bases, k))
    rhi, rlo = (x[::-1][ok] for x in windows(3 - bases[::-1], k))
    swap = (rhi < hi) | ((rhi == hi) & (rlo < lo))
    return np.where(swap, rhi, hi), np.where(swap, rlo, lo)


def counted(k: int, column: str = "seq", rows: int = 2000):
    """An Arrow function from sequences to (hi, lo, n), counts combined within some thousand sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                hi, lo = _of_batch([s for s in batch.column(column).slice(at, rows).to_pylist() if s], k)
                if len(hi):
                    order = np.lexsort((lo, hi))
                    hi, lo = hi[order], lo[order]
                    first = np.flatnonzero(np.r_[True, (np.diff(hi) != 0) | (np.diff(lo) != 0)])
                    n = np.diff(np.r_[first, len(hi)])
                    yield pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first]), pa.array(n)], ["hi", "lo", "n"])

    return run


def placed(k: int, keep: tuple[str, ...]):
    """An Arrow function from rows (*keep, seq) to (*keep, at, hi, lo): every k-mer as it stands, with its place from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [s or "" for s in batch.column("seq").to_pylist()]
            codes = _CODE[np.frombuffer(("-".join(seqs) + "-").encode("latin-1", "replace"), np.uint8)]
            if len(codes) < k:
                continue
            bad = np.r_[0, np.cumsum(codes > 3)]
            at = np.flatnonzero(bad[k:] == bad[:-k])
            hi, lo = (x[at] for x in windows(codes & 3, k))
            starts = np.r_[0, np.cumsum([len(s) + 1 for s in seqs])]
            row = np.searchsorted(starts, at, side="right") - 1
            rows = batch.select(list(keep)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((at - starts[row]).astype(np.int32)), pa.array(hi), pa.array(lo)], [*keep, "at", "hi", "lo"])

    return run


def reverse(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Reverse complements of packed k-mers, base by base over whole columns."""
    rhi, rlo = np.zeros_like(hi), np.zeros_like(lo)
    for i in range(k):  # base i from the end becomes base i from the start
        base = 3 - ((lo >> (2 * i)) & 3 if i < LOW else (hi >> (2 * (i - LOW))) & 3)
        at = k - 1 - i
        if at < LOW:
            rlo |= base << (2 * at)
        else:
            rhi |= base << (2 * (at - LOW))
    return rhi, rlo


def text(hi: Column, lo: Column, k: int) -> Column:
    """The bases of a packed k-mer."""
    return from_two_bit(lo, k) if k <= LOW else F.concat(from_two_bit(hi, k - LOW), from_two_bit(lo, LOW))


def both_strands(k: int):
    """An Arrow function from canonical (hi, lo, n) to rows (hi, lo, n) of both strands; a palindrome is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, n = (batch.column(c).to_numpy() for c in ("hi", "lo", "n"))
            rhi, rlo = reverse(hi, lo, k)
            other = (rhi != hi) | (rlo != lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[hi, rhi[other]]), pa.array(np.r_[lo, rlo[other]]), pa.array(np.r_[n, n[other]])], ["hi", "lo", "n"])

    return run


def without_last(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
    """The first k - 1 bases of a packed k-mer."""
    carried = F.shiftleft(hi.bitwiseAND(F.lit(3)), 2 * (LOW - 1)) if k > LOW else F.lit(0).cast("long")
    return F.shiftright(hi, 2), F.shiftright(lo, 2).bitwiseOR(carried)


def without_first(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
    """The last k - 1 bases of a packed k-mer."""
    if k - 1 <= LOW:
        return F.lit(0).cast("long"), lo.bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1))
    return hi.bitwiseAND(F.lit((1 << 2 * (k - 1 - LOW)) - 1)), lo


def first_bases(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``without_last`` on arrays."""
    return hi >> 2, (lo >> 2) | ((hi & 3) << (2 * (LOW - 1)) if k > LOW else 0)


def last_bases(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``without_first`` on arrays."""
    if k - 1 <= LOW:
        return np.zeros_like(hi), lo & ((1 << 2 * (k - 1)) - 1)
    return hi & ((1 << 2 * (k - 1 - LOW)) - 1), lo


def minimizers(hi: np.ndarray, lo: np.ndarray, k: int, m: int = 15) -> np.ndarray:
    """The least hash of the m-mers of each packed k-mer. Neighbouring k-mers mostly have the same one."""
    m = min(m, k)
    best = None
    for at in range(k - m + 1):  # bases after the m-mer
        shift = 2 * at
        if at >= LOW:
            x = hi >> (shift - 2 * LOW)
        elif at + m > LOW:
            x = (lo >> shift) | (hi << (2 * LOW - shift))
        else:
            x = lo >> shift
        x = (x & ((1 << 2 * m) - 1)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        best = x if best is None else np.minimum(best, x)
    return best.view(np.int64)


SLICE = 1 << 21  # bases of stretches that are turned into k-mers at once


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place on."""
    size = 1
    while size < w:
        step = min(size, w - size)
        x = np.minimum(x[: len(x) - step], x[step:])
        size += step
    return x


def _buckets(codes: np.ndarray, k: int, n: int, m: int = 15) -> np.ndarray:
    """The bucket of the k-mer at each place: the least hash of its m-mers, the same on either strand."""
    m = min(m, k)
    bases = codes & 3
    x = np.minimum(windows(bases, m)[1], windows(3 - bases[::-1], m)[1][::-1]).astype(np.uint64)
    x = (x ^ (x >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (_least(x, k - m + 1) >> np.uint64(20)) % np.uint64(n)


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 of all i."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def _cut_up(codes: np.ndarray, k: int, n: int, joints: bool) -> tuple[np.ndarray, ...]:
    """(bucket, start, length, before, after): stretches whose k-mers are in one bucket. With ``joints`` they take the
    base before and the base after along, so that a stretch has each (k+1)-mer that starts or ends with one of its k-mers."""
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return none, none, none, none, none
    bad = np.r_[0, np.cumsum(codes > 3)]
    ok = bad[k:] == bad[:-k]
    b = np.where(ok, _buckets(codes, k, n).astype(np.int64), -1)
    first = np.flatnonzero(np.r_[True, np.diff(b) != 0])
    last = np.r_[first[1:], len(b)] - 1
    before = ((first > 0) & ok[first - 1]).astype(np.int64) if joints else np.zeros(len(first), np.int64)
    after = ((last + 1 < len(b)) & ok[np.minimum(last + 1, len(b) - 1)]).astype(np.int64) if joints else np.zeros(len(first), np.int64)
    length = last - first + k + before + after
    use = ok[first] & (length >= k + joints)
    return b[first][use], (first - before)[use], length[use], before[use], after[use]


def _two_bits(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches one after the other, four bases a byte, each filled up to a whole byte."""
    padded = -(-length // 4) * 4
    out = np.zeros(padded.sum(), np.uint8)
    out[_flat(np.r_[0, np.cumsum(padded)[:-1]], length)] = codes[_flat(start, length)]
    out = out.reshape(-1, 4)
    return out[:, 0] << 6 | out[:, 1] << 4 | out[:, 2] << 2 | out[:, 3]


def bucketed(k: int, n: int, joints: bool = False):
    """An Arrow function from sequences to (bucket, bases, sizes): the stretches of each bucket in a batch, four bases a
    byte; a size is 4 * length, 1 more with a base before its bucket's k-mers, 2 more with one after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _CODE[np.frombuffer("-".join(s for s in batch.column("seq").to_pylist() if s).encode("latin-1", "replace"), np.uint8)]
            b, start, length, before, after = _cut_up(codes, k, n, joints)
            if not len(b):
                continue
            order = np.argsort(b, kind="stable")
            b, start, length = b[order], start[order], length[order]
            bases, sizes = _two_bits(codes, start, length), (4 * length + before[order] + 2 * after[order]).astype("<i4")
            at = np.flatnonzero(np.r_[True, np.diff(b) != 0])
            ends, byte = np.r_[at[1:], len(b)], np.r_[0, np.cumsum(-(-length // 4))]
            yield pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array([bases[byte[i] : byte[j]].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array([sizes[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], ["bucket", "bases", "sizes"])

    return run


def bucketed_texts(k: int, n: int, keep: tuple[str, ...]):
    """An Arrow function from rows (*keep, seq) to (*keep, bucket, at, piece): the stretches of a row by bucket, with their
    place from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [s or "" for s in batch.column("seq").to_pylist()]
            whole = "-".join(seqs) + "-"
            b, start, length, _, _ = _cut_up(_CODE[np.frombuffer(whole.encode("latin-1", "replace"), np.uint8)], k, n, False)
            starts = np.r_[0, np.cumsum([len(s) + 1 for s in seqs])]
            row = np.searchsorted(starts, start, side="right") - 1
            rows = batch.select(list(keep)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(b), pa.array((start - starts[row]).astype(np.int32)), pa.array([whole[i : i + j] for i, j in zip(start, length)], pa.string())], [*keep, "bucket", "at", "piece"])

    return run


def _counts(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((lo, hi))
    hi, lo, n, flags = hi[order], lo[order], n[order], flags[order]
    first = np.flatnonzero(np.r_[True, (np.diff(hi) != 0) | (np.diff(lo) != 0)])
    return hi[first], lo[first], np.add.reduceat(n, first), flags[first]


def bucket_counts(parts, k: int) -> tuple[np.ndarray, ...]:
    """(hi, lo, n, flags) of the canonical k-mers in ``parts`` (bases, sizes) of one bucket; flags has 1 where the k-mer's
    start, and 2 where its end, lies outside of the bucket. Counts are combined slice by slice."""
    empty = np.zeros(0, np.int64)
    done, waiting, size = (empty, empty, empty, empty), [], 0

    def add() -> tuple[np.ndarray, ...]:
        sizes = np.frombuffer(b"".join(s for _, s in waiting), "<i4").astype(np.int64)
        packed = np.frombuffer(b"".join(b for b, _ in waiting), np.uint8)
        codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()
        length = sizes >> 2
        start, count = np.r_[0, np.cumsum(-(-length // 4) * 4)[:-1]], length - k + 1
        at = _flat(start, count)
        hi, lo = (x[at] for x in windows(codes, k))
        rhi, rlo = (x[::-1][at] for x in windows(3 - codes[::-1], k))
        flags, ends = np.zeros(len(at), np.int64), np.cumsum(count)
        flags[ends - count] |= sizes & 1
        flags[ends - 1] |= sizes & 2
        swap = (rhi < hi) | ((rhi == hi) & (rlo < lo))
        flags = np.where(swap, flags >> 1 | (flags & 1) << 1, flags)
        new = (np.where(swap, rhi, hi), np.where(swap, rlo, lo), np.ones(len(at), np.int64), flags)
        return _counts(*(np.r_[a, b] for a, b in zip(done, new)))

    for bases, sizes in parts:
        waiting.append((bases, sizes))
        size += 4 * len(bases)
        if size > SLICE:
            done, waiting, size = add(), [], 0
    return add() if waiting else done


def found_in(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, want_hi: np.ndarray, want_lo: np.ndarray) -> np.ndarray:
    """The n of each wanted k-mer, 0 where (hi, lo), sorted and distinct, doesn't have it."""
    out = np.zeros(len(want_hi), np.int64)
    if not len(hi) or not len(want_hi):
        return out
    order = np.lexsort((np.r_[np.zeros(len(hi), np.int8), np.ones(len(want_hi), np.int8)], np.r_[lo, want_lo], np.r_[hi, want_hi]))
    mine = order < len(hi)
    at = np.maximum.accumulate(np.where(mine, np.arange(len(order)), -1))  # the last own k-mer up to here
    own = order[np.maximum(at, 0)]
    asked = ~mine & (at >= 0)
    which, own = order[asked] - len(hi), own[asked]
    same = (hi[own] == want_hi[which]) & (lo[own] == want_lo[which])
    out[which[same]] = n[own[same]]
    return out


def canonical_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the canonical k-mer at each place of base codes below 4."""
    hi, lo = windows(codes, k)
    rhi, rlo = (x[::-1] for x in windows(3 - codes[::-1], k))
    swap = (rhi < hi) | ((rhi == hi) & (rlo < lo))
    return np.where(swap, rhi, hi), np.where(swap, rlo, lo)


def codes_of(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
