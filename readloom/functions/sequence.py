"""Column expressions on sequences, barcodes and k-mers. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
BASES5 = "ACGTN"


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; N and other letters stay. Null stays null."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; a palindrome is its own."""
    return F.least(kmer, revcomp(kmer))


def encode_base(seq: Column, base: int, alphabet: str) -> Column:
    """Integer of a sequence, first letter most significant; null if a letter isn't of the alphabet."""
    digits = F.translate(seq, alphabet, "01234"[: len(alphabet)])
    return F.when(seq.rlike(f"^[{alphabet}]+$"), F.conv(digits, base, 10).cast("long"))


def letter_code(c: Column, alphabet: str) -> Column:
    out = F.lit(0)
    for i, letter in enumerate(alphabet):
        if i:
            out = F.when(c == letter, F.lit(i)).otherwise(out)
    return out


def base5(seq: Column) -> Column:
    """Base-5 code of a barcode (A C G T N = 0..4), at most 27 letters; null for other letters or an empty text."""
    return encode_base(seq, 5, BASES5)


def two_bit(seq: Column) -> Column:
    """2-bit code of at most 31 bases; null with N or an empty text."""
    return encode_base(seq, 4, BASES)


def from_base5(code: Column, n: int) -> Column:
    """The n letters of a base-5 code; null for a null or negative code."""
    return _digits(code, n, 5, BASES5)


def from_two_bit(code: Column, n: int) -> Column:
    """The n bases of a 2-bit code; null for a null or negative code."""
    return _digits(code, n, 4, BASES)


def _digits(code: Column, n: int, base: int, alphabet: str) -> Column:
    digits = F.lpad(F.conv(code.cast("string"), 10, base), n, "0")
    return F.when(code >= 0, F.translate(digits, "01234"[: len(alphabet)], alphabet))


def tag(info: Column, name: str) -> Column:
    """The value of ``name:Z:`` up to a space, a tab or the end; null without it."""
    return F.when(F.contains(info, F.lit(f"{name}:Z:")), F.regexp_extract(info, f"{name}:Z:([^ \t]*)", 1))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence in order, upper case; empty for shorter or null ones."""
    upper = F.upper(seq)
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(upper, i, F.lit(k)))


def is_acgt(kmer: Column) -> Column:
    return ~F.contains(kmer, F.lit("N")) & kmer.rlike("^[ACGT]+$")


def joined(seqs: Column, k: int) -> Column:
    """Neighbouring contigs of an ordered array as one sequence: each next one without its first k bases, which the one
    before ends with. A null member makes the result null."""
    return F.concat(F.element_at(seqs, 1), F.array_join(F.transform(F.slice(seqs, 2, F.size(seqs)), lambda s: F.substring(s, F.lit(k + 1), F.length(s))), ""))


def spaced(seqs: Column, n: int = 100) -> Column:
    """An ordered array of contigs with n N between neighbours."""
    return F.array_join(seqs, "N" * n)


def filled(seq: Column, holes: Column, cap: int | None = None) -> Column:
    """A sequence with its holes as N; ``cap`` bounds the N of one hole. Holes are in order of pos, the bases before
    each; without holes the sequence itself."""
    n = lambda h: F.least(h["len"], F.lit(cap)) if cap else h["len"]
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(holes, i - 1)["pos"])
    parts = F.transform(holes, lambda h, i: F.concat(F.substring(seq, start(i) + 1, h["pos"] - start(i)), F.repeat(F.lit("N"), n(h))))
    rest = F.substring(seq, F.element_at(holes, -1)["pos"] + 1, F.length(seq))
    return F.when(F.size(holes) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(seq)
