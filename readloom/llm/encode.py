"""Encoding of whole corpora with a public byte-level BPE, and decoding.

Texts are cut into overlapping chunks of a few thousand characters. Chunks are split into pre-tokens on their own; the
first place in an overlap where the splits of both sides agree is a stitch, if it lies between two kinds of characters
(letters, numbers, white space, others): no pre-token holds two kinds but for a space before it and the apostrophe of a
contraction, so every split of the whole text has a boundary there, whatever came before. The pieces between stitches
are encoded and put together; that equals the encoding of the whole text. A chunk without a stitch stays joined to the
one before. Texts up to ``SPREAD`` are cut and encoded where they are read, the pieces of longer ones in many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
OVERLAP = 256
SPREAD = 1 << 20  # bytes of a text whose pieces are spread over tasks
ROWS = 64  # texts encoded at once


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE of a rank file. Special tokens don't exist: their strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _id_lists(found: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    flat = np.fromiter((i for x in found for i in x), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


@lru_cache(1)
def _patterns():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN), regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=[^\s\p{L}\p{N}'])[\s\p{L}\p{N}]|(?<=')[\s\p{N}]")


def boundaries(text: str) -> set[int]:
    """Places of a text where its own split has a boundary and two kinds of characters meet."""
    split, kinds = _patterns()
    return {m.start() for m in split.finditer(text)} & {m.start() for m in kinds.finditer(text)}


def pieces(text: str, chunk: int, overlap: int) -> list[str]:
    """The text cut at its stitches. Either side of a cut is split from a place of its own."""
    starts = [0]
    for cut in range(chunk, len(text), chunk):
        before = cut - min(chunk, overlap)
        left = {before + i for i in boundaries(text[before : cut + overlap])}
        if stitch := min((cut + i for i in boundaries(text[cut : cut + overlap]) if cut + i in left), default=0):
            starts.append(stitch)
    return [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]


def _encode(path: str, key: list[str], chunk: int, overlap: int, counts: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = []
            for text in batch.column("text").to_pylist():
                if text and len(text) > chunk:
                    ids.append([i for piece in pieces(text, chunk, overlap) for i in enc.encode_ordinary(piece)])
                else:
                    ids.append(enc.encode_ordinary(text) if text else [])
            last = pa.array([len(x) for x in ids], pa.int32()) if counts else _id_lists(ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), last], [*key, "ids" if not counts else "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """Chunks of long texts with the boundaries in the overlaps at both ends, as places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text").to_pylist()):
                for k, start in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key.as_py()], pa.int64()), "k": pa.array([k], pa.int32()), "text": [text[start : start + chunk + overlap]]})

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts = [], []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                sure, base = sorted(boundaries(text)), k * chunk
                firsts.append([base + i for i in sure if 0 < i < overlap])
                lasts.append([base + i for i in sure if i > chunk])
            place = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), batch.column("text"), place(firsts), place(lasts)], ["doc_id", "k", "text", "firsts", "lasts"])

    return run, bounds


def _long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """The chunks of a text are split in many tasks; only the places of the overlaps pass the window of their text."""
    cut_up, bounds = _cut(chunk, overlap)
    chunks = docs.mapInArrow(cut_up, "doc_id long, k int, text string").repartition("doc_id", "k")
    chunks = chunks.mapInArrow(bounds, "doc_id long, k int, text string, firsts array<long>, lasts array<long>")
    order = Window.partitionBy("doc_id").orderBy("k")
    places = chunks.select("doc_id", "k", F.array_min(F.array_intersect(F.lag("lasts").over(order), F.col("firsts"))).alias("stitch"))
    places = places.withColumn("piece", F.sum(F.when(F.col("stitch").isNotNull(), 1).otherwise(0)).over(order))
    places = places.withColumn("until", F.coalesce(F.first("stitch").over(order.rowsBetween(1, 1)), (F.col("k") + 1).cast("long") * chunk))
    chunks = chunks.select("doc_id", "k", "text").join(places, ["doc_id", "k"])
    start = F.coalesce(F.col("stitch"), F.col("k").cast("long") * chunk)
    part = F.substring(F.col("text"), (start - F.col("k").cast("long") * chunk + 1).cast("int"), (F.col("until") - start).cast("int"))
    found = chunks.select("doc_id", "k", "piece", part.alias("text")).groupBy("doc_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    ids = found.mapInArrow(_encode(path, ["doc_id", "piece"], 1 << 31, 0), "doc_id long, piece long, ids array<int>")
    return ids.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids array<int>) of every document. Null and empty texts have the empty list.

    Rows with the same doc_id: those up to ``spread`` bytes are each encoded; longer ones must have one row per doc_id, as
    doc_id is a key. The second read of the text column for these costs less than writing all ids once more would.
    """
    path = path or vocabulary()
    docs = docs.select("doc_id", "text")
    usual = F.coalesce(F.octet_length("text"), F.lit(0)) <= spread
    ids = docs.filter(usual).mapInArrow(_encode(path, ["doc_id"], chunk, overlap), "doc_id long, ids array<int>")
    return ids.unionByName(_long(docs.filter(~usual), path, chunk, overlap))


def count_tokens(docs: DataFrame, *keep: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """``keep`` (with doc_id first) and n_tokens of every document, 0 for null and empty texts."""
    path = path or vocabulary()
    usual = F.coalesce(F.octet_length("text"), F.lit(0)) <= spread
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    counted = docs.filter(usual).select(*keep, "text").mapInArrow(_encode(path, list(keep), chunk, overlap, counts=True), f"{kept}, n_tokens int")
    rest = _long(docs.filter(~usual).select("doc_id", "text"), path, chunk, overlap).select("doc_id", F.size("ids").alias("n_tokens"))
    return counted.unionByName(docs.filter(~usual).select(*keep).join(rest, "doc_id").select(*keep, "n_tokens"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the raw bytes of the ids, one after another, read as UTF-8."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = [enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
