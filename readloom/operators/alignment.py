"""Similar sequences: candidates by shared minimizers, then global alignment in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links, minimizers

MATCH, MISMATCH, GAP = 1, -1, -3


def score(a: str, b: str) -> int:
    """Global alignment score with match 1, mismatch -1 and gap -3 per base, one row of the table at a time."""
    x, y = np.frombuffer(a.encode("ascii", "replace"), np.uint8), np.frombuffer(b.encode("ascii", "replace"), np.uint8)
    steps = np.arange(len(y) + 1) * GAP
    row = steps.copy()
    for i, c in enumerate(x):
        best = np.empty_like(row)
        best[0] = (i + 1) * GAP
        best[1:] = np.maximum(row[:-1] + np.where(y == c, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum.accumulate(best - steps) + steps  # gaps along the row
    return int(row[-1])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [score(a, b) for a, b in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("r1"), batch.column("r2"), batch.column("longest"), pa.array(got, pa.int32())], ["r1", "r2", "longest", "score"])


def similar_reads(reads: DataFrame, k: int = 17, w: int = 17, least: int = 3, share: float = 0.5, room: int = 200) -> DataFrame:
    """(r1, r2, longest, score), r1 < r2: different sequences that share ``least`` minimizers and whose alignment scores
    above ``share`` of the longer one's length and less than ``room`` below it.

    Equal sequences are one, represented by their least read_id * 2 + mate; case is ignored."""
    one = reads.filter("length(seq) > 0").groupBy(F.upper("seq").alias("seq")).agg(F.min(F.col("read_id") * 2 + F.col("mate") - 1).alias("read_id")).withColumn("mate", F.lit(0))
    keys = minimizers.of_sequences(one, k, w).select(F.col("read_id").alias("edge"), F.xxhash64("kmer").alias("key")).distinct()
    pairs = links.shared_counts(keys, least)
    text = one.select("read_id", "seq")
    pairs = pairs.join(text.toDF("e1", "s1"), "e1").join(text.toDF("e2", "s2"), "e2").select(F.col("e1").alias("r1"), F.col("e2").alias("r2"), F.greatest(F.length("s1"), F.length("s2")).alias("longest"), "s1", "s2")
    scored = pairs.mapInArrow(_scores, "r1 long, r2 long, longest int, score int")
    return scored.filter((F.col("score") > share * F.col("longest")) & (F.col("longest") - F.col("score") < room))


def similar_parallel(graph: DataFrame, longest: int = 1000, share: float = 0.5, room: int = 200) -> DataFrame:
    """(r1, r2, longest, score), r1 < r2: contigs below ``longest`` between the same nodes whose sequences align as
    ``similar_reads`` asks; of such contigs only one is needed."""
    e = graph.filter(F.col("seq_len") < longest).select("edge_id", "node_from", "node_to", "seq")
    side = lambda i: e.select(F.col("edge_id").alias(f"r{i}"), "node_from", "node_to", F.col("seq").alias(f"s{i}"))
    pairs = side(1).join(side(2), ["node_from", "node_to"]).filter("r1 < r2").select("r1", "r2", F.greatest(F.length("s1"), F.length("s2")).alias("longest"), "s1", "s2")
    scored = pairs.mapInArrow(_scores, "r1 long, r2 long, longest int, score int")
    return scored.filter((F.col("score") > share * F.col("longest")) & (F.col("longest") - F.col("score") < room))
