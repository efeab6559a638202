"""Most frequent values of a column in bounded memory: a majority-vote sketch.

The sketch has ``DEPTH`` rows of ``width`` cells. A cell holds the total count of what hashes to it, one candidate
value and the surplus of votes for the candidate over votes for all others. Each task keeps one sketch per source,
whatever the number of distinct values. Cells merge by vote cancellation:

* surplus of a merged cell = votes of the strongest candidate - votes of all others, at least 0;
* a candidate occurs at most (total + surplus) / 2 times, any other value of the cell at most (total - surplus) / 2;
* a candidate occurs at least as often as the surpluses that name it add up to.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 4
PLACES = [f"c{d}" for d in range(DEPTH)]
CELLS = "src string, depth int, cell int, total long, candidate string, surplus long"


def _places(val: Column, width: int) -> list[Column]:
    """The cell of a value in each row of the sketch."""
    return [F.pmod(F.xxhash64(F.lit(d), val), F.lit(width)).cast("int") for d in range(DEPTH)]


class Sketch:
    """Totals, candidates and surpluses of one task and source."""

    def __init__(self, width: int) -> None:
        self.total = np.zeros((DEPTH, width), np.int64)
        self.surplus = np.zeros((DEPTH, width), np.int64)
        self.mark = np.zeros((DEPTH, width), np.int64)  # hash of the candidate
        self.value = np.full((DEPTH, width), None, object)
        self.width = width

    def add(self, h: np.ndarray, places: list[np.ndarray], values: np.ndarray, n: np.ndarray) -> None:
        """Distinct values with their hashes, cells and counts."""
        for d, cell in enumerate(places):
            order = np.lexsort((-n, cell))
            cells, first, back = np.unique(cell[order], return_index=True, return_inverse=True)
            total = np.bincount(back, weights=n[order]).astype(np.int64)
            top = order[first]
            votes = np.maximum(0, 2 * n[top] - total)
            same = self.mark[d, cells] == h[top]
            old = self.surplus[d, cells]
            wins = ~same & (votes > old)
            self.total[d, cells] += total
            self.surplus[d, cells] = np.where(same, old + votes, np.abs(old - votes))
            self.mark[d, cells[wins]] = h[top[wins]]
            self.value[d, cells[wins]] = values[top[wins]]


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, Sketch] = {}
        for batch in batches:
            for src in pc.unique(batch.column("src")).to_pylist():
                part = pa.Table.from_batches([batch]).filter(pc.equal(batch.column("src"), src))
                part = part.group_by(["val", "h", *PLACES], use_threads=False).aggregate([([], "count_all")])
                h = part["h"].to_numpy()
                values = part["val"].to_numpy(zero_copy_only=False)
                sketches.setdefault(src, Sketch(width)).add(h, [part[c].to_numpy() for c in PLACES], values, part["count_all"].to_numpy())
        for src, s in sketches.items():
            d, c = np.nonzero(s.total)
            out = [pa.array([src] * len(d), pa.string()), pa.array(d, pa.int32()), pa.array(c, pa.int32()), pa.array(s.total[d, c]), pa.array(s.value[d, c].tolist(), pa.string()), pa.array(s.surplus[d, c])]
            yield pa.RecordBatch.from_arrays(out, ["src", "depth", "cell", "total", "candidate", "surplus"])

    return run


def vote_cells(values: DataFrame, width: int = 4096) -> DataFrame:
    """Merged cells (src, depth, cell, total, candidate, surplus, others) of ``values(src, val)``.

    At most one row per task, source and cell is shuffled; votes for one candidate are added up on the map side.
    """
    hashed = values.filter(F.col("val").isNotNull()).select("src", "val", F.xxhash64("val").alias("h"), *[c.alias(n) for c, n in zip(_places(F.col("val"), width), PLACES)])
    local = hashed.mapInArrow(_sketch(width), CELLS)
    votes = local.groupBy("src", "depth", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("votes"))
    return votes.groupBy("src", "depth", "cell").agg(
        F.sum("total").alias("total"), F.max_by("candidate", F.struct("votes", "candidate")).alias("candidate"), F.max("votes").alias("top"), F.greatest(F.lit(0), 2 * F.max("votes") - F.sum("votes")).alias("surplus")
    )


def sketch_width(share: float) -> int:
    """Cells per row of the sketch: 4096, or 32 / ``share`` for smaller shares, as a power of 2."""
    return max(4096, 1 << ceil(log2(32 / share)))


def heavy_values(values: DataFrame, share: float, width: int | None = None) -> DataFrame:
    """(src, val, n_rows, lower, upper): candidates that may hold ``share`` of the rows of their source.

    ``lower <= true count <= upper`` always holds. A value with ``share`` of the rows is missed only if the others in each
    of its ``DEPTH`` cells have as many rows: a cell gets 1 / width of them on average, so by Markov's inequality the
    chance is at most (1 / (width * share)) ** DEPTH, a millionth at the default ``sketch_width``. Null values count nowhere; an empty table gives no rows; ties and repeated rows are just counts.
    ``share`` of the rows and the number of sources bound the cells, and with them everything that is broadcast.
    """
    from ..session import cut

    width = width or sketch_width(share)
    cells = cut(vote_cells(values, width))  # DEPTH * width rows per source at most
    total = cells.filter(F.col("depth") == 0).groupBy("src").agg(F.sum("total").alias("n_rows"))
    found = cells.filter(F.col("surplus") > 0).join(F.broadcast(total), "src").filter(F.col("total") + F.col("surplus") >= 2 * F.lit(share) * F.col("n_rows"))
    found = found.select("src", F.col("candidate").alias("val"), "n_rows").distinct()
    places = found.select("src", "val", "n_rows", F.posexplode(F.array(*_places(F.col("val"), width))).alias("depth", "cell"))
    placed = cells.join(F.broadcast(places), ["src", "depth", "cell"])  # DEPTH rows per candidate
    mine = F.col("candidate") == F.col("val")
    bounds = placed.groupBy("src", "val", "n_rows").agg(
        F.max(F.when(mine, F.col("top")).otherwise(0)).alias("lower"),
        F.min(F.floor((F.col("total") + F.when(mine, F.col("surplus")).otherwise(-F.col("surplus"))) / 2)).alias("upper"),
    )
    return bounds.filter(F.col("upper") >= F.lit(share) * F.col("n_rows"))


def heavy_counts(values: DataFrame, share: float, width: int | None = None) -> DataFrame:
    """(src, val, n): the values that hold at least ``share`` of their source's rows, with exact counts.

    A second pass counts the sketch's candidates only; there are at most 1 / share + a few of them per source.
    """
    found = heavy_values(values, share, width)
    return values.join(F.broadcast(found.select("src", "val", "n_rows")), ["src", "val"]).groupBy("src", "val", "n_rows").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.lit(share) * F.col("n_rows")).select("src", "val", "n")
