"""Results per key where a few keys own most rows.

Rows are first compressed to value frequencies, one row per (key, value) with its count. That group-by has a
map-side combine, so a key with a third of all rows leaves each map task as its distinct values only. Distinct
counts, modes and percentiles then follow exactly from the weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """Each duplicate load once. Hashed over all columns, so no key is hot here."""
    return df.dropDuplicates()


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value occurs under each key. Null keys and null values are kept as such."""
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys_mode(df: DataFrame, key: str, value: str, share: float, absent: int = -1, out: str | None = None) -> DataFrame:
    """Keys with at least ``share`` of the rows that have a key, with their most frequent positive value.

    Rows with a null key or the key ``absent`` count nowhere. Duplicate rows count once.
    """
    rows = once(df.filter(F.col(key).isNotNull() & (F.col(key) != absent)))
    freq = compress(rows, key, value)
    best = F.max(F.when(F.col(value) > 0, F.struct(F.col("n").alias("n"), (-F.col(value)).alias("v"))))
    per_key = freq.groupBy(key).agg(F.sum("n").alias("n_rows"), best.alias("best"))
    total = per_key.agg(F.sum("n_rows"))
    return per_key.filter(F.col("n_rows") >= F.lit(share) * total.scalar()).select(key, (-F.col("best.v")).cast(df.schema[value].dataType).alias(out or value))


def weighted_percentiles(freq: DataFrame, key: str, value: str, shares: Sequence[float], fan: int = 1024) -> DataFrame:
    """(key, share, value): the smallest value with at least ``share`` of the key's weight at or below it.

    The range of all values is cut into ``fan`` bins, the bin that holds the answer into ``fan`` again, and so on down to
    single values, so a window runs over ``fan`` rows of a key at most, however many values it has. Null values have no
    weight. ``value`` must be integral.
    """
    freq = freq.filter(F.col(value).isNotNull())
    low, high = freq.agg(F.min(value), F.max(value)).first()
    widths = [1]
    while low is not None and (high - low) // widths[0] >= fan:
        widths.insert(0, widths[0] * fan)
    offset = F.col(value).cast("long") - F.lit(low or 0)
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    chosen = freq.groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("total")).select("_k", "total", wanted)
    chosen = chosen.select("_k", "share", F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1)).alias("rest"), F.lit(0).cast("long").alias("_b"))
    order = Window.partitionBy("_k", "share").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for i, width in enumerate(widths):
        outer = F.floor(offset / widths[i - 1]) if i else F.lit(0).cast("long")
        inside = freq.withColumn("_outer", outer).join(chosen, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_outer") == F.col("_b")))
        bins = inside.groupBy("_k", "share", "rest", F.floor(offset / width).alias("bin")).agg(F.sum("n").alias("bin_n")).withColumn("upto", F.sum("bin_n").over(order))
        bins = bins.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("bin_n") < F.col("rest")))
        chosen = bins.select("_k", "share", (F.col("rest") - F.col("upto") + F.col("bin_n")).alias("rest"), F.col("bin").alias("_b"))
    return chosen.select(F.col("_k").alias(key), "share", (F.col("_b") + F.lit(low or 0)).cast(freq.schema[value].dataType).alias(value))


def key_profile(df: DataFrame, key: str, value: str, absent: int = -1) -> DataFrame:
    """(key, n_rows, n_distinct, mode, median, p90) over the positive values of each present key, duplicates once.

    Keys whose rows have no positive value appear with n_distinct 0 and null mode and percentiles.
    """
    rows = once(df.filter(F.col(key).isNotNull() & (F.col(key) != absent)))
    freq = compress(rows, key, value)
    valid = F.col(value) > 0
    best = F.max(F.when(valid, F.struct(F.col("n").alias("n"), (-F.col(value)).alias("v"))))
    base = freq.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count(F.when(valid, 1)).alias("n_distinct"), best.alias("best"))
    base = base.select(key, "n_rows", "n_distinct", (-F.col("best.v")).alias("mode"))
    marks = weighted_percentiles(freq.filter(valid), key, value, (0.5, 0.9))
    at = lambda s: F.max(F.when(F.col("share") == s, F.col(value)))
    marks = marks.groupBy(key).agg(at(0.5).alias("median"), at(0.9).alias("p90"))
    return base.join(marks, key, "left")
