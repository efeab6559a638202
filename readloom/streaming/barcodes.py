"""Barcodes of a stream of read records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(records: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(start, lane, n, n_tagged): records per time window and lane of a stream or table with rec_id, barcode, lane and
    seen_at. Rows later than ``late`` are left out of a stream's closed windows; repeated loads within that time count
    once. Rows without a time belong to no window."""
    r = records.select("rec_id", "barcode", "lane", F.col("seen_at").cast("timestamp").alias("seen_at")).filter("seen_at is not null")
    r = r.withWatermark("seen_at", late).dropDuplicates(["rec_id", "seen_at", "lane", "barcode"])
    tagged = F.col("barcode").isNotNull() & (F.col("barcode") != -1)
    g = r.groupBy(F.window("seen_at", window), "lane").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(tagged, 1)).alias("n_tagged"))
    return g.select(F.col("window.start").alias("start"), "lane", "n", "n_tagged")
