"""Overlap sizes between many large sets by coordinated sampling of identifiers.

Thresholds on one common hash decide which identifiers a set keeps. The threshold of a set is the power of 1/2 at which
it keeps ``sample`` to twice as many, so sets of about one size share a threshold and the sample of a larger set is part
of what a smaller one's threshold would keep. Two sets are compared at the threshold of the smaller one: an identifier
that both have is kept by both or by none, so the co-occurrences among its ``s`` kept identifiers are a binomial sample
of its overlap, with a confidence interval.

A pair whose interval reaches the limit has at least ``c`` co-occurrences, so one of them is among the s - c + 1 rarest
kept identifiers of the smaller set. Only these are paired; what the pairs that met share of the commonest identifiers
is counted at these pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 40
FEW = 200_000  # rows of a side, counted before it is broadcast


def _beside(rows: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, which has one row per ``on``. A side of few rows, counted here, is broadcast, so that a
    set with a third of all memberships stays where it is; others are joined by a shuffle that adaptive execution may
    split."""
    return rows.join(F.broadcast(side) if side.count() <= FEW else side, on, how)


def _half(c: Column, tries: Column, z: float) -> Column:
    """Half the width of the interval of a proportion of ``c`` out of ``tries``."""
    p = F.least(F.lit(1.0), c / tries)
    return z * F.sqrt((p * (1 - p) + 1 / tries) / tries)


def fewest(kept: Column, exact: Column, share: float, z: float) -> Column:
    """The least count out of ``kept`` whose interval reaches ``share``: the lesser root of (share - p)^2 = half^2."""
    q = z * z / kept
    b = 2 * share + q
    root = (b - F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * (1 + q) * (share * share - q / kept)))) / (2 * (1 + q))
    least = F.when(exact, share * kept).otherwise(root * kept)
    return F.greatest(F.lit(1), F.ceil(least - 1e-9)).cast("int")


def _power(rate: str) -> Column:
    return F.pow(F.lit(2.0), F.col(rate)).cast("long")


def sample_size(sizes: DataFrame, share: float, z: float) -> int:
    """A tenth of the median set, at most 4096, but as many that an interval around nothing ends far below ``share``."""
    median = sizes.agg(F.percentile_approx("n", 0.5)).first()[0] or 0
    return max(int(4 * z / share) + 1, min(4096, int(median) // 10))


def sampled_overlaps(members: DataFrame, sizes: DataFrame, share: float, sample: int | None = None, z: float = 4.0) -> DataFrame:
    """(e1, e2, n1, n2, shared, low, high, share_low, share_high, exact): pairs e1 < e2 that share about ``share`` of the
    smaller set or more, with intervals of the common count and of the share of the smaller set.

    ``members(edge, key)`` holds each membership once or more, ``sizes(edge, n)`` an upper estimate of the set sizes.
    Kept are pairs whose interval of z standard deviations reaches ``share`` of either set. Sets below twice ``sample``
    (``sample_size`` if not given) keep all their identifiers: their counts are exact, ``low`` and ``high`` equal.
    Sizes and counts of others are estimates. Null keys and edges belong to no set. Larger sets keep further identifiers
    only where a smaller one has them in its sample.
    """
    from ..session import cut

    sample = sample or sample_size(sizes, share, z)
    rates = cut(sizes.filter(F.col("edge").isNotNull()).select("edge", F.greatest(F.lit(0), F.least(F.lit(HASH_BITS), F.floor(F.log2(F.col("n") / sample)))).cast("int").alias("rate")))
    least, most = rates.agg(F.min("rate"), F.max("rate")).first()
    h = F.shiftrightunsigned(F.xxhash64("key"), 64 - HASH_BITS)
    zeros = (HASH_BITS - F.when(h == 0, 0).otherwise(F.length(F.bin(h)))).cast("int")  # kept at every rate up to this one
    rows = members.filter(F.col("key").isNotNull() & F.col("edge").isNotNull()).select("edge", "key", zeros.alias("zeros")).filter(F.col("zeros") >= (least or 0))
    rows = _beside(rows, rates, "edge")
    own = cut(rows.filter(F.col("zeros") >= F.col("rate")).distinct())
    held = own.select("edge", "key", "zeros")
    if least != most:
        wanted = cut(own.filter(F.col("zeros") < most).select("key").distinct())
        held = held.unionByName(_beside(rows.filter(F.col("zeros") < F.col("rate")).select("edge", "key", "zeros"), wanted, "key", "left_semi").distinct())
    held = cut(held)
    per_set = own.groupBy("edge", "rate").agg(F.count(F.lit(1)).alias("kept")).withColumn("n", F.col("kept") * _power("rate"))
    per_set = cut(per_set.withColumn("least", fewest(F.col("kept"), F.col("rate") == 0, share, z)))
    # a set keeps about 2 * sample identifiers at most, so its order from rare to common is short
    holders = own.groupBy("key").agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("edge").orderBy("holders", "key")
    ranked = _beside(own.select("edge", "key").join(holders, "key"), per_set, "edge").withColumn("head", F.row_number().over(order) <= F.col("kept") - F.col("least") + 1)
    ranked = cut(ranked.select(F.col("edge").alias("a"), "key", F.col("n").alias("na"), F.col("rate").alias("ra"), F.col("kept").alias("ka"), "head"))
    other = _beside(held.select("edge", "key"), per_set.select("edge", "n", "rate", "kept"), "edge").toDF("b", "key", "nb", "rb", "kb")
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = cut(ranked.filter("head").join(other, "key").filter(smaller).groupBy("a", "b", "na", "nb", "ra", "rb", "ka", "kb").agg(F.count(F.lit(1)).alias("c")))
    tail = ranked.filter("not head").select("a", "key").join(met.select("a", "b"), "a").join(held.select(F.col("edge").alias("b"), "key"), ["b", "key"])
    met = met.join(tail.groupBy("a", "b").agg(F.count(F.lit(1)).alias("more")), ["a", "b"], "left").withColumn("c", F.col("c") + F.coalesce("more", F.lit(0)))
    rate = 1 / _power("ra")
    met = met.withColumn("shared", (F.col("c") * _power("ra")).cast("double")).withColumn("error", F.when(F.col("ra") == 0, F.lit(0.0)).otherwise(z * F.sqrt(F.col("c") * (1 - rate) + 1) / rate))
    of_a = F.col("c") / F.col("ka")
    half_a = F.when(F.col("ra") == 0, F.lit(0.0)).otherwise(_half(F.col("c"), F.col("ka"), z))
    # sets of nearly one size: the other one may be the smaller, so the share of it may reach the limit, too
    tries = F.least(F.col("kb").cast("double"), F.col("nb") / _power("ra"))
    of_b = F.least(F.lit(1.0), F.col("shared") / F.col("nb"))
    high_b = of_b + F.when((F.col("ra") == 0) & (F.col("rb") == 0), F.lit(0.0)).otherwise(_half(of_b * tries, tries, z))
    out = met.withColumn("share_low", of_a - half_a).withColumn("share_high", F.greatest(of_a + half_a, high_b)).filter(F.col("share_high") >= share)
    first = F.col("a") < F.col("b")
    return out.select(
        F.least("a", "b").alias("e1"), F.greatest("a", "b").alias("e2"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("n1"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("n2"),
        "shared", F.greatest(F.lit(0.0), F.col("shared") - F.col("error")).alias("low"), (F.col("shared") + F.col("error")).alias("high"),
        F.greatest(F.lit(0.0), "share_low").alias("share_low"), F.least(F.lit(1.0), "share_high").alias("share_high"), (F.col("ra") == 0).alias("exact"),
    )


def shared_at(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(e1, e2, n1, n2, shared): exact sizes and overlaps of given ``pairs(e1, e2)``. Only sets of these pairs are read,
    and they meet at the pairs only."""
    from ..session import cut

    pairs = cut(pairs.select("e1", "e2").distinct())
    named = cut(pairs.select(F.explode(F.array("e1", "e2")).alias("edge")).distinct())
    rows = cut(_beside(members.filter(F.col("key").isNotNull()), named, "edge").select("edge", "key").distinct())
    n = rows.groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    hits = rows.join(pairs.withColumnRenamed("e1", "edge"), "edge").withColumnRenamed("edge", "e1")
    hits = hits.join(rows.withColumnRenamed("edge", "e2"), ["e2", "key"]).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("shared"))
    hits = pairs.join(hits, ["e1", "e2"], "left").select("e1", "e2", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))
    return hits.join(n.toDF("e1", "n1"), "e1").join(n.toDF("e2", "n2"), "e2").select("e1", "e2", "n1", "n2", "shared")


def overlapping(members: DataFrame, sizes: DataFrame, share: float, **how) -> DataFrame:
    """(e1, e2): pairs that share at least ``share`` of the smaller set. Estimates decide where the interval lies on
    one side of ``share``; the others, a few, are counted exactly."""
    from ..session import cut

    got = cut(sampled_overlaps(members, sizes, share, **how).withColumn("sure", F.col("share_low") >= share))
    counted = shared_at(got.filter("not sure"), members)
    return got.filter("sure").select("e1", "e2").unionByName(counted.filter(F.col("shared") >= share * F.least("n1", "n2")).select("e1", "e2"))


def intervals(members: DataFrame, sizes: DataFrame, share: float, **how) -> DataFrame:
    """(e1, e2, shared, covered): exact overlaps of the estimated pairs and whether the interval holds them."""
    from ..session import cut

    got = cut(sampled_overlaps(members, sizes, share, **how).select("e1", "e2", "low", "high"))
    both = shared_at(got, members).join(got, ["e1", "e2"]).filter(F.col("shared") >= share * F.least("n1", "n2"))
    return both.select("e1", "e2", "shared", ((F.col("low") <= F.col("shared")) & (F.col("shared") <= F.col("high"))).alias("covered"))


def coverage_members(pieces: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members and size estimates of the COV sets of dumped barcode tables (edge, kind, keys, cnts).

    A key belongs to an edge if one of its rows counts it ``least`` times or more; -1 is an empty slot. Rows with a
    null keys or cnts array hold nothing; where the arrays differ in length the keys without a count don't belong.
    """
    cov = pieces.filter((F.col("kind") == "COV") & F.col("edge").isNotNull())
    held = F.filter(F.arrays_zip("keys", "cnts"), lambda x: (x["cnts"] >= least) & (x["keys"] != -1))
    sizes = cov.groupBy("edge").agg(F.sum(F.coalesce(F.size(held), F.lit(0)).cast("long")).alias("n"))
    return cov.select("edge", F.explode(held).alias("x")).select("edge", F.col("x.keys").alias("key")), sizes
