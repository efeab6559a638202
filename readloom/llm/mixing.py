"""Mixing sources to target weights within a repetition limit.

Weights are a temperature family between two share vectors: w(s) ~ target(s) * (natural(s) / target(s)) ** a, with
a = 0 the targets and a = 1 the natural token shares. The exponent is found by bisection: the least one at which no
source needs more repeats than it may have for the wanted budget, or the one whose weights have a wanted entropy. The
weights are then realised as block permutations: each source's documents in a hashed order, as many whole rounds as
the budget holds, and the part of one more round that fits. Running sums go over blocks of the hashed order first and
over the documents of the one cut block after that, so a source with a third of all rows isn't summed in one task.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1024


def temperature(natural: dict[str, float], target: dict[str, float], a: float) -> dict[str, float]:
    """Normalised weights at exponent ``a`` over the sources that have tokens and a target."""
    raw = {s: target[s] * (natural[s] / target[s]) ** a for s in target if target[s] > 0 and natural.get(s, 0) > 0}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def bisect_exponent(natural: dict[str, float], target: dict[str, float], fits, steps: int = 60) -> float:
    """The least a in [0, 1] with fits(weights at a), 1 if there is none below it; ``fits`` must turn true once."""
    if fits(temperature(natural, target, 0.0)):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(temperature(natural, target, mid)) else (mid, high)
    return high


def plan(sources: list[tuple[str, int, float, int]], budget: float | None = None, entropy_at_most: float | None = None) -> list[tuple[str, int, float, int, float, float]]:
    """(source, tokens, target, max_repeats, weight, quota) from (source, tokens, target_share, max_repeats).

    Without ``budget`` it is the largest at which the targets themselves keep every limit, so the exponent is 0 and the
    shares are met. With a larger budget the exponent rises until the limits hold; what even a = 1 can't hold is cut to
    the limit. A source without tokens or target has weight 0.
    """
    natural_total = sum(n for _, n, t, _ in sources if n > 0 and t > 0)
    natural = {s: n / natural_total for s, n, t, _ in sources if n > 0 and t > 0}
    target_total = sum(t for s, _, t, _ in sources if s in natural)
    target = {s: t / target_total for s, _, t, _ in sources if s in natural}
    cap = {s: n * r for s, n, _, r in sources}
    if not target:
        return [(*x, 0.0, 0.0) for x in sources]
    if budget is None:
        budget = min(cap[s] / target[s] for s in target)
    fits = lambda w: all(w[s] * budget <= cap[s] * (1 + 1e-12) for s in w) and (entropy_at_most is None or entropy(w) <= entropy_at_most)
    weights = temperature(natural, target, bisect_exponent(natural, target, fits))
    return [(s, n, t, r, weights.get(s, 0.0), float(min(weights.get(s, 0.0) * budget, cap[s]))) for s, n, t, r in sources]


def source_sizes(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tokens, docs, target_share, max_repeats): one row per source of either table."""
    have = counted.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return have.join(wanted, "source", "full").na.fill({"tokens": 0, "docs": 0, "target_share": 0.0, "max_repeats": 0})


def mixture(counted: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7, blocks: int = BLOCKS, entropy_at_most: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): how often each document is used, 1 or more.

    ``counted`` has doc_id, source and n_tokens; a null source and one without target are used nowhere. Documents of 0
    tokens add nothing and are left out. Of each source's last round the longest prefix of its hashed order that stays
    within the quota is used, so a source is short of its quota by less than one document. ``targets`` is a small
    table: one row per source goes to the driver. Repeated rows of a doc_id are documents of their own.
    """
    from ..session import cut

    docs = counted.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens")
    h = F.xxhash64(F.lit(seed), "doc_id")
    docs = docs.withColumn("h", h).withColumn("block", F.pmod(F.shiftrightunsigned("h", 40), F.lit(blocks)).cast("int"))
    sums = cut(docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")))
    sizes = {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("block_tokens")).collect()}
    wanted = [(r["source"], int(sizes.get(r["source"], 0)), float(r["target_share"] or 0.0), int(r["max_repeats"] or 0)) for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]
    spark = counted.sparkSession
    quota = [(s, int(q // n), float(q - (q // n) * n)) for s, n, _, _, _, q in plan(wanted, budget, entropy_at_most) if n > 0 and q > 0]
    quota = F.broadcast(spark.createDataFrame(quota, "source string, rounds int, rest double"))
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cuts = sums.join(quota, "source").withColumn("upto", F.sum("block_tokens").over(order))
    cuts = cuts.select("source", "block", "rounds", (F.col("upto") <= F.col("rest")).alias("whole"), ((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("block_tokens") < F.col("rest"))).alias("cut"), (F.col("rest") - F.col("upto") + F.col("block_tokens")).alias("left"))
    placed = docs.join(F.broadcast(cuts), ["source", "block"])  # sources * blocks rows
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut_docs = placed.filter("cut").withColumn("upto", F.sum("n_tokens").over(within)).withColumn("more", (F.col("upto") <= F.col("left")).cast("int"))
    rest = placed.filter(~F.col("cut")).withColumn("more", F.col("whole").cast("int"))
    used = cut_docs.select("doc_id", "source", "n_tokens", "rounds", "more").unionByName(rest.select("doc_id", "source", "n_tokens", "rounds", "more"))
    return used.select("doc_id", "source", "n_tokens", (F.col("rounds") + F.col("more")).alias("repeats")).filter(F.col("repeats") > 0)


def ordered(mix: DataFrame, seed: int = 7, per_block: int = 4096) -> DataFrame:
    """(epoch, block, place, doc_id, source, n_tokens): the mixture as block permutations, one row per use of a document.

    Each epoch deals its documents to blocks and orders every block by hashes of its own, so reading epoch by epoch and
    block by block is a permutation in which a document comes at most once per epoch. ``block`` is as many as make
    about ``per_block`` documents each, so no window orders more than a block."""
    from ..session import cut

    mix = cut(mix)
    used = mix.count()
    blocks = max(1, -(-used // per_block))
    rows = mix.select(F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("epoch"), "doc_id", "source", "n_tokens")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id"), F.lit(blocks)).cast("int"))
    order = Window.partitionBy("epoch", "block").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "doc_id"), "doc_id", "source")
    return rows.select("epoch", "block", F.row_number().over(order).alias("place"), "doc_id", "source", "n_tokens")


def kept(shares: DataFrame, targets: DataFrame, slack: float = 0.01) -> DataFrame:
    """(source, within_limit, near_target) of ``reached``: no document is used more often than the source may repeat, and
    the share is within ``slack`` of the target taken over the sources that have documents."""
    limits = targets.groupBy("source").agg(F.max("max_repeats").alias("limit"))
    have = F.sum(F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy(F.lit(1)))  # one row per source
    near = F.abs(F.col("actual_share") - F.when(F.col("tokens") > 0, F.col("target_share") / have).otherwise(0.0)) <= slack
    out = shares.withColumn("near_target", near).join(limits, "source")
    return out.select("source", (F.col("most_repeats") <= F.col("limit")).alias("within_limit"), "near_target")


def reached(mix: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, used_tokens, used_docs, most_repeats) for every source."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("repeats").alias("most_repeats"))
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    out = sizes.join(used, "source", "left").na.fill({"used_tokens": 0, "used_docs": 0, "most_repeats": 0})
    return out.select("source", "target_share", F.coalesce(F.try_divide(F.col("used_tokens"), all_used), F.lit(0.0)).alias("actual_share"), "tokens", "used_tokens", "used_docs", "most_repeats")
