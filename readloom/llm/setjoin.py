"""All pairs of records whose sets of values overlap above a Jaccard threshold, by T-occurrence list merging.

Tokens are ordered from rare to common. Tokens that only one record has can't be shared; they count for the size of
their set and go nowhere. Two sets above the threshold share one of the first ``n - ceil(t n) + 1`` tokens of each, the
head, and ``T`` of the first ``n - ceil(t n) + T``. A record is sent to the shards of its head's tokens, and only the
latter prefix goes along. A shard builds inverted lists of these prefixes and probes them with each record (``probe``):
the longest lists are set aside, the others are merged with a heap that skips what cannot reach ``T`` any more, and
candidates are looked up in the long lists by binary search. Pairs that could still reach the threshold are checked
exactly by a join with their sets. Shards are bounded in bytes; a token whose prefixes exceed the bound is split.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OCCUR = 4  # T
SHARD = 16 << 20  # bytes of prefixes in a shard
FEW = 100_000  # rows of a side, counted before it is broadcast


def need(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den) in integers."""
    return F.floor((n * num + den - 1) / den)


def memberships(members: DataFrame, giant: int) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and (src, id, n) of sets with ``n`` > ``giant`` different members, which are joined as relations
    and never become one value. Only sets with more than ``giant`` rows have their rows made distinct for that."""
    from ..session import cut

    m = members.filter(F.col("id").isNotNull() & F.col("tok").isNotNull()).select("src", "id", "tok")
    return m, cut(_sizes(m, giant + 1).filter(F.col("n") > giant))


def _longer(m: DataFrame, rows: int) -> DataFrame:
    """The distinct members of sets with at least ``rows`` rows, which are few."""
    many = m.groupBy("src", "id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= rows).select("src", "id")
    return m.join(F.broadcast(many), ["src", "id"], "left_semi").distinct()


def _sizes(m: DataFrame, rows: int) -> DataFrame:
    return _longer(m, rows).groupBy("src", "id").agg(F.count(F.lit(1)).alias("n"))


def ranked(m: DataFrame, salts: int = 64) -> DataFrame:
    """(src, id, n, unique, ranked): each set's tokens from rare to common as (df, tok), without those of one record, whose
    number is ``unique``. ``m(src, id, tok)`` may repeat rows.

    The rows are shuffled by token once, where repeats drop out and records are counted, and by set once. Tokens in more
    than 1/4096 of all rows are at most 4096; they are broadcast and spread over ``salts`` places each, and their rows
    stand for their records in the order.
    """
    from ..session import cut

    rows = cut(m.groupBy("src", "tok").agg(F.count(F.lit(1)).alias("rows")))
    limit = max(64, (rows.agg(F.sum("rows")).first()[0] or 0) // 4096)
    common = F.broadcast(rows.filter(F.col("rows") > limit))
    keyed = m.join(common, ["src", "tok"], "left").withColumn("salt", F.when(F.col("rows").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(salts))).cast("int"))
    keyed = keyed.repartition("src", "tok", "salt").dropDuplicates(["src", "tok", "salt", "id"])
    df = F.coalesce("rows", F.count(F.lit(1)).over(Window.partitionBy("src", "tok", "salt")))
    one = keyed.select("src", "id", "tok", df.alias("df")).groupBy("src", "id")
    sets = one.agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "tok")))).alias("ranked"))
    return sets.withColumn("unique", F.col("n") - F.size("ranked"))


def probe(lists: list[list[int]], want: int, low: int, high: int) -> list[int]:
    """Members of [low, high) that occur in at least ``want`` of the sorted ``lists``.

    The longest lists, up to want - 1, are set aside. The rest is merged with a heap: whenever the least member occurs
    less often than still needed, the heap pops want' - 1 lists and jumps them to the next member that can matter.
    """
    lists = sorted(lists, key=len)
    top = len(lists[-1])
    aside = min(want - 1, int(want / (0.01 * log2(top + 1) + 1)), len(lists) - 1)
    short, long_lists = lists[: len(lists) - aside], lists[len(lists) - aside :]
    t = want - aside
    if len(short) < t:
        return []
    at = []
    heap = []
    for k, x in enumerate(short):
        i = bisect_left(x, low)
        at.append(i)
        if i < len(x) and x[i] < high:
            heap.append((x[i], k))
    heapify(heap)
    found = []
    while len(heap) >= t:
        least = heap[0][0]
        popped = []
        while heap and heap[0][0] == least:
            popped.append(heappop(heap)[1])
        if len(popped) >= t:
            n = len(popped)
            for j, x in enumerate(long_lists):
                i = bisect_left(x, least)
                if i < len(x) and x[i] == least:
                    n += 1
                elif n + len(long_lists) - j - 1 < want:
                    break
            if n >= want:
                found.append(least)
            jump = least + 1
        else:
            while heap and len(popped) < t - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            jump = heap[0][0]
        for k in popped:
            x = short[k]
            i = bisect_left(x, jump, at[k])
            at[k] = i
            if i < len(x) and x[i] < high:
                heappush(heap, (x[i], k))
    return found


PAIRS = "src string, id1 long, id2 long"


def _shard(num: int, den: int, occur: int):
    """Candidates of a shard: rows (src, id, n, rest, head, prefix), ``rest`` being the shared tokens after the prefix."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        src = table["src"][0].as_py()
        left, right = (table[c][0].as_py() for c in ("part1", "part2"))
        ids, ns, rest, parts = (table[c].to_numpy() for c in ("id", "n", "rest", "part"))
        order = np.lexsort((ids, ns))
        ids, ns, rest, parts = ids[order], ns[order].tolist(), rest[order].tolist(), parts[order].tolist()
        prefixes = table["prefix"].chunk(0).take(pa.array(order))
        heads = table["head"].chunk(0).take(pa.array(order))
        lens = prefixes.value_lengths().to_numpy()
        flat = prefixes.flatten().to_numpy()
        starts = np.r_[0, np.cumsum(lens)]
        names, codes = np.unique(flat, return_inverse=True)
        by_token = np.argsort(codes, kind="stable")
        at = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(names)))].tolist()
        holders = memoryview(array("q", np.repeat(np.arange(len(ids)), lens)[by_token].tobytes()))
        codes = memoryview(array("q", codes.astype(np.int64).tobytes()))
        head_lens = heads.value_lengths().to_numpy()
        head_codes = np.searchsorted(names, heads.flatten().to_numpy())
        head_starts = np.r_[0, np.cumsum(head_lens)].tolist()
        several = np.bincount(head_codes, minlength=len(names)) > 1
        mine_head = head_codes.tolist()
        one, two = [], []
        for r in range(len(ids)):
            own = mine_head[head_starts[r] : head_starts[r + 1]]
            n = ns[r]
            want = (n * num + den - 1) // den  # members of the smallest possible partner, and common ones at least
            low = bisect_left(ns, want)
            if low >= r or not any(several[t] for t in own):
                continue
            mine = codes[starts[r] : starts[r + 1]]
            need_r = min(occur, want)
            lists = [holders[at[t] : at[t + 1]] for t in mine if at[t + 1] - at[t] > 1]
            if len(lists) < need_r:
                continue
            known, own = set(mine), set(own)
            for s in probe(lists, need_r, low, r):
                if left != right and parts[s] == parts[r]:
                    continue
                both = [t for t in codes[starts[s] : starts[s + 1]] if t in known]
                most = len(both) + max(rest[r], rest[s])  # tokens of one prefix may stand in the other's rest
                if most * den < (n + ns[s] - most) * num:
                    continue
                # the pair belongs to the shard of its rarest common token
                if both[0] in own and both[0] in mine_head[head_starts[s] : head_starts[s + 1]]:
                    one.append(min(ids[s], ids[r]))
                    two.append(max(ids[s], ids[r]))
        return pa.table({"src": pa.array([src] * len(one), pa.string()), "id1": pa.array(one, pa.int64()), "id2": pa.array(two, pa.int64())})

    return run


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The candidates whose sets reach the threshold: one join per side with the shared tokens of the sets."""
    side = lambda c: sets.select("src", F.col("id").alias(f"id{c}"), F.col("n").alias(f"n{c}"), F.col("toks").alias(f"t{c}"))
    both = pairs.join(side(1), ["src", "id1"]).join(side(2), ["src", "id2"]).withColumn("c", F.size(F.array_intersect("t1", "t2")))
    return both.filter(F.col("c") * den >= (F.col("n1") + F.col("n2") - F.col("c")) * num).select("src", "id1", "id2")


def similar_classes(members: DataFrame, num: int = 6, den: int = 10, giant: int = 200_000, shard_bytes: int = SHARD, occur: int = OCCUR) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, id1, id2) of representatives with Jaccard >= num/den, and (src, id, rep) for each set.

    ``members(src, id, tok)`` may repeat rows; null ids and tokens are none, so a set without tokens doesn't exist and
    is similar to nothing. Equal sets form one class, represented by their least id; exactly the threshold counts.
    ids and tokens are bigints. No partner is dropped: a token whose records' prefixes have more than ``shard_bytes`` has
    its records split into blocks which are probed pair by pair of blocks.
    """
    from ..session import cut, shuffle_width

    m, big = memberships(members, giant)
    is_big = not big.isEmpty()
    small = m.join(F.broadcast(big), ["src", "id"], "left_anti") if is_big else m
    rank = ranked(small)
    length = F.col("n") - need(F.col("n"), num, den) + 1 - F.col("unique")
    # only sets without a token of their own can be equal; a digest of their tokens stands for them
    digest = F.when(F.col("unique") == 0, F.sha2(F.array_join(F.transform("ranked", lambda r: r["tok"].cast("string")), ","), 256))
    sets = cut(rank.select("src", "id", "n", length.cast("int").alias("length"), "ranked", digest.alias("digest")))
    all_ids = sets.select("src", "id")
    same = sets.filter("digest is not null").groupBy("src", "n", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("src", "digest", "rep")
    twins = cut(sets.select("src", "id", "digest").join(same, ["src", "digest"]).select("src", "id", "rep"))
    copies = twins.filter(F.col("id") != F.col("rep")).select("src", "id")
    one = sets.join(copies, ["src", "id"], "left_anti").filter("length > 0")
    one = one.select("src", "id", "n", F.slice("ranked.tok", 1, F.col("length")).alias("head"), F.slice("ranked.tok", 1, F.col("length") + occur - 1).alias("prefix"), F.col("ranked.tok").alias("toks"))
    one = cut(one.withColumn("rest", F.size("toks") - F.size("prefix")))
    weight = (F.size("prefix") * 8 + 64).cast("long")
    heads = one.select("src", F.explode("head").alias("tok"), weight.alias("weight")).groupBy("src", "tok").agg(F.sum("weight").alias("weight"))
    crowd = cut(heads.filter(F.col("weight") > shard_bytes).select("src", "tok", F.ceil(F.col("weight") / shard_bytes).cast("int").alias("blocks")))
    total = one.agg(F.sum(weight * F.size("head"))).first()[0] or 0
    shards = max(1, min(64, 2 * shuffle_width(members.sparkSession)), total // shard_bytes)
    sent = one
    n_crowd = crowd.count()
    if n_crowd:
        split = one.select("src", "id", "n", "rest", "prefix", F.explode("head").alias("tok")).join(F.broadcast(crowd) if n_crowd <= FEW else crowd, ["src", "tok"])
        held = split.groupBy("src", "id").agg(F.collect_list("tok").alias("crowded"))
        sent = one.join(held, ["src", "id"], "left").withColumn("head", F.when(F.col("crowded").isNull(), F.col("head")).otherwise(F.array_except("head", "crowded")))
        split = split.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.select("src", "id", "n", "rest", "prefix", F.array("tok").alias("head"), F.col("tok").alias("shard"), F.least("part", "other").alias("part1"), F.greatest("part", "other").alias("part2"), "part")
    shard_of = lambda t: F.pmod(F.xxhash64(t), F.lit(shards))
    sent = sent.select("src", "id", "n", "rest", "prefix", "head", F.explode(F.array_distinct(F.transform("head", shard_of))).alias("shard"))
    sent = sent.select("src", "id", "n", "rest", "prefix", F.filter("head", lambda t: shard_of(t) == F.col("shard")).alias("head"), "shard", F.lit(-1).alias("part1"), F.lit(-1).alias("part2"), F.lit(0).alias("part"))
    if n_crowd:
        sent = sent.unionByName(split)
    found = sent.groupBy("src", "shard", "part1", "part2").applyInArrow(_shard(num, den, occur), PAIRS)
    pairs = _checked(cut(found.distinct()), one, num, den)
    if is_big:
        met = cut(_giant_pairs(m, big, num, den))
        equal = met.filter("same").groupBy("src", F.col("id2").alias("id")).agg(F.min("id1").alias("rep"))
        twins = cut(twins.unionByName(equal))
        for c in ("id1", "id2"):
            met = met.join(twins.select("src", F.col("id").alias(c)).filter(F.col("id") != F.col("rep")), ["src", c], "left_anti")
        pairs = pairs.unionByName(met.select("src", "id1", "id2"))
        all_ids = all_ids.unionByName(big.select("src", "id"))
    member = all_ids.join(twins, ["src", "id"], "left").select("src", "id", F.coalesce("rep", "id").alias("rep"))
    return pairs.distinct(), member


def _giant_pairs(m: DataFrame, big: DataFrame, num: int, den: int) -> DataFrame:
    """(src, id1, id2, same) with a giant set: both sets have at least num/den of the least giant's different members,
    so they are few; their common tokens are counted by a join."""
    from ..session import cut

    least = -(-big.agg(F.min("n")).first()[0] * num // den)
    rows = cut(_longer(m, least))
    near = rows.groupBy("src", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    flagged = near.join(F.broadcast(big.select("src", "id", F.lit(True).alias("big"))), ["src", "id"], "left")
    rows = rows.join(F.broadcast(flagged), ["src", "id"])
    a = rows.filter("big").select("src", "tok", F.col("id").alias("a"), F.col("n").alias("na"))
    b = rows.select("src", "tok", F.col("id").alias("b"), F.col("n").alias("nb"), "big")
    met = a.join(b, ["src", "tok"]).filter((F.col("a") < F.col("b")) | (F.col("big").isNull() & (F.col("a") != F.col("b"))))
    met = met.groupBy("src", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    met = met.filter(F.col("c") * den >= (F.col("na") + F.col("nb") - F.col("c")) * num)
    same = (F.col("c") == F.col("na")) & (F.col("c") == F.col("nb"))
    return met.select("src", F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), same.alias("same"))


def similar_pairs(members: DataFrame, num: int = 6, den: int = 10, **how) -> DataFrame:
    """(src, id1, id2), id1 < id2: all pairs above the threshold, copies included."""
    from ..session import cut

    pairs, member = similar_classes(members, num, den, **how)
    member = cut(member)
    rep = lambda c: member.select("src", F.col("rep").alias(f"id{c}"), F.col("id").alias(f"m{c}"))
    across = pairs.join(rep(1), ["src", "id1"]).join(rep(2), ["src", "id2"]).select("src", "m1", "m2")
    copied = member.filter(F.col("rep") != F.col("id")).select("src", "rep").distinct()
    group = member.join(copied, ["src", "rep"], "left_semi")
    inside = group.select("src", "rep", F.col("id").alias("m1")).join(group.select("src", "rep", F.col("id").alias("m2")), ["src", "rep"]).filter(F.col("m1") < F.col("m2")).select("src", "m1", "m2")
    both = across.unionByName(inside)
    return both.select("src", F.least("m1", "m2").alias("id1"), F.greatest("m1", "m2").alias("id2"))


def links_per_record(members: DataFrame, num: int = 6, den: int = 10, **how) -> DataFrame:
    """(src, id, class_id, n_links): for each set its class of equal sets and the number of records above the
    threshold, copies of its own class included. Copies aren't expanded into pairs."""
    from ..session import cut

    pairs, member = similar_classes(members, num, den, **how)
    member = cut(member)
    weight = member.groupBy("src", "rep").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.select("src", F.col("id1").alias("rep"), F.col("id2").alias("to")).unionByName(pairs.select("src", F.col("id2").alias("rep"), F.col("id1").alias("to")))
    linked = ends.join(weight.withColumnRenamed("rep", "to"), ["src", "to"]).groupBy("src", "rep").agg(F.sum("copies").alias("linked"))
    out = member.join(weight, ["src", "rep"]).join(linked, ["src", "rep"], "left")
    return out.select("src", "id", F.col("rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))


def barcode_sets(pieces: DataFrame, kind: str = "L1") -> DataFrame:
    """Members (src = 'bc', id, tok) of the barcode sets of one kind; -1 is an empty slot."""
    return pieces.filter(F.col("kind") == kind).select(F.lit("bc").alias("src"), F.col("edge").alias("id"), F.explode(F.array_distinct("keys")).alias("tok")).filter(F.col("tok") != -1)


def partner_sets(links: DataFrame) -> DataFrame:
    """Members (src = 'link', id, tok) of the partner sets of contigs; an edge is no partner of itself."""
    return links.filter(F.col("e1") != F.col("e2")).select(F.lit("link").alias("src"), F.col("e1").alias("id"), F.col("e2").alias("tok"))
