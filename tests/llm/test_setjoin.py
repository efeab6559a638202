import random

import pytest

from readloom.llm import setjoin

SCHEMA = "src string, id long, tok long, n int"


def members(spark, sets, extra=()):
    rows = [(s, i, t, 7) for (s, i), toks in sets.items() for t in toks]
    return spark.createDataFrame(rows + rows[:30] + list(extra), SCHEMA)


def brute(sets, num=6, den=10):
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and sets[a] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


def sample(seed, n=150):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        base = set(rng.sample(range(60 if seed % 2 else 900), rng.randint(1, 14))) | ({-5} if rng.random() < 0.6 else set())
        sets["a", i] = base
        if rng.random() < 0.4:
            near = set(rng.sample(sorted(base), max(1, len(base) * 4 // 5))) | {rng.randrange(900)}
            sets["a" if rng.random() < 0.7 else "b", 1000 + i] = near
        if rng.random() < 0.2:
            sets["a", 2000 + i] = set(base)
    return sets


@pytest.mark.parametrize("seed", range(4))
def test_pairs_against_brute_force(spark, seed):
    sets = sample(seed)
    got = [tuple(r) for r in setjoin.similar_pairs(members(spark, sets)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(sets)


def test_crowded_tokens_are_probed_in_blocks(spark):
    sets = sample(1, 120)
    got = {tuple(r) for r in setjoin.similar_pairs(members(spark, sets), shard_bytes=600).collect()}
    assert got == brute(sets)


def test_large_sets_in_small_shards(spark):
    """Hundreds of sets with thousands of common members each: shards stay within their bytes and nothing is lost."""
    rng = random.Random(11)
    base = [rng.sample(range(20_000), 1500) for _ in range(30)]
    sets = {("a", i): set(rng.sample(base[i % 30], 1300)) | {rng.randrange(20_000) for _ in range(rng.choice([20, 300]))} for i in range(240)}
    got = {tuple(r) for r in setjoin.similar_pairs(members(spark, sets), shard_bytes=1 << 20).collect()}
    want = brute(sets)
    assert want and got == want


def test_giant_sets_are_joined_as_relations(spark):
    sets = sample(2, 60) | {("a", 5000): set(range(100, 160)), ("a", 5001): set(range(95, 158)), ("a", 5002): set(range(100, 140))}
    got = {tuple(r) for r in setjoin.similar_pairs(members(spark, sets), giant=41).collect()}
    assert got == brute(sets)


def test_giant_sets_by_different_members(spark):
    few = {("a", 6000 + i): set(range(3000, 3008 + i % 2)) for i in range(4)}  # few members, repeated below
    large = {("a", 7000): set(range(100, 160)), ("a", 7001): set(range(100, 160)), ("a", 7002): set(range(95, 158)), ("a", 7003): set(range(100, 140)), ("a", 7004): set(range(100, 140))}
    sets = sample(2, 60) | few | large
    repeats = [("a", i, t, k) for _, i in few for t in few["a", i] for k in range(9)] + [("a", 7003, 100, k) for k in range(90)]
    df = members(spark, sets, repeats)
    got = [tuple(r) for r in setjoin.similar_pairs(df, giant=41).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(sets)
    want = {k: 0 for k in sets}
    for s, a, b in brute(sets):
        want[s, a] += 1
        want[s, b] += 1
    rows = {(r["src"], r["id"]): r for r in setjoin.links_per_record(df, giant=41).collect()}
    assert {k: r["n_links"] for k, r in rows.items()} == want
    assert {k: r["class_id"] for k, r in rows.items()} == {k: min(i for s, i in sets if s == k[0] and sets[s, i] == sets[k]) for k in sets}


def test_links_per_record(spark):
    sets = sample(3, 80)
    pairs = brute(sets)
    want = {k: 0 for k in sets}
    for s, a, b in pairs:
        want[s, a] += 1
        want[s, b] += 1
    got = setjoin.links_per_record(members(spark, sets)).collect()
    assert {(r["src"], r["id"]): r["n_links"] for r in got} == want
    for r in got:
        assert sets[r["src"], r["id"]] == sets[r["src"], r["class_id"]] and r["class_id"] <= r["id"]


def test_threshold_counts_and_nulls(spark):
    sets = {("a", 1): {1, 2, 3, 4}, ("a", 2): {1, 2, 3, 5}, ("a", 3): {1, 2, 3, 4, 9}, ("a", 4): {99}}  # 3 of 5 counts
    odd = [("a", None, 1, 0), ("a", 1, None, 0), ("a", 8, None, 0)]
    assert {tuple(r) for r in setjoin.similar_pairs(members(spark, sets, odd)).collect()} == brute(sets) == {("a", 1, 2), ("a", 1, 3)}


def test_empty(spark):
    assert setjoin.similar_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_probe(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
    want = rng.randint(1, len(lists))
    low, high = sorted((rng.randrange(61), rng.randrange(61)))
    expect = [x for x in range(low, high) if sum(x in y for y in lists) >= want]
    assert setjoin.probe(lists, want, low, high) == expect
