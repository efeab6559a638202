import random

import pytest

from readloom.llm import overlap

SCHEMA = "edge long, kind string, keys array<long>, cnts array<int>"


def pieces(sets, rng):
    rows = []
    for e, keys in sets.items():
        keys = list(keys)
        rng.shuffle(keys)
        for i in range(0, len(keys), 40):
            part = keys[i : i + 40] + keys[:3] + [-1, 10**9 + e]
            rows.append((e, "COV", part, [2] * (len(part) - 1) + [1]))
    return rows + [(1, "COV", None, None), (None, "COV", [5], [9]), (2, "L1", [5], [9]), (77, "COV", [], [])]


def make(seed, size):
    rng = random.Random(seed)
    sets = {}
    for e in range(24):
        n = rng.choice(size)
        sets[e] = {rng.randrange(10**7) for _ in range(n)} | set(range(20))
    for e in range(0, 24, 3):
        small = min(sets[e], sets[e + 1], key=len)
        big = e + 1 if small is sets[e] else e
        share = rng.choice([0.1, 0.2, 0.42, 0.6])
        sets[big] |= set(rng.sample(sorted(small), int(share * len(small))))
    return sets, rng


def brute(sets, share):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= share * min(len(sets[a]), len(sets[b]))}


@pytest.mark.parametrize("seed,size,sample", [(0, [300, 500], 4096), (1, [4000, 6000], 400), (2, [60, 5000], 300), (3, [1500, 9000], 200)])
def test_pairs(spark, seed, size, sample):
    sets, rng = make(seed, size)
    members, sizes = overlap.coverage_members(spark.createDataFrame(pieces(sets, rng), SCHEMA))
    got = [tuple(r) for r in overlap.overlapping(members, sizes, 0.3, sample=sample).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(sets, 0.3)


def test_intervals_cover_the_truth(spark):
    sets, rng = make(4, [6000, 9000])
    members, sizes = overlap.coverage_members(spark.createDataFrame(pieces(sets, rng), SCHEMA))
    rows = overlap.sampled_overlaps(members, sizes, 0.3, sample=500).collect()
    assert rows and not all(r["exact"] for r in rows)
    for r in rows:
        share = len(sets[r["e1"]] & sets[r["e2"]]) / min(len(sets[r["e1"]]), len(sets[r["e2"]]))
        n = min(r["n1"], r["n2"])
        assert r["low"] / n - 0.02 <= share <= r["high"] / n + 0.02


def test_sets_of_common_identifiers_only(spark):
    sets = {e: set(range(e % 3, 30)) for e in range(12)}
    members, sizes = overlap.coverage_members(spark.createDataFrame(pieces(sets, random.Random(1)), SCHEMA))
    assert {tuple(r) for r in overlap.overlapping(members, sizes, 0.3).collect()} == brute(sets, 0.3)


def test_sets_keep_a_sample_only(spark):
    """Without a given sample a tenth of the median set is kept, and still every pair comes out."""
    sets, rng = make(6, [3000, 5000, 9000])
    members, sizes = overlap.coverage_members(spark.createDataFrame(pieces(sets, rng), SCHEMA))
    assert overlap.sample_size(sizes, 0.3, 4.0) < 700
    rows = overlap.sampled_overlaps(members, sizes, 0.3).collect()
    assert rows and not any(r["exact"] for r in rows)
    assert {tuple(r) for r in overlap.overlapping(members, sizes, 0.3).collect()} == brute(sets, 0.3)
    held = overlap.intervals(members, sizes, 0.3).collect()
    assert {(r["e1"], r["e2"]) for r in held} == brute(sets, 0.3)
    assert all(r["covered"] for r in held)


def test_two_thousand_common_identifiers(spark):
    """More common identifiers than any list would hold: all sets share them, and few pairs share more."""
    rng = random.Random(8)
    sets = {e: set(range(2000)) | {rng.randrange(2000, 10**8) for _ in range(9000)} for e in range(30)}
    sets[1] |= set(sorted(sets[0])[2000:6000])
    members, sizes = overlap.coverage_members(spark.createDataFrame(pieces(sets, rng), SCHEMA))
    assert {tuple(r) for r in overlap.overlapping(members, sizes, 0.3, sample=500).collect()} == brute(sets, 0.3)


def test_empty(spark):
    members, sizes = overlap.coverage_members(spark.createDataFrame([], SCHEMA))
    assert overlap.overlapping(members, sizes, 0.3).collect() == []
