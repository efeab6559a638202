import random

import numpy as np
import pytest

from readloom.llm import spans

SCHEMA = "edge long, p int, mm long, k int"


def brute(rows, m):
    records = {}
    for e, p, mm in {(r[0], r[1], r[2]) for r in rows if r[0] is not None and r[1] is not None}:
        records.setdefault(e, []).append((p, mm is not None, mm or 0))
    seen, places = {}, {}
    for e, x in records.items():
        x.sort()
        for i in range(len(x) - m + 1):
            w = x[i : i + m]
            if all(y[1] for y in w):
                key = tuple(y[2] for y in w), tuple(b[0] - a[0] for a, b in zip(w, w[1:]))
                seen.setdefault(key, set()).add(e)
                places.setdefault(key, []).append((e, [y[0] for y in w]))
    return {(e, p) for k, es in seen.items() if len(es) > 1 for e, ps in places[k] for p in ps}


def sample(seed, records=40, alphabet=40, length=60):
    rng = random.Random(seed)
    passages = [[(rng.randint(1, 9), rng.randrange(alphabet)) for _ in range(rng.randint(3, 30))] for _ in range(6)]
    rows = []
    for e in range(records):
        p = 0
        while p < length * 5:
            part = rng.choice(passages) if rng.random() < 0.3 else [(rng.randint(1, 9), rng.randrange(alphabet)) for _ in range(rng.randint(1, 9))]
            for gap, mm in part:
                p += gap
                rows.append((e, p, None if rng.random() < 0.01 else mm, 0))
    return rows + rows[:40] + [(1, None, 5, 0), (None, 4, 5, 0)]


@pytest.mark.parametrize("seed,m", [(0, 12), (1, 5), (2, 3), (3, 12)])
def test_against_brute_force(spark, seed, m):
    rows = sample(seed)
    got = [tuple(r) for r in spans.shared_entries(spark.createDataFrame(rows, SCHEMA), m).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, m)


def test_crowded_symbols_and_periodic_records(spark):
    rows = [(e, 2 * i, i % 2, 0) for e in range(8) for i in range(50 + e)] + [(99, 2 * i, 7, 0) for i in range(80)] + sample(5)
    got = {tuple(r) for r in spans.shared_entries(spark.createDataFrame(rows, SCHEMA), 12, hot=5).collect()}
    assert got == brute(rows, 12)


def test_repeats_within_one_record_are_not_shared(spark):
    rows = [(1, 3 * i, i % 13, 0) for i in range(60)]
    assert spans.shared_entries(spark.createDataFrame(rows, SCHEMA), 12).collect() == []


def test_blocks_of_a_long_record(spark):
    rows = sample(7, records=4, length=400)
    got = {tuple(r) for r in spans.pieces(spark.createDataFrame(rows, SCHEMA), 12, width=16).select("edge").collect()}
    assert got == {(e,) for e in range(4)}
    want = brute(rows, 12)
    st = spans.pieces(spark.createDataFrame(rows, SCHEMA), 12, width=16).mapInArrow(spans._stretches(12), spans.STRETCH)
    assert want <= {(r["edge"], r["p0"] + int(g)) for r in st.collect() for g in np.r_[0, np.cumsum(r["gaps"])]}


def test_empty_and_short(spark):
    assert spans.shared_entries(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spans.shared_entries(spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 0)], SCHEMA)).collect() == []
    assert {tuple(r) for r in spans.shared_share(spark.createDataFrame([(1, 1, 1, 0), (1, 1, 1, 0)], SCHEMA)).collect()} == {(1, 1, 0)}


@pytest.mark.parametrize("seed", range(5))
def test_index_parts(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 6, 200)
    sa = spans.suffix_array(s)
    assert list(sa) == sorted(range(200), key=lambda i: tuple(s[i:]))
    tree = spans.WaveletMatrix(s, 6)
    c, i = rng.integers(0, 6, 50), rng.integers(0, 201, 50)
    assert list(tree.rank(c, i)) == [int((s[:b] == a).sum()) for a, b in zip(c, i)]
