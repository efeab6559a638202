import random
from collections import Counter

import numpy as np
import pytest

from readloom.llm import heavy

SCHEMA = "src string, val string, n int"


@pytest.mark.parametrize("width", [16, 64, 512])
def test_bounds_hold_and_heavy_values_are_found(spark, width):
    rng = random.Random(width)
    rows = [("a", f"h{min(int(rng.expovariate(0.6)), 12)}", 1) for _ in range(4000)] + [("a", f"x{rng.randrange(3000)}", 1) for _ in range(5000)]
    rows += [("b", "only", 1)] * 700 + [("b", None, 1)] * 900
    rng.shuffle(rows)
    count = Counter((s, v) for s, v, _ in rows if v is not None)
    n = Counter(s for s, v, _ in rows if v is not None)
    got = {(r["src"], r["val"]): r for r in heavy.heavy_values(spark.createDataFrame(rows, SCHEMA).repartition(5), 0.05, width).collect()}
    for k, r in got.items():
        assert r["lower"] <= count[k] <= r["upper"]
        assert r["n_rows"] == n[k[0]]
    if width >= 64:
        assert {k for k, c in count.items() if c >= 0.05 * n[k[0]]} <= set(got)


def test_exact_counts(spark):
    rows = [("a", f"v{i % 40}", 0) for i in range(1000)] + [("a", "top", 0)] * 500
    got = {tuple(r) for r in heavy.heavy_counts(spark.createDataFrame(rows, SCHEMA), 0.1).collect()}
    assert got == {("a", "top", 500)}


def test_merging_cells_is_vote_cancellation():
    s = heavy.Sketch(1)
    for values, counts in ((["x", "y"], [5, 2]), (["z"], [1]), (["y"], [9])):
        h = np.array([hash(v) for v in values])
        s.add(h, [np.zeros(len(values), int)] * heavy.DEPTH, np.array(values, object), np.array(counts))
    assert s.total[0, 0] == 17 and s.value[0, 0] == "y" and s.surplus[0, 0] == 7  # 3 x, then 2 x, then 9 - 2 y


def test_empty_null_and_long_values(spark):
    assert heavy.heavy_counts(spark.createDataFrame([], SCHEMA), 0.1).collect() == []
    assert heavy.heavy_counts(spark.createDataFrame([("a", None, 1)], SCHEMA), 0.1).collect() == []
    long = "ACGT" * 300_000
    rows = [("a", long, 1), ("a", long, 1), ("a", "", 1), ("a", "", 1), ("a", "s", 1)]
    got = {tuple(r) for r in heavy.heavy_counts(spark.createDataFrame(rows, SCHEMA), 0.3).collect()}
    assert got == {("a", long, 2), ("a", "", 2)}
