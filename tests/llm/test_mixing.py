import random

import pytest

from readloom.llm import mixing

DOCS = "doc_id long, source string, n_tokens int, block int, repeats int"


def corpus(seed=1):
    rng = random.Random(seed)
    sizes = {"big": 3000, "mid": 400, "small": 40, "other": 100, None: 50}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, rng.randint(0, 60), 0, 0))
            i += 1
    return rows


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)]


def run(spark, rows, budget=None, blocks=64):
    docs, targets = spark.createDataFrame(rows, DOCS), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mixing.mixture(docs, targets, budget, blocks=blocks)
    return mix.collect(), {r["source"]: r for r in mixing.reached(mix, mixing.source_sizes(docs, targets)).collect()}


@pytest.mark.parametrize("blocks", [1, 8, 1024])
def test_shares_and_limits(spark, blocks):
    rows = corpus()
    used, report = run(spark, rows, blocks=blocks)
    limit = {s: r for s, _, r in TARGETS}
    assert len({r["doc_id"] for r in used}) == len(used)
    assert all(1 <= r["repeats"] <= limit[r["source"]] and r["n_tokens"] > 0 for r in used)
    total = sum(r["n_tokens"] * r["repeats"] for r in used)
    tokens = {s: sum(r[2] for r in rows if r[1] == s) for s in limit}
    budget = min(tokens[s] * limit[s] * 0.95 / t for s, t, _ in TARGETS if tokens[s])
    for s, t, _ in TARGETS:
        want = 0 if s == "absent" else t / 0.95
        assert abs(report[s]["actual_share"] - want) < 0.02
        got = sum(r["n_tokens"] * r["repeats"] for r in used if r["source"] == s)
        assert got == report[s]["used_tokens"] and want * budget - 60 <= got <= want * budget + 1e-6
    assert report["other"]["used_tokens"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert total == sum(r["used_tokens"] for r in report.values())


def test_repeatable_and_spread_over_partitions(spark):
    rows = corpus(2)
    a, b = run(spark, rows)[0], run(spark, list(reversed(rows)))[0]
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_order_is_a_permutation_per_epoch(spark):
    used, _ = run(spark, corpus(4))
    mix = spark.createDataFrame([tuple(r) for r in used], "doc_id long, source string, n_tokens int, repeats int")
    rows = mixing.ordered(mix, per_block=50).collect()
    assert len(rows) == sum(r["repeats"] for r in used)
    assert len({(r["epoch"], r["doc_id"]) for r in rows}) == len(rows)
    for key in {(r["epoch"], r["block"]) for r in rows}:
        assert sorted(r["place"] for r in rows if (r["epoch"], r["block"]) == key) == list(range(1, 1 + sum((r["epoch"], r["block"]) == key for r in rows)))
    again = mixing.ordered(mix.orderBy("n_tokens"), per_block=50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.ordered(mix.limit(0)).collect() == []


def test_exponent():
    sources = [("a", 900, 0.5, 1), ("b", 100, 0.5, 1)]
    assert [round(x[4], 6) for x in mixing.plan(sources)] == [0.5, 0.5]
    full = mixing.plan(sources, budget=1000)  # only the natural shares fit
    assert abs(full[0][4] - 0.9) < 1e-6 and abs(full[1][5] - 100) < 1e-3
    some = mixing.plan(sources, budget=400)
    assert abs(some[1][5] - 100) < 1e-6 and abs(some[0][5] - 300) < 1e-6
    low = mixing.plan(sources, budget=10, entropy_at_most=0.5)
    assert abs(mixing.entropy({x[0]: x[4] for x in low}) - 0.5) < 1e-9


def test_quotas_are_floats_at_the_limit():
    assert all(isinstance(x[5], float) for x in mixing.plan([("a", 900, 0.5, 1), ("b", 100, 0.5, 1), ("c", 0, 0.1, 1)], budget=5000))


def test_empty(spark):
    used, report = run(spark, [])
    assert used == [] and all(r["actual_share"] == 0 for r in report.values())
