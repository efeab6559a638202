import random

import pytest
from test_graph import frame

from readloom.operators import regions


def brute(rows):
    """Sets, inner contigs and removals by walking, one source after the other."""
    ends = {r[0]: (r[2], r[3], r[6], r[1]) for r in rows}
    into, out = {}, {}
    for i, (u, v, _, _) in ends.items():
        into.setdefault(v, []).append(i)
        out.setdefault(u, []).append(i)
    sets = {}
    for s in sorted(out):
        if len(out[s]) < 2:
            continue
        step, level, n = {s: 0}, [s], 0
        count = {}
        while level:
            n, new = n + 1, []
            for u in level:
                for i in out.get(u, []):
                    v = ends[i][1]
                    if v != s:
                        count[v] = count.get(v, 0) + 1
            for v, c in count.items():
                if v not in step and c == len(into[v]):
                    new.append(v)
            step.update(dict.fromkeys(new, n))
            level = new
        sets[s] = step
    whole = {}
    for s, step in sets.items():
        x = [i for i, (u, v, _, _) in ends.items() if u in step and v in step]
        ids = set(x)
        if x and len(x) > len({ends[i][1] for i in x}) and not any(ends[i][3] in ids or ends[i][0] == ends[i][1] for i in x):
            whole[s] = x
    gone = set()
    least = {}
    for s in whole:
        for v in sets[s]:
            least[v] = min(least.get(v, s), s)
    for s, x in whole.items():
        if any(least[v] != s for v in sets[s]):
            continue
        lead = {}
        for i in sorted(x, key=lambda i: (sets[s][ends[i][0]], -(ends[i][2] or 0), i)):
            lead.setdefault(ends[i][1], i)
        kept, at = set(), [v for v in sets[s] if not any(ends[i][0] == v for i in x)]
        while at:
            v = at.pop()
            if v in lead:
                kept.add(lead[v])
                at.append(ends[lead[v]][0])
        gone |= {(s, i) for i in x if i not in kept}
    return sets, gone


@pytest.mark.parametrize("seed", range(3))
def test_sets_and_removals_against_walking(spark, seed):
    rng = random.Random(seed)
    spec, i = [], 0
    for base in range(10, 200, 20):  # ladders with ties between their rungs
        for a in range(base, base + 8):
            for b in rng.sample(range(a + 1, base + 10), min(base + 9 - a, rng.choice([1, 2]))):
                i += 1
                spec.append((i, a, b, rng.choice([60, 90]), rng.randrange(1, 9)))
    df = frame(spark, spec)
    sets, gone = brute([r for r in map(tuple, df.distinct().collect())])
    # coverage is the count over the length without k
    got = {}
    for r in regions.dominated(df).collect():
        got.setdefault(r["source"], {})[r["node"]] = r["step"]
    assert got == sets
    cov = {r["edge_id"]: r["cnt"] / (r["seq_len"] - 31) for r in df.collect()}
    _, gone = brute([(*t[:6], cov[t[0]], t[7]) for t in map(tuple, df.distinct().collect())])
    assert {tuple(r) for r in regions.removals(df).collect()} == gone


def test_long_contigs_keep_nodes_out(spark):
    spec = [(1, 1, 2, 90, 9), (2, 1, 3, 90, 9), (3, 2, 3, 90, 9), (4, 9, 3, 5000, 9), (5, 3, 4, 90, 9)]
    got = {(r["source"], r["node"]) for r in regions.dominated(frame(spark, spec)).collect()}
    assert (1, 2) in got and (1, 3) not in got and (1, 4) not in got


def test_fixpoint_leaves_trees(spark):
    spec = [(1, 1, 2, 90, 900), (2, 1, 2, 80, 90), (3, 2, 3, 90, 900), (4, 1, 3, 90, 90), (5, 3, 4, 90, 900), (6, 5, 1, 5000, 90_000), (7, 4, 6, 5000, 90_000)]
    left = {r["edge_id"] for r in regions.without_complex_bulges(frame(spark, spec)).collect()}
    assert {12, 13, 14, 15} <= left and len(left) < 14
    assert regions.removals(regions.without_complex_bulges(frame(spark, spec))).collect() == []
