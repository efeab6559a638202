import random

import pytest

from readloom.operators import contigs, graph, links, scaffold

CONTIG = "edge_id long, rc_id long, node_from long, node_to long, graph string, seq_len int, cnt long, holes array<struct<pos:int,len:int>>"


def strands(spec):
    """Both strands of (id, u, v, len, cnt): node x has the mirror -x."""
    out = []
    for i, u, v, n, c in spec:
        out += [(2 * i, 2 * i + 1, u, v, "local", n, c, []), (2 * i + 1, 2 * i, -v, -u, "local", n, c, [])]
    return out


def frame(spark, spec):
    rows = strands(spec)
    return spark.createDataFrame(rows + rows[:1], CONTIG)


def ids(df):
    return {r[0] for r in df.collect()}


def test_planted_tip_and_chimeric_edge(spark):
    main = [(1, 1, 2, 5000, 500_000), (2, 2, 3, 5000, 500_000)]
    assert ids(graph.tips(frame(spark, main + [(3, 9, 2, 120, 89)]))) == {6, 7}
    assert ids(graph.tips(frame(spark, main + [(3, 9, 2, 5000, 490_000)]))) == set()
    cross = [(1, 1, 2, 5000, 500_000), (2, 2, 3, 5000, 500_000), (4, 11, 12, 5000, 500_000), (5, 12, 13, 5000, 500_000), (6, 2, 12, 150, 119)]
    assert ids(graph.chimeric(frame(spark, cross))) == {12, 13}


def test_bubbles_and_simplify(spark):
    spec = [(1, 1, 2, 5000, 500_000), (2, 2, 3, 90, 2000), (3, 2, 3, 95, 1000), (4, 3, 4, 5000, 500_000)]
    b = {r["kept"]: (r["n"], r["cnt"]) for r in graph.bubbles(frame(spark, spec)).collect()}
    assert b == {6: (2, 3000), 7: (2, 3000)}
    assert ids(graph.simplify(frame(spark, spec)).select("edge_id")) == {2, 3, 6, 7, 8, 9}


def test_chains_and_rings(spark):
    line = [(1, 1, 2, 100, 10), (2, 2, 3, 200, 20), (3, 3, 4, 300, None), (5, 20, 21, 70, 1), (6, 21, 20, 80, 1)]
    got = {(r["n_edges"], r["seq_len"], r["cnt"], r["is_cycle"]) for r in graph.condense(frame(spark, line)).collect()}
    assert got == {(3, 600 - 62, 30, False), (2, 150 - 62, 2, True)}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.connected(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matching_against_sequential(spark, seed):
    rng = random.Random(seed)
    pairs = {}
    for _ in range(300):
        a, b = sorted(rng.sample(range(80), 2))
        pairs[a, b] = rng.randrange(12)
    used, want = set(), set()
    for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, n))
    got = {tuple(r) for r in scaffold.greedy(spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a long, b long, n long")).collect()}
    assert got == want


def test_scaffold_order_and_ring(spark):
    spec = [(i, 10 * i, 10 * i + 1, 5000, 1) for i in range(1, 8)]
    c = frame(spark, spec)
    link = [(2, 4, 9), (4, 7, 8), (8, 10, 7), (10, 12, 6), (12, 8, 5)]  # 1+ 2+ 3-, and a ring 4 5 6
    rows = [(v, u, n, n, None) for v, u, n in link]
    df = spark.createDataFrame(rows, "e1 long, e2 long, n_read int, n_pair int, counted_at timestamp")
    got = {}
    for r in scaffold.scaffolds(df, c).collect():
        got.setdefault(r["scaffold"], {})[r["pos"]] = r["edge_id"]
    orders = {tuple(v[i] for i in range(len(v))) for v in got.values()}
    assert (2, 4, 7) in orders or (6, 5, 3) in orders
    assert (8, 10, 12) in orders or (13, 11, 9) in orders
    assert sum(map(len, orders)) == 7


def test_bfs_goes_on_to_the_end(spark):
    spec = [(0, 1, 2, 5000, 1)] + [(i, 1 + i, 2 + i, 100, 1) for i in range(1, 20)] + [(30, 5, 40, 90, 1), (31, 40, 3, 90, 1), (32, 50, 51, 90, 1)]
    got = {r["edge_id"]: r["level"] for r in graph.bfs(frame(spark, spec)).collect()}
    assert got == {2 * i: i for i in range(20)} | {60: 4, 62: 5}


def test_ways_over_many_contigs(spark):
    spec = [(0, 1, 2, 5000, 1)] + [(i, 1 + i, 2 + i, 61, 1) for i in range(1, 9)] + [(9, 10, 11, 5000, 1), (20, 2, 10, 700, 1), (21, 6, 6, 40, 1)]  # eight of 30 bases, a longer detour, a loop of 9
    c = frame(spark, spec)
    paths = {(r["src"], r["des"]): (r["inserted"], r["n_middle"]) for r in graph.shortest_paths(c).collect()}
    assert paths == {(0, 18): (240, 8), (19, 1): (240, 8)}
    placed = spark.createDataFrame([(0, 0, 0), (0, 1, 18)], "scaffold long, pos long, edge_id long")
    assert [(r["state"], r["inserted"]) for r in scaffold.bridges(placed, c).collect()] == [("path", 240)]
    counts = {(r["src"], r["des"]): r["n_paths"] for r in graph.path_counts(c).collect()}
    assert counts == {(0, 18): 1 + 23, (19, 1): 1 + 23}  # the detour; eight contigs and the loop 0 to 22 times, 30 in all
    beside = spec[1:9] + [(20, 2, 10, 271, 1)]
    found = {r["edge_id"]: (r["n_edges"], r["length"]) for r in graph.bulges(frame(spark, beside)).collect()}
    assert found == {40: (8, 271), 41: (8, 271)}


def test_empty_and_null_contigs(spark):
    empty = spark.createDataFrame([], CONTIG)
    for f in (graph.invariants, graph.degrees, graph.components, graph.condense, graph.tips, graph.bubbles, graph.bfs, graph.shortest_paths, contigs.n50, contigs.units):
        f(empty).collect()
    odd = spark.createDataFrame([(1, None, 5, 6, "global", 10, None, None)], CONTIG)
    assert contigs.coverage(odd).collect()[0]["cov"] is None
    assert graph.condense(odd).collect()[0]["n_edges"] == 1
    assert {r["rule"]: r["violations"] for r in graph.invariants(odd).collect()}["rc_exists"] == 0


def test_shared_counts_with_common_barcodes(spark):
    rng = random.Random(1)
    sets = {e: set(rng.sample(range(300), 20)) | {1000, 1001, 1002} for e in range(60)}
    sets[61] = set(list(sets[1])[:15]) | {1000}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 5}
    got = links.shared_counts(spark.createDataFrame([(e, k) for e, s in sets.items() for k in s], "edge long, key long"), 5)
    assert {tuple(r) for r in got.collect()} == want
