import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_graph import frame, ids

from readloom.functions import packed
from readloom.operators import alignment, graph, links, mapping, paths, rewrite, scaffold, unitigs

REPEAT = [(1, 1, 3, 5000, 500_000), (2, 2, 3, 5000, 200_000), (3, 3, 4, 400, 60_000), (4, 4, 5, 5000, 500_000), (5, 4, 6, 5000, 200_000)]
PIECES = "edge long, kind string, keys array<long>, cnts array<int>"


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def sets(spark, of):
    return spark.createDataFrame([(e, "L1", list(k), [1] * len(k)) for e, k in of.items()] + [(9, "L1", None, None)], PIECES)


def test_chains_become_one_contig_on_both_strands(spark):
    spec = [(1, 1, 2, 500, 100), (2, 2, 3, 300, None), (3, 3, 4, 200, 50), (4, 3, 5, 700, 70)]
    got = {r["edge_id"]: r for r in rewrite.condensed(frame(spark, spec)).collect()}
    assert set(got) == {2, 5, 6, 7, 8, 9}
    assert (got[2]["rc_id"], got[2]["node_from"], got[2]["node_to"], got[2]["seq_len"], got[2]["cnt"]) == (5, 1, 3, 769, 100)
    assert (got[5]["rc_id"], got[5]["node_from"], got[5]["node_to"], got[5]["seq_len"]) == (2, -3, -1, 769)
    m = rows(rewrite.chain_map(frame(spark, spec)), "edge_id", "head", "pos")
    assert {(2, 2, 0), (4, 2, 1), (5, 5, 0), (3, 5, 1)} <= m
    of = sets(spark, {2: [1, 2], 4: [2, 3], 6: [7]})
    assert rows(rewrite.condensed_sets(frame(spark, spec), of), "edge_id", "n") == {(2, 3), (6, 1)}


def test_repeat_is_split_by_coverage(spark):
    c = frame(spark, REPEAT)
    assert rows(rewrite.coverage_pairs(c), "mid", "e_in", "e_out") >= {(6, 2, 8), (6, 4, 10)}
    got = {r["edge_id"]: r for r in rewrite.split_repeats(c, rewrite.coverage_pairs(c)).collect()}
    assert len(got) == 4
    assert (got[2]["rc_id"], got[2]["node_to"], got[2]["seq_len"]) == (9, 5, 5000 + 400 + 5000 - 62)
    assert (got[4]["rc_id"], got[4]["node_to"]) == (11, 6) and got[9]["rc_id"] == 2 and got[11]["rc_id"] == 4
    assert got[2]["cnt"] + got[4]["cnt"] in (1_460_000, 1_459_999)
    assert {r["violations"] for r in graph.invariants(rewrite.resolve_repeats(c, rewrite.coverage_pairs)).collect()} == {0}


@pytest.mark.parametrize("of,want", [
    ({2: range(50), 8: range(50), 4: range(100, 150), 10: range(100, 150)}, ("straight",) * 3),
    ({2: range(50), 10: range(50), 4: range(100, 150), 8: range(100, 150)}, ("crossed",) * 3),
    ({2: range(50), 8: range(50), 4: range(20), 10: range(20)}, (None, "straight", None)),
    ({2: [1], 8: [2]}, (None, None, None)),
])
def test_levels_of_barcode_support(spark, of, want):
    got = {r["edge_id"]: tuple(r[c] for c in ("high", "medium", "low")) for r in rewrite.strict_bridges(frame(spark, REPEAT), sets(spark, of)).collect()}
    assert got[6] == want or (want[1] == "straight" and got[6][0] is None)


def test_barcodes_split_both_strands(spark):
    straight = {2: range(50), 8: range(50), 4: range(100, 150), 10: range(100, 150)}
    both = sets(spark, straight | {k ^ 1: v for k, v in straight.items()})
    got = {r["edge_id"]: r["node_to"] for r in rewrite.split_repeats(frame(spark, REPEAT), rewrite.barcode_pairs(frame(spark, REPEAT), both)).collect()}
    assert got == {2: 5, 4: 6, 9: -1, 11: -2}
    pairs = rows(rewrite.many_to_many(frame(spark, REPEAT), both), "edge_id", "e_in", "e_out", "n")
    assert {(6, 2, 8, 50), (6, 4, 10, 50)} <= pairs


def test_loop_is_unrolled_by_coverage(spark):
    spec = [(1, 1, 2, 1000, 100_000), (2, 2, 2, 300, 85_000), (3, 2, 3, 1000, 100_000)]
    got = rows(rewrite.unrolled(frame(spark, spec)), "edge_id", "before", "after", "times", "seq_len")
    assert got == {(4, 2, 6, 3, 1000 + 3 * 269 + 1000 - 31), (5, 7, 3, 3, 1000 + 3 * 269 + 1000 - 31)}
    assert rows(graph.loops(frame(spark, spec)), "edge_id", "kind") == {(4, "self"), (5, "self")}


def test_diamonds_bulges_and_branches(spark):
    spec = [(1, 1, 2, 5000, 500_000), (2, 2, 3, 900, 90_000), (3, 2, 3, 800, 8_000), (4, 3, 4, 5000, 500_000)]
    assert rows(rewrite.diamonds(frame(spark, spec)), "edge_id", "kept") == {(6, 4), (7, 5)}
    bulge = [(1, 1, 2, 5000, 500_000), (2, 2, 3, 500, 5_000), (3, 2, 9, 300, 30_000), (5, 9, 3, 250, 25_000), (4, 3, 4, 5000, 500_000)]
    assert ids(rewrite.without_bulges(frame(spark, bulge)).select("edge_id")) == {2, 3, 6, 7, 8, 9, 10, 11}
    branch = [(1, 1, 2, 5000, 500_000), (2, 2, 3, 5000, 500_000), (3, 2, 10, 90, 100), (4, 10, 11, 90, 100)]
    assert ids(graph.topological_tips(frame(spark, branch))) == {6}
    assert ids(graph.simplify(frame(spark, branch)).select("edge_id")) == {2, 3, 4, 5}


def test_reach_on_rings_and_long_chains(spark):
    spec = [(i, i, i + 1, 36, 10) for i in range(1, 40)] + [(50, 100, 101, 40, 9), (51, 101, 100, 40, 9), (52, 99, 100, 40, 9)]
    got = dict(rows(graph.downstream_reach(frame(spark, spec)), "edge_id", "reach"))
    assert got[2] == 39 * 5 and got[78] == 5 and got[100] == got[102] == got[104] == 1000


def test_ways_are_listed(spark):
    spec = [(1, 1, 2, 5000, 1), (2, 2, 3, 131, 1), (3, 2, 3, 141, 1), (4, 3, 3, 81, 1), (5, 3, 4, 5000, 1)]
    got = rows(paths.listed(frame(spark, spec)).filter("src = 2").withColumn("p", __import__("pyspark").sql.functions.array_join("path", ",")), "des", "p", "inserted")
    assert got == {(10, "4", 100), (10, "6", 110), (10, "4,8", 150), (10, "6,8", 160)}
    listed = paths.listed(frame(spark, spec)).filter("src = 2")
    assert rows(paths.kinds(listed), "n_paths", "kind") == {(4, "complex")}
    assert rows(paths.best_middle(listed, frame(spark, spec)), "edge_id", "seq_len") == {(6, 141)}
    assert [r["path"] for r in paths.ranked(listed).orderBy("rank").collect()] == [[4], [6], [4, 8], [6, 8]]


def test_longest_ways_leave_rings_out(spark):
    spec = [(1, 1, 2, 100, 1), (2, 2, 3, 100, 1), (3, 3, 4, 100, 1), (5, 10, 11, 100, 1), (6, 11, 10, 100, 1), (7, 9, 10, 100, 1)]
    assert rows(paths.longest(frame(spark, spec)), "edge_id", "n_after") == {(2, 2), (4, 1), (6, 0), (7, 2), (5, 1), (3, 0), (15, 0)}
    assert rows(paths.plain_regions(frame(spark, spec)), "n_edges") == {(3,)}


def test_hot_barcodes_at_a_low_threshold(spark):
    rng = random.Random(2)
    of = {e: set(range(20)) if e % 3 else {rng.randrange(10**6) for _ in range(5)} for e in range(60)}
    m = spark.createDataFrame([(e, k) for e, s in of.items() for k in s], "edge long, key long")
    want = {(a, b, len(of[a] & of[b])) for a in of for b in of if a < b and len(of[a] & of[b]) >= 2}
    for block in (7, 1000):
        assert rows(links.shared_counts(m, 2, block), "e1", "e2", "n") == want


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_graph_of_reads_and_reads_on_it(spark):
    rng = random.Random(4)
    repeat, parts = genome(rng, 120), [genome(rng, 300) for _ in range(4)]
    texts = [parts[0] + repeat + parts[1], parts[2] + repeat + parts[3]]
    made = []
    for t in texts:
        made += [t[i : i + 100] for i in range(0, len(t) - 99, 5)] * 2
    df = spark.createDataFrame([(i, 1, s, None) for i, s in enumerate(made)] + [(9999, 1, None, None), (9998, 1, "NN", None)], "read_id long, mate int, seq string, info string")
    g = unitigs.read_graph(df, 45).cache()
    assert {r["violations"] for r in graph.invariants(g).collect()} == {0}
    seqs = {r["seq"] for r in g.collect()}
    assert repeat in {s for s in seqs if len(s) == 120} or any(repeat in s for s in seqs)
    assert len(seqs) == 10
    joined = rewrite.condensed(graph.simplify(g))
    assert {r["seq"] for r in joined.collect()} == seqs
    on = {r["read_id"]: r for r in mapping.read_edges(df, g).collect()}
    where = {r["edge_id"]: r["seq"] for r in g.collect()}
    assert len(on) > len(made) * 0.8 and all(made[i][r["stop"] - r["start"] :][:0] == "" and where[r["edge_id"]][r["start"] : r["stop"] + 31] in made[i] for i, r in on.items())
    counts = {r["edge_id"]: r["cnt"] for r in mapping.edge_counts(df, g, 45).collect()}
    assert counts == {r["edge_id"]: r["cnt"] for r in g.collect()}
    missing = mapping.junctions(df, unitigs.read_graph(df, 31), 31, 45).collect()
    assert missing and sum(r["n_missing"] == 0 for r in missing) >= 8


def test_packed_kmers(spark):
    rng = random.Random(7)
    seqs = [genome(rng, rng.randrange(150)) + rng.choice(["", "N", "acgt"]) for _ in range(30)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for k in (1, 15, 31, 32, 45, 62):
        want = {}
        for s in seqs:
            for i in range(len(s) - k + 1):
                w = s[i : i + k].upper()
                if "N" not in w:
                    c = min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
                    want[c] = want.get(c, 0) + 1
        got = df.mapInArrow(packed.counted(k), "hi long, lo long, n long").groupBy("hi", "lo").sum("n")
        from pyspark.sql import functions as F

        assert {(r[0], r[1]) for r in got.select(packed.text(F.col("hi"), F.col("lo"), k), "sum(n)").collect()} == set(want.items())


def test_parallel_contigs_that_align(spark):
    rng = random.Random(3)
    a = genome(rng, 300)
    b = a[:100] + "T" + a[101:]
    df = spark.createDataFrame([(1, 7, 8, 300, a), (2, 7, 8, 300, b), (3, 7, 8, 300, genome(rng, 300)), (4, 7, 9, 300, a)], "edge_id long, node_from long, node_to long, seq_len int, seq string")
    assert rows(alignment.similar_parallel(df), "r1", "r2") == {(1, 2)}


def test_scaffold_turns_every_other_contig(spark):
    spec = [(i, 10 * i, 10 * i + 1, 1000, 1) for i in range(1, 6)]
    placed = spark.createDataFrame([(2, p, 2 * i) for p, i in enumerate(range(1, 6))], "scaffold long, pos long, edge_id long")
    scored = spark.createDataFrame([(2, 5, 9), (5, 6, 9), (4, 7, 5), (7, 8, 5), (2, 4, 1), (6, 8, 4)], "v long, u long, n long")
    got = {r["pos"]: (r["edge_id"], r["flipped"]) for r in scaffold.refined(placed, scored, frame(spark, spec)).collect()}
    assert got == {0: (2, False), 1: (5, True), 2: (6, False), 3: (8, False), 4: (10, False)}
    assert scaffold.refined(placed.limit(0), scored, frame(spark, spec)).collect() == []


def test_kmers_of_reads_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    t = genome(rng, 400)
    df = spark.createDataFrame([(i, 1, t[i : i + 90]) for i in range(0, 300, 3)] * 2 + [(i, 2, t[i : i + 90]) for i in range(0, 300, 3)], "read_id long, mate int, seq string")
    plans = []
    cut = unitigs.cut
    for m in (unitigs, graph):
        monkeypatch.setattr(m, "cut", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or cut(x))
    g = unitigs.read_graph(df, 45)
    counted = mapping.edge_counts(df, g, 45)
    assert {r["cnt"] for r in counted.collect()} == {r["cnt"] for r in g.collect()}
    plans.append(counted._jdf.queryExecution().executedPlan().toString())
    joins = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin" in line and "_range" not in line]
    assert not joins


def test_common_barcodes_move_rows_instead_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    of = {e * 7: {rng.randrange(12) for _ in range(9)} | {rng.randrange(10**6) for _ in range(3)} for e in range(-40, 260)}
    m = spark.createDataFrame([(e, k) for e, s in of.items() for k in s], "edge long, key long")
    edges = sorted(of)
    for least in (1, 2, 5):
        for at_once in (50, 1 << 22):
            monkeypatch.setattr(links, "AT_ONCE", at_once)
            df = links.shared_counts(m, least)
            assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
            assert rows(df, "e1", "e2", "n") == {(a, b, len(of[a] & of[b])) for i, a in enumerate(edges) for b in edges[i + 1 :] if len(of[a] & of[b]) >= least}


def test_junctions_do_not_broadcast_kmers(spark):
    rng = random.Random(8)
    mid, t = genome(rng, 60), [genome(rng, 100) for _ in range(4)]
    seqs = [w for x in (t[0] + mid + t[1], t[2] + mid + t[3]) for w in [x[i : i + 90] for i in range(0, 171, 10)]]
    df = spark.createDataFrame([(i, 1, s) for i, s in enumerate(seqs)], "read_id long, mate int, seq string")
    edges = [(2, 1, 5, t[0] + mid[:31]), (4, 5, 6, mid[:31] + t[1]), (6, 5, 7, mid + t[3])]
    g = spark.createDataFrame(edges, "edge_id long, node_from long, node_to long, seq string")
    df2 = mapping.junctions(df, g, 31, 45)
    assert "BroadcastHashJoin" not in df2._jdf.queryExecution().executedPlan().toString()
    held = {w for s in seqs for i in range(46) for w in (s[i : i + 45], s[i : i + 45][::-1].translate(str.maketrans("ACGT", "TGCA")))}
    want = {(2, e, 13, sum((edges[0][3][-44:] + s[31:44])[i : i + 45] not in held for i in range(13))) for e, _, _, s in edges[1:]}
    assert rows(df2, "e1", "e2", "n_kmers", "n_missing") == want


@pytest.mark.parametrize("few", [0, 200_000])
def test_reads_of_a_common_barcode_are_spread_and_stay_together(spark, monkeypatch, few):
    for name, value in (("READS_OF_BLOCK", 32), ("SETS_OF_BLOCK", 16), ("FEW", few)):
        monkeypatch.setattr(mapping, name, value, raising=False)
    rng = random.Random(9)
    hot, rare, absent, of_none = (genome(rng, 18) for _ in range(4))
    code = lambda t: int("".join(str("ACGTN".index(c)) for c in t), 5)
    reads = [(i, 1 + i % 2, f"BX:Z:{b}\tQB:Z:FFF", genome(rng, 40), "F" * 40) for i, b in enumerate([hot] * 300 + [rare] * 5 + [absent] * 200)]
    reads += [(7, 2, f"BX:Z:{hot}", *reads[7][3:]), (900, 1, "", "ACGT", "FFFF"), (901, 1, f"BX:Z:{hot[:17]}", None, None), (902, 1, f"BX:Z:{hot}", None, None)]
    df = spark.createDataFrame(reads + reads[::9], "read_id long, mate int, info string, seq string, qual string")
    pairs = [(2 * i, 2 * i + 1) for i in range(60)]
    members = [(e, code(hot)) for e, _ in pairs] + [(0, code(rare)), (1, code(rare)), (3, code(of_none)), (500, code(absent))]
    args = df, spark.createDataFrame(pairs, "e1 long, e2 long"), spark.createDataFrame(members * 2, "edge long, key long")
    want = [(*p, r[0], r[1], *r[3:]) for r in reads for p in pairs if any(f"BX:Z:{b}" in r[2] for b in ([hot, rare] if p[0] == 0 else [hot]))]
    got = mapping.reads_of_pairs(*args).withColumn("part", F.spark_partition_id()).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert max(Counter(r["part"] for r in got).values()) < 0.6 * len(got)
    assert sum(a["read_id"] != b["read_id"] for a, b in zip(got, got[1:])) < 5 * len(reads)
    both = mapping.reads_of_pairs(*args, both=True)
    assert rows(both, "e1", "e2", "read_id") == {(0, 1, i) for i in range(300, 305)}
