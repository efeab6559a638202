import random
from collections import Counter, defaultdict

from readloom.operators import frequency

SCHEMA = "rec_id long, barcode long, len1 int, barcode_n string"


def rows():
    rng = random.Random(5)
    out = [(i, rng.choice([7, 7, 7, 7, 8, 9, -1, None]), rng.choice([1, 2, 2, 3, 300, 900, None, -1, 0]), "x") for i in range(3000)]
    return out + out[:50] + [(9001, 10, None, "x"), (9002, 10, -1, "x"), (9003, 11, 5, "x"), (9004, 11, 6, "x")]


def by_key(data):
    got = defaultdict(list)
    for r in set(data):
        if r[1] not in (None, -1):
            got[r[1]].append(r[2])
    return got


def mode(values):
    c = Counter(v for v in values if v and v > 0)
    return min((-n, v) for v, n in c.items())[1] if c else None


def test_heavy_keys(spark):
    data = rows()
    want = by_key(data)
    total = sum(map(len, want.values()))
    got = {r[0]: r[1] for r in frequency.heavy_keys_mode(spark.createDataFrame(data, SCHEMA), "barcode", "len1", 0.01).collect()}
    assert got == {k: mode(v) for k, v in want.items() if len(v) >= 0.01 * total}


def test_profile_against_brute_force(spark):
    data = rows()
    got = {r["barcode"]: r for r in frequency.key_profile(spark.createDataFrame(data, SCHEMA), "barcode", "len1").collect()}
    want = by_key(data)
    assert set(got) == set(want)
    for k, values in want.items():
        good = sorted(v for v in values if v and v > 0)
        r = got[k]
        assert (r["n_rows"], r["n_distinct"], r["mode"]) == (len(values), len(set(good)), mode(values))
        if good:
            assert r["median"] == good[-(-len(good) // 2) - 1]
            assert r["p90"] == good[-(-len(good) * 9 // 10) - 1]
        else:
            assert r["median"] is None and r["p90"] is None


def test_ties_take_the_smaller_value(spark):
    df = spark.createDataFrame([(1, 1, 5, ""), (2, 1, 4, "")], SCHEMA)
    assert [tuple(r) for r in frequency.heavy_keys_mode(df, "barcode", "len1", 0.01).collect()] == [(1, 4)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert frequency.heavy_keys_mode(df, "barcode", "len1", 0.01).collect() == []
    assert frequency.key_profile(df, "barcode", "len1").collect() == []


def test_percentiles_over_wide_ranges(spark):
    """Values far apart: the bins nest over several levels, and every one of them holds an answer of some key."""
    rng = random.Random(6)
    values = {k: [rng.choice([-(10**12), 0, 5, 10**6, 10**6 + 1, 10**15]) + rng.randrange(3) for _ in range(200)] for k in range(20)}
    weights = Counter((k, v) for k, vs in values.items() for v in vs)
    df = spark.createDataFrame([(k, v, n) for (k, v), n in weights.items()] + [(3, None, 99)], "k long, v long, n long")
    for fan in (4, 1024):
        got = {(r["k"], r["share"]): r["v"] for r in frequency.weighted_percentiles(df, "k", "v", (0.0, 0.5, 0.9, 1.0), fan).collect()}
        assert got == {(k, s): sorted(vs)[max(1, -(-int(s * 10) * len(vs) // 10)) - 1] for k, vs in values.items() for s in (0.0, 0.5, 0.9, 1.0)}
