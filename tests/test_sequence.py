import random

from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import alignment


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def test_codes(spark):
    rng = random.Random(1)
    for n, alphabet, enc, dec, base in ((18, "ACGTN", S.base5, S.from_base5, 5), (31, "ACGT", S.two_bit, S.from_two_bit, 4)):
        texts = ["A" * n, alphabet[-1] * n] + ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(20)]
        want = {t: sum(alphabet.index(c) * base ** (n - 1 - i) for i, c in enumerate(t)) for t in texts}
        df = spark.createDataFrame([(t,) for t in texts], "x string").withColumn("c", enc(F.col("x"))).withColumn("t", dec(F.col("c"), n))
        assert {r["x"]: (r["c"], r["t"]) for r in df.collect()} == {t: (c, t) for t, c in want.items()}
    for bad in ("", "ACX", "acgt", None):
        assert one(spark, bad, S.base5(F.col("x"))) is None
    assert one(spark, -1, S.from_base5(F.col("x"), 18), "long") is None


def test_strings(spark):
    assert one(spark, "acgNT", S.revcomp(F.col("x"))) == "ANCGT"
    assert one(spark, "ACGT", S.kmers(F.col("x"), 3)) == ["ACG", "CGT"]
    assert one(spark, "AC", S.kmers(F.col("x"), 3)) == [] and one(spark, None, S.kmers(F.col("x"), 3)) == []
    assert one(spark, ["AACC", "CCGG", "GGTT"], S.joined(F.col("x"), 2), "array<string>") == "AACCGGTT"
    assert one(spark, ["A", "C"], S.spaced(F.col("x"), 3), "array<string>") == "ANNNC"
    assert one(spark, "a BX:Z:ACG\tb", S.tag(F.col("x"), "BX")) == "ACG" and one(spark, "a", S.tag(F.col("x"), "BX")) is None
    df = spark.createDataFrame([("ACGTTA", [(3, 2), (5, 1)]), ("AC", [])], "s string, h array<struct<pos:int,len:int>>")
    assert [r[0] for r in df.select(S.filled(F.col("s"), F.col("h"))).collect()] == ["ACGNNTTNA", "AC"]
    assert [r[0] for r in df.select(S.filled(F.col("s"), F.col("h"), 1)).collect()] == ["ACGNTTNA", "AC"]


def test_alignment_score():
    def plain(a, b):
        row = [-3 * j for j in range(len(b) + 1)]
        for i, c in enumerate(a, 1):
            new = [-3 * i]
            for j, d in enumerate(b, 1):
                new.append(max(row[j - 1] + (1 if c == d else -1), row[j] - 3, new[-1] - 3))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(40):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(30))) for _ in range(2))
        assert alignment.score(a, b) == plain(a, b)
