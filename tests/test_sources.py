import gzip

import pytest

from readloom.sources import fastx, sinks


def test_split_fastq_reads_each_record_once(spark, tmp_path):
    text = "".join(f"@r{i}/1 BX:Z:A\n{'ACGT' * (i % 7 + 1)}\n+\n{'@+II' * (i % 7 + 1)}\n" for i in range(400))
    (tmp_path / "a.fq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@z\nAC\n+\nII\n")
    (tmp_path / "c.fq").write_text("")
    rows = fastx.read_fastq(spark, str(tmp_path), split=777).collect()
    assert sorted(r["name"] for r in rows) == sorted([f"r{i}" for i in range(400)] + ["z"])
    assert {len(r["seq"]) == len(r["qual"]) for r in rows} == {True}


def test_damaged_fastq_names_the_place(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastx.read_fastq(spark, str(tmp_path)).collect()


def test_fasta_wrapped_and_split(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">c{i} note\n{'ACGTA' * 3}\n{'GG' * (i % 3)}\n" for i in range(200)))
    rows = fastx.read_fasta(spark, str(tmp_path / "a.fa"), split=301).collect()
    assert sorted((r["name"], r["seq"]) for r in rows) == sorted((f"c{i}", "ACGTA" * 3 + "GG" * (i % 3)) for i in range(200))


def test_contigs_with_holes(spark):
    df = spark.createDataFrame([("a", "ACGNNTTNA"), ("b", "NACGT"), ("c", "AC"), ("d", None)], "name string, seq string")
    got = {(r["name"], r["strand"]): (r["seq"], [tuple(h) for h in r["holes"]]) for r in fastx.contigs_of(df, 4).collect()}
    assert got == {("a", "+"): ("ACGTTA", [(3, 2), (5, 1)]), ("a", "-"): ("TAACGT", [(1, 1), (3, 2)])}


def test_fasta_lines(spark):
    df = spark.createDataFrame([("a", "A" * 161), ("b", None)], "name string, seq string")
    assert [r[0] for r in sinks.fasta(df).collect()] == [">a\n" + "A" * 80 + "\n" + "A" * 80 + "\nA"]


def test_formats_by_first_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("@r1 x\nACGT\n+\nFFFF\n")
    (tmp_path / "b").write_text(">s1\nAC\nGT\n>s2\n\n")
    with gzip.open(tmp_path / "c.data", "wt") as f:  # compressed, whatever its name
        f.write("@r2\nGG\n+\nII\n")
    (tmp_path / "d").write_text("")
    got = {(r["name"], r["seq"], r["qual"]) for r in fastx.read_any(spark, str(tmp_path)).collect()}
    assert got == {("r1", "ACGT", "FFFF"), ("s1", "ACGT", None), ("s2", "", None), ("r2", "GG", "II")}
    with pytest.raises(ValueError, match="neither"):
        fastx.file_format(b"name,seq\n")


def test_index_reads_join_by_name(spark):
    schema = "name string, info string, seq string, qual string"
    one = spark.createDataFrame([("a", None, "AC", "FF"), ("b", None, "GG", "FF")], schema)
    two = spark.createDataFrame([("b", None, "TT", "FF"), ("a", None, "CA", "FF")], schema)
    index = spark.createDataFrame([("a", None, "ACGTN", "FFFFF"), ("c", None, "TTTTT", "FFFFF")], schema)
    got = {(r["name"], r["seq1"], r["seq2"], r["barcode"]) for r in fastx.tripled(one, two, index).collect()}
    assert got == {("a", "AC", "CA", "ACGTN"), ("b", "GG", "TT", None), ("c", None, None, "TTTTT")}


def test_fastg_names_followers(spark, tmp_path):
    (tmp_path / "g").write_text(">EDGE_1_length_4_cov_2.500:EDGE_2_length_3_cov_1.0',EDGE_1_length_4_cov_2.500;\nACGT\n>EDGE_2_length_3_cov_1.0';\nAAC\n")
    got = {(r["edge"], r["is_rc"], r["length"], r["cov"], tuple(tuple(x) for x in r["follows"]), r["seq"]) for r in fastx.read_fastg(spark, str(tmp_path)).collect()}
    assert got == {(1, False, 4, 2.5, ((2, True), (1, False)), "ACGT"), (2, True, 3, 1.0, (), "AAC")}
