"""Text exports: FASTQ, FASTA, GFA, DOT and tab-separated counts. One row of text each, written by ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.contigs import with_coverage


def wrap(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(records: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(value): FASTA text wrapped at 80; null sequences are left out."""
    return records.filter(F.col(seq).isNotNull()).select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrap(F.col(seq))).alias("value"))


def contig_names(contigs: DataFrame) -> DataFrame:
    """(edge_id, name): headers with id, strand, length and coverage of one strand of each contig; coverage 0.000 where
    there is none."""
    c = with_coverage(contigs).filter("rc_id is null or edge_id <= rc_id")
    return c.select("edge_id", F.format_string("SEQ_%d_%d_length_%d_cov_%.3f", "edge_id", F.coalesce("rc_id", "edge_id"), "seq_len", F.coalesce("cov", F.lit(0.0))).alias("name"))


def gfa(contigs: DataFrame) -> DataFrame:
    """(value): S lines of one strand per contig and L lines of contigs that meet at a node, overlap k."""
    c = with_coverage(contigs).withColumn("main", F.least("edge_id", F.coalesce("rc_id", "edge_id"))).withColumn("sign", F.when(F.col("edge_id") == F.col("main"), "+").otherwise("-"))
    s = c.filter("edge_id = main").select(F.concat_ws("\t", F.lit("S"), F.col("edge_id"), F.lit("*"), F.concat(F.lit("LN:i:"), F.col("seq_len")), F.concat(F.lit("KC:i:"), F.coalesce("cnt", F.lit(0)))).alias("value"))
    a = c.select(F.col("node_to").alias("node"), F.col("main").alias("a"), F.col("sign").alias("sa"), "k")
    b = c.select(F.col("node_from").alias("node"), F.col("main").alias("b"), F.col("sign").alias("sb"))
    l = a.join(b, "node").select(F.concat_ws("\t", F.lit("L"), F.col("a"), F.col("sa"), F.col("b"), F.col("sb"), F.concat(F.col("k"), F.lit("M"))).alias("value"))
    return s.unionByName(l)


def dot(pairs: DataFrame) -> DataFrame:
    """(value): lines of a directed graph's edges with their counts."""
    return pairs.select(F.concat(F.lit("  "), F.col("u"), F.lit(" -> "), F.col("v"), F.lit(" [label="), F.col("n"), F.lit("];")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """Part files, one per task."""
    lines.select("value").write.mode("overwrite").text(path)


def fastg(graph: DataFrame) -> DataFrame:
    """(value): contigs with sequences as FASTG: a record per strand that names the contigs which follow it. A contig has
    the lesser id of both strands; its reverse complement is marked by '."""
    g = graph.select("edge_id", F.coalesce("rc_id", "edge_id").alias("rc_id"), "node_from", "node_to", "seq", "seq_len", "cnt").dropDuplicates(["edge_id"])
    name = F.concat(F.lit("EDGE_"), F.least("edge_id", "rc_id"), F.lit("_length_"), "seq_len", F.lit("_cov_"), F.format_string("%.3f", (F.coalesce("cnt", F.lit(0)) / F.col("seq_len")).cast("double")), F.when(F.col("edge_id") > F.col("rc_id"), "'").otherwise(""))
    named = g.select("edge_id", "node_from", "node_to", "seq", name.alias("name"))
    after = named.select("edge_id", F.col("node_to").alias("node")).join(named.select(F.col("node_from").alias("node"), F.col("name").alias("next")), "node").groupBy("edge_id").agg(F.array_sort(F.collect_set("next")).alias("n"))
    tail = F.when(F.col("n").isNotNull(), F.concat(F.lit(":"), F.array_join("n", ","))).otherwise("")
    return named.join(after, "edge_id", "left").select(F.concat(F.lit(">"), "name", tail, F.lit(";\n"), "seq").alias("value"))


def contig_fasta(graph: DataFrame, shortest: int = 100) -> DataFrame:
    """(value): contigs of ``shortest`` bases or more, one strand each, as FASTA with holes as N."""
    g = graph.filter((F.col("seq_len") >= shortest) & (F.col("rc_id").isNull() | (F.col("edge_id") <= F.col("rc_id")))).dropDuplicates(["edge_id"])
    name = F.concat_ws("_", F.lit("SEQ"), "edge_id", F.coalesce("rc_id", "edge_id"), F.lit("length"), "seq_len")
    return fasta(g.select(name.alias("name"), S.filled(F.col("seq"), F.col("holes")).alias("seq")))
