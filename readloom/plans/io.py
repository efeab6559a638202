"""Queries that write a table as text and read it back, and a stream over read records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads
from ..session import shared_folder
from ..sources import fastx, sinks
from ..sources.tables import table
from ..streaming import barcodes
from .reads import _graph


def _place(s: SparkSession) -> str:
    return f"{shared_folder(s)}/{uuid.uuid4().hex}"


def fastq_round_trip(s: SparkSession, d: str) -> DataFrame:
    """All read records written as FASTQ and read back."""
    path = _place(s)
    sinks.write_text(reads.fastq_records(table(s, d, "seq_reads").filter("length(seq) > 0")).withColumnRenamed("record", "value"), path)
    return fastx.read_fastq(s, path).select("name", "info", "seq", "qual")


def fasta_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    rows = table(s, d, "seq_reads", "read_id", "mate", "seq").filter("length(seq) > 0").dropDuplicates()
    sinks.write_text(sinks.fasta(rows.select(F.concat_ws("_", "read_id", "mate").alias("name"), "seq")), path)
    return fastx.read_fasta(s, path).select("name", "seq")


def _mates(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "seq_reads").filter("length(seq) > 0").dropDuplicates(["read_id", "mate"])
    return rows.withColumn("name", F.concat(F.lit("r"), "read_id"))


def _written(s: SparkSession, rows: DataFrame) -> str:
    path = _place(s)
    sinks.write_text(rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), F.repeat(F.lit("F"), F.length("seq"))).alias("value")), path)
    return path


def fastq_pairs(s: SparkSession, d: str) -> DataFrame:
    """Mates written to two folders and joined by name."""
    m = _mates(s, d)
    one, two = (fastx.read_fastq(s, _written(s, m.filter(F.col("mate") == i))) for i in (1, 2))
    return fastx.paired(one, two).select("name", F.length("seq1").alias("len1"), F.length("seq2").alias("len2"))


def fastq_triples(s: SparkSession, d: str) -> DataFrame:
    """Mates and index reads with the barcodes of the comments, written to three folders and joined by name."""
    m = _mates(s, d)
    tags = m.filter("mate = 1").select("name", F.regexp_extract(F.coalesce("info", F.lit("")), "BX:Z:([ACGTN]{18})", 1).alias("seq")).filter("seq <> ''")
    one, two = (fastx.read_fastq(s, _written(s, m.filter(F.col("mate") == i))) for i in (1, 2))
    return fastx.tripled(one, two, fastx.read_fastq(s, _written(s, tags))).select("name", F.length("seq1").alias("len1"), F.length("seq2").alias("len2"), "barcode")


def mixed_formats(s: SparkSession, d: str) -> DataFrame:
    """First mates as FASTQ and second ones as FASTA in one folder, told apart by their first bytes."""
    m, path = _mates(s, d), _place(s)
    sinks.write_text(m.filter("mate = 1").select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), F.repeat(F.lit("F"), F.length("seq"))).alias("value")), f"{path}/one")
    sinks.write_text(sinks.fasta(m.filter("mate = 2").select("name", "seq")), f"{path}/two")
    return fastx.read_any(s, path).select("name", "seq", F.col("qual").isNotNull().alias("has_qual"))


def barcode_list(s: SparkSession, d: str) -> DataFrame:
    """The barcodes of L1 sets written as a list of texts, and the read pairs of those on the list."""
    from ..functions import sequence as S
    from ..operators import links

    path = _place(s)
    listed = links.members(table(s, d, "edge_barcodes", "edge", "kind", "keys", "cnts"), "L1").select("key").distinct()
    sinks.write_text(listed.select(S.from_base5(F.col("key"), 18).alias("value")), path)
    read = s.read.text(path).select(S.base5(F.col("value")).alias("barcode")).filter("barcode is not null").distinct()
    return reads.barcode_counts(table(s, d, "read_barcodes")).join(read, "barcode").select("barcode", "n")


def fastg_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The graph of the reads written as FASTG and read back."""
    from ..operators import unitigs

    path = _place(s)
    sinks.write_text(sinks.fastg(unitigs.read_graph(table(s, d, "seq_reads"), 45)), path)
    got = fastx.read_fastg(s, path)
    return got.select("edge", "is_rc", "length", "seq", F.size("follows").alias("n_follows"))


def contig_texts(s: SparkSession, d: str) -> DataFrame:
    from ..operators import unitigs

    return sinks.contig_fasta(unitigs.read_graph(table(s, d, "seq_reads"), 45))


def contigs_with_holes(s: SparkSession, d: str) -> DataFrame:
    """Read sequences as contigs on both strands, their runs of N as holes."""
    rows = table(s, d, "seq_reads", "read_id", "mate", "seq").dropDuplicates().select(F.concat_ws("_", "read_id", "mate").alias("name"), "seq")
    return fastx.contigs_of(rows, 31).select("name", "strand", "seq", F.col("holes.pos").alias("hole_pos"), F.col("holes.len").alias("hole_len"))


def stream_barcode_windows(s: SparkSession, d: str) -> DataFrame:
    """The windowed counts of a stream that reads the whole table as files arrive."""
    source = f"{d}/read_barcodes.parque[t]"  # as a pattern it may be one file or a folder
    schema = table(s, d, "read_barcodes").schema
    out, state = _place(s), _place(s)
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    counts = barcodes.windowed_counts(stream, late="3650 days")
    q = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return s.read.parquet(out)


QUERIES = {
    "fastq_round_trip": fastq_round_trip,
    "fasta_round_trip": fasta_round_trip,
    "contigs_with_holes": contigs_with_holes,
    "fastq_pairs": fastq_pairs,
    "fastq_triples": fastq_triples,
    "mixed_formats": mixed_formats,
    "barcode_list": barcode_list,
    "fastg_round_trip": fastg_round_trip,
    "contig_texts": contig_texts,
    "gfa_lines": lambda s, d: sinks.gfa(table(s, d, "contigs")),
    "contig_names": lambda s, d: sinks.contig_names(table(s, d, "contigs")),
    "stream_barcode_windows": stream_barcode_windows,
}

_RUNS = """with r as (select distinct read_id, mate, seq from seq_reads), s as (select read_id || '_' || mate as name, upper(seq) as full_seq from r where length(seq) >= 31 and not regexp_matches(seq, '^[Nn]')),
t as (select name, replace(full_seq, 'N', '') as seq, string_split_regex(full_seq, 'N+') as runs, regexp_extract_all(full_seq, 'N+') as gaps from s),
h as (select name, seq, list_transform(range(1, len(gaps) + 1), lambda i: {'pos': list_sum(list_transform(runs[:i], lambda x: length(x)))::int, 'len': length(gaps[i])::int}) as holes from t)"""

_RM = "m as (select read_id, mate, min(seq) as seq, count(distinct seq) as c, min(info) as info from seq_reads where length(seq) > 0 group by 1, 2)"

SQL = {
    "fastq_pairs": f"with {_RM} select 'r' || read_id as name, max(length(seq)) filter (mate = 1)::int as len1, max(length(seq)) filter (mate = 2)::int as len2 from m group by 1",
    "mixed_formats": f"with {_RM} select 'r' || read_id as name, seq, mate = 1 as has_qual from m",
    "fastq_triples": f"""with {_RM}, t as (select 'r' || read_id as name, regexp_extract(coalesce(info, ''), 'BX:Z:([ACGTN]{{18}})', 1) as b from m where mate = 1),
      p as (select 'r' || read_id as name, max(length(seq)) filter (mate = 1)::int as len1, max(length(seq)) filter (mate = 2)::int as len2 from m group by 1) select name, len1, len2, nullif(b, '') as barcode from p left join t using (name)""",
    "barcode_list": """select barcode, count(*) as n from (select distinct rec_id, barcode from read_barcodes where barcode is not null and barcode <> -1) where barcode in (select unnest(keys) from edge_barcodes where kind = 'L1' and edge is not null) and barcode < 3814697265625 group by 1""",
    "fastg_round_trip": f"""with recursive {_graph(45)} select least(a.edge_id, a.rc_id) as edge, a.edge_id > a.rc_id as is_rc, a.seq_len as length, a.seq, (select count(*) from g b where b.node_from = a.node_to)::int as n_follows from g a""",
    "contig_texts": f"with recursive {_graph(45)} select '>SEQ_' || edge_id || '_' || rc_id || '_length_' || seq_len || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) as value from g where seq_len >= 100 and edge_id <= rc_id",
    "fastq_round_trip": """with r as (select distinct read_id, mate, name, info, seq, qual from seq_reads where length(seq) > 0)
      select regexp_replace(name, '/[12]$', '') as name, case when info <> '' then info end as info, seq, case when length(qual) = length(seq) then qual else repeat('F', length(seq)) end as qual from r""",
    "fasta_round_trip": "select distinct read_id || '_' || mate as name, seq from seq_reads where length(seq) > 0",
    "contigs_with_holes": _RUNS
    + """ select name, '+' as strand, seq, list_transform(holes, lambda x: x.pos) as hole_pos, list_transform(holes, lambda x: x.len) as hole_len from h
      union all select name, '-', reverse(translate(seq, 'ACGT', 'TGCA')), list_reverse(list_transform(holes, lambda x: (length(seq) - x.pos)::int)), list_reverse(list_transform(holes, lambda x: x.len)) from h""",
    "gfa_lines": """with c as (select distinct *, least(edge_id, coalesce(rc_id, edge_id)) as main, case when graph = 'global' then 45 else 31 end as k from contigs), g as (select *, case when edge_id = main then '+' else '-' end as sign from c)
      select concat_ws(chr(9), 'S', edge_id, '*', 'LN:i:' || seq_len, 'KC:i:' || coalesce(cnt, 0)) as value from g where edge_id = main
      union all select concat_ws(chr(9), 'L', a.main, a.sign, b.main, b.sign, a.k || 'M') from g a join g b on a.node_to = b.node_from""",
    "contig_names": """with c as (select distinct *, case when graph = 'global' then 45 else 31 end as k from contigs where rc_id is null or edge_id <= rc_id)
      select edge_id, format('SEQ_{}_{}_length_{}_cov_{:.3f}', edge_id, coalesce(rc_id, edge_id), seq_len, round(coalesce(case when seq_len - (coalesce(len(holes), 0) + 1) * k > 0 then cnt::double / (seq_len - (coalesce(len(holes), 0) + 1) * k) end, 0.0::double), 3)) as name from c""",
    "stream_barcode_windows": """select time_bucket(interval 1 hour, seen_at)::timestamp as start, lane, count(*) as n, count(*) filter (barcode is not null and barcode <> -1) as n_tagged
      from (select distinct rec_id, barcode, lane, seen_at from read_barcodes where seen_at is not null) group by 1, 2""",
}
