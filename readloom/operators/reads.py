"""Operators on reads and their barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import shuffle_width

INLINE_BARCODE, INLINE_UMI = 16, 7


def clean(reads: DataFrame) -> DataFrame:
    """Distinct rows of a read table; a row that equals another in all columns is a repeated load."""
    return reads.dropDuplicates()


def spread(reads: DataFrame) -> DataFrame:
    """(read_id, mate, seq) without repeats, over all shuffle partitions: small files would stay in a few tasks, and each
    read becomes a hundred rows in what follows. The rows are shuffled once, by their key."""
    n = shuffle_width(reads.sparkSession)
    return reads.select("read_id", "mate", "seq").repartition(n, "read_id", "mate").dropDuplicates()


def reverse_complements(reads: DataFrame) -> DataFrame:
    """(read_id, mate, rc): null for a null sequence, empty for an empty one."""
    return clean(reads.select("read_id", "mate", "seq")).select("read_id", "mate", S.revcomp(F.col("seq")).alias("rc"))


def barcode_tags(reads: DataFrame) -> DataFrame:
    """(read_id, mate, bx, qb, code): tags of the comment and the base-5 code of an 18-base barcode, null otherwise."""
    bx = S.tag(F.col("info"), "BX")
    return clean(reads.select("read_id", "mate", "info")).select("read_id", "mate", bx.alias("bx"), S.tag(F.col("info"), "QB").alias("qb"), F.when(F.length(bx) == 18, S.base5(bx)).alias("code"))


def inline_barcodes(reads: DataFrame) -> DataFrame:
    """(read_id, barcode, umi, seq, qual, len) of first mates whose barcode stands in the read.

    16 bases of barcode and 7 of UMI are cut off the sequence and its qualities and taken off the length; a read
    shorter than that keeps its sequence and has no barcode. Null sequences are left out."""
    cut = INLINE_BARCODE + INLINE_UMI
    r = clean(reads.filter((F.col("mate") == 1) & F.col("seq").isNotNull()).select("read_id", "seq", "qual"))
    fits = F.length("seq") >= cut
    rest = lambda c: F.when(fits, F.substring(F.col(c), F.lit(cut + 1), F.length(c))).otherwise(F.col(c))
    return r.select(
        "read_id", F.when(fits, F.substring("seq", 1, INLINE_BARCODE)).alias("barcode"), F.when(fits, F.substring("seq", INLINE_BARCODE + 1, INLINE_UMI)).alias("umi"), rest("seq").alias("seq"), rest("qual").alias("qual"), F.length(rest("seq")).alias("len"),
    )


def base_name(name: Column) -> Column:
    """A read's name without the /1 or /2 of its mate."""
    return F.regexp_replace(name, "/[12]$", "")


def fastq_records(reads: DataFrame) -> DataFrame:
    """(read_id, mate, record): FASTQ text with the comment kept; a short or null quality is made up of F, a null
    sequence has no record."""
    r = clean(reads.select("read_id", "mate", "name", "info", "seq", "qual").filter("seq is not null"))
    qual = F.when(F.length("qual") == F.length("seq"), F.col("qual")).otherwise(F.repeat(F.lit("F"), F.length("seq")))
    head = F.concat(F.lit("@"), base_name(F.col("name")), F.lit("/"), F.col("mate"), F.when(F.col("info") != "", F.concat(F.lit(" "), F.col("info"))).otherwise(""))
    return r.select("read_id", "mate", F.concat_ws("\n", head, "seq", F.lit("+"), qual).alias("record"))


def tagged_records(reads: DataFrame) -> DataFrame:
    """(read_id, mate, header): FASTQ headers with barcode tags made anew: BX with the 18 bases, QB with their qualities, F
    where there are none of that length. Reads without a valid barcode or without a sequence have no record."""
    r = clean(reads.select("read_id", "mate", "name", "info", "seq").filter("seq is not null"))
    bx, qb = S.tag(F.col("info"), "BX"), S.tag(F.col("info"), "QB")
    r = r.select("read_id", "mate", "name", bx.alias("bx"), qb.alias("qb")).filter(F.col("bx").rlike("^[ACGTN]{18}$"))
    return r.select("read_id", "mate", F.concat(F.lit("@"), base_name(F.col("name")), F.lit(" BX:Z:"), "bx", F.lit(" QB:Z:"), F.when(F.length("qb") == 18, F.col("qb")).otherwise("F" * 18)).alias("header"))


def mate_pairs(reads: DataFrame) -> DataFrame:
    """(read_id, len1, len2, same_name): first and second mates side by side; a missing mate leaves its side null."""
    r = clean(reads.select("read_id", "mate", "name", "seq")).groupBy("read_id").agg(
        *[F.max(F.when(F.col("mate") == m, F.length("seq"))).alias(f"len{m}") for m in (1, 2)],
        *[F.max(F.when(F.col("mate") == m, base_name(F.col("name")))).alias(f"name{m}") for m in (1, 2)],
    )
    return r.select("read_id", "len1", "len2", (F.col("name1") == F.col("name2")).alias("same_name"))


def tagged(records: DataFrame) -> DataFrame:
    return records.filter(F.col("barcode").isNotNull() & (F.col("barcode") != -1))


def barcode_frequency(records: DataFrame) -> DataFrame:
    """(barcode, text, n): read pairs per barcode, duplicates once, with the decoded 18 bases."""
    n = tagged(records).dropDuplicates().groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))
    return n.select("barcode", S.from_base5(F.col("barcode"), 18).alias("text"), "n")


def barcode_index(records: DataFrame) -> DataFrame:
    """(barcode, lane, first_offset, n, bases1, bases2): where each barcode's run starts in a lane sorted by barcode.

    A run of the sorted file is a group here, so no sort is needed for its index; untagged records have none. Lengths
    that are null or not positive add nothing."""
    base = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0)).cast("long")
    return tagged(records).dropDuplicates().groupBy("barcode", "lane").agg(F.min("rec_offset").alias("first_offset"), F.count(F.lit(1)).alias("n"), base("len1").alias("bases1"), base("len2").alias("bases2"))


def sort_by_barcode(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """The tagged records ordered by barcode and offset over the whole result. Range partitioning also splits a barcode
    with very many records, as the offset is part of the range key."""
    r = tagged(records).dropDuplicates()
    keys = ["barcode", "lane", "rec_offset", "rec_id"]
    r = r.repartitionByRange(partitions, *keys) if partitions else r.repartitionByRange(*keys)
    return r.sortWithinPartitions(*keys)


def reads_of_sets(records: DataFrame, members: DataFrame) -> DataFrame:
    """(edge, n_records): read pairs whose barcode is in the edge's set. Records are counted per barcode before they
    meet the sets, so a barcode with a third of all records is one row of the join."""
    per = barcode_counts(records)
    return members.join(per, members["key"] == per["barcode"]).groupBy("edge").agg(F.sum("n").alias("n_records"))


def barcode_counts(records: DataFrame) -> DataFrame:
    return tagged(records.select("rec_id", "barcode")).dropDuplicates().groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))


def local_reads(reads: DataFrame, pairs: DataFrame, members: DataFrame, both: bool = False) -> DataFrame:
    """(e1, e2, n_reads, n_bases): reads whose tagged barcode is in the set of either contig of a pair, or with ``both``
    in both sets, for a local assembly of the gap between them. Reads are summed up per barcode before they meet the pairs' sets."""
    r = barcode_tags(reads).filter("code is not null").select("read_id", "mate", "code")
    size = clean(reads.select("read_id", "mate", "seq")).select("read_id", "mate", F.coalesce(F.length("seq"), F.lit(0)).alias("bases"))
    per = r.join(size, ["read_id", "mate"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("bases").alias("bases"))
    m = members.select("edge", "key").distinct()
    sets = pairs.select("e1", "e2", F.explode(F.array("e1", "e2")).alias("edge")).join(m, "edge").groupBy("e1", "e2", "key").agg(F.count(F.lit(1)).alias("ends"))
    sets = sets.filter("ends = 2") if both else sets
    got = sets.join(per, sets["key"] == per["code"]).groupBy("e1", "e2").agg(F.sum("n").alias("n_reads"), F.sum("bases").alias("n_bases"))
    return pairs.select("e1", "e2").join(got, ["e1", "e2"], "left").na.fill({"n_reads": 0, "n_bases": 0})
