"""FASTQ and FASTA files as DataFrames, by a Python data source that splits plain files.

A split of a plain FASTQ file starts at the first record boundary at or after its first byte: a line with ``@`` whose
second next line starts with ``+`` (a quality line may start with ``@``, but then the line two further on is a
sequence). Gzip files are one split each. Any file system that pyarrow knows by URI can be read.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, pos bigint, name string, info string, seq string, note string, qual string"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int | None  # None: a whole compressed file
    fmt: str = "fastq"


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def file_format(first: bytes) -> tuple[str, bool]:
    """(fastq or fasta, compressed) by the first bytes of a file: gzip by its two magic bytes, whatever its name, FASTQ by
    ``@``, FASTA by ``>`` or ``;``. An empty file is FASTQ without records."""
    packed = first[:2] == b"\x1f\x8b"
    if packed:
        first = zlib.decompressobj(31).decompress(first, 1)
    if first[:1] in (b"@", b""):
        return "fastq", packed
    if first[:1] in (b">", b";"):
        return "fasta", packed
    raise ValueError(f"neither FASTQ nor FASTA: {first[:20]!r}")


def header(line: str) -> tuple[str, str | None]:
    """Name without a /1 or /2 at its end, and the rest after the first space or tab."""
    at = min((i for i in (line.find(" "), line.find("\t")) if i >= 0), default=-1)
    name, info = (line, None) if at < 0 else (line[:at], line[at + 1 :])
    return (name[:-2] if name.endswith(("/1", "/2")) else name), info


class Lines:
    """Lines of a binary file from a byte on, with the place of the next one."""

    def __init__(self, f, pos: int) -> None:
        self.f, self.pos = f, pos

    def next(self) -> str | None:
        raw = self.f.readline()
        self.pos += len(raw)
        return raw.decode("utf-8", "replace").rstrip("\r\n") if raw else None


class FastxReader(DataSourceReader):
    def __init__(self, path: str, split: int, fmt: str) -> None:
        self.path, self.split, self.fmt = path, split, fmt

    def partitions(self) -> list[Split]:
        out = []
        for path, size in _files(self.path):
            system, inner = _system(path)
            with system.open_input_file(inner) as f:
                fmt, compressed = file_format(f.read(512))
            fmt = self.fmt if self.fmt != "auto" else fmt
            if compressed:
                out.append(Split(path, 0, None, fmt))
            else:
                out += [Split(path, at, min(size, at + self.split), fmt) for at in range(0, size, self.split)]
        return out or [Split("", 0, 0)]  # a source must have a partition

    def read(self, part: Split) -> Iterator[tuple]:
        if not part.path:
            return
        system, inner = _system(part.path)
        with system.open_input_file(inner) as raw:
            if part.stop is None:
                f = io.BufferedReader(gzip.GzipFile(fileobj=raw))
            else:
                f = io.BufferedReader(raw, 1 << 20)
                f.seek(part.start)
            reader = self._fastq if part.fmt == "fastq" else self._fasta
            yield from reader(f, part)

    def _fastq(self, f, part: Split) -> Iterator[tuple]:
        if part.start:
            start = self._boundary(f, part.start)
            if start is None or start >= (part.stop or 0):
                return
            f.seek(start)
            lines = Lines(f, start)
        else:
            lines = Lines(f, 0)
        while part.stop is None or lines.pos < part.stop:
            pos, head = lines.pos, lines.next()
            if head is None:
                return
            if not head:
                continue
            seq, note, qual = lines.next(), lines.next(), lines.next()
            if not head.startswith("@") or not seq or note is None or not note.startswith("+") or qual is None or len(qual) != len(seq):
                raise ValueError(f"{part.path}, byte {pos}: not a FASTQ record: {head[:60]!r}")
            yield (part.path, pos, *header(head[1:]), seq, note, qual)

    @staticmethod
    def _boundary(f, start: int) -> int | None:
        f.seek(start - 1)
        lines = Lines(f, start - 1)
        lines.next()  # the line that reaches into this split, or the end of the line before it
        window = []
        while len(window) < 8:
            pos, line = lines.pos, lines.next()
            if line is None:
                break
            window.append((pos, line))
        for i, (pos, line) in enumerate(window[:4]):
            if line.startswith("@") and i + 2 < len(window) and window[i + 2][1].startswith("+") and not window[i + 1][1].startswith(("@", "+")):
                return pos
        return None

    def _fasta(self, f, part: Split) -> Iterator[tuple]:
        if part.start:
            f.seek(part.start - 1)
            lines = Lines(f, part.start - 1)
            lines.next()
        else:
            lines = Lines(f, 0)
        pos, head, seq = lines.pos, None, []
        while True:
            at, line = lines.pos, lines.next()
            if line is None or line.startswith(">"):
                if head is not None:
                    yield (part.path, pos, *header(head), "".join(seq), None, None)
                if line is None or (part.stop is not None and at >= part.stop):
                    return
                pos, head, seq = at, line[1:], []
            elif head is not None:
                seq.append(line.strip())
            elif part.stop is not None and at >= part.stop:
                return


class FastxSource(DataSource):
    """Options: path, fmt (fastq, fasta or auto, by each file's first bytes), split (bytes of a task's part of a plain file, 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options["path"], int(self.options.get("split", 64 << 20)), self.options.get("fmt", "fastq"))


def read_fastq(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(file, pos, name, info, seq, note, qual) of FASTQ files under ``path``; pos is the record's first byte.

    Names lose /1 and /2. A record without sequence or +, or with qualities of another length, ends the job with its
    place; to load the sound records of damaged files use ``operators.rejects``. An empty file has no rows."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("fmt", "fastq").option("split", str(split)).load(path)


def read_fasta(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """The same columns for FASTA, note and qual null; sequences may be wrapped over lines."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("fmt", "fasta").option("split", str(split)).load(path)


def read_any(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """The same columns of FASTQ and FASTA files of one folder, told apart by their first bytes."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("fmt", "auto").option("split", str(split)).load(path)


def tripled(one: DataFrame, two: DataFrame, index: DataFrame) -> DataFrame:
    """(name, seq1, qual1, seq2, qual2, barcode, barcode_qual): records of both mates and of the index read, whose sequence
    is the barcode, by name. A part without its others keeps its side only."""
    return paired(one, two).drop("info").join(index.select("name", F.col("seq").alias("barcode"), F.col("qual").alias("barcode_qual")), "name", "full")


def read_fastg(spark: SparkSession, path: str) -> DataFrame:
    """(edge, is_rc, length, cov, follows array<struct<edge, is_rc>>, seq) of FASTG text: one record per contig and strand,
    ``>EDGE_<id>_length_<n>_cov_<x>['][:<follower>,...];`` with ' for a reverse complement."""
    r = read_fasta(spark, path).select(F.concat_ws(" ", "name", "info").alias("head"), F.upper("seq").alias("seq"))
    name = lambda c: F.struct(F.regexp_extract(c, r"^EDGE_(\d+)_", 1).cast("bigint").alias("edge"), F.endswith(c, F.lit("'")).alias("is_rc"))
    r = r.withColumn("head", F.regexp_replace("head", ";$", "")).withColumn("own", F.substring_index("head", ":", 1)).withColumn("rest", F.when(F.contains("head", F.lit(":")), F.split(F.regexp_replace("head", "^[^:]*:", ""), ",")))
    return r.select(
        name(F.col("own"))["edge"].alias("edge"), name(F.col("own"))["is_rc"].alias("is_rc"), F.regexp_extract("own", r"_length_(\d+)", 1).cast("int").alias("length"), F.regexp_extract("own", r"_cov_([\d.]+)", 1).cast("double").alias("cov"),
        F.transform(F.coalesce("rest", F.array().cast("array<string>")), name).alias("follows"), "seq",
    )


def paired(one: DataFrame, two: DataFrame) -> DataFrame:
    """(name, seq1, qual1, seq2, qual2, info): both files' records joined by name, which survives files of unequal
    order; a record without mate keeps its side only, so a mismatch shows as a null."""
    side = lambda df, m: df.select("name", F.col("seq").alias(f"seq{m}"), F.col("qual").alias(f"qual{m}"), F.col("info").alias(f"info{m}"))
    return side(one, 1).join(side(two, 2), "name", "full").select("name", "seq1", "qual1", "seq2", "qual2", F.coalesce("info1", "info2").alias("info"))


def contigs_of(records: DataFrame, k: int) -> DataFrame:
    """(name, strand, seq, holes): contigs of k bases or more on both strands. Runs of N become holes, (pos, len) with
    pos the bases before the hole; records that start with N are dropped. A hole's mirror is counted from the other
    end of the bases."""
    s = records.filter((F.length("seq") >= k) & ~F.col("seq").rlike("^[Nn]")).select("name", F.upper("seq").alias("full"))
    runs, gaps = F.split("full", "N+"), F.regexp_extract_all("full", F.lit("(N+)"), F.lit(1))
    s = s.select("name", F.regexp_replace("full", "N+", "").alias("seq"), runs.alias("runs"), gaps.alias("gaps"))
    ends = F.transform("gaps", lambda g, i: F.struct(F.aggregate(F.slice("runs", 1, i + 1), F.lit(0), lambda a, r: a + F.length(r)).alias("pos"), F.length(g).alias("len")))
    s = s.select("name", "seq", ends.alias("holes"))
    mirror = F.reverse(F.transform("holes", lambda h: F.struct((F.length("seq") - h["pos"]).alias("pos"), h["len"].alias("len"))))
    rc = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq"), F.col("holes").alias("holes")), F.struct(F.lit("-").alias("strand"), rc.alias("seq"), mirror.alias("holes")))
    return s.select("name", F.explode(both).alias("x")).select("name", "x.strand", "x.seq", "x.holes")
