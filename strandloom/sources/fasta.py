"""FASTA and FASTQ files, plain or gzip, as a table of contigs."""

from __future__ import annotations

import gzip
import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import MIN_CONTIG

CONTIGS = "genome_id string, file_name string, contig_order int, contig_index int, contig_name string, seq binary, len int"
#: Largest file that becomes one row.
WHOLE_BYTES = 1 << 30
log = logging.getLogger(__name__)


def parse_records(data: bytes) -> list[tuple[str, bytes]]:
    """``(whole header, sequence)`` of every record; raises ValueError if the file is neither format."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    data = data.replace(b"\r", b"")
    head = data.lstrip()[:1]
    if head == b">":
        out = []
        for rec in data[data.index(b">") + 1 :].split(b"\n>"):
            name, _, seq = rec.partition(b"\n")
            out.append((name.decode("utf-8", "replace"), seq.replace(b"\n", b"").replace(b" ", b"")))
        return out
    if head == b"@":
        lines = data.strip().split(b"\n")
        if len(lines) % 4 or any(not lines[i].startswith(b"@") or not lines[i + 2].startswith(b"+") for i in range(0, len(lines), 4)):
            raise ValueError("broken FASTQ record")
        return [(lines[i][1:].decode("utf-8", "replace"), lines[i + 1]) for i in range(0, len(lines), 4)]
    raise ValueError("neither FASTA nor FASTQ")


def _contigs(it: Iterator[pa.RecordBatch], individual: bool) -> Iterator[pa.RecordBatch]:
    names = ["genome_id", "file_name", "contig_order", "contig_index", "contig_name", "seq", "len"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int32()]
    for b in it:
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            path = path.removeprefix("file:") if path.startswith("file:/") else path
            try:
                kept = [(n, s) for n, s in parse_records(data) if len(s) >= MIN_CONTIG]
            except (ValueError, OSError) as e:
                log.warning("%s is not read: %s", path, e)
                continue
            if not kept:
                log.warning("%s has no sequence of %d bases or more", path, MIN_CONTIG)
                continue
            rows = [(f"{path}#{i}" if individual else path, path, i if individual else 0, 0 if individual else i, n, s, len(s)) for i, (n, s) in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _inputs(spark: SparkSession, paths: list[str], whole_bytes: int) -> tuple[list[str], list[str]]:
    """Files behind paths, patterns and folders: those to be read whole, and those to be read by record. What is blank or missing is logged and left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole, split = [], []
    for path in paths:
        if not path.strip():
            log.warning("a blank path is left out")
            continue
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = [f for f in (fs.globStatus(p) or [])]
        found = [f for d in found for f in (fs.listStatus(d.getPath()) if d.isDirectory() else [d]) if f.isFile() and f.getPath().getName()[0] not in "_."]
        if not found:
            log.warning("%s is missing and left out", path)
        for f in found:
            (split if f.getLen() > whole_bytes else whole).append(f.getPath().toString())
    return whole, split


def _local(path):
    return F.regexp_replace(path, "^file:/+", "/")


def _by_record(spark: SparkSession, paths: list[str], individual: bool) -> DataFrame:
    """The same contigs from FASTA files that are too large for one row, plain ones in splits, a record at a time."""
    text = spark.read.option("lineSep", "\n>").text(paths).select(_local(F.col("_metadata.file_path")).alias("file_name"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^\s*>", "").alias("r"))
    name = F.regexp_replace(F.substring_index("r", "\n", 1), "\r", "")
    rows = text.select("file_name", "at", name.alias("contig_name"), F.regexp_replace(F.expr("substring(r, length(substring_index(r, '\n', 1)) + 2)"), r"\s", "").cast("binary").alias("seq"))
    rows = rows.withColumn("len", F.length("seq").cast("int")).filter(F.col("len") >= MIN_CONTIG)
    order = rows.select("file_name", "at").withColumn("i", (F.row_number().over(Window.partitionBy("file_name").orderBy("at")) - 1).cast("int")).drop("file_name")
    zero = F.lit(0)
    out = rows.join(order, "at").withColumn("genome_id", F.concat("file_name", F.lit("#"), "i") if individual else F.col("file_name"))
    return out.select("genome_id", "file_name", (F.col("i") if individual else zero).alias("contig_order"), (zero if individual else F.col("i")).alias("contig_index"), "contig_name", "seq", "len")


def read_fasta(spark: SparkSession, paths: list[str] | str, *, individual: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Contigs of at least 500 bases, one genome a file or, if ``individual``, one a record.

    Paths that are blank or missing, and files that are broken, empty or too short, are
    logged and left out; if none is left there are no rows. Files of more than
    ``whole_bytes`` must be FASTA; they are read record by record, in splits unless
    they are compressed.
    """
    whole, split = _inputs(spark, [paths] if isinstance(paths, str) else list(paths), whole_bytes)
    out = spark.createDataFrame([], CONTIGS)
    if whole:
        files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(whole)
        out = files.select("path", "content").mapInArrow(lambda it: _contigs(it, individual), CONTIGS)
    return out.unionByName(_by_record(spark, split, individual)) if split else out


def read_file_list(path: str) -> list[str]:
    """Paths of a list, one a line, trimmed; blank lines are kept as empty paths, which reading leaves out."""
    with open(path) as f:
        return [x.strip() for x in f.read().splitlines()]


def contigs_from_table(df: DataFrame, genome: str, order: str, name: str, seq: str, *, file_name: str | None = None) -> DataFrame:
    """The same columns from a table that has one row per contig; short contigs are left out."""
    s = df.filter(F.length(seq) >= MIN_CONTIG)
    index = F.row_number().over(Window.partitionBy(genome).orderBy(order)) - 1
    return s.select(F.col(genome).cast("string").alias("genome_id"), F.col(file_name or genome).cast("string").alias("file_name"), F.lit(0).alias("contig_order"), index.cast("int").alias("contig_index"), F.col(name).cast("string").alias("contig_name"), F.col(seq).cast("binary").alias("seq"), F.length(seq).cast("int").alias("len"))
