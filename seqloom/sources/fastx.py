"""FASTA and FASTQ tables, read from files (plain or gzip) and written as text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from .splits import GZIP, Bytes, inflated, lines_of, record_ranges, records

SCHEMA = "filename string, filepos long, name string, comment string, seq string, qual string"
#: Besides, the range that a record was read in and its place among those of it that have bases.
FULL = f"{SCHEMA}, split long, place long"


def parse_fastx(content: bytes) -> Iterator[tuple[int, str, str, str, str | None]]:
    """(offset, name, comment, seq, qual) of each record of one file's bytes, plain or gzip."""
    chunks = iter([content])
    return records(lines_of(inflated(chunks) if content[:2] == GZIP else chunks, 0))


@dataclass
class Range(InputPartition):
    """Records of a file from ``entry`` on up to ``stop`` (None: to the end); a gzip file is inflated from a member on. ``most`` records at most."""

    filename: str
    split: int
    entry: int
    stop: int | None
    restart_at: int | None = None
    restart_pos: int | None = None
    most: int | None = None

    def records(self, file: Bytes) -> Iterator[tuple[int, str, str, str, str | None]]:
        if file.read(0, 2) == GZIP:
            at = self.restart_pos or 0
            chunks = inflated(file.chunks(self.restart_at or 0, size=1 << 16))
        else:
            at, chunks = self.entry, file.chunks(self.entry, self.stop, size=1 << 16 if self.most else 1 << 20)
        return islice(records(lines_of(_cut(chunks, at, self.entry, self.stop), self.entry)), self.most)

    def batches(self, file: Bytes, *, rows: int = 1000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        """Arrow batches, small ones: no more is held than a batch and a record."""
        columns, size, place = [[] for _ in range(8)], 0, 0
        for r in self.records(file):
            for column, value in zip(columns, (self.filename, *r, self.split, place)):
                column.append(value)
            place += bool(r[3])
            size += 2 * len(r[3])
            if len(columns[0]) == rows or size >= most_bytes:
                yield _batch(columns)
                columns, size = [[] for _ in range(8)], 0
        yield _batch(columns)


def _cut(chunks: Iterator[bytes], at: int, start: int, stop: int | None) -> Iterator[bytes]:
    """What of ``chunks``, which begin at ``at``, lies from ``start`` on and before ``stop``."""
    for chunk in chunks:
        if stop is not None and at >= stop:
            return
        end = at + len(chunk)
        if end > start:
            yield chunk[max(0, start - at) : None if stop is None else stop - at]
        at = end


class FastxReader(DataSourceReader):
    """Reads the ranges that a table names. Equal conditions on filename and filepos are pushed down: then a record is read, not a range."""

    def __init__(self, options: dict):
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]
        self.filename, self.filepos = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("filepos",):
                self.filepos = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("filename",):
                self.filename = f.value
            yield f  # Spark checks them too

    def partitions(self) -> list[Range]:
        found = [r for r in self.ranges if self.filename is None or r.filename == self.filename]
        if self.filepos is not None:
            found = [Range(r.filename, r.split, self.filepos, None, r.restart_at, r.restart_pos, 1) for r in found if r.entry <= self.filepos and (r.stop is None or self.filepos < r.stop)]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.filename:
            yield from partition.batches(Bytes(partition.filename))


class Fastx(DataSource):
    """The data source ``fastx``: ``ranges`` is a list of [filename, split, entry, stop, restart_at, restart_pos] as JSON."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return FULL

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(self.options)


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["filename", "filepos", "name", "comment", "seq", "qual", "split", "place"])


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(Fastx)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark asks for it where a source takes conditions


def files_of(spark: SparkSession, *paths: str) -> DataFrame:
    """filename, length and nth (the number of the path that names it) of all files; nothing of them is read."""
    listed = [spark.read.format("binaryFile").load(p).select(F.col("path").alias("filename"), "length", F.lit(n).alias("nth")) for n, p in enumerate(paths)]
    out = listed[0]
    for more in listed[1:]:
        out = out.union(more)
    return out


def fastx_ranges(spark: SparkSession, *paths: str, split_bytes: int = 32 << 20, gzip_members: bool = False) -> DataFrame:
    """The ranges of all files, to be kept and given to ``read_fastx`` again. With ``gzip_members`` gzip files of several members (as bgzip writes them) are split too."""
    return record_ranges(spark, files_of(spark, *paths), split_bytes, gzip_members=gzip_members)


def read_ranges(spark: SparkSession, ranges: DataFrame) -> DataFrame:
    """Records of ``ranges`` with split and place: a task a range."""
    _register(spark)
    listed = [list(r) for r in ranges.select("filename", "split", "entry", "stop", "restart_at", "restart_pos").orderBy("filename", "split").collect()]  # a row for each task
    return spark.read.format("fastx").option("ranges", json.dumps(listed)).load()


def read_fastx(spark: SparkSession, *paths: str, split_bytes: int = 32 << 20, gzip_members: bool = False) -> DataFrame:
    """All records of ``paths``. Plain files are split at records about every ``split_bytes``; a task streams its range, so
    it holds a batch and a record, whatever the size of the file, inflated or not."""
    return read_ranges(spark, fastx_ranges(spark, *paths, split_bytes=split_bytes, gzip_members=gzip_members)).drop("split", "place")


def load_sequences(spark: SparkSession, paths: list[str], *, use_quals: bool = True, split_bytes: int = 32 << 20) -> DataFrame:
    """idx (in file and record order), name, comment, seq, qual, filename, filepos; empty sequences go.

    Records are numbered where they are read; only sums over ranges are put in order.
    """
    files = files_of(spark, *paths)
    rows = read_ranges(spark, record_ranges(spark, files, split_bytes)).filter(F.length("seq") > 0)
    counts = rows.groupBy("filename", "split").agg(F.count("*").alias("__n")).join(files.select("filename", "nth"), "filename")
    # a file named by two paths is loaded for each
    each = Window.partitionBy("nth").orderBy("filename", "split").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    inside = counts.withColumn("__before", F.coalesce(F.sum("__n").over(each), F.lit(0)))
    whole = counts.groupBy("nth").agg(F.sum("__n").alias("__all"))
    base = whole.select("nth", F.coalesce(F.sum("__all").over(Window.partitionBy().orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # a row a path
    starts = inside.join(base, "nth").select(F.col("filename").alias("__f"), F.col("split").alias("__s"), (F.col("__base") + F.col("__before")).alias("__start"))
    qual = F.col("qual") if use_quals else F.lit(None).cast("string")
    numbered = rows.join(F.broadcast(starts), (F.col("filename") == F.col("__f")) & (F.col("split") == F.col("__s")))  # as many rows as tasks
    return numbered.select((F.col("__start") + F.col("place")).alias("idx"), "name", "comment", "seq", qual.alias("qual"), "filename", "filepos")


def record_at(spark: SparkSession, path: str, filepos: int, *, ranges: DataFrame | None = None) -> DataFrame:
    """The record at a place of a file. Of a plain file little more is read than the record; a gzip file is inflated up to it from its
    beginning, or from the last member before it where ``ranges`` (of ``fastx_ranges`` with ``gzip_members``) has one."""
    if ranges is None:
        ranges = files_of(spark, path).select("filename", F.lit(0).cast("long").alias("split"), F.lit(0).cast("long").alias("entry"), *(F.lit(None).cast("long").alias(c) for c in ("stop", "restart_at", "restart_pos")))
    one = (F.col("entry") <= filepos) & (F.col("stop").isNull() | (F.col("stop") > filepos))
    _register(spark)
    listed = [[r["filename"], r["split"], filepos, None, r["restart_at"], r["restart_pos"], 1] for r in ranges.filter(one).collect()]
    return spark.read.format("fastx").option("ranges", json.dumps(listed)).load().filter(F.col("filepos") == filepos).drop("split", "place")


def _header(seqs: DataFrame, mark: str) -> Column:
    comment = F.when(F.length("comment") > 0, F.concat(F.lit(" "), "comment")).otherwise("") if "comment" in seqs.columns else F.lit("")
    return F.concat(F.lit(mark), F.col("name"), F.coalesce(comment, F.lit("")))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.concat_ws("\n", _header(seqs, ">"), F.col("seq")).alias("value"))


def fastq_lines(seqs: DataFrame) -> DataFrame:
    """Without the quality lines where the quality is incomplete."""
    full = F.length("qual") == F.length("seq")
    return seqs.select(F.concat_ws("\n", _header(seqs, "@"), F.col("seq"), F.when(full, F.lit("+")), F.when(full, F.col("qual"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)
