"""Text sinks for sequences and alignments, with one commit for a write: what a retried or lost task left doesn't count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.align import gapped_fasta, refseq_fasta, sam_header, sam_lines, stockholm
from .fastx import fasta_lines, fastq_lines

#: What each format makes of alignments; the order of the lines is that of reads and references.
ALIGNMENT_FORMATS = {"sam": sam_lines, "stockholm": stockholm, "fasta": gapped_fasta, "refseq": refseq_fasta}
SEQUENCE_FORMATS = {"fasta": fasta_lines, "fastq": fastq_lines}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    part: int
    file: str
    size: int
    lines: int


class LinesWriter(DataSourceArrowWriter):
    """Each task writes a file of its own and tells its name; the commit moves those that were told into place and removes the rest."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        part, name = TaskContext.get().partitionId(), f"_tasks-{self.job}/{uuid.uuid4().hex}"
        store, root = _store(self.path)
        store.create_dir(f"{root}/_tasks-{self.job}", recursive=True)
        size = lines = 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for value in batch["value"].to_pylist():
                    content = (value or "").encode() + b"\n"
                    out.write(content)
                    size, lines = size + len(content), lines + 1
        return Part(part, name, size, lines)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):  # of an earlier write to this place
            if old.base_name.startswith("part-") or old.base_name == "_parts.json":
                store.delete_file(old.path)
        told = []
        for m in parts:
            store.move(f"{root}/{m.file}", f"{root}/part-{m.part:08d}.txt")
            told.append({"file": f"part-{m.part:08d}.txt", "size": m.size, "lines": m.lines})
        with store.open_output_stream(f"{root}/_parts.json") as out:  # last: a folder without it isn't a whole write
            out.write(json.dumps(told).encode())
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_tasks-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_tasks-{self.job}")


class Lines(DataSource):
    """The sink ``lines``: a text file a partition, in order of partitions, and ``_parts.json`` with their names and sizes."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"])


def write_lines(lines: DataFrame, path: str) -> None:
    """``value`` of each row as a line, or lines, of text files under ``path``."""
    lines.sparkSession.dataSource.register(Lines)
    lines.select("value").write.format("lines").mode("overwrite").save(path)


def alignment_lines(alignments: DataFrame, kind: str, *, threshold: float | None = 0.0) -> DataFrame:
    """y_idx, x_idx and value: ``alignments`` of at least ``threshold`` in one of ALIGNMENT_FORMATS."""
    if kind not in ALIGNMENT_FORMATS:
        raise ValueError(f"no format {kind!r}: one of {', '.join(ALIGNMENT_FORMATS)}")
    return ALIGNMENT_FORMATS[kind](alignments if threshold is None else alignments.filter(F.col("score") >= threshold))


def write_alignments(alignments: DataFrame, path: str, kind: str, *, refs: DataFrame | None = None, threshold: float | None = 0.0, partitions: int | None = None) -> None:
    """Alignments as text, in order of reads and references over the files; SAM with its header in a file of its own before them.

    The files read one after another are the same text, however many there are.
    """
    lines = alignment_lines(alignments, kind, threshold=threshold)
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if kind == "sam":
        if refs is None:
            raise ValueError("SAM needs the references for its header")
        head = sam_header(refs).select(F.lit(0).alias("late"), F.col("ord").alias("y_idx"), F.lit(0).cast("long").alias("x_idx"), "value")
        lines = head.union(lines.select(F.lit(1).alias("late"), "y_idx", "x_idx", "value"))
        write_lines(lines.repartitionByRange(n, "late", "y_idx", "x_idx", "value").sortWithinPartitions("late", "y_idx", "x_idx", "value"), path)
    else:
        write_lines(lines.repartitionByRange(n, "y_idx", "x_idx", "value").sortWithinPartitions("y_idx", "x_idx", "value"), path)


def write_sequences(seqs: DataFrame, path: str, kind: str) -> None:
    """Sequences as FASTA or FASTQ."""
    if kind not in SEQUENCE_FORMATS:
        raise ValueError(f"no format {kind!r}: one of {', '.join(SEQUENCE_FORMATS)}")
    write_lines(SEQUENCE_FORMATS[kind](seqs), path)


def join_parts(alignments_path: str, target: str) -> int:
    """The parts of a write as one file, in order, moved a block at a time; its size. For files that one machine may hold: a cluster reads the parts."""
    store, root = _store(alignments_path.rstrip("/"))
    with store.open_input_stream(f"{root}/_parts.json") as f:
        parts = json.loads(f.read())
    to, name = _store(target)
    total = 0
    with to.open_output_stream(name) as out:
        for part in parts:
            with store.open_input_stream(f"{root}/{part['file']}") as f:
                copied = 0
                while block := f.read(1 << 20):
                    out.write(block)
                    copied += len(block)
            if copied != part["size"]:
                raise ValueError(f"{part['file']} has {copied} bytes, not {part['size']}")
            total += copied
    return total


def stream_lines(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """A stream's ``value`` as lines, a folder for each batch, replaced if the batch runs again: each record stays once."""

    def batch(rows: DataFrame, number: int) -> None:
        write_lines(rows, f"{path.rstrip('/')}/batch-{number:08d}")

    writer = stream.select("value").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
