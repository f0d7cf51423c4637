"""Byte ranges of FASTA and FASTQ files that hold whole records, whatever a quality line begins with.

A range alone can't tell a header from a quality line that begins with ``@``. But each line that may be a header has one
end if it is one, so a range maps every possible first record to where the first record of the next range begins; as
records that begin wrongly soon meet the right ones, that map is a few rows. Maps are made by all ranges at once and
joined from the file's beginning on: the result is that of one reader, not a guess.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = "filename string, split long, entry long, stop long, restart_at long, restart_pos long"
#: What counts as a base and as a quality (graphic characters; a quality may hold DEL).
BASE = np.zeros(256, np.uint8)
BASE[33:127] = 1
QUAL = np.zeros(256, np.uint8)
QUAL[33:128] = 1
NOT_BASE, NOT_QUAL = (bytes(np.flatnonzero(kind == 0).astype(np.uint8)) for kind in (BASE, QUAL))
GZIP = b"\x1f\x8b"


class Bytes:
    """A file that counts what is read of it."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file, self.read_bytes = store.open_input_file(name), 0
        self.size = self.file.size()

    def read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(size)
        self.read_bytes += len(out)
        return out

    def chunks(self, start: int, stop: int | None = None, size: int = 1 << 20) -> Iterator[bytes]:
        at = start
        while content := self.read(at, size if stop is None else min(size, stop - at)):
            yield content
            at += len(content)


def inflated(chunks: Iterator[bytes], members: list[tuple[int, int]] | None = None, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of gzip members, at most ``step`` bytes at a time; ``members`` gets the place of each in the file and in the content."""
    inflate, at, out = None, 0, 0
    for chunk in chunks:
        while chunk:
            if inflate is None:
                chunk, at = (chunk.lstrip(b"\0"), at + len(chunk) - len(chunk.lstrip(b"\0"))) if out else (chunk, at)  # padding after a member
                if not chunk:
                    break
                inflate = zlib.decompressobj(31)
                if members is not None:
                    members.append((at, out))
            piece = inflate.decompress(chunk, step)
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            at += len(chunk) - len(rest)
            out += len(piece)
            if piece:
                yield piece
            while not inflate.eof and not rest and (more := inflate.decompress(b"", step)):
                out += len(more)
                yield more
            chunk, inflate = rest, None if inflate.eof else inflate
    if inflate is not None:
        raise ValueError("a gzip file ends inside a member")


def lines_of(chunks: Iterator[bytes], at: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of each line, without its end; a line may be any number of chunks long."""
    held: list[bytes] = []
    for chunk in chunks:
        first, *more = chunk.split(b"\n")
        held.append(first)
        for line in more:
            whole = b"".join(held)
            yield at, whole
            at += len(whole) + 1
            held = [line]
    if whole := b"".join(held):
        yield at, whole


def records(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, str, str, str, str | None]]:
    """(place, name, comment, seq, qual) of each record.

    One reader for both formats, which may be mixed: a record begins at a line of ``>`` or ``@``; its sequence is all
    printable characters up to a line that begins with ``>``, ``@`` or ``+``; after ``+`` as many quality characters
    follow as there are bases. A record whose quality ends early, or is longer, has none.
    """
    at, line = next(lines, (0, None))
    while line is not None:
        if line[:1] not in (b">", b"@"):
            at, line = next(lines, (0, None))
            continue
        place, head = at, line[1:].decode("latin-1").rstrip("\r")
        gap = min((n for n in (head.find(" "), head.find("\t")) if n >= 0), default=len(head))
        seq = []
        for at, line in lines:
            if line[:1] in (b">", b"@", b"+"):
                break
            seq.append(line.translate(None, NOT_BASE))
        else:
            line = None
        bases, qual = b"".join(seq), None
        if line is not None and line[:1] == b"+":
            got, n = [], 0
            while n < len(bases):
                at, line = next(lines, (0, None))
                if line is None:
                    break
                got.append(line.translate(None, NOT_QUAL))
                n += len(got[-1])
            qual = b"".join(got).decode("latin-1") if n == len(bases) else None
            at, line = next(lines, (0, None)) if line is not None else (0, None)
        yield place, head[:gap], head[gap + 1 :], bases.decode("latin-1"), qual or None


def range_map(file: Bytes, start: int, end: int, more: int = 1 << 16) -> list[tuple[int, int]]:
    """(upto, next): a reader that looks for a record from x on, with start <= x <= upto (the least such), goes on at ``next``, at ``end`` or behind it."""
    size, extra = file.size, more
    while True:
        to = min(size, end + extra)
        data = np.frombuffer(file.read(max(0, start - 1), to - max(0, start - 1)), np.uint8)
        whole = to == size
        breaks = np.flatnonzero(data == 10)
        starts = breaks + 1
        if start:
            first = max(0, start - 1)
        else:
            first, starts = 0, np.concatenate([[0], starts])
        starts = starts[starts < len(data)]
        if not whole:
            starts = starts[starts <= breaks[-1]] if len(breaks) else starts[:0]  # lines that are there in full
        at = starts + first
        n = len(starts)
        if n == 0:
            if whole:
                return [(end, size)]
            extra *= 4
            continue
        heads = data[starts]
        last = len(data) if whole else breaks[-1]  # where the last full line ends
        total = lambda kind: np.concatenate([[0], np.cumsum(np.add.reduceat(kind[data[: last + 1]], starts, dtype=np.int64))])
        bases, quals = total(BASE), total(QUAL)
        mark = (heads == 62) | (heads == 64)
        # the next line from here on that ends a sequence; n if there is none
        stops = np.append(np.flatnonzero(mark | (heads == 43)), n)
        may = np.flatnonzero(mark & (at < end))
        j = stops[np.searchsorted(stops, may + 1)]
        plus = (j < n) & (heads[np.minimum(j, n - 1)] == 43)
        need = bases[j] - bases[may + 1]
        m = np.where(plus, np.searchsorted(quals, quals[np.minimum(j + 1, n)] + need), j)  # the line after the record
        m = np.where(plus & (need == 0), j + 1, m)
        open_ = m >= n  # the record, or the line after it, isn't in the data
        if open_.any() and not whole:
            extra *= 4
            continue
        places = np.append(at, size)
        after = places[np.minimum(m, n)]
        behind = places[np.searchsorted(at, end)]
        if behind == size and not whole and not (at >= end).any():
            extra *= 4
            continue
        goes: list[int] = [0] * len(may)
        candidates = at[may]
        follow = np.searchsorted(candidates, after)
        for i in range(len(may) - 1, -1, -1):
            k = int(follow[i])
            goes[i] = int(after[i]) if after[i] >= end else goes[k] if k < len(may) else int(behind)
        out: list[tuple[int, int]] = []
        for c, g in zip(candidates.tolist(), goes):
            if out and out[-1][1] == g:
                out[-1] = (c, g)
            else:
                out.append((c, g))
        return [*out, (end, int(behind))]


def gzip_ranges(path: str, split_bytes: int) -> list[tuple[int, int, int | None, int, int]]:
    """(split, entry, stop, member's place in the file, and in the content): cut at records behind which a new member has begun."""
    file, members = Bytes(path), []
    out, entry, restart, held = [], 0, (0, 0), 0
    for at, *_ in records(lines_of(inflated(file.chunks(0), members), 0)):
        while held + 1 < len(members) and members[held + 1][1] <= at:
            held += 1
        if at - entry >= split_bytes and members[held] != restart:
            out.append((len(out), entry, at, *restart))
            entry, restart = at, members[held]
    return [*out, (len(out), entry, None, *restart)]


def record_ranges(spark: SparkSession, files: DataFrame, split_bytes: int = 32 << 20, *, gzip_members: bool = False) -> DataFrame:
    """A row for each range of ``files`` (filename, length): the place of its first record, and where those of the next range begin.

    A plain file is cut every ``split_bytes``; a gzip file is one range, or with ``gzip_members`` cut at members, which takes a pass over it.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / split_bytes).cast("long"))
    ranges = files.select("filename", "length", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("split"))
    maps_type = "filename string, length long, split long, gz boolean, upto array<long>, goes array<long>"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                file, start = Bytes(r["filename"]), r["split"] * split_bytes
                gz = file.read(0, 2) == GZIP
                got = [] if gz or not file.size else range_map(file, start, min(file.size, start + split_bytes))
                rows.append({**r, "gz": gz, "upto": [u for u, _ in got], "goes": [g for _, g in got]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("filename", pa.string()), ("length", pa.int64()), ("split", pa.int64()), ("gz", pa.bool_()), ("upto", pa.list_(pa.int64())), ("goes", pa.list_(pa.int64()))]))

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        """A file's maps, joined from its beginning: a few numbers for each range."""
        path, x, out = key[0].as_py(), 0, []
        got = sorted(rows.to_pylist(), key=lambda r: r["split"])
        if got[0]["gz"]:
            cuts = gzip_ranges(path, split_bytes) if gzip_members else [(0, 0, None, 0, 0)]
            out = [dict(zip(("filename", "split", "entry", "stop", "restart_at", "restart_pos"), (path, *c))) for c in cuts]
        else:
            for r in got:
                if not r["upto"] or x >= min(r["length"], (r["split"] + 1) * split_bytes):
                    continue  # a record of an earlier range goes on behind this one
                goes = r["goes"][int(np.searchsorted(r["upto"], x))]
                out.append({"filename": path, "split": r["split"], "entry": x, "stop": goes})
                x = goes
        return pa.Table.from_pylist(out, schema=pa.schema([("filename", pa.string()), *((c, pa.int64()) for c in ("split", "entry", "stop", "restart_at", "restart_pos"))]))

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return ranges.repartition(tasks, "filename", "split").mapInArrow(mapped, maps_type).groupBy("filename").applyInArrow(joined, RANGES)
