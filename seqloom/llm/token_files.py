"""Token files: each document's ids as an independent zstandard frame, with a trailing seek table.

File layout: one frame for each document (its ids as little-endian unsigned
32-bit integers), a skippable frame with the document ids, then the seek table
of the public zstd seekable format, itself a skippable frame: compressed size,
decompressed size and checksum (low 32 bits of XXH64 of the content) for each
frame. Any zstd decoder reads the file from its start; our reader reads the
tail and then only the frames asked for, and checks them.

Documents are range-partitioned and sorted by id; a task writes a file, or
several where its texts are long. File names carry the attempt, and the
manifest that Spark commits names the files of the attempts that counted, so
retries and lost executors leave at most unused files. Starts come from
running sums over the manifest, in two levels.

Defined results: a null or empty text is just the end id; a null document id
sorts first and is read back as null; equal ids are neighbours, ordered by how
their texts begin (64 characters); a very long text is one frame of up to 4 GiB; an empty
table writes no files; further columns are not looked at.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workers import give_back, tidy
from .workspace import Workspace, table

IDS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class FileWriter:
    def __init__(self, sink, level: int = 3):
        import xxhash
        import zstandard

        self.sink, self.zstd, self.xxh = sink, zstandard.ZstdCompressor(level=level), xxhash.xxh64_intdigest
        self.seek, self.ids = [], []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.zstd.compress(content)
        self.sink.write(frame)
        self.seek.append(struct.pack("<III", len(frame), len(content), self.xxh(content) & 0xFFFFFFFF))
        self.ids.append(struct.pack("<?q", doc_id is not None, doc_id or 0))

    def close(self) -> None:
        for magic, body in ((IDS_MAGIC, b"".join(self.ids)), (SEEK_MAGIC, b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, FOOTER_MAGIC))):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)
        self.sink.close()


class FileReader:
    """Random access to a token file by place or by document id."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.zstd, self.xxh = source, zstandard.ZstdDecompressor(), xxhash.xxh64_intdigest
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table_at = end - 9 - 12 * n
        self.entries = list(struct.iter_unpack("<III", self._at(table_at, 12 * n)))
        self.doc_ids = [i if known else None for known, i in struct.iter_unpack("<?q", self._at(table_at - 8 - 9 * n, 9 * n))]
        self.offsets = [0]
        for size, _, _ in self.entries:
            self.offsets.append(self.offsets[-1] + size)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def content(self, k: int) -> bytes:
        size, full, check = self.entries[k]
        out = self.zstd.decompress(self._at(self.offsets[k], size), max_output_size=full)
        if len(out) != full or self.xxh(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return out

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(id, ids as bytes) in file order; with ``wanted``, only those documents' frames are read."""
        only = None if wanted is None else set(wanted)
        for k, doc_id in enumerate(self.doc_ids):
            if only is None or doc_id in only:
                yield doc_id, self.content(k)


def open_reader(path: str) -> FileReader:
    store, at = fs.FileSystem.from_uri(path)
    return FileReader(store.open_input_file(at))


#: The normaliser and splitter that the short way below stands for; with any other the tokenizer does all.
SHORT_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SHORT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters, digits, marks and white space that NFC leaves alone and that Python and the tokenizer lower-case alike.
_LETTERS = "a-zß-öø-įı-ſ"
PLAIN = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿À-įı-ſ‐-‧‰-⁞€]*")
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in shown else next(rest) for b in range(256)}


class Encoder:
    """Ids of whole texts as bytes. Texts of plain characters are parted here, in the tokenizer's way, and only parts
    that are not remembered go to its model; texts with other characters go to the tokenizer whole.

    About ``most`` parts are remembered, and as many of those before; of these, what is met again stays."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, tokenizer: str, most: int = 80_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.letters = Tokenizer.from_file(tokenizer), most, _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        told = json.loads(self.tokenizer.to_str())
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        splits = len(steps) == 2 and steps[0].get("pattern") == {"Regex": SHORT_SPLIT} and steps[0].get("invert") and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]
        self.short = told["normalizer"] == SHORT_NORMALISER and splits and told["model"]["type"] == "BPE" and not told["model"]["dropout"] and not told["post_processor"]
        self.added = [t["content"] for t in told["added_tokens"]]

    @classmethod
    def of(cls, tokenizer: str) -> Encoder:
        """The one of this worker process: what it remembers serves its later tasks."""
        if tokenizer not in cls._kept:
            cls._kept[tokenizer] = cls(tokenizer)
        return cls._kept[tokenizer]

    @classmethod
    def let_go(cls) -> None:
        """Give back the memory of those of this worker process."""
        if cls._kept:
            cls._kept.clear()
            gc.collect()
            give_back()

    def _plain(self, text: str) -> bool:
        return self.short and PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _learn(self, parts: Iterable[str]) -> None:
        tokenize, letters, kept, before = self.tokenizer.model.tokenize, self.letters, self.parts, self.before
        for part in parts:
            if part in before:
                kept[part] = before[part]
                continue
            tokens = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(letters))
            kept[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        if len(self.parts) > self.most:
            self.before, self.parts = self.parts, {}
        end, out, odd = struct.pack("<I", end_id), [], []
        known = self.parts.__getitem__
        for t in texts:
            if not t:
                out.append(end)
            elif self._plain(t):
                split = PARTS.findall(t.lower())
                try:
                    ids = b"".join(map(known, split))
                except KeyError:
                    self._learn({*split}.difference(self.parts))
                    ids = b"".join(map(known, split))
                out.append(ids + end)
            else:
                odd.append(len(out))
                out.append(b"")
        for at, e in zip(odd, self.tokenizer.encode_batch_fast([texts[at] for at in odd], add_special_tokens=False)):
            out[at] = struct.pack(f"<{len(e.ids)}I", *e.ids) + end
        return out


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", file_bytes: int = 8 << 20) -> DataFrame:
    """Write ``docs`` in ascending id order; the manifest: part, nth, file, n_docs, n_ids (lazily: the writing is its job).

    A task takes a range of about ``file_bytes`` of text, and begins a new file after as many bytes of ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    tasks = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0) // file_bytes))
    # rows of one id are dealt by how their texts begin and then by their place in the input, so that no id fills one task
    keyed = rows.select("*", F.substring("text", 1, 64).alias("begin"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(tasks, "id", "begin", "row").sortWithinPartitions("id", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, context, nth, n_ids, file = Encoder.of(tokenizer), None, TaskContext.get(), 0, 0, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"part": [context.partitionId()], "nth": [nth], "file": [file], "n_docs": [len(writer.ids)], "n_ids": [n_ids]})

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                if writer is None:
                    file = f"{path}/part-{context.partitionId():08d}-{nth:04d}-{context.taskAttemptId()}.tok.zst"
                    store, name = fs.FileSystem.from_uri(file)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    writer = FileWriter(store.open_output_stream(name, compression=None))
                for doc_id, ids in zip(piece["id"].to_pylist(), encoder.encode(piece["text"].to_pylist(), end_id)):
                    writer.add(doc_id, ids)
                    n_ids += len(ids) // 4
                if 4 * n_ids >= 2 * file_bytes:
                    yield closed()
                    writer, nth, n_ids = None, nth + 1, 0
        if writer is not None:
            yield closed()

    return dealt.mapInArrow(tidy(write), "part long, nth long, file string, n_docs long, n_ids long")


def with_starts(manifest: DataFrame, *, block: int = 1024) -> DataFrame:
    """``manifest`` with ``base``: the ids before each file. Sums over blocks of parts come first, so one task sees a row a block."""
    first = (Window.unboundedPreceding, -1)
    blocked = manifest.withColumn("block", F.floor(F.col("part") / block))
    blocks = blocked.groupBy("block").agg(F.sum("n_ids").alias("in_block"))
    before = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("in_block").over(Window.partitionBy().orderBy("block").rowsBetween(*first)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "nth").rowsBetween(*first)), F.lit(0))
    return blocked.withColumn("inside", inside).join(before, F.col("block") == F.col("b")).withColumn("base", F.col("before") + F.col("inside")).drop("b", "block", "before", "inside")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, file, frame, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.let_go()  # the files are written
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["base"], {k: [] for k in ("doc_id", "file", "frame", "start", "n_tokens", "ids_crc32")}
                for k, (doc_id, ids) in enumerate(open_reader(row["file"]).documents()):
                    n = len(ids) // 4
                    for name, value in zip(out, (doc_id, row["file"], k, start, n, zlib.crc32(ids))):
                        out[name].append(value)
                    start += n
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("frame", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    spread = with_starts(manifest).repartition(max(1, min(manifest.count(), 4096)))
    return spread.mapInArrow(tidy(read), "doc_id long, file string, frame long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    work = Workspace(docs.sparkSession, "tokens")
    manifest = work.save(write_tokens(docs, f"{work.path}/files", tokenizer=tokenizer or default_tokenizer(), end_id=end_id), "manifest")
    return read_tokens(manifest)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
