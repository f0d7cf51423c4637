import io
import random
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.token_files import PLAIN, Encoder, FileReader, FileWriter, default_tokenizer, read_tokens, round_trip, with_starts, write_tokens

TEXTS = [None, "", " \n\t", "Hello, World!  it's 42 o'clock", "NAÏVE É é Straße ΣΟΦΌΣ İstanbul", "x" * 3000, "a.b,c;;; don't. END.", "<|endoftext|> #$%&", "word joined by wide\x1cblanks", "日本語 text。", "😀😀 ok", "don.'s"]


def test_words_apart_encode_as_the_whole_text():
    whole = Tokenizer.from_file(default_tokenizer())
    own = Encoder(default_tokenizer(), most=3)
    for _ in range(2):
        for text, ids in zip(TEXTS, own.encode(TEXTS, 1)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_the_short_way_is_the_tokenizer_s():
    whole, own, rng = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer()), random.Random(5)
    assert own.short
    plain = [chr(c) for c in range(0x2100) if PLAIN.fullmatch(chr(c))]
    texts = plain + ["x" + c + "y" for c in plain] + ["".join(rng.choices([*plain, *"  ''stem01ab"], k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("aé'sİΣ\u0301\u00a0½五 ", k=9)) for _ in range(500)]
    for text, ids in zip(texts, own.encode(texts, 1)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(text, add_special_tokens=False).ids + [1], text


def test_starts_over_several_blocks_and_files_of_a_part(spark):
    rows = [(p, n, f"f{p}-{n}", 1, (7 * p + 3 * n) % 11) for p in range(9) for n in range(1 + p % 2)]
    got = {(r["part"], r["nth"]): r["base"] for r in with_starts(spark.createDataFrame(rows, "part long, nth long, file string, n_docs long, n_ids long"), block=4).collect()}
    at = 0
    for p, n, _, _, ids in rows:
        assert got[p, n] == at
        at += ids


def test_one_id_over_many_tasks_and_a_very_long_text(spark, tmp_path):
    rows = [(None, f"text {i % 50}") for i in range(3000)] + [(7, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = write_tokens(docs, f"file://{tmp_path}", tokenizer=default_tokenizer(), end_id=1, file_bytes=4_000).cache()
    assert made.filter("n_docs > 0").count() >= 5 and made.agg(F.max("n_docs")).first()[0] < 1500
    got = sorted(map(tuple, read_tokens(made).select("start", "n_tokens", "doc_id").collect()))
    assert len(got) == 3001 and got[-1][2] == 7 and got[-1][1] == 20_001
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_reader_takes_only_what_is_asked_and_checks_it():
    class Kept(io.BytesIO):
        def close(self):
            pass

    sink = Kept()
    writer = FileWriter(sink)
    contents = {i: struct.pack("<3I", i, i + 1, i + 2) * (i + 1) for i in range(20)}
    for i, c in contents.items():
        writer.add(i, c)
    writer.add(None, b"")
    writer.close()
    raw = sink.getvalue()
    reader = FileReader(pa.BufferReader(raw))
    assert dict(reader.documents()) == contents | {None: b""}
    assert dict(reader.documents([3, 7])) == {3: contents[3], 7: contents[7]}
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(contents.values())
    other = zstandard.ZstdCompressor(level=3).compress(struct.pack("<3I", 9, 9, 9))
    size = reader.entries[0][0]
    if len(other) == size:
        with pytest.raises(ValueError):
            FileReader(pa.BufferReader(other + raw[size:])).content(0)


def test_round_trip_with_nulls_ties_and_clashing_columns(spark):
    rows = [(5, "b"), (None, "a"), (5, "a a"), (-3, None), (7, "c"), (7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("part", F.lit(1))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in round_trip(docs).collect())
    whole = Tokenizer.from_file(default_tokenizer())
    expected, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((at, i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == expected
    assert round_trip(docs.limit(0)).count() == 0


def test_very_long_text():
    text = "Wörd, and ’more’ " * 300_000
    ids = Encoder(default_tokenizer()).encode([text], 1)[0]
    one = Tokenizer.from_file(default_tokenizer()).encode(text[:17], add_special_tokens=False).ids
    assert ids == struct.pack(f"<{len(one)}I", *one) * 300_000 + struct.pack("<I", 1)


def test_remembered_parts_are_bounded():
    """A worker that meets ever new words keeps the last ones; before, it kept a million."""
    own = Encoder(default_tokenizer())
    word = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    for at in range(0, 400_000, 10_000):
        texts = ["the same " + " ".join(map(word, range(at, at + 10_000)))]
        got = own.encode(texts, 1)
        assert at % 100_000 or got[0][:-4] == b"".join(i.to_bytes(4, "little") for i in own.tokenizer.encode(texts[0], add_special_tokens=False).ids)
    assert len(own.parts) + len(own.before) < 350_000 and "same" in own.parts | own.before
