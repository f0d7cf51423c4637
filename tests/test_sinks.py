import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_sequences import simulated

from seqloom.operators import sequences as sq
from seqloom.operators.align import EnvelopeConfig, align
from seqloom.sources.fastx import read_fastx
from seqloom.sources.sinks import LinesWriter, alignment_lines, join_parts, stream_lines, write_alignments, write_lines, write_sequences


@pytest.fixture(scope="module")
def found(spark):
    reads, refs, _ = simulated(spark)
    both = sq.with_revcomps(refs, 3)
    return align(reads, both, config=EnvelopeConfig(threshold=8, band=20), use_quals=False).cache(), both


def test_one_text_over_any_number_of_files(spark, found, tmp_path):
    alignments, refs = found
    for kind, begins in (("sam", "@HD\tVN:1.0"), ("stockholm", "# STOCKHOLM 1.0"), ("fasta", ">Ref "), ("refseq", ">")):
        texts = set()
        for n in (1, 3, 7):
            path = str(tmp_path / f"{kind}-{n}")
            write_alignments(alignments, path, kind, refs=refs, partitions=n)
            assert join_parts(path, f"{path}.txt") == os.path.getsize(f"{path}.txt")
            texts.add(open(f"{path}.txt").read())
            assert not [f for f in os.listdir(path) if f.startswith("_tasks")]
        [text] = texts
        assert text.startswith(begins)
        if kind == "sam":
            lines = text.splitlines()
            assert [x.split("\t")[0] for x in lines[:4]] == ["@HD", "@SQ", "@SQ", "@SQ"] and len(lines) == 4 + alignments.count()
            assert [x.split("\t")[0] for x in lines[4:]] == [f"read{i}" for i in range(6)]
    with pytest.raises(ValueError, match="no format 'bam'"):
        alignment_lines(alignments, "bam")
    with pytest.raises(ValueError, match="needs the references"):
        write_alignments(alignments, str(tmp_path / "x"), "sam")
    assert alignment_lines(alignments, "sam", threshold=1e9).count() == 0


def test_a_retried_task_leaves_each_record_once(spark, tmp_path):
    path, flag = str(tmp_path / "out"), str(tmp_path / "failed")

    def once(batches):
        for batch in batches:
            yield batch
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("lost")

    rows = spark.range(5000, numPartitions=3).select(F.col("id").cast("string").alias("value"))
    try:
        write_lines(rows.mapInArrow(once, "value string"), path)
    except Exception:  # a local session doesn't retry tasks: the whole write is done again
        assert not os.path.exists(f"{path}/_parts.json")
        write_lines(rows.mapInArrow(once, "value string"), path)
    got = [x for part in json.load(open(f"{path}/_parts.json")) for x in open(f"{path}/{part['file']}").read().split()]
    assert sorted(map(int, got)) == [*range(5000)]
    assert {f for f in os.listdir(path) if not f.startswith((".", "_"))} == {p["file"] for p in json.load(open(f"{path}/_parts.json"))}


def test_attempts_that_are_not_told_do_not_count(tmp_path, monkeypatch):
    class Context:
        @staticmethod
        def partitionId():  # noqa: N802
            return 4

    monkeypatch.setattr("seqloom.sources.sinks.TaskContext.get", lambda: Context)
    writer = LinesWriter(str(tmp_path / "w"))
    batch = pa.RecordBatch.from_pydict({"value": ["a", None, "b"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.file != kept.file and (kept.size, kept.lines) == (5, 3)
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path / "w")) == ["_parts.json", "part-00000004.txt"]
    assert open(tmp_path / "w/part-00000004.txt").read() == "a\n\nb\n"


def test_sequences_and_streams(spark, tmp_path):
    rows = [("a", "x y", "ACGT", "IIII"), ("b", "", "GG", None), ("c", "", "", None)]
    seqs = spark.createDataFrame(rows, "name string, comment string, seq string, qual string")
    write_sequences(seqs, str(tmp_path / "fq"), "fastq")
    join_parts(str(tmp_path / "fq"), str(tmp_path / "all.fq"))
    got = sorted(tuple(r) for r in read_fastx(spark, str(tmp_path / "all.fq")).select("name", "comment", "seq", "qual").collect())
    assert got == sorted(rows)
    for n in (1, 2):
        spark.range(n * 10, n * 10 + 5).select(F.col("id").cast("string").alias("value")).write.mode("append").text(str(tmp_path / "in"))
        query = stream_lines(spark.readStream.schema("value string").text(str(tmp_path / "in")), str(tmp_path / "stream"), str(tmp_path / "state"), availableNow=True)
        query.awaitTermination()
    batches = sorted(os.listdir(tmp_path / "stream"))
    got = [x for b in batches for part in json.load(open(tmp_path / "stream" / b / "_parts.json")) for x in open(tmp_path / "stream" / b / part["file"]).read().split()]
    assert batches == ["batch-00000000", "batch-00000001"] and sorted(map(int, got)) == [*range(10, 15), *range(20, 25)]
