import random
import resource

import pytest
from pyspark.sql import functions as F

from seqloom.operators import sequences as sq
from seqloom.operators.align import EnvelopeConfig, align, reference_rows, reference_windows

SEQS = "idx long, name string, seq string, qual string"
PLACES = ["y_idx", "x_idx", "score", "ref_start", "ref_end", "ref_rev", "ref_row", "read_row"]


def read_of(rng, seq, i):
    out = list(seq)
    for _ in range(4):
        out[rng.randrange(len(out))] = rng.choice("ACGT")
    del out[rng.randrange(len(out))]
    text = "".join(out)
    return (i, f"r{i}", text[::-1].translate(str.maketrans("ACGT", "TGCA")) if i % 2 else text, None)


def test_windows_cover_each_reference(spark):
    refs = reference_rows(sq.with_revcomps(spark.createDataFrame([(0, "a", "ACGT" * 25, None), (1, "b", "AC", None), (2, "c", "G" * 30, None)], SEQS), 10))
    for size, lap in ((30, 10), (29, 28), (200, 3)):
        rows = reference_windows(refs, size, lap).collect()
        for ref in refs.collect():
            cut = sorted((r["offset"], r["seq"]) for r in rows if r["idx"] == ref["idx"])
            assert all(ref["seq"][at : at + size] == s for at, s in cut) and cut[0][0] == 0 and cut[-1][0] + len(cut[-1][1]) == len(ref["seq"])
            assert all(a[0] + len(a[1]) - b[0] == lap for a, b in zip(cut, cut[1:]))
    with pytest.raises(ValueError, match="longer than its overlap"):
        reference_windows(refs, 10, 10)


def test_windows_give_what_whole_references_give(spark):
    rng = random.Random(6)
    refs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1500, 700, 90)]
    reads = [read_of(rng, refs[i % 2][at : at + 90], i) for i, at in enumerate((0, 610, 95, 333, 1400, 200))]
    both = sq.with_revcomps(spark.createDataFrame([(i, f"x{i}", s, None) for i, s in enumerate(refs)], SEQS), 3)
    frame = spark.createDataFrame(reads, SEQS)
    # with a band, diagonal 0 of each window is searched besides: chance alignments of unlike pairs can be better ones
    for config, best in ((EnvelopeConfig(full=True), True), (EnvelopeConfig(full=True), False), (EnvelopeConfig(threshold=8, band=20), True)):
        got = [sorted(map(tuple, align(frame, both, config=config, use_quals=False, best_only=best, threshold=20.0, window=w).select(*PLACES).collect())) for w in (None, (300, 150))]
        assert got[0] == got[1] and len(got[0]) >= len(reads)


def test_a_long_reference_in_bounded_memory(spark):
    """5 Mb: windows hold the sweep to a window, whatever the reference's length."""
    rng = random.Random(7)
    block = "".join(rng.choice("ACGT") for _ in range(50_000))
    parts = [block[k:] + block[:k] for k in (rng.randrange(50_000) for _ in range(100))]
    ref = "".join(parts)
    at = 3_333_333
    reads = spark.createDataFrame([(0, "r0", ref[at : at + 400], None)], SEQS)
    refs = spark.createDataFrame([(0, "long", ref, None)], SEQS).withColumn("source", F.lit(None).cast("struct<name:string,start:int,end:int,rev:boolean>")).withColumn("is_orig", F.lit(True))
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    [found] = align(reads, refs, config=EnvelopeConfig(threshold=150), use_quals=False, window=(50_000, 2_000)).collect()
    assert ref[found["ref_start"] - 1 : found["ref_end"]] == ref[at : at + 400] and "-" not in found["ref_row"]
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss <= max(before, 600_000)  # KB, of finished workers
