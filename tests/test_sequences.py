import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import sequences as sq
from seqloom.operators.align import EnvelopeConfig, align, gapped_fasta, null_model, overlap, refseq_fasta, sam_header, sam_lines, stockholm
from seqloom.plans.model import Params
from seqloom.plans.train import counts_of, e_step, train
from seqloom.sources.fastx import fasta_lines, fastq_lines, load_sequences, parse_fastx, read_fastx, record_at

SEQS = "idx long, name string, seq string, qual string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, dna.revcomp(lit("AcGTN"))) == "NACGT"
    assert [one(spark, dna.tokenize(lit(c))) for c in "ACGTacgtN"] == [0, 1, 2, 3, 0, 1, 2, 3, -1]
    assert one(spark, dna.tokens(lit("GATT"))) == [2, 0, 3, 3]
    with pytest.raises(Exception, match="not a nucleotide: N"):
        one(spark, dna.tokens(lit("GANT")))
    assert one(spark, dna.kmer_encode(lit("GATTACA"))) == int("2033010", 4)
    assert one(spark, dna.kmer_decode(lit(int("2033010", 4)), 7)) == "GATTACA"
    assert one(spark, dna.kmers(lit("ACG"), 5)) == [] and one(spark, dna.kmers(lit("ACGTA"), 4)) == ["ACGT", "CGTA"]
    assert one(spark, dna.context_kmers(lit("GTTA"), 3)) == ["TTG", "TGT", "GTT", "TTA"]
    assert one(spark, dna.context_kmers(lit("ACAC"), 2)) == ["AA", "AC", "CA", "AC"] and one(spark, dna.context_kmers(lit("AC"), 0)) == ["", ""]
    assert one(spark, dna.qual_scores(lit("!~\x7f I"))) == [0, 93, 93, 0, 40]
    assert one(spark, dna.qual_string(F.array(lit(0), lit(200), lit(40)))) == "!~I"
    assert one(spark, dna.ungap(lit("A-C.G"))) == "ACG" and one(spark, dna.ungap_qual(lit("A-C.G"), lit("12345"))) == "135"
    assert one(spark, dna.consensus(lit("AC-T"), lit("AGTT"))) == "A:-T"
    assert one(spark, dna.cigar(lit("AC-T--G"), lit("A-GT--G"))) == "1M1D1I2M"
    assert one(spark, dna.cigar(lit("AAA"), lit("AAA"), op_first=True)) == "M3"
    assert one(spark, dna.log_sum_exp(lit(float("-inf")), lit(float("-inf")))) == float("-inf")


def test_compose(spark):
    inner = F.struct(F.lit("s").alias("name"), F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit(False).alias("rev"))
    outer = F.struct(F.lit("root").alias("name"), F.lit(11).alias("start"), F.lit(20).alias("end"), F.lit(True).alias("rev"))
    assert tuple(one(spark, dna.compose(inner, outer))) == ("root", 16, 18, True)


def test_tables(spark):
    seqs = spark.createDataFrame([(0, "a", "ACGTACGTAA", "I" * 10), (1, "b", "", None), (2, "a", "TTTT", None)], SEQS)
    full = sq.drop_empty(seqs)
    both = {r["idx"]: r for r in sq.with_revcomps(full, 10).collect()}
    assert both[10]["seq"] == "TTACGTACGT" and both[10]["name"] == "revcomp(a)" and both[10]["source"]["rev"] and both[0]["source"] is None
    with pytest.raises(ValueError, match="more than once: a"):
        sq.require_unique_names(full)
    diags = sq.diagonal_counts(full, full, 4).filter("x_idx = 0 and y_idx = 0").collect()
    words = [seqs.first()["seq"][i : i + 4] for i in range(7)]
    by_hand = Counter(i - j for i, a in enumerate(words) for j, b in enumerate(words) if a == b)
    assert {r["diag"]: r["cnt"] for r in diags} == by_hand == {0: 7, 4: 2, -4: 2}
    pairs = sq.triangular_pairs(spark.range(6).withColumnRenamed("id", "idx"), 3).collect()
    assert {(r["x_idx"], r["y_idx"]) for r in pairs} == {(x, y) for x in (0, 1) for y in range(x + 1, 6)}
    prefix = sq.training_prefix(spark.createDataFrame([(i, "A" * 10) for i in range(9)], "idx long, seq string"), 35)
    assert sorted(r["idx"] for r in prefix.collect()) == [0, 1, 2, 3]
    ll = spark.createDataFrame([(1, 1, -10.0), (1, 2, -11.0), (1, 3, -40.0)], "y long, x long, ll double")
    assert sorted(r["x"] for r in sq.survivors(ll, "y", "ll").collect()) == [1, 2]
    assert sum(r["posterior"] for r in sq.posteriors(ll, "y", "ll").collect()) == pytest.approx(1)


def test_fastx(spark, tmp_path):
    import gzip

    text = b">one two three\nACG\nTT\n@q c\nACGT\n+\nab\ncd\n@cut\nACGT\n+\nabc"
    assert [r[1:] for r in parse_fastx(text)] == [("one", "two three", "ACGTT", None), ("q", "c", "ACGT", "abcd"), ("cut", "", "ACGT", None)]
    (tmp_path / "a.fq").write_bytes(text)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">z\nAC\n>empty\n>y\nGG\n"))
    paths = [str(tmp_path / "a.fq"), str(tmp_path / "b.fa.gz")]
    assert read_fastx(spark, *paths).count() == 6
    loaded = load_sequences(spark, paths).orderBy("idx").collect()
    assert [(r["idx"], r["name"]) for r in loaded] == [(0, "one"), (1, "q"), (2, "cut"), (3, "z"), (4, "y")]
    assert record_at(spark, paths[0], loaded[1]["filepos"]).first()["name"] == "q"
    q = spark.createDataFrame(loaded[1:3])
    assert sorted(r["value"] for r in fastq_lines(q).collect()) == ["@cut\nACGT", "@q c\nACGT\n+\nabcd"]
    assert fasta_lines(q.filter("name = 'q'")).first()["value"] == ">q c\nACGT"


def simulated(spark, n=6, seed=2):
    rng = random.Random(seed)
    refs = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(3)]
    rows, truth = [], {}
    for i in range(n):
        r, at, rev = i % 3, rng.randrange(200), i % 2 == 1
        seq = refs[r][at : at + 80]
        if rev:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        seq = seq[:30] + seq[32:50] + "T" + seq[50:]
        rows.append((i, f"read{i}", seq, "".join(chr(33 + rng.randrange(5, 20)) for _ in seq)))
        truth[i] = (r, at + 1, at + 80, rev)
    return spark.createDataFrame(rows, SEQS), spark.createDataFrame([(i, f"ref{i}", s, None) for i, s in enumerate(refs)], SEQS), truth


def test_align_finds_where_reads_come_from(spark):
    reads, refs, truth = simulated(spark)
    both = sq.with_revcomps(refs, 3)
    config = EnvelopeConfig(threshold=8, band=20)
    found = align(reads, both, config=config, use_quals=False).persist()
    for r in found.collect():
        ref, start, end, rev = truth[r["y_idx"]]
        assert (r["x_idx"] % 3, r["ref_rev"]) == (ref, rev) and abs(r["ref_start"] - start) <= 3 and abs(r["ref_end"] - end) <= 3
    assert found.count() == len(truth)
    full = {r["y_idx"]: r["raw"] for r in align(reads, both, config=EnvelopeConfig(full=True), use_quals=False).collect()}
    assert all(r["raw"] <= full[r["y_idx"]] + 1e-9 and r["raw"] > full[r["y_idx"]] - 1 for r in found.collect())
    assert align(reads, both, config=config, use_quals=False, best_only=False, threshold=None).count() > len(truth)
    sam = [r["value"].split("\t") for r in sam_lines(found).collect()]
    assert {f[1] for f in sam} == {"0", "16"} and all(f[5].endswith("M") for f in sam)
    assert [r["value"].split("\t")[0] for r in sam_header(both).orderBy("ord").collect()] == ["@HD", "@SQ", "@SQ", "@SQ"]
    assert stockholm(found).first()["value"].startswith("# STOCKHOLM 1.0\n") and gapped_fasta(found).first()["value"].startswith(">Ref substr(")
    assert "-" not in refseq_fasta(found).first()["value"].split("\n")[1]


def test_overlaps_with_and_without_seeds(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(260))
    rows = [(i, f"r{i}", genome[50 * i : 50 * i + 110], None) for i in range(4)]
    both = sq.with_revcomps(spark.createDataFrame(rows, SEQS), 4)
    config = EnvelopeConfig(threshold=14, band=20)
    null = null_model(spark.createDataFrame([(0, "q", genome, "5" * 260)], SEQS))
    all_pairs = overlap(both, 4, null=null, config=config).collect()
    seeded = overlap(both, 4, null=null, config=config, require_seed=True).collect()
    good = {(r["x_idx"], r["y_idx"]) for r in all_pairs if r["score"] > 30}
    assert {(0, 1), (1, 2), (2, 3)} <= good and good <= {(r["x_idx"], r["y_idx"]) for r in seeded}
    assert {(r["x_start"], r["x_end"]) for r in seeded if (r["x_idx"], r["y_idx"]) == (0, 1)} == {(51, 110)}


def test_training_raises_the_likelihood(spark):
    reads, refs, _ = simulated(spark)
    both = sq.with_revcomps(refs, 3)
    config = EnvelopeConfig(threshold=8, band=20)
    fit = train(reads, both, max_iter=4, min_inc=0.0001, config=config)
    totals = [a + b for _, a, b in fit.history]
    assert len(totals) >= 2 and totals == sorted(totals)
    evidence, sums = e_step(reads, both, fit.params, fit.null, config=config)
    c = counts_of(sums)
    emitted = c.insert.sum() + c.match.sum()
    assert emitted == pytest.approx(sum(len(r["seq"]) for r in reads.collect()), rel=0.02)
    assert all(r["kept"] for r in evidence.collect())
    again = counts_of(e_step(reads, both, fit.params, fit.null, config=config, survivors=evidence)[1])
    assert np.allclose(c.match, again.match, atol=1e-4)
    assert Params.from_json(fit.params.to_json()).to_json() == fit.params.to_json()
