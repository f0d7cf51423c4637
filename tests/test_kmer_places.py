import random
from collections import Counter

import pytest

from seqloom import catalog
from seqloom.operators import sequences as sq

SEQS = "idx long, name string, seq string, qual string"
SF = "/root/testdata/sf0.001"


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s, None) for i, s in enumerate(seqs)], SEQS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["diagonal_counts", "seed_diagonals", "band_envelopes", "count_distribution", "storage_layout", "memory_thresholds"])
def test_kmers_are_not_shuffled(spark, name):
    assert "hashpartitioning(kmer" not in plan_of(catalog.queries()[name](spark, SF))


def test_what_is_no_base_is_named(spark):
    with pytest.raises(Exception, match="not a nucleotide: 'N'"):
        sq.diagonal_counts(frame(spark, ["ACGNACGT"]), frame(spark, ["AACGACGT"]), 4).collect()


@pytest.mark.parametrize(("k", "piece"), [(1, 7), (5, 9), (12, 64), (13, 10), (31, 50)])
def test_places_over_pieces_and_sequences(spark, k, piece):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTacgt") for _ in range(n)) for n in (0, 1, k - 1, k, 40, 200)] + [None]
    number = lambda w: sum("ACGT".index(c.upper()) * 4 ** (k - 1 - i) for i, c in enumerate(w))
    want = Counter((i, p, number(s[p : p + k])) for i, s in enumerate(seqs) if s for p in range(len(s) - k + 1))
    rows = frame(spark, seqs).coalesce(1)
    places = sq.kmer_places(rows, k, "x", piece=piece)
    assert Counter(map(tuple, places.collect())) == want
    some = sq.kmer_set(sq.kmer_places(rows.filter("idx = 5"), k, "y"), k, 1000)
    kept = Counter(map(tuple, sq.kmer_places(rows, k, "x", some, piece).collect()))
    in_y = {c for i, _, c in want if i == 5}
    assert not kept - want and {r for r in want if r[2] in in_y} <= set(kept)
    assert sq.kmer_set(sq.kmer_places(rows, k, "y"), k, 1) is None


def test_texts_become_the_same_bases(spark):
    from seqloom.functions import dna

    texts = ["Hello, World", "", None, "12 . \n", "ÄÖ éİstanbul Kelvin ß", "z" * 50]
    rows = frame(spark, texts)
    want = [tuple(r) for r in sq.drop_empty(rows.withColumn("seq", dna.dna_of_text(rows["seq"]))).collect()]
    got = sq.from_text(rows)
    assert [tuple(r) for r in got.collect()] == want and got.schema == rows.schema


def test_layout_sorts_no_rows(spark):
    assert "Window" not in plan_of(catalog.queries()["storage_layout", "memory_thresholds"](spark, SF))


def test_thresholds_list_no_diagonals(spark):
    assert "Generate" not in plan_of(catalog.queries()["memory_thresholds"](spark, SF))


def test_places_in_order_of_a_key_with_gaps(spark):
    keys = [5, 900, 7, 40, 41, 10**12, 0]
    got = sq.numbered(spark.createDataFrame([(k,) for k in keys], "key long").repartition(3), "key").collect()
    assert {r["key"]: r["idx"] for r in got} == {k: n for n, k in enumerate(sorted(keys))}


def test_pairs_are_dealt_over_tasks_and_none_is_lost(spark):
    seqs = spark.range(60).withColumnRenamed("id", "idx").coalesce(1)
    got = sq.triangular_pairs(seqs, 30, block=7)
    assert got.rdd.getNumPartitions() >= 4
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == [(x, y, y >= 30) for x in range(29) for y in range(x + 1, 60)]


def test_strands_are_turned_a_text_at_a_time(spark):
    from seqloom.functions import dna

    rows = frame(spark, ["ACGTN", "acgt", "", None, "ÄACG"])
    got = sq.with_revcomps(rows, 10)
    want = {r["idx"] + 10: r["rc"] for r in rows.select("idx", dna.revcomp(rows["seq"]).alias("rc")).collect()}
    assert {r["idx"]: r["seq"] for r in got.filter("not is_orig").collect()} == want
    assert "translate(" not in plan_of(got)


@pytest.mark.parametrize("name", ["diagonal_counts", "seed_diagonals"])
def test_diagonals_are_counted_where_the_reference_is(spark, name):
    assert "Exchange" not in plan_of(catalog.queries()[name](spark, SF)) and "Join" not in plan_of(catalog.queries()[name](spark, SF))


@pytest.mark.parametrize("most_hits", [1, 7, 2_000_000])
def test_diagonals_in_place_are_those_of_the_join(spark, monkeypatch, most_hits):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    xs = [text(80), "", None, text(3), "A" * 40, text(300), text(6)]
    ys = [text(30), "A" * 9, xs[5][40:90] + "acgt", None, ""]
    x, y = frame(spark, xs), spark.createDataFrame([(7, "a", ys[0], None), (7, "b", ys[1], None), (None, "c", ys[2], None), (9, "d", ys[3], None), (10, "e", ys[4], None)], SEQS)
    x = x.withColumn("idx", x["idx"] * 3).coalesce(1)
    joined = sq.kmer_hits(x, y, 4).selectExpr("x_idx", "y_idx", "px - py as diag").groupBy("x_idx", "y_idx", "diag").count()
    want = sorted((tuple(r) for r in joined.collect()), key=str)
    start = sq.batch_places
    monkeypatch.setattr(sq, "batch_places", lambda b, k, within, piece=11: start(b, k, within, piece))
    places = sq.kmer_places(y, 4, "y").toArrow()
    got = sq._diagonals_in_place(x, places, 4, "bigint", most_hits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sq.diagonal_counts(x, y, 4).schema == got.schema


def test_repeated_references_are_one(spark):
    x, y = frame(spark, ["ACGTACGT"]), frame(spark, ["ACGTAC"])
    once = {(r["diag"], r["cnt"]) for r in sq.diagonal_counts(x, y, 4).collect()}
    twice = sq.diagonal_counts(x.union(x), y, 4).collect()
    assert {(r["diag"], r["cnt"]) for r in twice} == {(d, 2 * c) for d, c in once} and len(twice) == len(once)
    assert sq.diagonal_counts(x, frame(spark, ["", None]), 4).count() == 0


def test_envelopes_join_lengths_once(spark):
    assert plan_of(catalog.queries()["band_envelopes"](spark, SF)).count("Join") == 2
