import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm.language_id import fold
from seqloom.llm.lm_scoring import _of_part, _short, _shorten, END, THRESHOLDS, VALUES, BloomModel, Frequent, LogBloom, levels_of, mixed, pair_keys, share, token_stream

SCHEMA = "doc_id long, text string"


def texts(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randrange(0, 80)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "New\tWORDS \x0b w1 W1"), (n + 3, " x é É")]


def brute(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    return n, {i: (len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


def scores(rows, prior):
    """By document: the sum of log10 P with exact tables, counts quantised as in the filter, no false positives."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None]
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    n, v = sum(c.values()), len(c)
    p = lambda a, b: (VALUES[levels_of(np.array([pairs[a, b]]))[0]] + prior * (c[b] + 1) / (n + v + 1)) / (c[a] + prior)
    return {i: sum(math.log10(p(a, b)) for a, b in zip([None, *words(t)], words(t))) for i, t in rows}


SMALL = [dict(), dict(head=40, head_bytes=400_000, part_bytes=3_000), dict(head=0, head_bytes=0, part_bytes=100_000), dict(head=10**9, head_bytes=1 << 30)]


@pytest.mark.parametrize("parts", SMALL)
def test_scores_are_those_of_exact_tables_wherever_the_counts_lie(spark, parts):
    rows = texts() + [(500, " ".join(f"w{i % 300}" for i in range(60_000)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = BloomModel(docs.filter(fold(F.col("doc_id"), 7) != 2), **parts)
    got = model.score(docs, piece_bytes=3_000).collect()
    (n, expected), score = brute(rows), scores(rows, model.probability.prior)
    assert len(got) == len(rows)
    for r in got:
        size, known, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-5)
        assert r["score"] == pytest.approx(score[r["doc_id"]], rel=2e-3, abs=0.02)


def test_a_table_in_files_needs_no_saved_pieces(spark, tmp_path):
    spark.createDataFrame(texts(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    model = BloomModel(docs, head=0, head_bytes=0, part_bytes=5_000)
    saved, stable = (sorted(model.score(docs, piece_bytes=2_000, stable=s).collect(), key=lambda r: r["doc_id"]) for s in (False, True))
    assert saved == stable and len(saved) == len(texts())


def test_levels():
    counts = np.array([0, 1, 2, 3, 5, 6, 7, 8, 9, 100, 10**9])
    level = levels_of(counts)
    assert level[0] == 0 and np.all(THRESHOLDS[level[1:] - 1] <= counts[1:]) and np.all(counts[1:] < THRESHOLDS[level[1:]])
    assert np.all(VALUES[level[:6]] == counts[:6]) and np.all(np.abs(VALUES[level] - counts) <= 0.075 * counts)


def test_filter_reads_levels_back():
    keys = mixed(np.arange(20_000, dtype=np.uint64))
    levels = np.random.default_rng(1).integers(1, 9, 20_000)
    segments = 32
    whole = LogBloom.of(keys, levels, each=5, segments=segments)
    assert np.array_equal(whole.levels(keys), levels)
    others = mixed(np.arange(10**6, 10**6 + 200_000, dtype=np.uint64))
    assert np.mean(whole.levels(others) > 0) < 1e-3
    assert np.array_equal(Frequent(whole.words, 5, segments, 3).levels(keys), np.where(levels >= 3, levels, 0))


def test_probabilities_of_a_context_add_up_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = [token_stream(pa.array([r["text"]]))[0] for r in docs.collect()]
    counts = Counter(w for s in words for w in s.tolist())
    tokens, n = np.array([*counts], np.uint64), np.array([*counts.values()])
    rare, frequent = tokens[np.argsort(n)[:20]], tokens[np.argsort(-n)[:20]]
    for parts in (dict(head_bytes=1 << 30, head=10**9), dict(head_bytes=0, part_bytes=1 << 30)):
        model = BloomModel(docs, **parts)
        assert (len(counts), sum(counts.values())) == (model.v, model.n)
        rest = model.known.filter("kind = 1").first()["rest"]
        filters = [(Frequent(*model.shared_filter.value), lambda k: _of_part(_short(_shorten(k)), share(k, model.parts))), (LogBloom(np.frombuffer(rest, np.uint64), each=model.each, segments=len(rest) >> 16), lambda k: _short(_shorten(k)))]
        for a in [*rare, *frequent, np.uint64(12345)]:
            keys = mixed(np.full(len(tokens), a) * np.uint64(0xC2B2AE3D27D4EB4F) + tokens)
            level = np.maximum(*(f.levels(of(keys)) for f, of in filters))
            total = model.probability(level, n, counts.get(int(a), 0)).sum() + model.probability(np.array([0]), np.array([0]), counts.get(int(a), 0))[0]
            assert abs(total - 1) < 0.02


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_unseen_documents_are_likelier_than_by_single_tokens(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = BloomModel(docs.filter(fold(F.col("doc_id"), 7) != 2)).score(docs).filter(fold(F.col("doc_id"), 7) == 2)
    r = got.agg(F.avg(F.col("score") / F.col("n_tokens")).alias("score"), F.avg(F.col("base_score") / F.col("n_tokens")).alias("base"), F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["score"] > r["base"] + 0.2 and r["s"] > r["b"]


def test_first_token_comes_after_an_end():
    stream, at = token_stream(pa.array(["a b", None, "a"]))
    keys = pair_keys(stream)
    assert list(at) == [0, 3, 4, 6] and stream[2] == END and keys[0] == keys[4] and len(keys) == 6


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], SCHEMA).withColumn("row", F.lit(1)).withColumn("token", F.lit("x"))
    got = BloomModel(docs).score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in got) == [(0, 2, 2), (1, 3, 3), (1, 3, 3)]
    nothing = BloomModel(docs.limit(0)).score(docs).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in nothing] == [(0, 0, 0.0)] * 3
    assert BloomModel(docs).score(docs.limit(0)).count() == 0
