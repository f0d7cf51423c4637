import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from seqloom.llm.importance import resample

SCHEMA = "doc_id long, text string"


def brute(docs, target, n, buckets, least_words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for _, text in rows for b in runs(text)[1]) for rows in (docs, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in docs:
        words, got = runs(text)
        weight = sum(map(gain, got)) // len(got) if got else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
    wanted = percent * len(may) // 100
    return sorted([(*r, k + 1) for k, r in enumerate(may[:wanted])] + [(*r, None) for r in may[wanted:]] + [(*r, None) for r in out if r[1] < least_words], key=str)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 35), (3, 7, 100)])
def test_draw_is_that_of_brute_force(spark, n, buckets, percent):
    rng = random.Random(n)
    text = lambda: " ".join(rng.choice(["Alpha", "beta", "ga-mma", "Ünder", "東京", "x1", "é", "IT'S"]) for _ in range(rng.randrange(40)))
    docs = [(i, text()) for i in range(80)] + [(5, "same words here " * 9)] * 30 + [(None, "no id " * 12)] * 7 + [(300, None), (301, ""), (302, "--- !"), (303, "Beta " * 50_000)]
    target = [(1, "alpha beta x1 x1"), (2, None), (3, text())]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5).withColumn("score", F.lit("x")).withColumn("part", F.lit(2)).withColumn("at", F.lit(1))
    got = resample(frame, [spark.createDataFrame(target, SCHEMA)], n=n, buckets=buckets, percent=percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str) == brute(docs, target, n, buckets, 20, percent)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c " * 10), (2, "c d " * 20)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resample(none, [docs]).count() == 0
    assert sorted(r["rank"] for r in resample(docs, [none], percent=100).collect()) == [1, 2]
    assert [r["rank"] for r in resample(docs, [none], percent=1).collect()] == [None, None]
