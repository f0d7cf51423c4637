import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm.divergence import Audit, audit, probability

SCHEMA = "lang string, source string, text string"


def brute(rows, least_docs, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, lang_n, df = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((x or "" for x in r) for r in rows):
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low)))
        n[lang, source].update(terms)
        lang_n[lang].update(terms)
        df[lang].update(terms.keys())
    out = []
    for lang, source in n:
        kept = [t for t, d in df[lang].items() if d >= least_docs]
        v = len(kept)

        def shares(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        mine, whole = shares(n[lang, source]), shares(lang_n[lang])
        pairs = [(sum(abs(mine[t] - q) for t, q in shares(n[lang, o]).items()), o) for l, o in n if l == lang and o != source]
        terms = [(mine[t] - whole[t], t) for t in kept if n[lang, source][t] and mine[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else top]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def corpus(seed, n=150, sources=5, words=60):
    rng = random.Random(seed)
    every = [f"{a}{b}" for a in ("Al", "be", "ç", "東", "z", "of", "é", "q") for b in ("", "a", "ü", "京", "ot", "RR", "s", "x")][:words]
    rows = []
    for _ in range(n):
        source = rng.randrange(sources)
        own = every[source * 3 :]
        rows.append((rng.choice(["en", "fr"]), f"s{source}", " ".join(own[int(len(own) * rng.random() ** 2)] for _ in range(rng.randrange(30)))))
    return rows + [("en", "s1", "same text here is alpha " * 40)] * 20 + [(None, None, None), ("", "é", "1 2 3"), ("en", "empty", ""), ("de", "a", "one"), ("de", "b", "two"), ("fr", None, "Al " * 100_000)]


@pytest.mark.parametrize(("seed", "least_docs", "top", "tile"), [(1, 30, 50, 128), (2, 3, 4, 2), (3, 1, 1, 1), (4, 8, 3, 3)])
def test_rows_are_those_of_brute_force(spark, seed, least_docs, top, tile):
    rows = corpus(seed, sources=4 + seed)
    found = Audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least_docs=least_docs, tile=tile)
    got = found.pairs(block=20).withColumn("part", F.lit("pair")).unionByName(found.top_terms(top).withColumn("part", F.lit("term")))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, least_docs, top)


def test_buckets_below_the_kth_value_are_not_evaluated(spark):
    rows = corpus(2, n=400, sources=6, words=64)
    found = Audit(spark.createDataFrame(rows, SCHEMA), least_docs=1)
    found.top_terms(2).count()
    buckets = spark.read.parquet(f"{found.work.path}/buckets")
    assert buckets.filter("seen >= 2").count() > buckets.filter("seen < 2").count()


def test_counts_beyond_64_bits_are_exact(spark):
    n = [(10**12, 3 * 10**12, 10**6), (0, 0, 1), (7, 11, 2)]
    got = spark.createDataFrame(n, "n long, total long, terms long").select(probability(F.col("n"), F.col("total"), F.col("terms"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (a + 5) // (b + 5 * v) for a, b, v in n]


def test_empty_table_and_clashing_columns(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(*r, "x", 1, 2.0) for r in corpus(5, n=40)]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, term string, n long, p double")
    assert sorted(map(tuple, audit(frame, least_docs=2).collect())) == brute([r[:3] for r in rows], 2, 50)
