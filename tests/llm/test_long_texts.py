import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import language_id, mixing, quality_rules, sharding, words
from seqloom.llm.workspace import Workspace, word_count

LONG = "wörd and more " * 150_000


def test_words_longer_than_a_slab():
    long = "x" * ((1 << 20) + 500)
    hashes, at = words.word_hashes(pa.array([f"a {long} b", long, long[:-1], f" {long}"]))
    assert list(at) == [0, 3, 4, 5, 6]
    assert hashes[1] == hashes[3] == hashes[5] != hashes[4] and len({int(h) for h in hashes}) == 4
    [short, same] = words.shingle_sets(pa.array(["a b c d e f", LONG]))
    assert len(short) == 2 and len(same) == 3


def test_sharding_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG), (3, "a"), (4, "b"), (5, None)], "doc_id long, text string").withColumn("size", F.lit("x"))
    got = {r["doc_id"]: r for r in sharding.shard(docs, shards=3).collect()}
    assert got[1]["shard"] == got[2]["shard"] and got[1]["size"] == len(LONG.encode()) + 1 and got[1]["text_crc32"] == zlib.crc32(LONG.encode())
    assert {got[3]["shard"], got[4]["shard"]}.isdisjoint({got[1]["shard"]})


def test_statistics_words_and_languages_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    r = quality_rules.with_stats(docs).select(*quality_rules.STATS, word_count(F.col("text")).alias("w")).first()
    assert r["n_words"] == r["w"] == r["n_repeat_words"] == 450_000
    assert len(language_id.slots_of(LONG, 1 << 12)) > 1_000_000


def test_a_very_long_document_and_ties_in_the_mix(spark):
    docs = spark.createDataFrame([(1, "a", 450_000), (1, "a", 450_000), (2, "a", 10), (3, None, 0), (None, "b", 5), (None, "b", 5)], "doc_id long, source string, words long").withColumn("key", F.lit(1))
    got = mixing.mix(docs, size=F.col("words"), quality=F.lit(1.0)).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(3), size=F.col("words"), quality=F.lit(1.0)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_closed_workspace_leaves_nothing(spark):
    work = Workspace(spark, "closed")
    work.save(spark.range(3), "a")
    path = work.path.removeprefix("file://")
    import os

    assert os.path.isdir(path)
    work.close()
    assert not os.path.exists(path) and np.isfinite(1)
