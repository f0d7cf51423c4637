"""Target-distribution importance resampling: draws the documents whose word counts look most like a target text's.

1. Runs of words are hashed to a fixed number of buckets. One pass over the
   corpus and one over the target fill an array of counts each; a task sends
   its array once, so what is shuffled doesn't grow with the texts.
2. A bucket's gain is its log ratio of target to corpus; the gains are one
   array of that fixed length, and a second pass scores each document from it
   (the mean gain of its runs) and adds Gumbel noise made from its id, which
   turns "the highest scores" into a draw without replacement.
3. Scores are whole numbers in a range that doesn't grow with the data (gains
   are bounded by the largest count's logarithm), so an exact histogram of them
   is small. Its sums from the top give the rank at which each score begins and
   the score at which the draw ends; only documents at or above that one
   are sorted, each score for itself, by id. Documents alike in all that is returned are counted, not sorted:
   an id that a third of all rows have is one entry for each input partition.

Defined results: a null or empty text has no runs and weight 0; a text of fewer
words than a run has none either, but its words count towards ``least_words``;
repeated rows are documents of their own and draw alike, ranks stay gapless;
ties go to the smaller id, null ids last; a null id hashes as the empty string;
very long texts count whole; an empty corpus gives an empty result, an empty
target no documents' preference but the corpus's rarity; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, table

#: Bytes of UTF-8 to what they count as: A-Z as a-z, digits, a-z and all beyond ASCII as themselves, the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def run_hashes(text: bytes, n: int) -> tuple[np.ndarray, int]:
    """crc32 of every run of 1 to ``n`` words joined by one space, and the number of words."""
    words = text.translate(WORD_BYTES).split()
    hashes = longer = [crc32(w) for w in words]
    for size in range(2, n + 1):
        # a run is the run without its last word, a space, that word
        longer = [crc32(w, crc32(b" ", h)) for h, w in zip(longer, words[size - 1 :])]
        hashes = hashes + longer
    return np.array(hashes, np.int64), len(words)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """UTF-8 of each text, null as empty, one after another."""
    for value in batch[column].cast(pa.large_string()).cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(texts: DataFrame, *, text: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many runs of all texts fall into each bucket: ``buckets`` numbers, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in _texts(batch, "text"):
                total += np.bincount(run_hashes(t, n)[0] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    got = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share of the target to its share of the corpus, with one more run in each bucket."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, by_bucket: np.ndarray, *, id_col: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """id, n_words, n_features (runs) and weight (mean gain of the runs, rounded down) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            rows = []
            for t in _texts(batch, "text"):
                hashes, words = run_hashes(t, n)
                rows.append((words, len(hashes), int(gain[hashes % len(gain)].sum()) // len(hashes) if len(hashes) else 0))
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate made from the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, work: Workspace, *, percent: int) -> DataFrame:
    """``scored`` (id, n_words, n_features, weight, score, eligible, part) with ``rank``: 1, 2, ... for the drawn, else null.

    ``part`` is a number of the row's input partition: it keeps what is counted as one no larger than a partition.
    """
    histogram = scored.filter("eligible").groupBy("score").count().toArrow().to_pydict()
    levels = sorted(zip(histogram["score"], histogram["count"]), reverse=True)
    wanted, begins, above = percent * sum(n for _, n in levels) // 100, [], 0
    for score, n in levels:  # a row for each score, in a range that the data don't widen
        if above >= wanted:
            break
        begins.append((score, above))
        above += n
    columns = [c for c in scored.columns if c != "part"]
    undrawn = lambda df: df.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not begins:
        return undrawn(scored)
    offsets = work.spark.createDataFrame(begins, "at long, before long")
    high = F.col("eligible") & (F.col("score") >= begins[-1][0])
    alike = scored.filter(high).groupBy(*scored.columns).agg(F.count("*").alias("n"))
    by_id = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_words", "n_features", "part")
    placed = alike.withColumn("place", F.sum("n").over(by_id.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ranked = placed.join(F.broadcast(offsets), F.col("score") == F.col("at"))
    each = ranked.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("rank", F.col("before") + F.col("place") + F.col("nth"))
    drawn = each.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.union(undrawn(scored.filter(~high)))


def resample(docs: DataFrame, targets: list[DataFrame], *, id_col: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of each of ``docs``: the draw of ``percent`` of those with ``least_words`` words."""
    work = Workspace(docs.sparkSession, "importance")
    target = reduce(add, (bucket_counts(t, text=text, n=n, buckets=buckets) for t in targets))
    by_bucket = gains(bucket_counts(docs, text=text, n=n, buckets=buckets), target)
    scored = weights(docs, by_bucket, id_col=id_col, text=text, n=n)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    return draw(work.save(scored.withColumn("part", F.spark_partition_id()), "scored"), work, percent=percent).withColumnRenamed("id", id_col)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), [table(spark, sf_dir, "benchmark")])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The same for DuckDB, which has no crc32: the table of its 256 remainders, then a byte at a time over each different word.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), w AS (
  SELECT doc_id, unnest(words) AS word FROM d
), x AS (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(1, length(hex(encode(word))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT word FROM w UNION SELECT word FROM b), crc
), s AS (
  SELECT bucket, count(*) AS s FROM w JOIN x USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN x USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), f AS (
  SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN x USING (word) JOIN g USING (bucket) GROUP BY doc_id
), o AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(f.weight, 0) AS weight,
    coalesce(f.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN f USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20
)
SELECT o.doc_id, o.n_features, o.weight, o.score, CASE WHEN r.rank <= 10 * r.n // 100 THEN r.rank END::BIGINT AS rank FROM o LEFT JOIN r USING (doc_id)
"""
