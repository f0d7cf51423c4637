"""Source divergence audit: how the term frequencies of each source of a language differ from its other sources', and by which terms.

1. A pass over the texts counts terms for each language and source; a task adds
   up before it sends. What comes out are postings: a row for each term and
   group that has it. A language keeps the terms in ``least_docs`` of its documents.
2. *Terms a group has more of.* A group's terms of one count share the
   probability p, so a bucket of them is bounded by p less the smallest
   probability q that the language gives to one of them. Buckets are evaluated
   best first: those that hold the first ``top`` terms give the kth value so
   far, then the others unless their bound is strictly below it. The terms of all others are never evaluated.
3. *Pairs of sources.* The distance summed over all kept terms is that of the
   absent counts, plus for each side what its own terms change (a sum over its buckets, read off running sums), plus
   for terms that both have a correction from the postings. Sources are dealt in tiles, postings in
   blocks of terms, so a task holds a tile's sums and a block's postings; nothing is emitted for a pair and term.

All numbers are whole: probabilities are in units of 1e-9, rounded down, plus
one; products are taken in decimals or in Python's integers. Defined results: null text, lang and source read
as empty; a text without terms makes its group occur; a language that keeps no
term gives pairs of value 0 and no terms; repeated rows count each; ties are
broken by the item's UTF-8 bytes; very long texts count whole; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, table

UNIT, SMOOTH = 1_000_000_000, 5
#: Bytes of UTF-8 to what they count as: A-Z as a-z, a-z and all beyond ASCII as themselves, the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame, *, most: int = 400_000) -> DataFrame:
    """``docs`` (lang, source, text): lang, source, term, n (occurrences), docs; and a row with a null term for each group that occurs.

    A task keeps up to about ``most`` sums before it sends them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            """A batch for each group, its counts and documents in the same order."""
            while sums:
                (lang, source), (n, d) = sums.popitem()
                size = len(n) + 1
                term = pa.concat_arrays([pa.nulls(1, pa.binary()), pa.array(list(n), pa.binary())]).cast(pa.string())
                count = np.fromiter(chain([0], n.values()), np.int64, size)
                docs = np.fromiter(chain([0], map(d.__getitem__, n)), np.int64, size)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), term, pa.array(count), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            texts = batch["text"].cast(pa.large_string()).cast(pa.large_binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts):
                n, d = sums.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                # both are counted from plain iterables: counting from another counter is a loop in Python
                words = text.as_py().translate(TERM_BYTES).split()
                n.update(words)
                d.update(set(words))
                held += len(n) - before
                if held > most:
                    yield from sent()
                    held = 0
        yield from sent()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)), in decimals: exact for any counts."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, (total + SMOOTH * terms).cast("decimal(19,0)"))


class Audit:
    """The sums of one corpus: ``groups`` (lang, source, total, terms, base, at, tile) and ``postings`` (lang, source, term, n, p, q, base, at, tile), for kept terms."""

    def __init__(self, docs: DataFrame, *, least_docs: int = 30, tile: int = 128):
        self.spark, self.work = docs.sparkSession, Workspace(docs.sparkSession, "divergence")
        save = self.work.save
        counted = save(count_terms(docs), "counted")
        kept = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
        kept = save(kept.drop("docs"), "kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("of_lang"))
        held = save(counted.filter("term is not null").drop("docs").join(kept, ["lang", "term"]), "held")
        totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counted.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("of_lang", F.lit(0)).alias("of_lang"))
        groups = groups.withColumn("base", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0))
        numbered = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)  # a row for each source, not each document
        self.groups = save(numbered.withColumn("tile", F.floor(F.col("at") / tile)), "groups")
        p, q = probability(F.col("n"), F.col("total"), F.col("terms")), probability(F.col("in_lang"), F.col("of_lang"), F.col("terms"))
        self.postings = save(held.join(self.groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "base", "at", "tile"), "postings")
        self.tile = tile

    def top_terms(self, top: int = 50) -> DataFrame:
        """lang, source, item, value, rank: the ``top`` terms of each group that it has more of than its language."""
        group, save = ("lang", "source"), self.work.save
        buckets = self.postings.groupBy(*group, "n").agg(F.min("p").alias("p"), F.min("q").alias("least_q"), F.count("*").alias("held"))
        buckets = buckets.select(*group, "n", (F.col("p") - F.col("least_q")).alias("bound"), "held").filter("bound > 0")
        first = Window.partitionBy(*group).orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
        buckets = save(buckets.withColumn("seen", F.coalesce(F.sum("held").over(first), F.lit(0))), "buckets")
        value, of_group = (F.col("p") - F.col("q")).alias("value"), Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        evaluated = lambda which: self.postings.join(which.select(*group, "n"), [*group, "n"]).select(*group, F.col("term").alias("item"), value).filter("value > 0")
        best = lambda df: df.withColumn("rank", F.row_number().over(of_group)).filter(F.col("rank") <= top)
        early = save(best(evaluated(buckets.filter(F.col("seen") < top))), "early")
        kth = early.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        late = buckets.filter(F.col("seen") >= top).join(kth, [*group], "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        return best(early.drop("rank").union(evaluated(late)))

    def pairs(self, block: int = 100_000) -> DataFrame:
        """lang, source, item (each other source), value, rank."""
        save = self.work.save
        tiles = self.groups.groupBy("lang", "tile").agg(F.first("terms").alias("terms"))
        other = tiles.select(F.col("lang").alias("of"), F.col("tile").alias("tile_b"))
        # a row for each pair of tiles of a language, so for each tile * tile rows of the result
        met = save(tiles.join(other, F.col("lang") == F.col("of")).filter(F.col("tile") <= F.col("tile_b")).select("lang", F.col("tile").alias("tile_a"), "tile_b"), "tiles")

        def dealt(rows: DataFrame, *keys: str) -> DataFrame:
            """``rows`` at each pair of tiles that theirs is in."""
            asked = met.select(F.col("lang").alias("of"), "tile_a", "tile_b", F.explode(F.array_distinct(F.array("tile_a", "tile_b"))).alias("mine"))
            return rows.join(asked, (F.col("lang") == F.col("of")) & (F.col("tile") == F.col("mine"))).drop("of", "mine", "tile").groupBy("lang", "tile_a", "tile_b", *keys)

        size, out = self.tile, "lang string, a long, b long, value long"
        buckets = self.postings.groupBy("lang", "at", "p").agg(F.count("*").alias("held"))
        own = self.groups.select("lang", "at", "tile", "base", "terms").join(buckets, ["lang", "at"], "left").select("lang", "at", "tile", "base", "terms", "p", "held")
        blocks = max(1, -(-self.postings.count() // block))
        shared = self.postings.select("lang", "at", "tile", "term", "p", "base").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
        alone = dealt(own).applyInArrow(_alone(size), out)
        both = dealt(shared, "block").applyInArrow(_both(size), out)
        sums = alone.union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        way = lambda x, y: F.struct(F.col(x).alias("at"), F.col(y).alias("to"))
        each = sums.select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "value").select("lang", "e.*", "value")
        names = self.groups.select("lang", "at", "source")
        named = each.join(names, ["lang", "at"]).join(names.select("lang", F.col("at").alias("to"), F.col("source").alias("item")), ["lang", "to"])
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return named.select("lang", "source", "item", "value", rank.alias("rank"))


def _pairs(lang: str, at: tuple[int, int], sums: np.ndarray) -> pa.Table:
    """``sums`` [a, b] of two tiles that begin at ``at``: a row for each pair once."""
    a, b = np.nonzero(sums)
    keep = a + at[0] < b + at[1]
    a, b = a[keep], b[keep]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a + at[0], "b": b + at[1], "value": sums[a, b]})


def _alone(size: int):
    """Of two tiles: for each pair, what the absent counts and the terms of either side alone make.

    Each bucket of a source is set against the other's probability of an absent term; with the source's buckets in order that is read off running sums.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, ta, tb = (k.as_py() for k in key)
        bases, kept, lists = {}, 0, {}
        for at, base, terms, p, held in zip(*(rows[c].to_pylist() for c in ("at", "base", "terms", "p", "held"))):
            bases[at], kept = base, terms
            if p is not None:
                lists.setdefault(at, []).append((p, held))
        sides = [sorted(at for at in bases if at // size == t) for t in (ta, tb)]

        def change(one: int, others: list[int]) -> np.ndarray:
            """Sum over the terms of ``one`` of |p - base of the other| - |own base - base of the other|."""
            ys = np.array([bases[o] for o in others], np.int64)
            if one not in lists:
                return np.zeros(len(ys), np.int64)
            p, held = (np.array(x, np.int64) for x in zip(*sorted(lists[one])))
            n, s = np.concatenate([[0], np.cumsum(held)]), np.concatenate([[0], np.cumsum(held * p)])
            under = np.searchsorted(p, ys)
            away = ys * n[under] - s[under] + (s[-1] - s[under]) - ys * (n[-1] - n[under])
            return away - n[-1] * np.abs(bases[one] - ys)

        a, b = sides
        ya, yb = (np.array([bases[o] for o in side], np.int64) for side in sides)
        sums = kept * np.abs(ya[:, None] - yb[None, :])
        sums += np.array([change(one, b) for one in a]) + np.array([change(one, a) for one in b]).T
        i, j = np.meshgrid(a, b, indexing="ij")
        once = i < j
        return pa.table({"lang": pa.array([lang] * int(once.sum()), pa.string()), "a": i[once].astype(np.int64), "b": j[once].astype(np.int64), "value": sums[once]})

    return run


def _both(size: int):
    """Of two tiles and a block of terms: for each pair, what terms that both have change beyond ``_alone``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, ta, tb, _ = (k.as_py() for k in key)
        codes = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        at, p, base = (rows[c].to_numpy()[order] for c in ("at", "p", "base"))
        codes = codes[order]
        sums, mine, theirs = np.zeros((size, size), np.int64), at // size == ta, at // size == tb
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            i, j = np.flatnonzero(mine[lo:hi]) + lo, np.flatnonzero(theirs[lo:hi]) + lo
            pa_, ba, pb, bb = p[i][:, None], base[i][:, None], p[j][None, :], base[j][None, :]
            # a source is in a term's postings once, so no cell is addressed twice
            sums[np.ix_(at[i] - ta * size, at[j] - tb * size)] += np.abs(pa_ - pb) - np.abs(pa_ - bb) - np.abs(ba - pb) + np.abs(ba - bb)
        return _pairs(lang, (ta * size, tb * size), sums)

    return run


def audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank for ``docs`` (lang, source, text)."""
    found = Audit(docs, least_docs=least_docs)
    parts = (found.pairs().withColumn("part", F.lit("pair")), found.top_terms(top).withColumn("part", F.lit("term")))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return parts[0].select(*columns).union(parts[1].select(*columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same for DuckDB, with every term for every group.
OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words,
         row_number() OVER () AS doc FROM documents
), w AS (
  SELECT doc, lang, source, unnest(words) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS in_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 5) // (s.n + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.in_lang + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
), o AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL
), r AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM o
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
) WHERE part = 'pair' OR rank <= 50
"""
