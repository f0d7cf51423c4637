"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by weight, capped at ``max_epochs`` times
its own words; the excess goes to the others by weight (water-filling, solved
in closed form over sources sorted by cap/weight). A source first takes whole
epochs; what remains is a prefix of its documents in ascending order of the
exponential keys ``-ln(u) / quality``. The prefix sums are found in three steps,
over blocks of key ranges, over ranges and inside each range, so a source that
holds a third of all rows is dealt over many tasks.

Keys come from md5 of the id and the seed: reruns agree. Defined results: a
null text or a text without words has size 0 and is taken with its range;
repeated rows are documents of their own (ties in the order are broken by key,
id and size; equal rows are interchangeable and counted together); a null source is a source, last
in order; a null id hashes as the empty string; a null or non-positive quality
counts as 1; very long texts count by all their words; further columns are not looked at, or kept by the
pipeline's stage; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, row_key, table, word_count


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from the id: 52 bits of an md5."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sources: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with weight and target. One row a source: windows over this table are small.

    Shares are level * weight; the level at which every share is inside its cap is found among the
    sources in order of cap / weight: those before the first that isn't full are held at their caps.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    named = sources.withColumn("w", F.element_at(F.lit([float(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    capped = named.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_cap = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)["level"]
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(final * F.col("w"), F.col("cap")))).select("source", "source_size", F.col("w").alias("weight"), "target")


def ranged_rows(docs: DataFrame, *, size: Column, quality: Column, work: Workspace | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 8, rows_per_range: int = 500) -> DataFrame:
    """A row for each id, source and size: id, source, size, key, n (documents alike in these) and range, which grows with the key."""
    work = work or Workspace(docs.sparkSession, "mixing")
    good = F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), (-F.log(uniform(F.col(id_col), seed)) / good).alias("key"), good.alias("quality"))
    # documents alike are interchangeable: counted, so that an id that very many have is a few rows
    rows = work.save(rows.groupBy("source", "id", "size", "key").agg(F.first("quality").alias("quality"), F.count("*").alias("n")), "rows")
    ranges = max(1, -(-rows.count() // rows_per_range))
    # key * quality is exponential, so the share of keys below one is the mean of 1 - exp(-key * quality) over the qualities:
    # ranges of that hold like numbers of rows (any growing function of the key is right, so the commonest qualities do)
    kinds = rows.groupBy("quality").count().orderBy(F.desc("count"), "quality").limit(64).collect()
    everyone = sum(r["count"] for r in kinds) or 1
    below = sum((F.lit(r["count"] / everyone) * (1 - F.exp(-F.col("key") * F.lit(r["quality"]))) for r in kinds), F.lit(0.0))
    return rows.drop("quality").withColumn("range", F.floor(below * ranges).cast("long"))


def mix_groups(docs: DataFrame, *, size: Column, quality: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 8, rows_per_range: int = 500) -> DataFrame:
    """A row for each id, source and size: id, source, size, n (documents alike in these), source_size, target, epochs, extra (how many of the n are taken once more)."""
    work = Workspace(docs.sparkSession, "mixing")
    ranged = ranged_rows(docs, size=size, quality=quality, work=work, id_col=id_col, source_col=source_col, seed=seed, rows_per_range=rows_per_range)
    words = F.col("size") * F.col("n")
    by_source = work.save(targets(ranged.groupBy("source").agg(F.sum(words).alias("source_size")), weights=weights, max_epochs=max_epochs), "sources")
    sums = ranged.groupBy("source", "range").agg(F.sum(words).alias("in_range")).withColumn("block", F.floor(F.col("range") / 1024))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda what, *by: F.coalesce(F.sum(what).over(upto(*by)), F.lit(0).cast("long"))
    blocks = sums.groupBy("source", "block").agg(F.sum("in_range").alias("in_block"))
    blocks = blocks.select(F.col("source").alias("bs"), F.col("block").alias("bb"), before("in_block", "source", "block").alias("in_blocks"))
    bases = sums.withColumn("in_ranges", before("in_range", "source", "block", "range")).join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
    bases = bases.join(by_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    bases = bases.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("in_blocks") + F.col("in_ranges")).alias("base"), "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("run", F.coalesce(F.sum(words).over(inside), F.lit(0).cast("long")))
    full = run.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    over, start = F.col("target") - F.col("epochs") * F.col("source_size"), F.col("base") + F.col("run")
    # the middle of the document lies before the budget's end: the prefix that comes nearest
    chosen = (start + F.col("size") / 2.0 <= over) & (over > 0) & (F.col("epochs") < max_epochs)
    fit = F.when(F.col("size") > 0, F.floor((over - start - F.col("size") / 2.0) / F.col("size")) + 1).otherwise(F.col("n"))
    out = full.withColumn("epochs", epochs).withColumn("extra", F.when(chosen, F.greatest(F.lit(1), F.least(F.col("n"), fit))).otherwise(0).cast("long"))
    return out.select("id", "source", "size", "n", "source_size", "target", "epochs", "extra")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """One row a document: id, source, size, source_size, target, epochs, copies (how often the mix holds it), taken."""
    groups = mix_groups(docs, id_col=id_col, source_col=source_col, **how)
    each = groups.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = each.withColumn("copies", F.col("epochs") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def label_quality(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Weight 2 for a document labelled good, 1/2 for one labelled bad; others have none (1)."""
    grouped = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg("quality").alias("__q"))
    return grouped.select("__id", F.when(F.col("__q") > 0.5, 2.0).when(F.col("__q") < 0.5, 0.5).otherwise(1.0).alias("__quality"))


def slim(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size and quality: texts stay behind before anything is shuffled."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("__size"))
    return rows.join(label_quality(labels), rows["doc_id"] == F.col("__id"), "left").drop("__id")


def repeat_taken(docs: DataFrame, labels: DataFrame, *, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` as often as the mix takes them: rows repeat for whole epochs, and those not taken go.

    Rows that share an id are told apart by source and size. Where the budget ends among rows alike in these (once
    a source at most), the rest goes to those with the least hashes of all columns. The texts are read in one
    narrow pass while the choice fits a broadcast of ``broadcast_rows``, else joined once.
    """
    work, key = Workspace(docs.sparkSession, "repeat"), ("__id", "__source", "__words")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    groups = mix_groups(slim(docs, labels), size=F.col("__size"), quality=F.coalesce(F.col("__quality"), F.lit(1.0)))
    groups = groups.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words"), "n", "epochs", "extra").filter("epochs + extra > 0")
    groups = work.save(groups.withColumn("parted", (F.col("extra") > 0) & (F.col("extra") < F.col("n"))), "groups")
    rows = docs.withColumn("__size", word_count(F.col("text")))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words"))
    whole = F.col("epochs") + F.when((F.col("extra") > 0) & ~F.col("parted"), 1).otherwise(0)
    repeated = lambda df, times: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)
    taken = groups.filter((F.col("epochs") > 0) | ~F.col("parted")).select(*key, whole.alias("__times"))
    out = repeated(rows.join(small(taken), same).filter("__times > 0"), F.col("__times"))
    parted = groups.filter("parted").select(*key, "extra")
    if parted.isEmpty():
        return out
    # rows alike by the hash of all columns, in ranges of hashes whose sums come first: no range holds more than a small share
    hashed = rows.withColumn("__row", row_key(docs)).join(small(parted), same)
    classes = hashed.groupBy(*key, "extra", "__row").agg(F.count("*").alias("m")).withColumn("range", F.shiftright("__row", 54))
    classes = work.save(classes, "classes")
    upto = lambda *by: Window.partitionBy(*key, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = classes.groupBy(*key, "range").agg(F.sum("m").alias("in_range"))
    base = sums.select(*(F.col(c).alias(f"{c}_of") for c in (*key, "range")), F.coalesce(F.sum("in_range").over(upto("range")), F.lit(0)).alias("base"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*key, "range")]
    placed = classes.withColumn("run", F.coalesce(F.sum("m").over(upto("range", "__row")), F.lit(0))).join(base, on)
    rest = F.least(F.col("m"), F.col("extra") - F.col("base") - F.col("run"))
    rest = work.save(placed.select(F.col("__row").alias("__of"), "m", rest.alias("rest")).filter("rest > 0"), "rest")
    hashed = rows.withColumn("__row", row_key(docs)).join(small(rest), F.col("__row") == F.col("__of"))
    # copies in all columns are interchangeable: one of them stands for those of the class where not all are taken
    some = hashed.filter("rest < m").dropDuplicates(["__row"])
    return out.union(hashed.filter("rest = m").select(*docs.columns)).union(repeated(some, F.col("rest")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slim(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    mixed = mix(rows, size=F.col("__size"), quality=F.coalesce(F.col("__quality"), F.lit(1.0)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same for DuckDB.
OP8_SQL = r"""
WITH q AS (
  SELECT doc_id, CASE WHEN avg(quality) > 0.5 THEN 2.0 WHEN avg(quality) < 0.5 THEN 0.5 ELSE 1.0 END AS quality FROM labels GROUP BY doc_id
), d AS (
  SELECT documents.doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         -ln((('0x' || substr(md5(documents.doc_id::VARCHAR || ':8'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(q.quality, 1.0)::DOUBLE AS key
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source
), l AS (
  SELECT *, 3.0 * source_size::DOUBLE AS cap,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0 * source_size::DOUBLE) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM s WINDOW b AS (ORDER BY 3.0 * source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, epochs + CASE WHEN run::DOUBLE + size / 2.0 <= target - epochs * source_size AND target - epochs * source_size > 0 AND epochs < 3 THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM c
"""
