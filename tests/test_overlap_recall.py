from pyspark.sql import functions as F

from seqloom import catalog
from seqloom.operators import sequences as sq
from seqloom.operators.align import EnvelopeConfig, null_model, overlap

SF = "/root/testdata/sf0.01"


def test_seeded_overlaps_find_what_all_pairs_find(spark):
    """Recall of the candidates from the k-mer join, against every pair: reads of a dozen items and their reverse complements."""
    some, n = catalog.overlapping_reads(spark, SF)
    few = some.filter(F.col("idx") < 24).withColumn("seq", F.substring("seq", 1, 110)).withColumn("qual", F.substring("qual", 1, 110)).cache()
    null = null_model(few)
    bare = sq.with_revcomps(few.withColumn("qual", F.lit(None).cast("string")), n).cache()
    config = EnvelopeConfig(threshold=14, band=20)
    key = lambda df: {(r["x_idx"], r["y_idx"]): r["score"] for r in df.collect()}
    every, seeded = key(overlap(bare, n, null=null, config=config)), key(overlap(bare, n, null=null, config=config, require_seed=True))
    assert len(every) >= 10
    found = [p for p in every if p in seeded and seeded[p] >= every[p] - 1e-6]
    assert len(found) >= 0.9 * len(every), (len(found), len(every))
    print("recall", len(found), len(every))
