"""Alignment of a stream of reads, with Structured Streaming.

``align`` looks at each read by itself, so a stream is aligned batch by batch;
the null model is fixed beforehand, as one fitted on a batch would give a read
another score in another batch. Overlaps and training need all reads and stay
batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import align
from ..plans.model import NullModel

READS = "idx long, name string, seq string, qual string"


def stream_reads(spark: SparkSession, folder: str, *, files_per_batch: int = 100) -> DataFrame:
    """Reads (READS) from Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def align_stream(reads: DataFrame, refs: DataFrame, sink: Callable[[DataFrame, int], None], *, null: NullModel, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Start aligning ``reads``; ``sink`` gets the alignments of each batch and its number.

    A batch that fails is given to ``sink`` again under the same number, so a sink that
    overwrites by number (see ``parquet_sink``) keeps each alignment once. Reads without
    bases are left out. ``options`` are those of ``align``.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(align(batch.filter(F.length("seq") > 0), refs, null=null, **options), number)

    started = reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if available_now else started).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, named by the batch's number."""

    def write(alignments: DataFrame, number: int) -> None:
        alignments.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
