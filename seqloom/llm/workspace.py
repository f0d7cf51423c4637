"""Where operators keep intermediate tables: a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of the gaps between words: space, tab, LF, VT, FF, CR.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where a local session sets none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file:///tmp/checkpoints"
    spark.sparkContext.setCheckpointDir(own)
    return own


class Workspace:
    """Named Parquet tables in the shared folder; they go when dropped, or when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm, jsc = self.spark._jvm, self.spark._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, which also cuts its lineage."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark drop the shuffle files of finished steps now: it does so when the driver's JVM finds that nothing refers to them."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()

    def close(self) -> None:
        """Remove all of its tables; results that still read them can't be computed afterwards."""
        self._remove(self.path)
        atexit.unregister(self._remove)

    def drop(self, name: str) -> None:
        self._remove(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def drop_others(self, *names: str) -> None:
        """Remove all tables but those named: what a finished step leaves."""
        with contextlib.suppress(Exception):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            for found in place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place):
                if found.getPath().getName() not in names:
                    self.drop(found.getPath().getName())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of maximal runs without gap characters; null counts 0."""
    pieces = F.size(F.split(text, GAP))
    ends = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(pieces - ends, F.lit(0))).cast("long")


def row_key(docs: DataFrame) -> Column:
    """64 bits of all columns that can be hashed: rows of one key are copies in all of them."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
