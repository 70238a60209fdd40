"""Scoring, de-duplication and running mosaics as granules land."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridscan.functions.stats import n_true


def read_arrivals(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def drop_redelivered(stream: DataFrame, key: Sequence[str], arrival: str = "arrival", delay: str = "1 day") -> DataFrame:
    """First delivery of each key within the watermark; state is bounded by the delay."""
    return stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(key))


def running_mosaic(stream: DataFrame, gi: Column, gj: Column, v: str) -> DataFrame:
    """Sum and count of valid passes per ground cell; state is one row per cell of the ground grid."""
    return stream.groupBy(gi.alias("gi"), gj.alias("gj")).agg(F.avg(v).alias("mean"), F.count(v).alias("passes"))


def windowed_keep_rate(stream: DataFrame, p: str, theta: float, arrival: str = "arrival", size: str = "1 day", slide: str | None = None,
                       delay: str = "1 day") -> DataFrame:
    w = F.window(arrival, size, slide) if slide else F.window(arrival, size)
    return stream.withWatermark(arrival, delay).groupBy(w.alias("w")).agg(
        F.count(p).alias("n"), n_true(F.col(p) >= theta).alias("kept"))


def append_to(stream: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = ()):
    """Exactly-once parquet sink for append queries."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        w = w.partitionBy(*partition)
    return w.trigger(availableNow=True).start()


def updates_to(stream: DataFrame, path: str, checkpoint: str):
    """Every update of an aggregate under its batch number.  A replayed batch overwrites its own folder."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Current state from the update log: the newest batch wins per key."""
    u = spark.read.parquet(path)
    rest = [c for c in u.columns if c not in key and c != "batch"]
    return u.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*key, "_s.*")


def run(query) -> None:
    """Drain what is available and surface a failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring (column expressions or a Spark ML transform) of arriving tiles."""
    return scorer(stream)
