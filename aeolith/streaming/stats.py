"""Event-time statistics: each window of a site once its watermark has passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aeolith.functions.scaling import clean


def windowed_stats(stream: DataFrame, dataset: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None, gid: str = "gid", ts: str = "ts", median: bool = False) -> DataFrame:
    """gid, start, n, mean, min, max and std of a population; NaN is passed over, rows later than ``late`` are dropped.

    With ``median`` also the exact median: the counts of a window's values are kept as
    state until its watermark has passed.
    """
    x = clean(F.col(dataset).cast("double"))
    rows = stream.select(F.col(gid).alias("gid"), F.col(ts).cast("timestamp").alias("ts"), x.alias("x")).withWatermark("ts", late)
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = rows.groupBy("gid", frame.alias("w")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.stddev_pop("x").alias("std"), *([F.median("x").alias("median")] if median else []))
    return out.select("gid", F.col("w.start").alias("start"), *out.columns[2:])


def upserted(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps each batch's changed windows under ``path`` until all input there is has been read.

    A batch has a folder of its own, which a repetition after a failure writes again, so
    every change counts once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stats.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str] = ("gid", "start")) -> DataFrame:
    """The last state of each window."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
