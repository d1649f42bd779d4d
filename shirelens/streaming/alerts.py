"""Streaming alerts over tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import clip
from ..operators.incidents import surge, window_counts
from ..operators.scoring import alerts


def event_stream(spark: SparkSession, directory: str, schema: T.StructType, ts: str = "ts", glob: str = "*.parquet",
                 max_files: int = 100) -> DataFrame:
    """File stream with a zoned event time, which watermarks need."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
            .parquet(directory).withColumn(ts, F.col(ts).cast("timestamp")))


def closed_windows(events: DataFrame, key: str, ts: str, width: str, lateness: str, value: str | None = None) -> DataFrame:
    """Window counts under a watermark; in append mode a window is emitted once, when it closes."""
    return window_counts(events.withWatermark(ts, lateness), key, ts, width, value)


def window_alerts(counts: DataFrame, key: str, expected: float) -> DataFrame:
    """Alert rows of window counts: the risk is the count as a share of the expected one, the anomaly the peak value's."""
    scored = counts.withColumns({
        "risk_score": F.round(clip(F.col("n") / F.lit(expected) * 50.0, 0.0, 100.0), 2),
        "anomaly_score": F.round(clip(F.col("peak") / 100.0, 0.0, 1.0), 4),
        "crime_forecast": F.col("n").cast("double"),
    })
    return alerts(scored, key, keep=["window_start", "n"])


def start_window_sink(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet table, exactly once, for everything available now."""
    return (windows.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_alert_sink(windows: DataFrame, key: str, expected: float, path: str, checkpoint: str) -> StreamingQuery:
    """Alerts of closed windows.  Each batch writes its own sub-folder, so a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        window_alerts(batch, key, expected).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (windows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_surge_sink(windows: DataFrame, key: str, trailing: int, counts_path: str, surge_path: str, checkpoint: str) -> StreamingQuery:
    """Surge ratios against the counts before each window.

    A row-based frame needs earlier windows, which a stream does not keep; every batch leaves the last ``trailing`` counts of
    each key for the next one.  What a batch reads so depends on the number of keys, not on the length of the history,
    and a replayed batch finds what it found before.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{counts_path}/batch={batch_id}"
        counts = batch.withColumn("fresh", F.lit(True))
        if batch_id:
            counts = counts.unionByName(spark.read.schema(counts.schema).parquet(f"{counts_path}/batch={batch_id - 1}").withColumn("fresh", F.lit(False)))
        newest = W.partitionBy(key).orderBy(F.desc("window_start"))
        counts.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= trailing).drop("_r").write.mode("overwrite").parquet(own)
        rated = surge(counts, key, "window_start", "n", trailing).where("fresh").drop("fresh")
        rated.write.mode("overwrite").parquet(f"{surge_path}/batch={batch_id}")

    return (windows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
