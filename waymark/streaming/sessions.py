"""Sessions over a stream of fixes: event-time windows with a gap, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(fixes: DataFrame, gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """uid, t0, t1, n of each session; a stream's sessions are emitted once the watermark has passed them. ts is a timestamp."""
    rows = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    return rows.groupBy("uid", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("uid", F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n")


def from_files(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, as the table `name`."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
