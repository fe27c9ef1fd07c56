"""Lines as a stream: the same expressions over files as they come, windows with watermarks, Parquet as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokenizer import last_key_wins
from ..options import ScanOptions
from ..sources.reader import scan_lines


def stream_log(spark: SparkSession, folder: str, options: ScanOptions) -> DataFrame:
    """Typed rows of the files that appear in a folder. A stream's schema has to be given."""
    if not options.schema:
        raise ValueError("a stream needs a schema")
    last_key_wins(spark)
    return scan_lines(spark.readStream.option("lineSep", "\n").text(folder), options)


def count_by_window(rows: DataFrame, time: str, column: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by value and tumbling window; rows later than the watermark are left out, and its passing closes a window."""
    timed = rows.withColumn("_at", F.col(f"`{time}`").cast("timestamp")).withWatermark("_at", late)
    out = timed.groupBy(F.window("_at", window).alias("w"), F.col(f"`{column}`")).agg(F.count("*").alias("count"))
    return out.select(F.col("w.start").alias("window_start"), F.col(f"`{column}`"), "count")


def sink_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").trigger(availableNow=True).start()
