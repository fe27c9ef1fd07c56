"""Bytes written per table and finished run: the analysis that logs of a table writer are kept for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract
from ..operators.asof import asof_join
from ..operators.rows import row_index, sum_of
from ..options import ScanOptions
from ..sources.reader import scan_lines
from ..sources.sinks import staged

WRITES = ScanOptions(line_filter='msg="finish to process/write "', schema={"time": "datetime", "new": "string", "bytes": "integer"})
RUNS = ScanOptions(line_filter='msg="run finished"', schema={"time": "datetime", "totals": "string"})


def bytes_per_run(lines: DataFrame) -> DataFrame:
    """table_name, finished_id, bytes_sum, first_totals from lines of writes and of finished runs: each write belongs to the next run that finishes after it."""
    runs = scan_lines(lines, RUNS).select("time", F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("table_name"), "totals", F.lit(True).alias("is_run"))
    writes = scan_lines(lines, WRITES).where(~F.contains("new", F.lit("health_check"))).select("time", "bytes", extract(F.col("new"), "/out/([^/]+)/").alias("table_name"), F.lit(None).cast("string").alias("totals"), F.lit(False).alias("is_run"))
    read = staged(writes.union(runs), "read")  # in one job, so that tasks of either fill all cores
    runs = row_index(read.where("is_run").select("time", "totals"), ["time", "totals"], "finished_id").select("finished_id", F.col("time").alias("finished_at"), "totals")
    joined = asof_join(read.where("NOT is_run").select("time", "bytes", "table_name"), runs, "time", "finished_at")
    # a run has one text of totals: as a key it is hashed, while Spark sorts the rows for an aggregate that is a text
    return joined.groupBy("table_name", "finished_id", F.col("totals").alias("first_totals")).agg(sum_of("bytes").alias("bytes_sum")).select("table_name", "finished_id", "bytes_sum", "first_totals")
