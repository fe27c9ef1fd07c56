"""python -m logloom.cli --source app.log [--agg count,count_by:level] [--agg-filter 'msg~finish'] [--out [FILE]]

--out writes the scan as zstd Parquet, beside the source if no path is given; --streaming counts files of a folder as a stream.
"""

from __future__ import annotations

import argparse
import os
import uuid

from pyspark.sql import SparkSession

from .operators.filters import filter_rows
from .operators.rows import aggregate
from .options import ScanOptions
from .plans.schema import kinds_of_frame
from .sources.paths import KEY, PASSWORD
from .sources.reader import scan_log
from .sources.sinks import parquet_path, write_parquet
from .streaming.logs import stream_log


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom", description=__doc__)
    p.add_argument("--source", required=True, help="a path, or ssh://user@host[:port]/path")
    p.add_argument("--cmd", help="command to run on the other host")
    p.add_argument("--line-filter", help="text that a raw line must hold")
    p.add_argument("--batch-size", type=int, default=1000)
    p.add_argument("--preview-rows", type=int, default=5)
    p.add_argument("--key-path", help="private key for ssh")
    p.add_argument("--password", help="password for ssh, or of the key")
    p.add_argument("--agg", default="count", help="count, count_by:COLUMN, bytes_sum:COLUMN, with commas between")
    p.add_argument("--agg-filter", help="key=value, key!=value, key~part, key!~part")
    p.add_argument("--infer-schema-length", type=int, default=1)
    p.add_argument("--aligned", action="store_true", help="columns of the first line; null where missing")
    p.add_argument("--streaming", action="store_true", help="read a folder's files one after another as a stream, and aggregate what has come")
    p.add_argument("--out", nargs="?", const="", help="Parquet path")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    given = {name: value for name, value in ((KEY, a.key_path), (PASSWORD, a.password)) if value}
    os.environ.update(given)  # for the driver; executors get them as their environment
    if spark is None:
        conf = {"spark.sql.session.timeZone": "UTC", **{f"spark.executorEnv.{name}": value for name, value in given.items()}}
        spark = SparkSession.builder.appName("logloom").config(map=conf).getOrCreate()
    options = ScanOptions(line_filter=a.line_filter, cmd=a.cmd, batch_size=a.batch_size, infer_schema_length=a.infer_schema_length, aligned_cols_cnt=a.aligned)
    df = scan_log(spark, a.source, options)
    if a.streaming:
        stream = stream_log(spark, a.source, options.but(schema=kinds_of_frame(df)))
        for name, result in aggregate(filter_rows(stream, a.agg_filter), a.agg).items():
            print(name)
            table = f"streamed_{uuid.uuid4().hex}"
            result.writeStream.format("memory").queryName(table).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
            spark.table(table).show(truncate=False)
        return 0
    df = filter_rows(df, a.agg_filter)
    if a.preview_rows:
        df.show(a.preview_rows, truncate=False)
    for name, result in aggregate(df, a.agg).items():
        print(name)
        result.show(truncate=False)
    if a.out is not None:
        print(write_parquet(df, a.out or parquet_path(a.source), mode="overwrite"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
