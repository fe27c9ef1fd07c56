"""Scans: lines of text become typed rows by Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenizer import last_key_wins, parse_map, raw_map, unescaped, unquote
from ..functions.values import typed
from ..options import ScanOptions
from ..plans import schema as schemas
from .datasource import kinds_of, register
from .sinks import staged
from .units import UnitSource, unit_lines


def accept(options: ScanOptions, column: str = "value") -> Column | None:
    """The line filter as a condition on the raw line (with its newline), if there is one."""
    if options.line_filter is None:
        return None
    line = F.concat(F.col(column), F.lit("\n")) if isinstance(options.line_filter, str) and "\n" in options.line_filter else F.col(column)
    return F.contains(line, F.lit(options.line_filter)) if isinstance(options.line_filter, str) else options.line_filter(F.col(column))


def once(value: Column) -> Column:
    """The same value, computed where it stands: Catalyst neither moves a filter below it nor repeats it in one, as it would with the tokenizer's regular expressions."""
    return F.when(F.spark_partition_id() >= 0, value)


def scan_lines(lines: DataFrame, options: ScanOptions | None = None, column: str = "value") -> DataFrame:
    """Typed rows of a column of lines.

    Blank lines are left out; the line filter works on the text before anything is parsed; every line is tokenised once, and only
    columns that are used are unquoted and cast. Columns stand in order of their keys.
    """
    options = options or ScanOptions()
    last_key_wins(lines.sparkSession)
    schema = options.schema or schemas.infer(lines, 1 if options.aligned_cols_cnt and options.infer_schema_length is None else options.infer_schema_length, accept(options, column), options.compat, column)
    rows = lines.select(once(F.col(column)).alias(column)).where(F.col(column).rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows if options.line_filter is None else rows.where(accept(options, column))
    if options.row_filter is not None:
        rows = rows.where(options.row_filter(parse_map(F.col(column), options.compat)))
    if options.n_threads:
        rows = rows.coalesce(options.n_threads)
    rows = rows.select(once(raw_map(F.col(column))).alias("_raw"))
    names = schemas.in_order(schema)
    rows = rows.select(*(F.try_element_at("_raw", F.lit(n)).alias(n) for n in names))
    value = lambda n: unquote(F.col(f"`{n}`"), options.compat)
    rows = rows.select(*((unescaped(value(n)) if options.unescape else value(n)).alias(n) for n in names))
    return rows.select(*(typed(F.col(f"`{n}`"), schema[n], options.fill).alias(n) for n in names))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file's lines, split at newlines only. Spark splits plain files into tasks; zstd files come by frame."""
    if path.endswith(".zst") or path.startswith("ssh://"):
        register(spark)
        return spark.read.format("logfmt").option("raw", "true").load(path)
    return spark.read.option("lineSep", "\n").text(path)


def scan_log(spark: SparkSession, source: str | Sequence[str], options: ScanOptions | None = None) -> DataFrame:
    """Typed rows of a file: local or in any store that Spark reads, over ssh, plain or zstd. Several files, of one kind, are given as a list; the first with text has the schema."""
    if not isinstance(source, str):
        options = options or ScanOptions()
        frames = [text_lines(spark, s) for s in source]
        return scan_lines(reduce(DataFrame.union, frames), options)
    options = options or ScanOptions()
    if options.cmd and not source.startswith("ssh://"):
        raise ValueError(f"cmd needs an ssh:// source, not {source}")
    if options.cmd:
        register(spark)
        lines = spark.read.format("logfmt").option("raw", "true").option("options", ScanOptions(cmd=options.cmd).to_json()).load(source)
        if not options.schema:  # a command runs once: what its schema is inferred from is what is scanned
            lines = staged(lines, "command")
    else:
        if (source.endswith(".zst") or source.startswith("ssh://")) and not options.schema and not callable(options.line_filter):
            options = options.but(schema=kinds_of(source, options))  # the first lines are read here, without a job
        lines = text_lines(spark, source)
    return scan_lines(lines, options)


def scan_text(spark: SparkSession, text: str | bytes, options: ScanOptions | None = None) -> DataFrame:
    """Typed rows of lines that are in memory."""
    lines = (text.decode("utf-8") if isinstance(text, bytes) else text).split("\n")
    return scan_lines(spark.createDataFrame([(x,) for x in lines], "value string"), options)


def scan_units(spark: SparkSession, source: UnitSource, options: ScanOptions | None = None) -> DataFrame:
    return scan_lines(unit_lines(spark, source), options)


def batches(df: DataFrame, size: int = 1000) -> Iterator[list]:
    """The rows in lists of at most size, pulled partition by partition."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


class LogReader:
    """The same scans, put together step by step: LogReader(spark).source(path).line_filter("error").build()."""

    def __init__(self, spark: SparkSession, options: ScanOptions | None = None):
        self._spark, self._options, self._open = spark, options or ScanOptions(), None

    def _with(self, **changes) -> LogReader:
        self._options = replace(self._options, **changes)
        return self

    def source(self, path: str) -> LogReader:
        self._open = lambda: scan_log(self._spark, path, self._options)
        return self

    def from_text(self, text: str | bytes) -> LogReader:
        self._open = lambda: scan_text(self._spark, text, self._options)
        return self

    def from_lines(self, lines: DataFrame, column: str = "value") -> LogReader:
        self._open = lambda: scan_lines(lines, self._options, column)
        return self

    def from_units(self, source: UnitSource) -> LogReader:
        self._open = lambda: scan_units(self._spark, source, self._options)
        return self

    def line_filter(self, f: str | Callable) -> LogReader:
        return self._with(line_filter=f)

    def row_filter(self, f: Callable) -> LogReader:
        return self._with(row_filter=f)

    def schema(self, schema: dict[str, str]) -> LogReader:
        return self._with(schema=schema)

    def infer_schema_length(self, n: int | None) -> LogReader:
        return self._with(infer_schema_length=n)

    def aligned_cols_cnt(self, on: bool = True) -> LogReader:
        return self._with(aligned_cols_cnt=on)

    def batch_size(self, n: int) -> LogReader:
        return self._with(batch_size=n)

    def n_threads(self, n: int) -> LogReader:
        return self._with(n_threads=n)

    def cmd(self, command: str) -> LogReader:
        return self._with(cmd=command)

    def build(self) -> DataFrame:
        if self._open is None:
            raise ValueError("a source is needed")
        return self._open()

    def next_batches(self) -> Iterator[list]:
        return batches(self.build(), self._options.batch_size or 1000)
