"""A Spark data source "logfmt" for what the text reader cannot split: frames of seekable zstd files, units, commands over ssh.

    register(spark); spark.read.format("logfmt").option("options", '{"line_filter": "error"}').load("app.log.zst")

It also serves CREATE TEMPORARY VIEW ... USING logfmt. Files are split by frame, or by chunks of whole lines; what has no
table of frames is one partition. A line belongs to the task in whose frames it begins: every task but the first begins after its
first newline, and every task reads on to the first newline behind its frames, so that frames may end anywhere and the driver decompresses
none. With the option raw=true the lines come as they are, in one column "value"; scan_log() takes that way, as Column
expressions prune columns and push filters, which a Python source cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import values
from ..functions.tokenizer import pairs
from ..options import ScanOptions
from ..plans import schema as schemas
from . import seekzst
from .paths import Bytes, lines_of, ssh_stream

#: Bytes that one task reads (of zstd files, decompressed): a sixteenth of the file, within these bounds.
LEAST_SPLIT, MOST_SPLIT = 512 << 10, 32 << 20
#: Lines in one Arrow batch.
BATCH_LINES = 10_000


class Part(InputPartition):
    def __init__(self, kind: str, frames: list = (), start: int = 0, length: int = 0):
        self.kind, self.frames, self.start, self.length = kind, list(frames), start, length


def parts(path: str, cmd: str | None = None, split: int | None = None) -> list[Part]:
    if cmd:
        return [Part("command")]
    read = Bytes(path)
    size = read.size()
    share = lambda total: split or min(MOST_SPLIT, max(LEAST_SPLIT, total // 16))
    if path.endswith(".zst"):
        listed = seekzst.frames(read, size)
        if not listed:
            return [Part("stream")]
        groups: list[list] = []
        most = share(listed[-1].start + listed[-1].length)
        for f in listed:
            if not groups or sum(x.length for x in groups[-1]) >= most:
                groups.append([])
            groups[-1].append(f)
        return [Part("frames", g) for g in groups]
    return [Part("plain", start=a, length=n) for a, n in seekzst.plan(size, read, chunk=share(size))]


def pieces_of(path: str, part: Part, cmd: str | None = None) -> Iterator[bytes]:
    read = Bytes(path)
    if part.kind == "command":
        return ssh_stream(path, cmd)
    if part.kind == "stream":
        return seekzst.whole(read, read.size())
    if part.kind == "frames":
        return lines_begun(read, part.frames)
    return (read(a, min(1 << 20, part.start + part.length - a)) for a in range(part.start, part.start + part.length, 1 << 20))


def lines_begun(read: Bytes, own: list[seekzst.Frame]) -> Iterator[bytes]:
    """The bytes of the lines that begin in these frames; the line that begins right behind them counts as theirs, and the one at their start as that of the task before."""
    at, inside = 0, own[0].index == 0
    for frame in own:
        piece = seekzst.read_frame(read, frame)
        if not inside:
            at = piece.find(b"\n") + 1
            inside, piece = at > 0, piece[at:] if at else b""
        if piece:
            yield piece
    if inside:  # else one line covers all of them, and the task in which it began reads it
        for frame in seekzst.frames(read, read.size())[own[-1].index + 1 :]:
            piece = seekzst.read_frame(read, frame)
            end = piece.find(b"\n") + 1
            if chosen := piece[:end] if end else piece:
                yield chosen
            if end:
                return


def read_lines(path: str, part: Part, cmd: str | None = None) -> Iterator[str]:
    return lines_of(pieces_of(path, part, cmd))


def line_batches(pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Lines without their newlines, in Arrow batches."""
    rest, held = b"", []
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        held += whole
        while len(held) >= BATCH_LINES:
            yield _batch(held[:BATCH_LINES])
            held = held[BATCH_LINES:]
    if rest:
        held.append(rest)
    if held:
        yield _batch(held)


def _batch(lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], names=["value"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logfmt"

    def _scan(self) -> tuple[str, ScanOptions, bool]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        options = ScanOptions.from_json(self.options.get("options", "{}"))
        if options.cmd and not path.startswith("ssh://"):
            raise ValueError("cmd needs an ssh:// path")
        return path, options, self.options.get("raw", "false").lower() == "true"

    def schema(self) -> T.StructType:
        path, options, raw = self._scan()
        if raw:
            return T.StructType([T.StructField("value", T.StringType())])
        return schemas.struct_type(kinds_of(path, options))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path, options, raw = self._scan()
        return LogReaderTask(path, options, raw, {} if raw else kinds_of(path, options), schema)


class LogReaderTask(DataSourceReader):
    def __init__(self, path: str, options: ScanOptions, raw: bool, kinds: dict[str, str], schema: T.StructType):
        self.path, self.options, self.raw, self.schema = path, options, raw, schema
        self.columns = [(n, kinds.get(n, "string")) for n in schema.names]

    def partitions(self) -> list[Part]:
        return parts(self.path, self.options.cmd)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if self.raw:
            yield from line_batches(pieces_of(self.path, part, self.options.cmd))
            return
        lines = accepted(read_lines(self.path, part, self.options.cmd), self.options)
        types = to_arrow_schema(self.schema)
        while some := list(islice(lines, BATCH_LINES)):
            rows = [dict(pairs(line, self.options.compat)) for line in some]
            columns = [[values.py_typed(row.get(n), k, self.options.fill) for row in rows] for n, k in self.columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)


def kinds_of(path: str, options: ScanOptions) -> dict[str, str]:
    """The schema given, or that of the first lines, which are read for it."""
    if options.schema:
        return options.schema
    lines = (x for p in parts(path, options.cmd) for x in read_lines(path, p, options.cmd))
    return infer_lines(accepted(lines, options), options.infer_schema_length, options.compat)


def accepted(lines: Iterator[str], options: ScanOptions) -> Iterator[str]:
    return (x for x in lines if x.strip() and (not options.line_filter or options.line_filter in x))


def infer_lines(lines: Iterator[str], n: int | None, compat: bool = True) -> dict[str, str]:
    out = schemas.merge({k: values.py_infer(v) for k, v in dict(pairs(x, compat)).items()} for x in islice(lines, n))
    if not out:
        raise ValueError(schemas.NO_LINE)
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
