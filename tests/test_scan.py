import os
import stat

import pytest
from pyspark.sql import functions as F

from logloom import cli
from logloom.options import ScanOptions
from logloom.plans.schema import NO_LINE, infer_from_rows, merge
from logloom.functions.tokenizer import last_key_wins, parse_map
from logloom.sources import seekzst
from logloom.sources.paths import Bytes, lines_of, parse_ssh
from logloom.sources.reader import LogReader, batches, scan_lines, scan_log, scan_text, scan_units
from logloom.sources.sinks import parquet_path, write_lines
from logloom.sources.units import UnitSource
from logloom.streaming.logs import count_by_window, sink_parquet, stream_log

APP = "n=1 ts=2031-05-06T08:30:00+05:30 level=info msg=open\nn=2 ts=2031-05-06T08:30:07+05:30 level=error msg=jammed\n\nn=3 ts=2031-05-06T08:31:00+05:30 level=info msg=shut\n"
MIXED = "level=info n=1\nlevel=error n=2\nlevel=info n=1.5 extra=x\n"
RAGGED = "level=info msg=a n=1\nlevel=info msg=b\nlevel=info msg=c n=3\n"
BIG = "".join(f"n={n} step={n // 7} level={('error', 'info')[n % 2]}\n" for n in range(1, 2001))


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture
def app(tmp_path):
    path = tmp_path / "app.log"
    path.write_text(APP)
    return str(path)


def test_plain_file(spark, app):
    df = scan_log(spark, app)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("level", "string"), ("msg", "string"), ("n", "bigint"), ("ts", "timestamp_ntz")]
    assert [(r["n"], r["msg"], str(r["ts"])) for r in df.orderBy("n").collect()] == [(1, "open", "2031-05-06 03:00:00"), (2, "jammed", "2031-05-06 03:00:07"), (3, "shut", "2031-05-06 03:01:00")]
    assert df.count() == df.count() == 3


def test_line_filter_and_columns(spark, app):
    df = scan_log(spark, app, ScanOptions(line_filter="error"))
    assert values(df, "n") == [2]
    plan = df.select("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan
    assert values(scan_log(spark, app, ScanOptions(line_filter=lambda line: line.rlike("n=[13]"))), "n") == [1, 3]
    assert values(scan_log(spark, app, ScanOptions(row_filter=lambda row: row["n"] == "3")), "msg") == ["shut"]


def test_missing_values(spark):
    assert values(scan_text(spark, RAGGED), "n") == [1, 0, 3]
    assert values(scan_text(spark, RAGGED, ScanOptions(aligned_cols_cnt=True)), "n") == [1, None, 3]
    assert values(scan_text(spark, RAGGED, ScanOptions(missing="null")), "n") == [1, None, 3]


def test_inference_and_widening(spark):
    first = scan_text(spark, MIXED)
    assert first.columns == ["level", "n"] and first.schema["n"].dataType.simpleString() == "bigint"
    assert values(first, "n") == [1, 2, 0]  # 1.5 is no integer
    wide = scan_text(spark, MIXED, ScanOptions(infer_schema_length=3))
    assert wide.columns == ["extra", "level", "n"] and values(wide, "n") == [1.0, 2.0, 1.5] and values(wide, "extra") == ["", "", "x"]
    assert merge([{"a": "integer"}, {"a": "string", "b": "boolean"}, {"a": "float"}]) == {"a": "string", "b": "boolean"}
    with pytest.raises(ValueError, match=NO_LINE[:20]):
        scan_text(spark, "\n\n")
    with pytest.raises(ValueError):
        scan_text(spark, MIXED, ScanOptions(infer_schema_length=0))


def test_schema_overrides(spark):
    line = 'id="481" score="7.25" enabled=yes code=031 rate=x took=1.5s on=1 at=never'
    schema = {"id": "integer", "score": "float", "enabled": "boolean", "code": "string", "rate": "float", "took": "duration", "on": "boolean", "at": "datetime", "gone": "auto"}
    row = scan_text(spark, line, ScanOptions(schema=schema)).first().asDict()
    assert row == {"at": None, "code": "031", "enabled": True, "gone": "", "id": 481, "on": False, "rate": 0.0, "score": 7.25, "took": 1_500_000}
    assert scan_text(spark, "", ScanOptions(schema={"level": "string", "n": "integer"})).count() == 0


def test_options():
    assert ScanOptions.from_json('{"line_filter": "x", "aligned_cols_cnt": true}') == ScanOptions(line_filter="x", aligned_cols_cnt=True)
    with pytest.raises(ValueError, match="lines_filter"):
        ScanOptions.from_json('{"lines_filter": "x"}')
    with pytest.raises(ValueError):
        ScanOptions(schema={"a": "number"})


def test_limits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text(BIG)
    df = scan_log(spark, str(path))
    assert values(df.limit(3).where("level = 'error'"), "n") == [2]
    assert values(df.where("level = 'error'").limit(3), "n") == [2, 4, 6]
    assert [len(b) for b in batches(df, 700)] == [700, 700, 600]


def test_builder(spark, app):
    df = LogReader(spark).source(app).line_filter("info").schema({"n": "integer"}).batch_size(1).build()
    assert df.columns == ["n"] and values(df, "n") == [1, 3]
    assert [len(b) for b in LogReader(spark).from_text(APP).batch_size(2).next_batches()] == [2, 1]
    with pytest.raises(ValueError):
        LogReader(spark).build()
    with pytest.raises(ValueError, match="ssh://"):
        scan_log(spark, app, ScanOptions(cmd="cat x"))


# --- zstd ---


def test_frames(spark, tmp_path):
    path = str(tmp_path / "big.log.zst")
    written = seekzst.write(BIG.encode(), path, 4096)
    read = Bytes(path)
    listed = seekzst.frames(read, read.size())
    assert listed == written and len(listed) > 5 and seekzst.ends_with_lines(read, listed)
    assert b"".join(seekzst.read_frame(read, f) for f in listed) == BIG.encode() == b"".join(seekzst.whole(read, read.size()))
    df = scan_log(spark, path)
    assert sorted(values(df, "n")) == list(range(1, 2001))
    typed = spark.read.format("logfmt").option("options", '{"line_filter": "error"}').load(path)
    assert typed.schema["n"].dataType.simpleString() == "bigint" and sorted(values(typed, "n")) == list(range(2, 2001, 2))


def test_zst_without_table_or_lines(spark, tmp_path):
    import zstandard

    plain, cut = tmp_path / "plain.log.zst", tmp_path / "cut.log.zst"
    plain.write_bytes(zstandard.compress(APP[:60].encode()) + zstandard.compress(APP[60:].encode()))
    seekzst.write(BIG.encode(), str(cut), 1000, separator=b" ")
    assert values(scan_log(spark, str(plain)), "n") == [1, 2, 3]
    assert values(scan_log(spark, str(cut)), "n") == list(range(1, 2001))


def test_plan():
    def reader(data):
        return lambda a, n: data[a : a + n]

    data = b"line1\nline2\nline3\nline4\n"
    assert seekzst.plan(24, reader(data)) == [(0, 24)] and seekzst.plan(23, reader(data[:-1])) == [(0, 23)] and seekzst.plan(0, reader(b"")) == []
    assert seekzst.plan(24, reader(data), chunk=8) == [(0, 6), (6, 6), (12, 6), (18, 6)]
    assert seekzst.plan(12, reader(b"abc\ndef\nghi\n"), chunk=2) == [(0, 4), (4, 4), (8, 4)]


def test_data_source_over_plain_files_and_sql(spark, app):
    from logloom.sources.datasource import register

    register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW app USING logfmt OPTIONS (path '{app}')")
    assert [r[0] for r in spark.sql("SELECT n FROM app WHERE level = 'info' ORDER BY n").collect()] == [1, 3]
    with pytest.raises(Exception, match="unknown field"):
        spark.read.format("logfmt").option("options", '{"lines_filter": "x"}').load(app)


# --- units, ssh ---


class Texts(UnitSource):
    def __init__(self, texts, known=True):
        self.texts, self.known = texts, known

    def count_units(self):
        return len(self.texts) if self.known else None

    def read_unit(self, index):
        return self.texts[index].encode() if index < len(self.texts) else None


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("options", [ScanOptions(), ScanOptions(aligned_cols_cnt=True), ScanOptions(line_filter="info")])
def test_units_equal_text(spark, known, options):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    lines = (RAGGED + "\n" + RAGGED).splitlines(keepends=True)
    units = Texts(["".join(lines[:2]), "", "".join(lines[2:5]), "".join(lines[5:])], known)
    assert sorted(map(repr, scan_units(spark, units, options).collect())) == sorted(map(repr, scan_text(spark, RAGGED + RAGGED, options).collect()))


def test_ssh_addresses():
    s = parse_ssh("ssh://me@host/var/log/a.log")
    assert (s.user, s.host, s.port, s.path) == ("me", "host", 22, "/var/log/a.log") and parse_ssh("ssh://me@host:2222/x").port == 2222
    for bad, word in (("http://me@h/x", "ssh"), ("ssh://h/x", "user"), ("ssh://me@/x", "host"), ("ssh://me@h", "path")):
        with pytest.raises(ValueError, match=word):
            parse_ssh(bad)


def test_ssh_by_a_stub(spark, tmp_path, monkeypatch, app):
    stub = tmp_path / "bin" / "ssh"
    stub.parent.mkdir()
    stub.write_text('#!/bin/sh\nfor last; do :; done\nexec sh -c "$last"\n')
    stub.chmod(stub.stat().st_mode | stat.S_IXUSR)
    monkeypatch.setenv("PATH", f"{stub.parent}:{os.environ['PATH']}")
    remote = f"ssh://me@host{app}"
    assert Bytes(remote).size() == len(APP) and Bytes(remote)(7, 4) == b"2031"
    zst = str(tmp_path / "a.log.zst")
    seekzst.write(APP.encode(), zst, 20)
    read = Bytes(f"ssh://me@host{zst}")
    assert b"".join(seekzst.read_frame(read, f) for f in seekzst.frames(read, read.size())) == APP.encode()
    from logloom.sources.datasource import Part, parts, read_lines

    assert "".join(x for p in parts(remote) for x in read_lines(remote, p)) == APP
    assert list(read_lines(remote, Part("command"), f"head -n 1 {app}")) == [APP.splitlines(keepends=True)[0]]


def test_lines_over_short_reads():
    text = "".join(f"level=info n={i}\n" for i in range(50)).encode() + b"last"
    assert "".join(lines_of(text[i : i + 7] for i in range(0, len(text), 7))).encode() == text


# --- sinks, streams, command line ---


def test_sinks(spark, app, tmp_path):
    assert parquet_path("a.log.seek.zst") == "a.log.seek.parquet" and parquet_path("s3://b/a.log") == "s3://b/a.parquet"
    out = write_lines(scan_log(spark, app).select("n", "msg"), str(tmp_path / "lines"))
    assert sorted(values(scan_log(spark, out), "n")) == [1, 2, 3]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text(APP)
    rows = stream_log(spark, str(folder), ScanOptions(schema={"level": "string", "n": "integer", "ts": "datetime"}))
    sink_parquet(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(values(spark.read.parquet(str(tmp_path / "out")), "n")) == [1, 2, 3]
    query = count_by_window(rows, "ts", "level").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["level"], r["count"]) for r in spark.table("windows").collect()) == [("error", 1), ("info", 2)]
    with pytest.raises(ValueError):
        stream_log(spark, str(folder), ScanOptions())


def test_command_line(spark, app, capsys, tmp_path):
    assert cli.main(["--source", app, "--agg", "count,count_by:level,bytes_sum:n", "--agg-filter", "msg!~jam"], spark) == 0
    out = capsys.readouterr().out
    assert "count_by:level" in out and "|4" in out.replace(" ", "")
    assert cli.main(["--source", app, "--out", str(tmp_path / "o.parquet"), "--preview-rows", "0"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 3


def test_infer_from_rows_collects_keys_only(spark):
    last_key_wins(spark)
    df = spark.createDataFrame([(x,) for x in MIXED.splitlines()], "value string").select(parse_map(F.col("value")).alias("row"))
    assert infer_from_rows(df) == {"extra": "string", "level": "string", "n": "float"}
    assert scan_lines(spark.createDataFrame([("a=1",)], "l string"), column="l").first()["a"] == 1
