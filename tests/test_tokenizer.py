import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import values
from logloom.functions.tokenizer import last_key_wins, pairs, parse_map, parse_pairs, render, unescaped

VECTORS = [
    ("level=info msg=hello code=200", [("level", "info"), ("msg", "hello"), ("code", "200")]),
    ('msg="hello world" user=alice', [("msg", "hello world"), ("user", "alice")]),
    ("flag level=info n=1", [("n", "1")]),
    ("a =b", [("a", "b")]),
    ("a = b", [("a", "")]),
    ("a=", [("a", "")]),
    ("a= b=1", [("a", ""), ("b", "1")]),
    ('a="" b=1', [("a", '"'), ("b", "1")]),
    ('m="e\\"q" n=2', [("m", 'e\\"q'), ("n", "2")]),
    ('m="un term', [("m", "un term\n")]),
    ("=x y=1", [("y", "1")]),
    ('a="x"b=1', [("a", "x"), ("b", "1")]),
    ("x=a=b=c", [("x", "a=b=c")]),
    ("k=1 k=2", [("k", "1"), ("k", "2")]),
    ("", []),
    ("inputs.0=5", [("inputs.0", "5")]),
]


def test_vectors(spark):
    last_key_wins(spark)
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(VECTORS)], "i int, line string")
    got = {r["i"]: r for r in df.select("i", parse_pairs(F.col("line")).alias("p"), parse_map(F.col("line")).alias("m")).collect()}
    for i, (line, want) in enumerate(VECTORS):
        assert [(p["k"], p["v"]) for p in got[i]["p"]] == want, line
        assert got[i]["m"] == dict(want), line
        assert list(pairs(line + "\n")) == want, line


def test_without_compat(spark):
    df = spark.createDataFrame([('a="" b="x"',)], "line string")
    assert df.select(parse_map(F.col("line"), compat=False).alias("m")).first()["m"] == {"a": "", "b": "x"}
    assert spark.createDataFrame([('a \\"b\\" \\\\',)], "v string").select(unescaped(F.col("v"))).first()[0] == 'a "b" \\'
    assert dict(pairs('a="" b="x"\n', compat=False)) == {"a": "", "b": "x"}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='ab=" \\\t\f\r1é\x01', max_size=24), min_size=300, max_size=400))
def test_expressions_equal_the_state_machine(spark, lines):
    last_key_wins(spark)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    for r in df.select("i", "line", parse_pairs(F.col("line")).alias("p"), parse_map(F.col("line")).alias("m")).collect():
        assert r["m"] == dict(pairs(r["line"] + "\n")), repr(r["line"])
        assert [(p["k"], p["v"]) for p in r["p"]] == list(pairs(r["line"] + "\n")), repr(r["line"])


def test_render_is_read_back(spark):
    df = spark.createDataFrame([("plain", 1), ("two words", None), ("a=b", 3)], "t string, n int")
    rows = df.select(parse_map(render(["t", "n"])).alias("m")).collect()
    assert [r["m"] for r in rows] == [{"t": "plain", "n": "1"}, {"t": "two words"}, {"t": "a=b", "n": "3"}]


INFERRED = {
    "2026-01-22T12:00:00+09:00": "datetime", "42": "integer", "-7": "integer", "99999999999999999999": "float", "3.14159": "float", "1e5": "float", "nan": "float", "true": "boolean", "YES": "boolean", "off": "boolean",
    "hello": "string", "1s": "duration", "500ms": "duration", "0.123s": "duration", "0s": "duration", "1d": "duration", "2h 30m": "duration", "0": "integer", "2026": "integer", "2026-01-22": "string", "": "string", "1x": "string",
}


def test_inference(spark):
    df = spark.createDataFrame([(k,) for k in INFERRED], "v string")
    assert {r["v"]: r["t"] for r in df.select("v", values.infer_type(F.col("v")).alias("t")).collect()} == INFERRED
    assert {v: values.py_infer(v) for v in INFERRED} == INFERRED


def test_durations(spark):
    want = {"1s": 1_000_000, "500ms": 500_000, "0.123s": 123_000, "2h 30m": 9_000_000_000, "1d": 86_400_000_000, "1month": 2_630_016_000_000, "1year": 31_557_600_000_000, "999ns": 0, "1500ns": 1, "-1s": None, "1": None, "s": None, None: None}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", values.parse_duration(F.col("v")).alias("n")).collect()} == want
    assert {v: values.py_duration(v) for v in want if v is not None} == {k: n for k, n in want.items() if k is not None}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times_do_not_depend_on_the_session(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2026-01-12T00:01:01.688+09:00",), ("2026-01-12t00:01:01z",), ("2026-01-12",), ("x",)], "v string")
        got = [r[0] for r in df.select(values.parse_rfc3339(F.col("v")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2026-01-11 15:01:01.688", "2026-01-12 00:01:01", None, None]
    assert values.py_rfc3339("2026-01-12T00:01:01.688+09:00") == dt.datetime(2026, 1, 11, 15, 1, 1, 688000)


def test_casts_between_kinds(spark):
    df = spark.createDataFrame([(90_500_000, 1.9, True, "7")], "d long, f double, b boolean, s string")
    c = lambda name, a, b: values.convert(F.col(name), a, b)
    row = df.select(c("d", "duration", "float"), c("f", "float", "integer"), c("b", "boolean", "integer"), c("s", "string", "integer"), c("d", "duration", "string"), c("f", "float", "boolean")).first()
    assert tuple(row) == (90.5, 1, 1, 7, "1m 30s 500ms", True)
