import random

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom import catalogue
from logloom.functions.text import between, extract, human_bytes
from logloom.operators import asof, filters, rows
from logloom.operators.asof import asof_join, next_index
from logloom.plans import flagship
from logloom.sources.datasource import parts


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, sf_dir, same_rows, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE_SQL:
        same_rows(df, catalogue.ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_queries_over_all_rows(spark, sf_dir):
    n, orders = catalogue.table(spark, sf_dir, "events").count(), catalogue.table(spark, sf_dir, "orders").count()
    got = [tuple(r) for r in catalogue.sort_multi_key_all(spark, sf_dir).collect()]
    assert len(got) == n and got == sorted(got)
    got = [(r["value"] is None, r["value"] or 0, r["event_id"]) for r in catalogue.sort_desc_nulls_first_all(spark, sf_dir).collect()]
    assert len(got) == n and got == sorted(got, reverse=True)
    words = [r["words"] for r in catalogue.duration_format_all(spark, sf_dir).collect()]
    assert len(words) == n and all(any(unit in w for w in words) for unit in ("year", "month", "day"))
    assert catalogue.union_keys_frame_all(spark, sf_dir).count() == n + orders
    assert catalogue.run_lines(spark, sf_dir, "true").where("value LIKE '%run finished%'").count() == orders


def test_zstd_events_are_split(spark, tmp_path):
    """Frames of the real size, in several groups of a file."""
    df = spark.range(40_000).selectExpr("id AS event_id", "id % 7 AS user_id", "'click' AS event_type", "id / 2D AS value")
    df.write.parquet(str(tmp_path / "events.parquet"))
    files = catalogue.event_files(spark, str(tmp_path))
    assert len(files) == spark.sparkContext.defaultParallelism and all(n > 4 for _, n in files)
    assert all(len(parts(path, split=128 << 10)) > 1 for path, _ in files)
    for scan in (catalogue.zst_scan_events, catalogue.unit_scan_events):
        assert sorted(map(tuple, scan(spark, str(tmp_path)).select("event_id", "user_id", "event_type", "value").collect())) == sorted(map(tuple, df.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_texts():
    parse = filters.parse_filter
    assert parse("msg~finish") == filters.FilterSpec("~", "msg", "finish") and parse("new!~x").op == "!~" and parse(" a != b ") == filters.FilterSpec("!=", "a", "b")
    assert parse("a!=b~c") == filters.FilterSpec("~", "a!=b", "c") and parse(None).op == parse("  ").op == "always"
    for bad in ("=x", "x=", "x", "~"):
        with pytest.raises(ValueError):
            parse(bad)


def test_filters_and_absent_keys(spark):
    df = spark.createDataFrame([("x",), (None,), ("xy",)], "a string")
    n = lambda text: filters.filter_rows(df, text).count()
    assert (n("a=x"), n("a!=x"), n("a~x"), n("a!~x"), n("b=x"), n("b!=x"), n("")) == (1, 2, 2, 1, 0, 3, 3)
    m = df.select(F.create_map(F.lit("a"), "a").alias("row"))
    assert m.where(filters.filter_map(F.col("row"), "b!~x")).count() == 3 and m.where(filters.filter_map(F.col("row"), "a~y")).count() == 1


def test_time_range(spark):
    df = spark.createDataFrame([("2026-01-21T12:00:00+09:00",), ("2026-01-22T00:00:00+09:00",), ("x",), (None,)], "t string")
    assert filters.filter_time_range(df, "t", "2026-01-21T00:00:00+09:00", "2026-01-21T12:00:00+09:00").count() == 1
    assert filters.filter_time_range(df, "none", "2026-01-21T00:00:00Z", "2026-01-21T12:00:00Z").count() == 4
    with pytest.raises(ValueError):
        filters.filter_time_range(df, "t", "yesterday", "today")


def test_texts(spark):
    df = spark.createDataFrame([("/srv/out/T_ONE/x",), ("/out//out/x/",), ("/srv/out/",), (None,)], "p string")
    assert [r[0] for r in df.select(between(F.col("p"), "/out/", "/")).collect()] == ["T_ONE", None, None, None]
    assert [r[0] for r in df.select(extract(F.col("p"), "/out/([^/]+)/")).collect()] == ["T_ONE", "x", None, None]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1_572_864,), (-2048,), (5 << 40,), (None,)], "n long")
    assert [r[0] for r in sizes.select(human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "1.50 MB", "-2.00 KB", "5.00 TB", None]


def test_human_sizes_beyond_megabytes(spark, tmp_path):
    """Keys as large as those of large tables: the SQL knows no unit above MB, and rounds parts of a byte."""
    rows_ = [(i, i % 7 + 1, q, k) for i, (q, k) in enumerate([(50.0, 60_000), (50.0, 360_000), (49.0, 29_959), (1.0, 5243), (0.005, 3), (0.015, 1), (None, 1), (1.0, 0), (30.0, 36_700)] * 7)]
    spark.createDataFrame(rows_, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.human_sizes(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(catalogue.ORACLE_SQL["human_sizes"]).fetchall()))
    assert "12016.30 MB" in {r[2] for r in got}
    shown = spark.range(1).select(human_bytes(F.lit(3 << 30)), human_bytes(F.lit(3 << 30), "MB"), human_bytes(F.lit(3 << 20), "KB"), human_bytes(F.lit(-(3 << 30)), "MB"))
    assert tuple(shown.first()) == ("3.00 GB", "3072.00 MB", "3072.00 KB", "-3072.00 MB")


def test_row_index_and_unions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("v"))
    got = rows.row_index(df, ["v"]).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(i, i) for i in range(1000)]
    maps = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "3", "c": "4"},)], "row map<string,string>")
    assert [tuple(r) for r in rows.union_of_keys(maps).collect()] == [("1", "2", None), (None, "3", "4")]
    with pytest.raises(ValueError):
        rows.aggregate(df, "median")


@pytest.mark.parametrize("direction", ["forward", "backward", "nearest"])
@pytest.mark.parametrize("allow_equal", [False, True])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_asof_equals_brute_force(spark, direction, allow_equal, by):
    rng = random.Random(f"{direction}{allow_equal}{by}")
    left = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(40)])) for i in range(60)]
    right = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(40)])) for i in range(25)]
    l, r = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "j int, k string, u long")
    got = asof_join(l, r if by else r.drop("k"), "t", "u", by=by, direction=direction, allow_equal=allow_equal, tolerance=12, first_by=["j"], buckets=4)

    def one(k, t):
        def best(sign):
            fit = [((u - t) * sign, j) for j, rk, u in right if u is not None and (not by or rk == k) and 0 <= (u - t) * sign <= 12 and (allow_equal or u != t)]
            return min(fit, default=None)

        if t is None:
            return None
        a, b = best(1), best(-1)
        if direction == "forward":
            return a and a[1]
        if direction == "backward":
            return b and b[1]
        return a[1] if a and (not b or a[0] <= b[0]) else b and b[1]

    assert {x["i"]: x["j"] for x in got.collect()} == {i: one(k, t) for i, k, t in left}


def plans_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_parses_each_line_once_and_makes_no_join_by_time(spark, sf_dir, monkeypatch):
    """What is staged is read; the as-of join carries its left rows along, so nothing is joined back by time; groups are hashed, not sorted."""
    written, keep = [], flagship.staged
    monkeypatch.setattr(flagship, "staged", lambda df, name: written.append(plans_of(df)) or keep(df, name))
    out = flagship.bytes_per_run(catalogue.run_lines(spark, sf_dir, "true"))
    assert sum(p.count("regexp_replace") > 0 for p in written) == len(written) == 1
    plan = plans_of(out)
    assert not any(word in plan for word in ("regexp_replace", "SortMergeJoin", "SortAggregate [table_name", "SortAggregate(key=[table_name"))
    assert plan.count("Join") == 1 and plan.count("HashAggregate(keys=[table_name") == 2


def test_asof_splits_a_time_that_many_rows_share(spark, monkeypatch):
    """One time holds nearly all left rows, and several right rows: buckets are of one size still, and all rows get the right row that is first."""
    n, kept, keep = 8000, [], asof.bucketed
    monkeypatch.setattr(asof, "bucketed", lambda *a: kept.append(keep(*a)) or kept[-1])
    left = spark.range(n).selectExpr("id AS i", "CASE WHEN id < 10 THEN id ELSE 100 END AS t")
    right = spark.createDataFrame([(j, 100 + j // 6, f"x{j % 6}") for j in range(12)], "j int, u long, name string")
    for allow_equal, wanted in ((True, {(100, 0)}), (False, {(101, 6)})):
        got = asof_join(left, right, "t", "u", allow_equal=allow_equal, first_by=["name"], buckets=8).collect()
        assert len({r["i"] for r in got}) == len(got) == n
        assert {(r["u"], r["j"]) for r in got if r["t"] == 100} == wanted and {(r["u"], r["j"]) for r in got if r["t"] < 100} == {(100, 0)}
        sizes = [r["count"] for r in kept[-1].groupBy("_b").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * n / 8


def test_next_index():
    assert [next_index([0, 60], t) for t in (0, 30, 60, 120)] == [0, 1, 1, None]
