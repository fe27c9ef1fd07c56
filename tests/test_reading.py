"""Frames that end anywhere, commands that run once, keys and passwords for ssh, slices, unescaping, buckets of time, errors."""

import os
import random
import stat

import pytest
from pyspark.sql import functions as F

from logloom import cli
from logloom.operators import rows
from logloom.operators.asof import asof_join, bucketed
from logloom.options import ScanOptions
from logloom.sources import paths, seekzst
from logloom.sources.datasource import parts, read_lines, register
from logloom.sources.reader import scan_log, scan_text
from logloom.sources.sinks import shared_folder


def test_frames_may_end_anywhere(spark, tmp_path):
    rng = random.Random(1)
    lines = [f"k={i} v={'x' * rng.choice([0, 3, 50, 900])}" for i in range(400)]
    lines[100] = f"k=100 v={'y' * 9000}"  # longer than several groups of frames
    for end in ("\n", ""):
        text = ("\n".join(lines) + end).encode()
        path = str(tmp_path / f"cut{len(end)}.log.zst")
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(150)), *(i + 1 for i, c in enumerate(text[:20_000]) if c == 10 and rng.random() < 0.2)})
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        with open(path, "wb") as out:
            seekzst.write((p + b"\0" for p in pieces), out, 1, separator=b"\0")
        read = paths.Bytes(path)
        # the separators are taken out again, so that frames end where the text was cut
        whole = [seekzst.read_frame(read, f)[:-1] for f in seekzst.frames(read, read.size())]
        _write_frames(path, whole)
        for split in (1, 700, 5000, 1 << 20):
            got = [x for p in parts(path, split=split) for x in read_lines(path, p)]
            assert "".join(got).encode() == text and len(got) == 400
        assert len(parts(path, split=700)) > 20
    df = scan_log(spark, path, ScanOptions(schema={"k": "integer", "v": "string"}))
    assert sorted(r["k"] for r in df.select("k").collect()) == list(range(400))
    register(spark)
    assert spark.read.format("logfmt").load(path).where("k = 100").count() == 1


def _write_frames(path, pieces):
    import struct

    import zstandard

    packed = [zstandard.ZstdCompressor(write_content_size=True).compress(p) for p in pieces]
    table = b"".join(struct.pack("<II", len(z), len(p)) for z, p in zip(packed, pieces)) + struct.pack("<IBI", len(packed), 0, seekzst.FOOTER)
    with open(path, "wb") as out:
        out.write(b"".join(packed) + struct.pack("<II", seekzst.SKIPPABLE, len(table)) + table)


def ssh_stub(tmp_path, monkeypatch, script):
    stub = tmp_path / "bin" / "ssh"
    stub.parent.mkdir()
    stub.write_text("#!/bin/sh\n" + script)
    stub.chmod(stub.stat().st_mode | stat.S_IXUSR)
    monkeypatch.setenv("PATH", f"{stub.parent}:{os.environ['PATH']}")


def test_a_command_runs_once(spark, tmp_path, monkeypatch):
    """Lines that its schema is inferred from are not asked for again."""
    count = tmp_path / "count"
    # workers keep the PATH that they began with: the stub's folder is given to ssh_stream by its own name
    stub = tmp_path / "once"
    stub.write_text(f"#!/bin/sh\necho x >> {count}\nn=$(wc -l < {count})\necho a=$n b=1\necho a=$n b=2\n")
    stub.chmod(0o755)
    ssh = tmp_path / "bin" / "ssh"
    ssh.parent.mkdir()
    ssh.write_text('#!/bin/sh\nfor last; do :; done\nexec sh -c "$last"\n')
    ssh.chmod(0o755)
    monkeypatch.setattr(paths.SshSource, "command", lambda self, remote, program=str(ssh): [program, remote])
    from logloom.sources import reader

    taken = []
    monkeypatch.setattr(reader, "staged", lambda df, name: taken.append(name) or spark.createDataFrame([(x.rstrip(),) for p in parts("ssh://me@h/x", str(stub)) for x in read_lines("ssh://me@h/x", p, str(stub))], "value string"))
    df = scan_log(spark, "ssh://me@h/x", ScanOptions(cmd=str(stub)))
    assert [tuple(r) for r in df.collect()] == [(1, 1), (1, 2)] == [tuple(r) for r in df.collect()]
    assert taken == ["command"] and count.read_text().count("x") == 1


def test_ssh_key_and_password(tmp_path, monkeypatch):
    source = paths.parse_ssh("ssh://me@host:23/x")
    assert source.command("ls") == ["ssh", "-o", "BatchMode=yes", "-p", "23", "me@host", "ls"]
    monkeypatch.setenv(paths.KEY, "/k/id")
    assert source.command("ls")[1:7] == ["-o", "BatchMode=yes", "-i", "/k/id", "-o", "IdentitiesOnly=yes"]
    monkeypatch.setenv(paths.PASSWORD, "p'a s\"s")
    ssh_stub(tmp_path, monkeypatch, 'printf "$SSH_ASKPASS_REQUIRE $*\\n"; "$SSH_ASKPASS" prompt\n')
    assert b"".join(paths.ssh_stream("ssh://me@host/x", "ls")).decode() == "force -i /k/id -o IdentitiesOnly=yes -p 22 me@host ls\np'a s\"s\n"


def test_slices_and_tails(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i % 4) for i in range(20)], "i long, g long")
    assert [r["i"] for r in rows.slice_rows(df, 5, 3, ["i"]).collect()] == [5, 6, 7] and rows.slice_rows(df, 30, 3, ["i"]).count() == 0
    assert [r["i"] for r in rows.last_rows(df, 3, ["i"]).collect()] == [17, 18, 19]
    assert [(r["g"], r["i"]) for r in rows.last_rows(df, 20, ["g", "i"]).collect()][:2] == [(None, 3), (0, 0)]


def test_unescaping_is_an_option(spark):
    line = r'a="say \"hi\" \\ there" n="1\2" b=x\y'
    assert scan_text(spark, line).first()["a"] == r'say \"hi\" \\ there'
    got = scan_text(spark, line, ScanOptions(unescape=True, schema={"a": "string", "b": "string", "n": "integer"})).first()
    assert (got["a"], got["b"], got["n"]) == ('say "hi" \\ there', "xy", 12)


def test_several_files(spark, tmp_path):
    seekzst.write(b"a=1\na=2\n", str(tmp_path / "x.log.zst"))
    (tmp_path / "y.log").write_text("a=3\n")
    df = scan_log(spark, [str(tmp_path / "x.log.zst"), str(tmp_path / "y.log")])
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3]


def test_stray_times_do_not_fill_a_bucket(spark):
    times = [-10**15, 10**17, *range(10**12, 10**12 + 20_000)]
    df = spark.createDataFrame([(t,) for t in times], "_t long")
    sizes = [r["count"] for r in bucketed(df, 8).groupBy("_b").count().collect()]
    assert sum(sizes) == len(times) and len(sizes) >= 7 and max(sizes) < 2 * len(times) / 8
    burst = spark.createDataFrame([(t % 3000,) for t in times] + [(10**15,)], "_t long").distinct()
    sizes = [r["count"] for r in bucketed(burst, 8).groupBy("_b").count().collect()]
    assert max(sizes) < 2 * burst.count() / 8
    left, right = df.withColumnRenamed("_t", "t"), df.where("_t % 50 = 0").withColumnRenamed("_t", "u")
    got = asof_join(left, right, "t", "u", allow_equal=True, buckets=8).collect()
    known = sorted(t for t in times if t % 50 == 0)
    assert all(r["u"] == next((u for u in known if u >= r["t"]), None) for r in random.Random(2).sample(got, 300))


def test_command_line_defaults(spark, tmp_path, capsys):
    path = tmp_path / "in" / "a.log"
    path.parent.mkdir()
    path.write_text("k=a n=1\nk=b n=2\nk=a n=3\n")
    assert cli.main(["--source", str(path)], spark) == 0
    out = capsys.readouterr().out
    assert "count" in out and "|3" in out.replace(" ", "") and not path.with_suffix(".parquet").exists()
    assert cli.main(["--source", str(path), "--out"], spark) == 0 and spark.read.parquet(str(path.with_suffix(".parquet"))).count() == 3
    capsys.readouterr()
    folder = tmp_path / "more"
    folder.mkdir()
    (folder / "a.log").write_text(path.read_text())
    assert cli.main(["--source", str(folder), "--streaming", "--agg", "count_by:k"], spark) == 0
    assert "|a|2" in capsys.readouterr().out.replace(" ", "")


def test_errors_reach_the_caller(spark, tmp_path, monkeypatch):
    with pytest.raises(Exception, match="none.log"):
        scan_log(spark, str(tmp_path / "none.log")).collect()
    with pytest.raises(Exception, match="none.log.zst"):
        scan_log(spark, str(tmp_path / "none.log.zst")).collect()
    ssh_stub(tmp_path, monkeypatch, "echo 'connect to host port 9: Connection refused' >&2; exit 255\n")
    with pytest.raises(Exception, match="255"):
        scan_log(spark, "ssh://me@localhost:9/x.log")
    with pytest.raises(OSError, match="255"):
        list(paths.ssh_stream("ssh://me@localhost:9/x", "ls"))


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf, sparkContext = spark.conf, type("C", (), {"master": "yarn"})

    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        assert shared_folder(spark).startswith("file:///tmp/")
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Cluster)
