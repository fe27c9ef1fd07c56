"""op5: the determinant that is reached, groups of few rows, long repetitive texts."""

import itertools
import math
import random

import numpy as np
import pytest

from logloom.llm import quality_rules as q
from logloom.llm.base import written


def made(rng, n):
    return " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def log_det(x, inside):
    cov = np.cov(x[inside].T, bias=True) * q.CONSISTENCY + np.diag(np.square(q.FLOORS))
    return np.linalg.slogdet(cov)[1]


def plain_mcd(x, rng, tries=200):
    """The lowest log determinant that concentration reaches from many random starts."""
    h, out = math.ceil(q.COVERAGE * len(x)), np.inf
    for _ in range(tries):
        inside = rng.choice(len(x), q.DIM + 2, replace=False)
        for _ in range(30):
            mean = x[inside].mean(axis=0)
            inv = np.linalg.inv(np.cov(x[inside].T, bias=True) * q.CONSISTENCY + np.diag(np.square(q.FLOORS)))
            inside = np.argsort(np.einsum("ij,jk,ik->i", x - mean, inv, x - mean), kind="stable")[:h]
        out = min(out, log_det(x, inside))
    return out


def test_determinant_is_that_of_many_starts(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, q.DIM)) @ rng.normal(0, 0.4, (q.DIM, q.DIM))
    x[:60] = rng.normal(0, 0.2, (60, q.DIM)) + 4  # a cloud of its own, which hides in classical estimates
    rows = written(spark.createDataFrame([("g", v.tolist()) for v in x], "g string, x array<double>"), "x")
    got = q.fit(rows).collect()
    assert len(got) == 1
    det = -np.linalg.slogdet(np.array(got[0]["precision"]).reshape(q.DIM, q.DIM))[1]
    assert det == pytest.approx(plain_mcd(x, rng), abs=0.05)


def test_small_groups_lean_on_wider_ones(spark):
    rng = np.random.default_rng(4)
    draw = lambda n, at: (rng.normal(0, 0.3, (n, q.DIM)) + at).tolist()
    data = [("=en", "=big", v) for v in draw(2000, 0)] + [("=en", "=mid", v) for v in draw(100, 1)] + [("=en", "=one", [9.0] * q.DIM)] + [("=de", "=x", v) for v in draw(500, 2)]
    rows = written(spark.createDataFrame(data, "l string, s string, x array<double>"), "rows")
    got = {r["g"]: np.array(r["mean"]) for r in q.fit(q._levels(rows)).collect()}
    assert len(got) == 1 + 2 + 4
    at = lambda g: float(got[g].mean())
    assert abs(at("s3:=en=big")) < 0.1 and 0.3 < at("s3:=en=mid") < 0.6 and 1.7 < at("s3:=de=x") < 2
    assert at("s3:=en=one") == pytest.approx((9 + q.PRIOR * at("l=en")) / (1 + q.PRIOR), abs=0.02)  # one row hardly moves what it is judged by
    sizes = [float(np.ravel(q.shrunk(n, np.array([1.0]), np.array([0.0])))[0]) for n in range(1, 1000)]
    assert all(0 < b - a < 0.01 for a, b in itertools.pairwise(sizes))  # the weight has no step at any size


def test_long_repetitive_texts_are_rejected(spark):
    rng = random.Random(5)
    clean = [(i, "\n".join(made(rng, 30).capitalize() + "." for _ in range(rng.randint(2, 12))), "en", f"s{i % 5}") for i in range(600)]
    once = [(700 + i, "\n".join([line := made(rng, 8), t, line]), "en", "s1") for i, t, *_ in clean[:20]]  # one short line again
    lines = [made(rng, 3) for _ in range(20)]
    bad = [(1000 + i, "\n".join([made(rng, 300), *rng.choices(lines, k=70)]), "en", f"s{i}") for i in range(5)]
    docs = written(spark.createDataFrame(clean + once + bad, "doc_id long, text string, lang string, source string"), "docs")
    judged = {r["doc_id"]: r for r in q.judge(docs).collect()}
    assert not any(judged[r[0]]["base_failed"] or judged[r[0]]["kept"] for r in bad)
    assert all(judged[r[0]]["kept"] for r in clean + once)
    assert {r["doc_id"] for r in q.keep(docs).collect()} == {i for i, r in judged.items() if r["kept"]}
