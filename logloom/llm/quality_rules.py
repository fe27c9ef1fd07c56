"""Quality rules: base counts of each text, and robust multivariate outliers per language and source.

A text's counts become a vector of transformed shares. For each language and source, each language, and all rows, the minimum
covariance determinant is approached by concentration: COVERAGE of the rows nearest by Mahalanobis distance give the next mean
and covariance, with the consistency factor of the normal distribution. It begins at four starts (median and quartiles; the same
with correlations of squashed, and of projected, vectors; a quarter of the rows by hash), takes two steps from each, goes on from the
lowest determinant and stops when no determinant changes by TOLERANCE. At every step a group's mean and covariance are weighed against those
of its language, and a language's against those of all rows, by their numbers of rows and PRIOR: the fewer rows, the more the wider group
counts, by one formula for every size. Quantiles and moments are partial aggregates of all rows, so that no task holds a group.
A vector further off than CUTOFF is rejected.

Null texts have no words and fail the base rule, as do all texts of fewer than MIN_WORDS; null languages and sources are values
like others; repeated rows count each; an empty table gives no rows. Columns besides doc_id, text, lang and source pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import join_small, kind, map_batches, table, texts, utf8, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Share of rows that the estimates rest on; change of a log determinant that ends the steps, and their greatest number.
COVERAGE, TOLERANCE, STEPS = 0.75, 1e-3, 30
#: Rows that the wider group counts for.
PRIOR = 100
#: Lines and words that are added to a text's own in the shares of repeated ones, as one repeated line of a short text says little.
MORE_LINES, MORE_WORDS = 8, 100
#: Least standard deviation of each component, in the units of measure().
FLOORS = (0.06, 0.04, 0.08, 0.08, 0.05, 0.05)
#: Squared distance above which a row is rejected: the 1 - 1e-7 quantile of chi-squared with six degrees of freedom.
TAIL = 1e-7

DIM = len(FLOORS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = bytes(range(9, 14)) + b" "
_UPPER, _MARKS = bytes(range(65, 91)), b".,;:!?"


def chi2_cdf(x: float, even_dim: int) -> float:
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(even_dim // 2))


def chi2_quantile(p: float, even_dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, even_dim) < p else (low, mid)
    return low


CUTOFF = chi2_quantile(1 - TAIL, DIM)
#: What makes the covariance of the nearest COVERAGE of normal rows that of all.
CONSISTENCY = COVERAGE / chi2_cdf(chi2_quantile(COVERAGE, DIM), DIM + 2)


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    _, two = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, inverse, counts = np.unique(two[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(w), bool)
    twice = counts[inverse] > 1
    for k in range(3):
        hit[k : n + k] |= twice
    return int(hit.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS, then capital letters, marks and lines with a word."""
    data = utf8(text)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    without = lambda drop: len(data) - len(data.translate(None, drop))
    return (len(words), len(data.translate(None, _CONTINUATION + _SPACE)), without(SYMBOLS), len(lines) - len(set(lines)), repeated(words), without(_UPPER), without(_MARKS), len(lines))


def measure(batch) -> tuple[np.ndarray, np.ndarray]:
    """counts() of each text, and vectors of: log word length, and square roots of the shares of symbols, repeated lines, repeated words, capitals and marks."""
    c = np.array([counts(t) for t in batch], np.int64).reshape(-1, 8)
    some = np.maximum(c, 1).astype(float)
    shares = ((2, 1, 0), (3, 7, MORE_LINES), (4, 0, MORE_WORDS), (5, 1, 0), (6, 1, 0))
    return c, np.stack([np.log(some[:, 1] / some[:, 0]), *(np.sqrt(c[:, a] / (some[:, b] + more)) for a, b, more in shares)], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source with COUNTS and the vector x."""

    def apply(batch: pa.RecordBatch) -> dict:
        c, x = measure(texts(batch))
        return {k: c[:, i] for i, k in enumerate(COUNTS)} | {"x": x.tolist()}

    rows = docs.select("doc_id", "lang", "source", "text")
    return map_batches(rows, ", ".join(f"{c} {kind(docs, c)}" for c in ("doc_id", "lang", "source")) + "".join(f", {k} bigint" for k in COUNTS) + ", x array<double>", apply)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _named(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def _levels(rows: DataFrame) -> DataFrame:
    """Rows (l, s, x) once for all rows, once for their language, once for language and source: g, wider (the next group up), x."""
    every, lang = F.lit("*"), F.concat(F.lit("l"), F.col("l"))
    source = F.concat(F.lit("s"), F.length("l").cast("string"), F.lit(":"), F.col("l"), F.col("s"))
    part = lambda g, wider: F.struct(g.alias("g"), wider.alias("wider"))
    return rows.select(F.explode(F.array(part(every, F.lit(None).cast("string")), part(lang, every), part(source, lang))).alias("i"), "x").select("i.g", "i.wider", "x")


_ESTIMATE = "g string, wider string, start int, size bigint, mean array<double>, cov array<double>, precision array<double>, log_det double"


def _moments(rows: DataFrame, x: str = "x") -> DataFrame:
    """Rows in groups (g, wider, start, size) -> n, s (sums) and ss (sums of products)."""
    return rows.groupBy("g", "wider", "start", "size").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(F.col(x)[i]) for i in range(DIM))).alias("s"),
        F.array(*(F.sum(F.col(x)[i] * F.col(x)[j]) for i in range(DIM) for j in range(i, DIM))).alias("ss"),
    )


def _cov(n: float, s: list, ss: list) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = np.array(s, float) / n, np.zeros((DIM, DIM))
    cov[np.triu_indices(DIM)] = np.array(ss, float) / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, cov


def shrunk(n: float, own: np.ndarray, wider: np.ndarray | None) -> np.ndarray:
    """An estimate of n rows weighed against the wider group's, which counts for PRIOR rows."""
    return own if wider is None else (n * own + PRIOR * wider) / (n + PRIOR)


def _estimate(g: str, wider: str | None, start: int, size: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    full = cov + np.diag(np.square(FLOORS))
    return g, wider, start, size, mean.tolist(), cov.ravel().tolist(), np.linalg.inv(full).ravel().tolist(), float(np.linalg.slogdet(full)[1])


def _mapped(rows: DataFrame, one) -> DataFrame:
    """_ESTIMATE rows: one(row) for each row."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(r) for r in frame.itertuples()], columns=[x.split()[0] for x in _ESTIMATE.split(", ")])

    return rows.mapInPandas(apply, _ESTIMATE)


def starts(rows: DataFrame) -> DataFrame:
    """_levels() rows -> the four starts of each group."""
    quartiles = rows.groupBy("g", "wider").agg(F.count("*").alias("size"), *(F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(DIM)))
    scale = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2)
    known = quartiles.select("g", "wider", "size", F.array(*(F.col(f"q{i}")[1] for i in range(DIM))).alias("middle"), F.array(*(scale(i) for i in range(DIM))).alias("scale"))
    known = written(known, "quartiles")
    z = F.array(*((F.col("x")[i] - F.col("middle")[i]) / F.col("scale")[i] for i in range(DIM)))
    held = join_small(rows.drop("wider"), known, ["g"], "inner").select("g", "wider", "size", z.alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(1e-12), lambda a, v: a + v * v))
    quarter = F.when(F.xxhash64("z") % 4 == 0, F.col("z"))
    held = held.select("g", "wider", "size", F.posexplode(F.array(F.transform("z", lambda v: F.tanh(v)), F.transform("z", lambda v: v / norm), quarter)).alias("k", "y")).where("y IS NOT NULL")
    sums = _moments(held.select("g", "wider", "size", (F.col("k") + 1).cast("int").alias("start"), "y"), "y")
    none = F.array(*(F.lit(0.0) for _ in range(DIM)))
    ss = F.array(*(F.lit(float(i == j)) for i in range(DIM) for j in range(i, DIM)))
    sums = sums.unionByName(known.select("g", "wider", F.lit(0).alias("start"), "size", F.lit(1).cast("bigint").alias("n"), none.alias("s"), ss.alias("ss")))
    sums = join_small(sums, known.select("g", "middle", "scale"), ["g"], "inner")

    def one(r) -> tuple:
        mean, cov = _cov(r.n, r.s, r.ss)
        scale = np.array(r.scale)
        if r.start in (1, 2):  # correlations only
            size = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            mean, cov = mean * 0, cov / np.outer(size, size)
        cov = shrunk(r.n, cov, np.eye(DIM))
        return _estimate(r.g, r.wider, r.start, r.size, np.array(r.middle) + scale * mean, cov * np.outer(scale, scale))

    return written(_mapped(sums, one), "starts")


def concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One step from every estimate: the nearest rows' mean and covariance, weighed against the wider group's best."""
    far = join_small(rows.drop("wider"), now.select("g", "wider", "start", "size", "mean", "precision"), ["g"], "inner").select("g", "wider", "start", "size", "x", distance().alias("d"))
    cuts = written(far.groupBy("g", "start").agg(F.percentile_approx("d", COVERAGE, 10_000).alias("cut")), "cuts")
    sums = _moments(join_small(far, cuts, ["g", "start"], "inner").where("d <= cut"))
    above = written(best(now).select(F.col("g").alias("wider"), F.col("mean").alias("wider_mean"), F.col("cov").alias("wider_cov")), "wider")

    def one(r) -> tuple:
        mean, cov = _cov(r.n, r.s, r.ss)
        cov = cov * CONSISTENCY
        if r.wider_mean is not None:
            mean, cov = shrunk(r.n, mean, np.array(r.wider_mean)), shrunk(r.n, cov, np.array(r.wider_cov).reshape(DIM, DIM))
        return _estimate(r.g, r.wider, r.start, r.size, mean, cov)

    return written(_mapped(join_small(sums, above, ["wider"]), one), "estimates")


def best(estimates: DataFrame) -> DataFrame:
    """For each group the estimate of the lowest determinant."""
    columns = F.struct("log_det", *(c for c in estimates.columns if c not in ("g", "log_det")))
    return estimates.groupBy("g").agg(F.min(columns).alias("e")).select("g", *(f"e.{c}" for c in estimates.columns if c != "g"))


def fit(rows: DataFrame) -> DataFrame:
    """_levels() rows -> g, mean, precision for each group. Without the column wider, groups stand alone."""
    rows = rows if "wider" in rows.columns else rows.withColumn("wider", F.lit(None).cast("string"))
    now = concentrated(rows, concentrated(rows, starts(rows)))
    now = written(best(now), "best")
    for _ in range(STEPS):
        after = concentrated(rows, now)
        moved = after.select("g", F.col("log_det").alias("to")).join(now, "g").where(F.abs(F.col("to") - F.col("log_det")) > TOLERANCE)
        now, still = after, moved.isEmpty()
        if still:
            break
    return now.select("g", "mean", "precision")


def fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """measured() rows with base_failed and the names l, s of their group; and l, s, mean, precision for every language and source."""
    rows = written(measured(docs).withColumns({"base_failed": base_failed(), "l": _named("lang"), "s": _named("source")}), "measured")
    good = rows.where(~F.col("base_failed"))
    model = fit(_levels(good.select("l", "s", "x")))
    names = good.select("l", "s").distinct().select("l", "s", F.concat(F.lit("s"), F.length("l").cast("string"), F.lit(":"), "l", "s").alias("g"))
    return rows, written(names.join(model, "g").select("l", "s", "mean", "precision"), "model")


def distance(mean: str = "mean", precision: str = "precision") -> Column:
    z = [F.col("x")[i] - F.col(mean)[i] for i in range(DIM)]
    return sum((z[i] * z[j] * F.col(precision)[i * DIM + j] * F.lit(1.0 if i == j else 2.0) for i in range(DIM) for j in range(i, DIM)), F.lit(0.0))


def verdict(failed: np.ndarray, x: np.ndarray, means: list, precisions: list, cutoff: float) -> tuple[np.ndarray, list[float | None]]:
    """Whether each row is kept, and its squared distance; null where no group was fitted, which only rows that fail the base rule can meet."""
    d2: list[float | None] = []
    for v, mean, precision in zip(x, means, precisions, strict=True):
        z = None if mean is None else v - np.array(mean)
        d2.append(None if z is None else float(z @ np.array(precision).reshape(DIM, DIM) @ z))
    return ~failed & np.array([d is None or d <= cutoff for d in d2], bool), d2


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, d2 (squared distance; null if no group was fitted) and kept for every row of docs."""
    rows, model = fitted(docs)

    def apply(batch: pa.RecordBatch) -> dict:
        x = np.array(texts(batch, "x"), float).reshape(-1, DIM)
        kept, d2 = verdict(np.array(texts(batch, "base_failed"), bool), x, texts(batch, "mean"), texts(batch, "precision"), cutoff)
        return {"kept": kept, "d2": d2}

    out = join_small(rows, model, ["l", "s"])
    schema = rows.drop("l", "s", "x").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(None).cast("boolean")}).schema
    return map_batches(out, schema, apply)


def keep(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts are measured again where they lie instead of being joined to verdicts."""
    model = fitted(docs)[1].select(F.col("l").alias("_l"), F.col("s").alias("_s"), F.col("mean").alias("_mean"), F.col("precision").alias("_precision"))

    def apply(batch: pa.RecordBatch) -> dict:
        c, x = measure(texts(batch))
        failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
        return {None: verdict(failed, x, texts(batch, "_mean"), texts(batch, "_precision"), cutoff)[0]}

    rows = join_small(docs.withColumns({"_l": _named("lang"), "_s": _named("source")}), model, ["_l", "_s"])
    return map_batches(rows.select(*(F.col(f"`{c}`") for c in docs.columns), "_mean", "_precision"), docs.schema, apply)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).select("doc_id", *COUNTS, "base_failed", "kept")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_quality_rules that its base rule gives, which SQL can express too."""
    rows = measured(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"))


BASE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c
"""
