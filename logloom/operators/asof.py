"""As-of joins: to each left row the nearest right row in time, without any pair being made."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import staged


def bucketed(both: DataFrame, buckets: int | None = None, then: Sequence[str | Column] = ()) -> DataFrame:
    """Rows of a time _t, written with the number _b of their bucket of time: range partitions, whose bounds follow a sample of the times, so that neither
    stray times nor bursts fill one bucket; equal times share one, or go by what orders them (_n is then left out). Without a number, as many as shuffles have, fewer if they are small."""
    dealt = both.repartitionByRange(buckets, "_t", *then) if buckets else both.repartitionByRange("_t", *then)
    return staged(dealt.withColumn("_b", F.spark_partition_id()).drop("_n"), "asof")


def next_index(times: Sequence, at) -> int | None:
    """For a sorted list in memory: the index of the first time that is not before `at`."""
    i = bisect_left(times, at)
    return i if i < len(times) else None


def _number(df: DataFrame, name: str) -> Column:
    """A time or number as a number: times in microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(f"`{name}`"))
    return F.unix_micros(f"`{name}`") if isinstance(kind, T.TimestampType) else F.col(f"`{name}`").cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "bigint")


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), direction: str = "forward", allow_equal: bool = False, tolerance: float | None = None, first_by: Sequence[str] = (), suffix: str = "_right", buckets: int | None = None
) -> DataFrame:
    """All left rows, with the columns of the nearest right row later (forward), earlier (backward) or either (nearest; forward on ties).

    Of right rows of one time, the one that is first by first_by counts. tolerance is in microseconds for times. Left rows without a match, and those
    of null time, get nulls; null keys are equal. The rows of both sides are dealt to buckets of about as many each, in one order of time, right rows by first_by and left
    rows by a hash, so that a time which many rows share fills no bucket (rows that are the same in all columns stay together); a task of its own sorts each, and left
    rows take their answer along. A bucket that holds no answer gets it from a table with one row for each bucket.
    """
    if direction == "nearest":
        return _nearest(left, right, left_on, right_on, by, allow_equal, tolerance, first_by, suffix, buckets)
    sign = 1 if direction == "forward" else -1
    atomic = lambda df: [c for c in df.columns if isinstance(df.schema[c].dataType, T.AtomicType)]
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in by}
    order = [F.col("_r").getField(names[c]) for c in first_by or atomic(right) if c not in by]
    lefts = left.select(*by, (_number(left, left_on) * sign).alias("_t"), F.struct(*(F.col(f"`{c}`").alias(c) for c in left.columns)).alias("_l"), (F.hash(*(F.col(f"`{c}`") for c in atomic(left))) % 1000).alias("_n"))
    rights = right.where(F.col(f"`{right_on}`").isNotNull()).select(*by, (_number(right, right_on) * sign).alias("_t"), F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).alias("_r"))
    # equal times: a right row that may match stands after the left row, one that may not before it
    lefts = lefts.withColumns({"_r": F.lit(None).cast(rights.schema["_r"].dataType), "_s": F.lit(0 if allow_equal else 1)})
    rights = rights.withColumns({"_l": F.lit(None).cast(lefts.schema["_l"].dataType), "_n": F.lit(0), "_s": F.lit(1 if allow_equal else 0)})
    both = bucketed(lefts.unionByName(rights), buckets, ["_s", *order, "_n"])
    firsts = both.groupBy(*by, "_b").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", *order))).alias("_first"))
    later = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(*by, "_b", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    here = Window.partitionBy(*by, "_b").orderBy(F.col("_t").desc(), F.col("_s").desc(), *(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_here", F.last("_r", ignorenulls=True).over(here)).where(F.col("_l").isNotNull())
    found = found.join(firsts if by else F.broadcast(firsts), [found[k].eqNullSafe(firsts[k]) for k in by] + [found["_b"] == firsts["_b"]])
    found = found.select("_l", F.when(found["_t"].isNotNull(), F.coalesce("_here", "_later")).alias("_m"), found["_t"])
    if tolerance is not None:
        at = F.col("_m").getField(names[right_on])
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at) if isinstance(right.schema[right_on].dataType, T.TimestampNTZType) else F.unix_micros(at) if isinstance(right.schema[right_on].dataType, T.TimestampType) else at
        found = found.withColumn("_m", F.when(at * sign - F.col("_t") <= tolerance, F.col("_m")))
    return found.select(*(F.col("_l").getField(c).alias(c) for c in left.columns), *(F.col("_m").getField(n).alias(n) for n in names.values()))


def _nearest(left, right, left_on, right_on, by, allow_equal, tolerance, first_by, suffix, buckets) -> DataFrame:
    after = asof_join(left, right, left_on, right_on, by, "forward", allow_equal, tolerance, first_by, suffix, buckets)
    added = [c for c in after.columns if c not in left.columns]
    both = asof_join(after, right.select(*by, *(F.col(f"`{c}`").alias(f"_before_{c}") for c in right.columns if c not in by)), left_on, f"_before_{right_on}", by, "backward", allow_equal, tolerance, [f"_before_{c}" for c in first_by], suffix, buckets)
    at = right_on + suffix if right_on in left.columns else right_on
    own = _number(both, left_on)
    ahead, behind = _number(both, at) - own, own - _number(both, f"_before_{right_on}")
    use = ahead.isNotNull() & (behind.isNull() | (ahead <= behind))
    source = {c + suffix if c in left.columns else c: c for c in right.columns if c not in by}
    return both.select(*(F.col(f"`{c}`") for c in left.columns), *(F.when(use, F.col(f"`{c}`")).otherwise(F.col(f"`_before_{source[c]}`")).alias(c) for c in added))
