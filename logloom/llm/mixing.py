"""Mixing sources to target weights under a time-varying curriculum; DataFrame operations only.

Every source has a weight schedule over training time 0..1. Its integral, scaled to the source's target, is the
cumulative demand of words; a document stands where that demand reaches the words before it, and the mix is
range-sorted by this position. Null texts have size 0 and are never repeated into words; null sources are a source of
their own, ranked last; repeated rows are separate documents; equal rows get any of their shared places. An empty table
gives an empty mix. Columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, table, word_count, written

#: Weights of the sources in order of name, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most so often.
MAX_REPEAT = 3
#: Relative weight of a source at the start and at the end of training, repeating like WEIGHTS.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
#: Hex digits of the order key that make a bucket: 16 ** 3 buckets for each source, so that no task holds a source.
BUCKET_DIGITS = 3


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> rank, target: weights share all words; a target stops at max_repeat times its source's size, and the excess is shared again.

    With sources in order of cap/weight, the first k are capped where the level that the rest then share is the first to lie
    below the next cap. One row for each source: the windows without a key see the sources only, never the documents.
    """
    fill = Window.orderBy("ratio", "rank")
    capped = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", _pick(weights, F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    levels = (
        capped.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("below", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("below")) / F.col("left"))
    )
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return levels.withColumn("target", F.coalesce(F.least(F.col("weight") * level, F.col("cap")), F.col("cap"))).select("source", "rank", "source_size", "target")


def position(share: Column, start: Column, end: Column) -> Column:
    """The time at which a linear schedule from start to end has met this share of its integral."""
    rise = end - start
    area = (start + end) / 2
    return F.when(F.abs(rise) < 1e-12, share).otherwise((F.sqrt(start * start + 2 * rise * share * area) - start) / rise)


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT, carry: tuple[str, ...] = (), sort: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, positions (of the copies taken, in order), and the columns to carry, for every row of docs, sorted by first position.

    The order in a source is that of an MD5 of the row; words before a document are those of earlier buckets plus those
    before it in its own bucket. Copy e of a document stands e * source_size further on; it is taken if its middle lies
    below the target.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("_key"), F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"), name.alias("_source"), *(F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry))
    rows = rows if carry else written(rows, "mix")
    buckets = written(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"), F.first("source").alias("source")), "mix-buckets")
    sizes = buckets.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes.select("source", "source_size"), weights, max_repeat).withColumn("_source", name).drop("source")
    earlier = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_words")
    starts = buckets.select("_source", "_bucket", earlier.alias("_start")).join(targets, "_source")
    inner = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_inner", F.sum("size").over(inner) - F.col("size")).join(starts, ["_source", "_bucket"])
    middle = F.col("_start") + F.col("_inner") + F.col("size") / F.lit(2.0)
    start, end = (_pick(tuple(s[i] for s in schedules), F.col("rank")) for i in (0, 1))
    at = lambda e: middle + F.lit(float(e)) * F.col("source_size")
    copies = sum(((at(e) < F.col("target")).cast("long") for e in range(max_repeat)), F.lit(0).cast("long"))
    positions = F.filter(F.array(*(F.when(at(e) < F.col("target"), position(at(e) / F.col("target"), start, end)) for e in range(max_repeat))), lambda p: p.isNotNull())
    out = placed.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), positions.alias("positions"), *(F.col(f"_carry_{c}").alias(c) for c in carry))
    if not sort:
        return out
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))  # documents that are not taken stand behind
    return out.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")


def training_order(docs: DataFrame, carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """A row for each copy that the mix takes, sorted by position: position, copy (from 0), doc_id, source, size and the columns to carry."""
    own = docs.select("doc_id", "source", "text", *(F.col(f"`{c}`").alias(f"_own_{c}") for c in carry))
    taken = mix(own, carry=tuple(f"_own_{c}" for c in carry), sort=False)
    taken = taken.select("doc_id", "source", "size", *(f"`_own_{c}`" for c in carry), F.posexplode("positions").alias("copy", "position"))
    out = taken.select("position", "copy", "doc_id", "source", "size", *(F.col(f"`_own_{c}`").alias(c) for c in carry))
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "copy")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below,
         sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM r),
v AS (SELECT *, (total - below) / rest AS level FROM l),
t AS (
  SELECT source, source_size, coalesce(least(weight * (SELECT max(level) FROM v WHERE level <= ratio), cap), cap) AS target FROM v),
p AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (((middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2.0 * source_size < target)::BIGINT) * p.size)::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
