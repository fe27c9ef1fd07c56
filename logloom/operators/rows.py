"""Row numbers, orders, limits, unions and the aggregates that logs are usually asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import in_order


def row_index(df: DataFrame, order: Sequence[Column | str] = (), name: str = "id") -> DataFrame:
    """Consecutive numbers from 0, in an order if one is given.

    Rows are range-sorted and counted by partition; a partition's numbers start after the counts before it, so that no task sees all rows.
    """
    from pyspark.sql.internal import InternalFunction

    rows = df.orderBy(*order) if order else df
    return rows.select(InternalFunction.distributed_sequence_id().alias(name), "*")


def sort(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    """Sorted with nulls first, either way."""
    return df.orderBy(*(F.col(f"`{c}`").desc_nulls_first() if descending else F.col(f"`{c}`").asc_nulls_first() for c in columns))


def first_rows(df: DataFrame, n: int, order: Sequence[Column | str] = ()) -> DataFrame:
    """The first n rows in an order (a top-k, without a full sort), or any n."""
    return (df.orderBy(*order) if order else df).limit(n)


def slice_rows(df: DataFrame, offset: int, n: int, order: Sequence[Column | str]) -> DataFrame:
    """n rows from an offset on, in an order."""
    return df.orderBy(*order).offset(offset).limit(n)


def last_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last n rows in an order of columns (nulls first): the first n of the opposite order, turned round again."""
    return sort(sort(df, *order, descending=True).limit(n), *order)


def sum_of(column: str, kind: str = "bigint") -> Column:
    """A sum that is 0 over no values."""
    return F.coalesce(F.sum(F.col(f"`{column}`").cast(kind)), F.lit(0).cast(kind))


def sum_first(df: DataFrame, keys: Sequence[str], total: str, first: str, order: str, names: tuple[str, str]) -> DataFrame:
    """For each group the sum of one column and another's value in the row that is first in order."""
    return df.groupBy(*keys).agg(sum_of(total).alias(names[0]), F.min_by(F.col(f"`{first}`"), F.col(f"`{order}`")).alias(names[1]))


def with_total(df: DataFrame, column: str, name: str) -> DataFrame:
    """The column's sum over all rows beside every row; the sum is one row, made from partial sums."""
    total = df.agg(sum_of(column).alias(name))
    return df.crossJoin(F.broadcast(total))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(f"`{column}`").distinct()


def aggregate(df: DataFrame, plan: str = "count") -> dict[str, DataFrame]:
    """count, count_by:COLUMN and bytes_sum:COLUMN, in a list with commas."""
    out: dict[str, DataFrame] = {}
    for item in filter(None, map(str.strip, plan.split(","))):
        what, _, column = item.partition(":")
        if what == "count":
            out[item] = df.agg(F.count("*").alias("count"))
        elif what == "count_by" and column:
            out[item] = df.groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("count"))
        elif what == "bytes_sum":
            out[item] = df.agg(sum_of(column or "bytes").alias("bytes_sum"))
        else:
            raise ValueError(f"unknown aggregate: {item}")
    return out


def union_of_keys(rows: DataFrame, column: str = "row") -> DataFrame:
    """A column of maps as columns of text: all keys there are, in order; null where a row has none. Only the distinct keys come to the driver."""
    keys = in_order(r["k"] for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().collect())
    return rows.select(*(F.try_element_at(F.col(column), F.lit(k)).alias(k) for k in keys))


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames below each other; missing columns are null, columns in order of names."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*(F.col(f"`{c}`") for c in in_order(out.columns)))
