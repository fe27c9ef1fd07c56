"""Schemas of lines: inferred from the first of them, widened, turned into Spark types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..functions.tokenizer import last_key_wins, parse_map

NO_LINE = "no line with pairs found in the source; pass a schema to scan an empty source"


def in_order(names: Iterable[str]) -> list[str]:
    """Columns stand in order of their keys' bytes."""
    return sorted(names, key=lambda n: n.encode("utf-8", "surrogatepass"))


def merge_kinds(a: str, b: str) -> str:
    """What holds both: numbers widen to floats, all else to text."""
    return a if a == b else "float" if {a, b} == {"integer", "float"} else "string"


def merge(schemas: Iterable[dict[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for schema in schemas:
        for name, kind in schema.items():
            out[name] = merge_kinds(out[name], kind) if name in out else kind
    return {n: out[n] for n in in_order(out)}


def struct_type(schema: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, values.SPARK_TYPES[schema[n]]) for n in in_order(schema)])


def kinds_of_frame(df: DataFrame) -> dict[str, str]:
    """The schema of a scan's rows, for another scan; durations are the numbers that they are there."""
    kinds = {kind.simpleString(): name for name, kind in reversed(values.SPARK_TYPES.items()) if name not in ("duration", "auto")}
    return {f.name: kinds[f.dataType.simpleString()] for f in df.schema}


def infer_from_rows(rows: DataFrame, column: str = "row") -> dict[str, str]:
    """The schema that all rows (maps of text) have together; kinds of a key meet in an aggregate, so that only keys come to the driver."""
    tags = rows.select(F.explode(column).alias("k", "v")).select("k", values.infer_type(F.col("v")).alias("t")).distinct()
    return merge({r["k"]: r["t"]} for r in tags.groupBy("k", "t").count().collect())


def infer(lines: DataFrame, n: int | None = 1, line_filter: Column | None = None, compat: bool = True, column: str = "value") -> dict[str, str]:
    """The schema of the first n lines that have text and pass the filter; None takes all lines."""
    last_key_wins(lines.sparkSession)
    some = lines.where(F.trim(F.regexp_replace(column, r"\s+", "")) != "")
    some = some.where(line_filter) if line_filter is not None else some
    some = some if n is None else some.limit(n)
    out = infer_from_rows(some.select(parse_map(F.col(column), compat).alias("row")))
    if not out:
        raise ValueError(NO_LINE)
    return out
