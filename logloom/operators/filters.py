"""A small filter language, and time ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import parse_rfc3339, py_rfc3339


@dataclass(frozen=True)
class FilterSpec:
    """op: "always", "=", "!=", "~" (contains) or "!~"."""

    op: str = "always"
    key: str = ""
    value: str = ""


def parse_filter(text: str | None) -> FilterSpec:
    """key=value, key!=value, key~part, key!~part; nothing lets all rows pass. Of several operators, !~ counts first, then ~, != and =."""
    text = (text or "").strip()
    if not text:
        return FilterSpec()
    for op in ("!~", "~", "!=", "="):
        key, found, value = text.partition(op)
        if found:
            if not key.strip() or not value.strip():
                raise ValueError(f"filter needs a key and a value: {text}")
            return FilterSpec(op, key.strip(), value.strip())
    raise ValueError(f"filter has no operator: {text}")


def filter_condition(value: Column, spec: FilterSpec) -> Column:
    """The condition on a key's text (null where the key is absent): absent keys pass the negative operators only."""
    equal, held = value.eqNullSafe(F.lit(spec.value)), F.coalesce(F.contains(value, F.lit(spec.value)), F.lit(False))
    return {"=": equal, "!=": ~equal, "~": held, "!~": ~held}.get(spec.op, F.lit(True))


def filter_map(row: Column, text: str | FilterSpec | None) -> Column:
    """For a map of keys to texts."""
    spec = text if isinstance(text, FilterSpec) else parse_filter(text)
    return filter_condition(F.try_element_at(row, F.lit(spec.key)), spec)


def filter_rows(df: DataFrame, text: str | FilterSpec | None) -> DataFrame:
    """For columns; one that does not exist is absent from every row."""
    spec = text if isinstance(text, FilterSpec) else parse_filter(text)
    if spec.op == "always":
        return df
    return df.where(filter_condition(F.col(f"`{spec.key}`").cast("string") if spec.key in df.columns else F.lit(None).cast("string"), spec))


def in_time_range(text: Column, start: str, end: str) -> Column:
    """Whether an RFC 3339 text lies from start to end, both included; other texts and nulls do not."""
    return F.coalesce(parse_rfc3339(text).between(*_bounds(start, end)), F.lit(False))


def _bounds(start: str, end: str) -> tuple[Column, Column]:
    out = []
    for x in (start, end):
        if (at := py_rfc3339(x)) is None:
            raise ValueError(f"not an RFC 3339 time: {x}")
        out.append(F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"))
    return out[0], out[1]


def filter_time_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows of a time range; the column holds RFC 3339 texts or times. A frame without the column stays as it is."""
    if column not in df.columns:
        return df
    name = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.where(in_time_range(name, start, end))
    if isinstance(df.schema[column].dataType, T.TimestampType):
        name = F.timestamp_add("MICROSECOND", F.unix_micros(name), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return df.where(F.coalesce(name.between(*_bounds(start, end)), F.lit(False)))
