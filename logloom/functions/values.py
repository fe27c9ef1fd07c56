"""Values of lines: types told from text, casts, timestamps with offsets, durations in words."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
TRUE, FALSE = ("true", "yes", "on"), ("false", "no", "off")
#: Nanoseconds of each unit name.
UNITS = {
    **dict.fromkeys(("nanos", "nsec", "ns"), 1),
    **dict.fromkeys(("usec", "us"), 10**3),
    **dict.fromkeys(("millis", "msec", "ms"), 10**6),
    **dict.fromkeys(("seconds", "second", "secs", "sec", "s"), 10**9),
    **dict.fromkeys(("minutes", "minute", "mins", "min", "m"), 60 * 10**9),
    **dict.fromkeys(("hours", "hour", "hrs", "hr", "h"), 3600 * 10**9),
    **dict.fromkeys(("days", "day", "d"), 86400 * 10**9),
    **dict.fromkeys(("weeks", "week", "wks", "wk", "w"), 7 * 86400 * 10**9),
    **dict.fromkeys(("months", "month", "M"), 2_630_016 * 10**9),
    **dict.fromkeys(("years", "year", "yrs", "yr", "y"), 31_557_600 * 10**9),
}
_UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
_STEP = rf"([0-9]+(?:\.[0-9]+)?)[ \t]*({_UNIT})(?![A-Za-z])"
DURATION = rf"^[ \t]*({_STEP}[ \t]*)+$".replace("([0-9]+(?:", "(?:[0-9]+(?:").replace(f"({_UNIT})", f"(?:{_UNIT})")
#: Column types.
SPARK_TYPES = {"string": T.StringType(), "auto": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.TimestampNTZType(), "duration": T.LongType()}
DEFAULTS = {"string": "", "auto": "", "integer": 0, "float": 0.0, "boolean": False, "duration": 0}


def parse_rfc3339(v: Column) -> Column:
    """The instant of an RFC 3339 text as UTC wall clock (without zone), else null; whatever the session's time zone."""
    at = F.unix_micros(F.try_to_timestamp(F.when(v.rlike(RFC3339), F.upper(v))))
    return F.timestamp_add("MICROSECOND", at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_duration(v: Column) -> Column:
    """Microseconds of a duration such as "1h 30m", "500ms" or "0.123s"; else null. What is below a microsecond is cut."""
    nanos = F.create_map(*(F.lit(x) for u, n in UNITS.items() for x in (u, n)))
    some = F.when(v.rlike(DURATION), v)
    parts = F.zip_with(F.regexp_extract_all(some, F.lit(_STEP), F.lit(1)), F.regexp_extract_all(some, F.lit(_STEP), F.lit(2)), lambda n, u: F.floor(n.cast("decimal(28,9)") * F.element_at(nanos, u).cast("decimal(18,0)")).cast("decimal(38,0)"))
    return F.try_divide(F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)")), F.lit(1000)).try_cast("decimal(38,6)").try_cast("bigint")


def format_duration(micros: Column) -> Column:
    """A duration in words: "1h 30m", "500ms", "0s"."""
    rest, parts = micros, []
    for unit, size in (("years", 31_557_600_000_000), ("months", 2_630_016_000_000), ("days", 86_400_000_000), ("h", 3_600_000_000), ("m", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("us", 1)):
        n = F.floor(rest / size).cast("bigint")
        name = F.when(n == 1, F.lit(unit[:-1])).otherwise(F.lit(unit)) if unit in ("years", "months", "days") else F.lit(unit)
        parts.append(F.when(rest >= size, F.concat(n.cast("string"), name)))
        rest = rest % size
    return F.when(micros == 0, F.lit("0s")).otherwise(F.concat_ws(" ", *parts))


def infer_type(v: Column) -> Column:
    """The kind that a text is taken for, in this order: datetime, integer, duration, float, boolean, string."""
    return (
        F.when(parse_rfc3339(v).isNotNull(), "datetime")
        .when(v.rlike(INTEGER) & v.try_cast("bigint").isNotNull(), "integer")
        .when(parse_duration(v).isNotNull(), "duration")
        .when(v.rlike(FLOAT), "float")
        .when(F.lower(v).isin(*TRUE, *FALSE), "boolean")
        .when(v.isNotNull(), "string")
    )


def typed(v: Column, kind: str, fill: bool) -> Column:
    """A text as a value of a kind. Text that is none of the kind is 0, 0.0, false or a null time; missing text is null, or with fill the kind's default."""
    missing = F.lit(DEFAULTS.get(kind) if fill else None).cast(SPARK_TYPES[kind])
    if kind in ("string", "auto"):
        return F.coalesce(v, missing) if fill else v
    if kind == "datetime":
        return parse_rfc3339(v)
    if kind == "boolean":
        return F.coalesce(F.lower(v).isin(*TRUE), missing)
    value = parse_duration(v) if kind == "duration" else F.when(v.rlike(INTEGER if kind == "integer" else FLOAT), v.try_cast(SPARK_TYPES[kind]))
    return F.coalesce(value, F.when(v.isNotNull(), F.lit(DEFAULTS[kind]).cast(SPARK_TYPES[kind])), missing)


def as_string(value: Column, kind: str) -> Column:
    """A typed value as text: times in RFC 3339 (UTC), durations in words."""
    if kind == "datetime":
        fraction = F.regexp_replace(F.date_format(value, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    return format_duration(value) if kind == "duration" else value.cast("string")


def convert(value: Column, source: str, target: str) -> Column:
    """A typed value as another kind: times and texts become numbers only where they are numbers; durations are microseconds as integers, seconds as floats."""
    if source == target:
        return value
    if target in ("string", "auto"):
        return as_string(value, source)
    zero = F.lit(DEFAULTS.get(target)).cast(SPARK_TYPES[target])
    table = {
        ("duration", "integer"): value,
        ("duration", "float"): value / F.lit(1e6),
        ("float", "integer"): F.when(F.isnan(value), F.lit(0)).otherwise(value.cast("bigint")),
        ("integer", "float"): value.cast("double"),
        ("boolean", "integer"): value.cast("bigint"),
        ("boolean", "float"): value.cast("double"),
        ("integer", "boolean"): value != 0,
        ("float", "boolean"): value != 0,
    }
    if source in ("string", "auto"):
        return typed(value, target, False)
    return table.get((source, target), F.when(value.isNotNull(), zero) if target != "datetime" else F.lit(None).cast("timestamp_ntz"))


def duration_interval(micros: Column) -> Column:
    """Microseconds as a day-time interval."""
    return F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))


# --- the same in Python, for sources that only Python reads ---


def py_duration(v: str) -> int | None:
    if not re.match(DURATION, v):
        return None
    return int(sum(int(Decimal(n) * UNITS[u]) for n, u in re.findall(_STEP, v)) // 1000)


def py_rfc3339(v: str) -> datetime | None:
    if not re.match(RFC3339, v):
        return None
    try:
        head, fraction, zone = re.match(r"(.{19})(\.\d+)?(.*)", v.upper().replace(" ", "T")).groups()
        at = datetime.fromisoformat(head + (zone if zone != "Z" else "+00:00"))
        return (at.astimezone(UTC) + timedelta(microseconds=int((fraction or ".0")[1:7].ljust(6, "0")))).replace(tzinfo=None)
    except ValueError:
        return None


def py_infer(v: str) -> str:
    if py_rfc3339(v) is not None:
        return "datetime"
    if re.match(INTEGER, v) and -(1 << 63) <= int(v) < 1 << 63:
        return "integer"
    if py_duration(v) is not None:
        return "duration"
    if re.match(FLOAT, v):
        return "float"
    return "boolean" if v.lower() in (*TRUE, *FALSE) else "string"


def py_typed(v: str | None, kind: str, fill: bool):
    if v is None:
        return DEFAULTS.get(kind) if fill else None
    if kind == "integer":
        return int(v) if re.match(INTEGER, v) and -(1 << 63) <= int(v) < 1 << 63 else 0
    if kind == "float":
        return float(v) if re.match(FLOAT, v) else 0.0
    if kind == "boolean":
        return v.lower() in TRUE
    if kind == "datetime":
        return py_rfc3339(v)
    return (py_duration(v) or 0) if kind == "duration" else v
