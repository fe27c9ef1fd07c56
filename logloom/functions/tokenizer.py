r"""Lines of key=value pairs as arrays and maps, in regular expressions that run on the JVM.

Rules: white space is space, tab, newline, form feed, carriage return. It may stand between key and "=", not after "=", where it ends an
empty value. A bare word takes the next word with it. A quoted value ends at the first quote that no backslash precedes and
keeps its backslashes; one without an end runs to the end of the line. In compat mode "" is the value " (one quote), as in the format's
first reader. A key that occurs again takes its last value. A line is read as if a newline ended it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_W, _N, _NW = r"[ \t\n\f\r]", r"[^= \t\n\f\r]", r"[^ \t\n\f\r]"
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'
#: Group 1 is a key and group 2 its raw value; the other branches consume what is no pair and leave both empty.
PAIR = rf'(?s)({_N}++){_W}*+=(?=.)({_QUOTED}(?:"|\\?\z)|(?!"){_NW}*+)|{_N}++{_W}*+=\z|{_N}++{_W}++{_NW}*+|{_N}++\z|={_NW}*+'
_CLOSED = rf'(?s)\A{_QUOTED}"\z'


def last_key_wins(spark: SparkSession) -> None:
    """Maps keep the last of equal keys; every scan sets this for its session."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def unquote(raw: Column, compat: bool = True) -> Column:
    """A raw value without its quotes."""
    inner = F.when(raw.rlike(_CLOSED), F.when(F.length(raw) == 2, F.lit('"' if compat else "")).otherwise(F.substr(raw, F.lit(2), F.length(raw) - 2)))
    return F.when(~F.startswith(raw, F.lit('"')), raw).otherwise(F.coalesce(inner, F.substr(raw, F.lit(2))))


def unescaped(value: Column) -> Column:
    """A value with what backslashes protect in place of the backslashes, as older readers of the format give it."""
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def raw_map(line: Column) -> Column:
    """Keys to raw values of a line without its newline (and an empty key for what is no pair). Needs last_key_wins().

    One pass of the pattern writes the pairs with marks between, which split into a map; lines that hold such marks themselves take two passes.
    """
    ended = F.concat(line, F.lit("\n"))
    marked = F.regexp_replace(ended, F.lit(f"(?s){_W}*+(?:{PAIR.removeprefix('(?s)')})|{_W}++"), F.lit("$1\x01$2\x02"))
    pairs_ = F.map_from_arrays(F.regexp_extract_all(ended, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(ended, F.lit(PAIR), F.lit(2)))
    return F.when(F.contains(line, F.lit("\x01")) | F.contains(line, F.lit("\x02")), pairs_).otherwise(F.str_to_map(marked, F.lit("\x02"), F.lit("\x01")))


def parse_map(line: Column, compat: bool = True) -> Column:
    """Keys to values of a line."""
    return F.transform_values(F.map_filter(raw_map(line), lambda k, _: k != ""), lambda _, v: unquote(v, compat))


def parse_pairs(line: Column, compat: bool = True) -> Column:
    """All pairs of a line in order, as an array of (k, v); repeated keys stay."""
    ended = F.concat(line, F.lit("\n"))
    both = F.arrays_zip(F.regexp_extract_all(ended, F.lit(PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(ended, F.lit(PAIR), F.lit(2)).alias("v"))
    return F.transform(F.filter(both, lambda p: p["k"] != ""), lambda p: F.struct(p["k"].alias("k"), unquote(p["v"], compat).alias("v")))


def pairs(line: str, compat: bool = True) -> Iterator[tuple[str, str]]:
    """The pairs of one line in Python, for sources that only Python reads. The line keeps its newline, if it has one."""
    space, n, i = " \t\n\f\r", len(line), 0
    while i < n:
        if line[i] in space:
            i += 1
            continue
        start = i
        while i < n and line[i] != "=" and line[i] not in space:
            i += 1
        key = line[start:i]
        while key and i < n and line[i] in space:
            i += 1
        if not key or i >= n or line[i] != "=":
            while i < n and line[i] not in space:
                i += 1
            continue
        i += 1
        if i >= n:
            return
        if line[i] != '"':
            start = i
            while i < n and line[i] not in space:
                i += 1
            yield key, line[start:i]
            continue
        start = i = i + 1
        while i < n and line[i] != '"':
            i += 2 if line[i] == "\\" else 1
        if i < n:
            yield key, line[start:i] or ('"' if compat else "")
            i += 1
        else:
            yield key, line[start:]


def render(names: list[str]) -> Column:
    """A line from columns: texts are quoted where they need it, and quotes and backslashes get a backslash; nulls are left out."""
    parts = []
    for name in names:
        value = F.col(f"`{name}`").cast("string")
        quoted = F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
        parts.append(F.concat(F.lit(f"{name}="), F.when(value.rlike(r'[ \t\n\f\r"=\\]|^$'), quoted).otherwise(value)))
    return F.concat_ws(" ", *parts)
