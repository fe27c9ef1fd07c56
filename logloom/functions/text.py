"""Small text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def between(text: Column, before: str, after: str) -> Column:
    """What stands between the first `before` and the next `after`; null if either is missing or nothing stands there."""
    rest = F.when(F.contains(text, F.lit(before)), F.substr(text, F.position(F.lit(before), text) + len(before)))
    return F.nullif(F.when(F.contains(rest, F.lit(after)), F.substring_index(rest, after, 1)), F.lit(""))


def human_bytes(n: Column, largest: str = "TB") -> Column:
    """Bytes for people: 1023 B, 1.00 KB, 1.50 MB; the sign stays. Larger numbers than those of the largest unit stay in it: 2048.00 MB."""
    units = ("KB", "MB", "GB", "TB")
    size, out = F.abs(n).cast("double"), None
    for power, unit in reversed(list(enumerate(units[: units.index(largest) + 1], 1))):
        shown = F.format_string(f"%.2f {unit}", F.bround(size / F.lit(float(1024**power)), 2))
        out = F.when(size >= 1024**power, shown) if out is None else out.when(size >= 1024**power, shown)
    return F.when(n < 0, F.concat(F.lit("-"), out.otherwise(F.concat(F.abs(n).cast("string"), F.lit(" B"))))).otherwise(out.otherwise(F.concat(n.cast("string"), F.lit(" B"))))
