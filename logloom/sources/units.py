"""Numbered units of whole lines, such as the records of some store, read one to a task where their number is known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .paths import lines_of


class UnitSource:
    """To be derived from; it travels to the tasks by pickle. A unit may be empty and holds whole lines."""

    def read_unit(self, index: int) -> bytes | None:
        """The unit's bytes, or None after the last."""
        raise NotImplementedError

    def count_units(self) -> int | None:
        """How many units there are, if that is known."""
        return None


def unit_lines(spark: SparkSession, source: UnitSource) -> DataFrame:
    """The lines of all units in one column "value"; units of unknown number are read one after another by one task."""
    n = source.count_units()

    def every() -> Iterator[bytes]:
        i = 0
        while (unit := source.read_unit(i)) is not None:
            yield unit
            i += 1

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                units = every() if n is None else iter([source.read_unit(int(i)) or b""])
                held: list[str] = []
                for unit in units:
                    held += [x.removesuffix("\n") for x in lines_of(iter([unit]))]
                    if len(held) >= 10_000:
                        yield pd.DataFrame({"value": held})
                        held = []
                yield pd.DataFrame({"value": pd.Series(held, dtype=object)})

    ids = spark.range(0, 1 if n is None else n, 1, 1 if n is None else max(1, min(n, 10_000)))
    return ids.mapInPandas(apply, "value string")
