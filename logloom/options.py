"""Options of a scan, as a value and as strict JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

#: Types a column of a schema may have; "auto" is text.
KINDS = ("string", "integer", "float", "boolean", "datetime", "duration", "auto")


@dataclass(frozen=True)
class ScanOptions:
    """How lines become rows.

    line_filter: text that a raw line must hold (or a function from the line's Column to a Column), applied before parsing.
    row_filter: a function from the row's map Column to a Column.
    schema: column -> kind; if given, nothing is inferred, and other keys are left out.
    infer_schema_length: lines that the schema is inferred from.
    aligned_cols_cnt: columns are the first line's keys, and what is missing is null; else missing numbers are 0, texts empty.
    missing: "fill" or "null" overrides that choice. compat: keep the format's oddities (see functions.tokenizer).
    unescape: what backslashes protect in place of the backslashes, in all values. batch_size: rows in a pulled batch. n_threads: partitions of a scan, if any wish. cmd: remote command instead of reading the path.
    """

    line_filter: str | Callable | None = None
    schema: dict[str, str] | None = None
    infer_schema_length: int | None = 1
    batch_size: int | None = None
    n_threads: int | None = None
    aligned_cols_cnt: bool = False
    cmd: str | None = None
    row_filter: Callable | None = None
    missing: str | None = None
    compat: bool = True
    unescape: bool = False

    #: What JSON may hold.
    JSON = ("line_filter", "schema", "infer_schema_length", "batch_size", "n_threads", "aligned_cols_cnt", "cmd")

    def __post_init__(self):
        for name, kind in (self.schema or {}).items():
            if kind not in KINDS:
                raise ValueError(f"unknown type {kind!r} of column {name!r}")
        if self.missing not in (None, "fill", "null"):
            raise ValueError("missing is 'fill' or 'null'")

    @property
    def fill(self) -> bool:
        return self.missing == "fill" if self.missing else not self.aligned_cols_cnt

    @classmethod
    def from_json(cls, text: str) -> ScanOptions:
        values = json.loads(text or "{}")
        if not isinstance(values, dict):
            raise ValueError("options are a JSON object")
        if unknown := sorted(set(values) - set(cls.JSON)):
            raise ValueError(f"unknown field `{unknown[0]}`, expected one of {', '.join(cls.JSON)}")
        return cls(**values)

    def but(self, **changes) -> ScanOptions:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self) if f.name in self.JSON and not callable(getattr(self, f.name))})
