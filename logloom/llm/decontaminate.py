"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark texts.

Words are runs of ASCII letters (A-Z lowered), digits and characters above 127. A window is WINDOW consecutive words of an
item; an item of fewer words is one window, an item of none is never found. The automaton reads words, as numbers in digits, so that no
state has many successors, and holds every item once: cut into anchors of half a window, so that each window holds a whole anchor, or whole if it is short. A text
is scanned once; windows around the anchors found are looked up among those of the benchmark and compared word by word. A
hit covers whole words and is mapped back to code points of the original.

A benchmark of up to BLOCK_CHARS is one automaton and one scan of the documents. Beyond, each block of it is a scan that writes
only what it hits, by the hash of the text; hits of one text are merged, and texts are read once more to be joined with them. The
driver holds one block at a time.

Null texts have no words; a null item_id still marks words but is not listed; an empty benchmark finds nothing. Repeated rows
are scanned each for itself. Columns of the documents other than text pass through unchanged, whatever their names, but for the four that are added.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOWER_ALNUM, join_small, map_batches, table, texts, utf8, words, written

WINDOW = 13
#: Characters of benchmark texts in one automaton: what the driver and each worker hold at once.
BLOCK_CHARS = 10_000_000
#: Digits of a word's number: so many for each place, each place with signs of its own, so that matches begin and end with words.
DIGITS = 32
#: A document is contaminated if hits cover at least 1 / SHARE of its words.
SHARE = 20

_FACTORS = np.random.default_rng(13).integers(1, 1 << 63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(rows: np.ndarray) -> np.ndarray:
    """One number for each row of word numbers."""
    return (rows.astype(np.uint64) * _FACTORS[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)


class Index:
    """One automaton over a block of items (item_id, text), and the windows of its items in order of a hash."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.anchor = window, (window + 1) // 2
        number: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        every = [np.array([number.setdefault(w, len(number) + 1) for w in words(text, LOWER_ALNUM)], np.uint32) for _, text in items]
        long = [k for k, w in enumerate(every) if len(w) >= window]
        self.width = next(k for k in range(1, 9) if DIGITS**k > len(number))
        sign = lambda n: "".join(chr(1 + DIGITS * k + n // DIGITS**k % DIGITS) for k in range(self.width))
        signs = ["", *map(sign, number.values())]
        self.signs = dict(zip(number, signs[1:], strict=True))
        self.automaton = ahocorasick.Automaton()
        key = lambda some: "".join([signs[n] for n in some.tolist()])
        an_anchor = (self.anchor, True, ())
        for k in long:
            for i in range(0, len(every[k]) - self.anchor + 1, self.anchor):
                self.automaton.add_word(key(every[k][i : i + self.anchor]), an_anchor)
        for k, w in enumerate(every):
            if 0 < len(w) < window:
                _, is_anchor, owners = self.automaton.get(key(w), (0, False, ()))
                self.automaton.add_word(key(w), (len(w), is_anchor, (*owners, k)))
        self.least = min((min(len(w), window) for w in every if len(w)), default=0)
        if self.least:
            self.automaton.make_automaton()
        # windows: where they start in the items' words one after another, their items, in order of hash
        self.flat = np.concatenate([np.zeros(0, np.uint32), *(every[k] for k in long)])
        starts = np.cumsum([0, *(len(every[k]) for k in long)])[:-1]
        at = np.concatenate([np.zeros(0, np.int64), *(s + np.arange(len(every[k]) - window + 1) for s, k in zip(starts, long, strict=True))]).astype(np.int64)
        owner = np.repeat(np.array(long, np.int64), [len(every[k]) - window + 1 for k in long])
        hashes = np.concatenate([np.zeros(0, np.uint64), *(_hashes(self._rows(self.flat, at[i : i + 65536])) for i in range(0, len(at), 65536))])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.owner = hashes[order], at[order], owner[order]

    def _rows(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        return numbers[at[:, None] + np.arange(self.window)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit word ranges (end exclusive, merged, in order) and items found."""
        w = words(text, LOWER_ALNUM)
        if not self.least or len(w) < self.least:
            return len(w), [], set()
        get, none = self.signs.get, "\0" * self.width
        line = "".join([get(x, none) for x in w])
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        near: set[int] = set()
        for at, (n, is_anchor, short) in self.automaton.iter(line):
            end = at // self.width
            if short:
                spans.append((end - n + 1, end + 1))
                owners.update(short)
            if is_anchor:  # windows that hold all of it
                near.update(range(max(0, end + 1 - self.window), min(end - n + 1, len(w) - self.window) + 1))
        if near:
            digits = np.frombuffer(line.encode("utf-32-le"), np.uint32).reshape(-1, self.width).astype(np.int64) - (1 + DIGITS * np.arange(self.width))
            numbers, at = (digits * DIGITS ** np.arange(self.width)).sum(axis=1), np.array(sorted(near))
            rows = self._rows(numbers, at)
            hashes = _hashes(rows)
            first, last = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
            for i in np.flatnonzero(last > first).tolist():
                same = (self._rows(self.flat, self.at[first[i] : last[i]]) == rows[i]).all(axis=1)
                if same.any():
                    spans.append((int(at[i]), int(at[i]) + self.window))
                    owners.update(self.owner[first[i] : last[i]][same].tolist())
        return len(w), merged(spans), {self.names[k] for k in owners}


_built: dict[str, Index] = {}


def index_of(name: str, items: list, window: int) -> Index:
    """The index over a block; a worker builds it once and keeps the last."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, window)
    return _built[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point ranges of the text itself."""
    if not spans:
        return []
    data = utf8(text)
    plain = data.translate(LOWER_ALNUM)
    bounds, at = [], 0
    for w in plain.split():
        at = plain.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    points = lambda a: len(data[:a].decode("utf-8", "surrogatepass"))
    return [(points(bounds[a][0]), points(bounds[b - 1][1])) for a, b in spans]


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of whole items, as it comes; the last may be empty."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1] or "")
        if chars >= size:
            yield block
            block, chars = [], 0
    yield block


_SPANS = "array<array<int>>"
#: Words as a pattern, with and without capital letters.
ANY_CASE, ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _scanned(docs: DataFrame, block: list, window: int, schema: T.StructType, only_hits: bool = False) -> DataFrame:
    """docs with what a block hits; only_hits: rows with a hit, with both kinds of span as [word, end, code point, end] in spans."""
    held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def apply(batch: pa.RecordBatch) -> dict:
        found, rows = index_of(name, held.value, window), []
        for text in texts(batch):
            n, spans, owners = found.scan(text)
            rows.append((n, spans, original(text, spans), sorted({x for x in owners if x is not None})))
        if only_hits:
            return {"spans": [[[*x, *y] for x, y in zip(r[1], r[2], strict=True)] for r in rows], "items": [r[3] for r in rows], None: [bool(r[1]) for r in rows]}
        return {c: [r[k] for r in rows] for k, c in enumerate(("n_words", "word_spans", "char_spans", "items"))}

    return map_batches(docs, schema, apply)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, drop_text: bool = False) -> DataFrame:
    """docs with n_words, word_spans, char_spans (arrays of [start, end)) and items (distinct item_ids, sorted) beside its own columns; drop_text leaves out the text."""
    added = {"n_words": "bigint", "word_spans": _SPANS, "char_spans": _SPANS, "items": "array<string>"}
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    full = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added.items()))
    blocks = _blocks(benchmark, block_chars)
    block = next(blocks)
    further = next(blocks, None)
    if not further:
        return _scanned(rows, block, window, (full.drop("text") if drop_text else full).schema)
    text_hash = F.md5(F.coalesce("text", F.lit("")))
    only = rows.select(text_hash.alias("_hash"), "text")
    schema = T.StructType([only.schema["_hash"], *T.StructType.fromDDL(f"spans {_SPANS}, items array<string>").fields])
    hits = []
    while block:
        hits.append(written(_scanned(only, block, window, schema, only_hits=True).dropDuplicates(["_hash"]), "hits"))
        block, further = further, next(blocks, None)
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"_{c}")
    hits = written(reduce(DataFrame.union, hits).groupBy("_hash").agg(together("spans"), together("items")), "leaks")
    out = join_small(rows.withColumn("_hash", text_hash), hits, ["_hash"]).withColumn("_spans", _united(F.coalesce("_spans", F.array().cast(_SPANS))))
    part = lambda name, i: F.transform("_spans", lambda s: F.array(s[i], s[i + 1])).alias(name)
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE)).cast("long").alias("n_words")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "text" or not drop_text]
    return out.select(*kept, n_words, part("word_spans", 0), part("char_spans", 2), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def _united(spans: Column) -> Column:
    """merged() of sorted spans, by their words."""

    def put(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.array(last[0], F.greatest(last[1], s[1]), last[2], F.greatest(last[3], s[3]))
        return F.when((F.size(out) > 0) & (s[0] <= last[1]), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPANS), put)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from find_leaks()."""
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    found = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with all their columns: a passage of the benchmark is one, however long the document around it."""
    added = ("n_words", "word_spans", "char_spans", "items", "n_hit", "n_items", "items_sha256", "contaminated")
    aside = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in added})
    clean = find_leaks(aside, benchmark).where(F.size("word_spans") == 0)
    return clean.select(*(F.col(f"`_own_{c}`" if c in added else f"`{c}`").alias(c) for c in docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return digest(find_leaks(docs, benchmark, drop_text=True)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _sql(pattern: str = ALNUM) -> str:
    """The same from windows joined as texts; short items are windows of their own length."""
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w FROM benchmark),
bw AS (
  SELECT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


OP3_SQL = _sql()
