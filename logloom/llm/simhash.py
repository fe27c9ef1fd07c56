"""SimHash near-duplicates: a byte-position inverted index, count filtering, verification, connected components.

A fingerprint is eight bytes, each at its position. Two fingerprints of at most three differing bits share at least five
positional bytes. The index posts every distinct fingerprint under each set of four positions whose numbers XOR to zero:
those fourteen sets form a Steiner system S(3, 4, 8), so any five shared positions contain one of them, and every such pair
meets in a posting list. Within a list, shared positional bytes are tallied for a pair, pairs of at least five are retained
and their bits are counted. A list is searched breadth first: what is reached leaves the list, so a dense cloud of near
copies costs little more than its size and yields a spanning tree instead of all pairs.

Null and empty texts have fingerprint zero and are linked like any other. Copies meet in one fingerprint before anything is
indexed. A null doc_id is a row like others and never the smallest of its group, unless all ids are null: then component_id is
null. Repeated rows each get their own row. An empty table gives no rows. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kind, map_batches, table, texts, utf8, written

SEED, SHINGLE, MAX_BITS, BYTES = 42, 3, 3, 8
#: Bytes in which two fingerprints within MAX_BITS agree at least.
MIN_SHARED = BYTES - MAX_BITS
#: Byte positions of each posting list.
POSITIONS = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Shingles hashed at once, and pairs compared at once: bounds on a worker's memory, not on the work.
CHUNK, PAIRS = 1 << 16, 1 << 20


def fingerprint(text: str | None) -> int:
    w = utf8(text).lower().split()  # bytes.lower() changes A-Z only; bytes.split() splits at 0x20 and 0x09-0x0D
    if not w:
        return 0
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        return digest(line, SEED)  # one hash: its own majority
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a bigint) for every row."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    apply = lambda batch: {"fp": np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)}
    return map_batches(rows, f"doc_id {kind(docs)}, text_hash bigint, fp bigint", apply)


def posting_keys(fp: Column) -> Column:
    """The fourteen posting lists of a fingerprint, each as one bigint: which positions, then their bytes."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * (BYTES - 1 - p)).bitwiseAND(F.lit(255))
    key = lambda i, c: F.lit(i << 32) + F.shiftleft(byte(c[0]), 24) + F.shiftleft(byte(c[1]), 16) + F.shiftleft(byte(c[2]), 8) + byte(c[3])
    return F.array(*(key(i, c) for i, c in enumerate(POSITIONS)))


def near(x: np.ndarray) -> np.ndarray:
    """For XORs of fingerprints: True where at least MIN_SHARED positional bytes are shared and at most MAX_BITS bits differ."""
    shared = np.zeros(x.shape, np.uint8)
    for p in range(BYTES):
        shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    out = shared >= MIN_SHARED
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def tree(list_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints of one posting list."""
    rest, a, b = list_, [], []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            step = max(1, PAIRS // len(rest))
            now, frontier = frontier[:step], frontier[step:]
            hit = np.zeros(len(rest), bool)
            who = np.zeros(len(rest), np.int64)
            for i in range(0, len(rest), PAIRS):
                match = near(now[:, None] ^ rest[None, i : i + PAIRS])
                hit[i : i + PAIRS], who[i : i + PAIRS] = match.any(axis=0), match.argmax(axis=0)
            a.append(now[who[hit]])
            b.append(rest[hit])
            frontier, rest = np.concatenate([frontier, rest[hit]]), rest[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, fp) in order of key -> links (a, b) with a < b that connect what is linked within each list."""

    def within(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        twos = starts[ends - starts == 2]
        twos = twos[near(fps[twos] ^ fps[twos + 1])]
        found = [(fps[twos], fps[twos + 1]), *(tree(fps[s:e]) for s, e in zip(starts, ends, strict=True) if e - s > 2)] if len(keys) else []
        a, b = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on in the next batch
    for frame in frames:
        keys, fps = frame["key"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1])) if not held or held[-1][0][-1] != keys[-1] else 0
        if cut or held and held[-1][0][-1] != keys[-1]:
            yield within(np.concatenate([*(k for k, _ in held), keys[:cut]]), np.concatenate([*(f for _, f in held), fps[:cut]]))
            held = []
        held.append((keys[cut:], fps[cut:]))
    if held:
        yield within(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def components(edges: DataFrame) -> DataFrame:
    """(a, b), any links -> (node, root): every node with the smallest node that it is connected with.

    Alternating large stars and small stars: each round joins a node's neighbours to the smallest of them, which keeps
    components and needs a logarithmic number of rounds. A round is written, so none depends on the rounds before.
    """
    now = written(edges.where("a < b").distinct(), "star")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # its size is then known, and a hub's links can be split
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a > m").select("m", F.col("a").alias("b")).union(least.select("m", "b"))
        after = written(small.select(F.col("m").alias("a"), "b").distinct(), "star")
        mark = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark(after) == mark(now):
            return after.select(F.col("b").alias("node"), F.col("a").alias("root")).union(after.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (the group's fingerprint) and component_id (its smallest doc_id) for every row of docs (doc_id, text)."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    posted = distinct.select(F.explode(posting_keys(F.col("fp"))).alias("key"), "fp")
    found = posted.repartition("key").sortWithinPartitions("key").mapInPandas(links, "a bigint, b bigint")
    nodes = written(components(found), "nodes")
    firsts = nodes.join(distinct, nodes["node"] == distinct["fp"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = nodes.join(firsts, "root").select(F.col("node").alias("fp"), "root", "component_id")
    groups = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "groups")
    return rows.join(groups, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one of each group: the one of the smallest doc_id (nulls last), of equal ids that of the smallest text hash, of equal rows any."""
    groups = near_duplicates(docs).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n"))
    winners = written(groups.groupBy("root").agg(first.alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_hash"), F.col("w.n").alias("_n")), "winners")
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(winners, docs["doc_id"].eqNullSafe(winners["_id"]) & (text_hash == winners["_hash"]))
    if winners.where("_n > 1").isEmpty():
        return kept.select(*docs.columns)
    once = kept.where("_n = 1").select(*docs.columns)
    return once.unionByName(kept.where("_n > 1").dropDuplicates(["_id", "_hash"]).select(*docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
