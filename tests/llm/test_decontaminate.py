"""op3 and its stage of the pipeline: the automaton against search, long documents with short passages."""

import collections
import random

import pytest

from logloom.llm import decontaminate
from tests.llm.test_llm import plain_leaks


def texts_of(rng):
    vocabulary = ["".join(rng.choice("ab1c") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([0, 1, 3, 7, 12, 13, 14, 20, 40])))) for k in range(25)]
    items += [(100, items[-1][1]), (None, " ".join(some(15))), (101, None)]
    docs = []
    for _ in range(120):
        w = some(rng.randint(0, 60))
        for _, text in rng.sample(items, 2):
            v = (text or "").split()
            a = rng.randint(0, len(v))
            w[rng.randint(0, len(w)) : 0] = v[a : a + rng.randint(0, len(v))]
        docs.append(", ".join(w).upper())
    return items, [d + " é" for d in docs]


@pytest.mark.parametrize("window", [13, 4, 5])
def test_index_equals_search(window):
    items, docs = texts_of(random.Random(window))
    index = decontaminate.Index([(None if k is None else str(k), t) for k, t in items], window)
    hits = 0
    for text in [*docs, "", None]:
        n, spans, found = index.scan(text)
        want = plain_leaks(text, items, window)
        assert (n, sum(b - a for a, b in spans), len(found - {None})) == want[:3]
        hits += bool(spans)
    assert hits > 20


def test_one_automaton_for_a_large_vocabulary():
    items = [(str(k), " ".join(f"w{k * 40 + j}" for j in range(40))) for k in range(1000)]
    index = decontaminate.Index(items)
    assert index.width == 4 and decontaminate.DIGITS**3 < 40_000
    n, spans, found = index.scan("x " + " ".join(f"W{40 * 7 + j}" for j in range(11, 30)) + " x w5 w6")
    assert (n, spans, found) == (23, [(1, 20)], {"7"})


def test_blocks_give_the_same(spark):
    items, docs = texts_of(random.Random(5))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate([*docs, None, docs[0]])], "doc_id long, text string, word_spans string, _hash int").withColumnRenamed("_hash", "hash")
    one, many = (decontaminate.find_leaks(df, benchmark, window=5, block_chars=n) for n in (decontaminate.BLOCK_CHARS, 200))
    assert one.columns == many.columns
    rows = lambda d: collections.Counter(repr(r) for r in d.collect())
    assert rows(one) == rows(many)
    assert "text" not in decontaminate.find_leaks(df, benchmark, block_chars=200, drop_text=True).columns


def test_a_passage_in_a_long_document_is_dropped(spark):
    passage = " ".join(f"question{i}" for i in range(20))
    rows = [(1, "word " * 3000 + passage), (2, "word " * 3000), (3, passage), (4, None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4]
