"""op4: what the net adds on real documents, borders of windows, the kept weights."""

import random

import numpy as np
import pytest

from logloom.llm import pii
from logloom.sources.sinks import exists, kept_path


@pytest.fixture(scope="module")
def net(spark):
    return pii.net_of(spark)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect()
    return [r["text"] for r in rows if r["text"]]


def placed(documents, made, n):
    """Pieces put between words of documents: text, start, end."""
    rng = random.Random(3)
    for text in documents[:n]:
        w = text.split()
        at = rng.randint(0, len(w))
        before, piece = "".join(x + " " for x in w[:at]), made(rng)
        yield before + piece + "".join(" " + x for x in w[at:]), len(before), len(before) + len(piece)


def share_found(documents, made, kind, net, n=100):
    cases = list(placed(documents, made, n))
    spans = [s for _, s in pii.all_spans([t for t, _, _ in cases], net)]
    return np.mean([any(k == pii.KINDS.index(kind) and s < b and a < e for s, k, e in found) for (_, a, b), found in zip(cases, spans, strict=True)])


def test_what_patterns_cannot_find_in_documents(documents, net):
    spelled = lambda r: f"{r.choice(['john', 'mary dot smith', 'info', 'peter_k', 'sales99'])} at {r.choice(['example', 'mail', 'uni-berlin'])} dot {r.choice(['org', 'com', 'de'])}"
    bracketed = lambda r: f"{r.choice(['john', 'm.lee', 'info'])} [at] {r.choice(['example', 'mail'])}.{r.choice(['org', 'com'])}"
    secret = lambda r: f'{r.choice(["token", "api_key"])} = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"'
    national = lambda r: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    assert share_found(documents, spelled, "email", net) >= 0.35
    assert share_found(documents, bracketed, "email", net) >= 0.8
    assert share_found(documents, secret, "secret", net) >= 0.9
    assert share_found(documents, national, "phone", net) >= 0.8


def test_numbers_alone_are_no_phones(documents, net):
    assert not any(pii.plausible(d, pii.KINDS.index("phone")) for d in ("2123465659789240", "123456789012", "12345678"))
    assert pii.plausible("0049 30 1234567", 3) and pii.plausible("(212) 555-0101", 3) and pii.plausible("004930123456789", 3)
    number = lambda r: str(r.randint(10**15, 10**16))
    assert share_found(documents, number, "phone", net) == 0


def test_borders_of_windows(net, monkeypatch):
    rng = random.Random(4)
    filler = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(400))
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    texts = []
    for at in range(pii.CORE - len(secret) - 10, pii.CORE + 10):
        texts.append(filler[:at].rstrip().ljust(at, "a") + " " + secret + " " + filler[at:])
    cut = list(pii.read(texts, net))
    monkeypatch.setattr(pii, "CORE", 1 << 16)
    whole = list(pii.read(texts, net))
    at = [t.index(secret) for t in texts]
    held = lambda found, a: [s for s in found if s[0] < a + len(secret) and a < s[2]]
    same = [held(x, a) == held(y, a) for x, y, a in zip(cut, whole, at, strict=True)]
    assert np.mean(same) >= 0.9 and all(held(x, a) for x, a in zip(cut, at, strict=True))


def test_weights_are_kept(spark, net):
    pii.net_of(spark)
    path = kept_path(spark, f"pii-{pii._name()}")
    if exists(spark, path):
        kept = {r["name"]: tuple(r["shape"]) for r in spark.read.parquet(path).collect()}
        assert kept == {k: v.shape for k, v in pii.Net().p.items()}


def test_texts_without_any_trace_need_not_be_read(documents, net, monkeypatch):
    """Every plausible span holds a trace, so that leaving out texts without one changes nothing."""
    rng = random.Random(6)
    pieces = ["at", "dot", "(at)", "[AT]", "@", "x", "co", "com", "=", ":", "7", "12345678", "\u00b2\u00b3\u2460", "\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "-", ".", "(", "[dot]", " ", " ", " "]
    for _ in range(20_000):
        piece = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        if any(pii.plausible(piece, k) for k in range(len(pii.KINDS))):
            assert pii._could().search(f"a {piece} b"), piece
    some = [*documents[:300], "mary at example dot org", "call \u0660\u0661\u0662-\u0663\u0664\u0665\u0666"]
    fewer = list(pii.all_spans(some, net))
    monkeypatch.setattr(pii, "_could", lambda: __import__("re").compile(""))
    assert list(pii.all_spans(some, net)) == fewer and any(len(s) > len(b) for b, s in fewer)
