"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nystroem landmarks.

The kernel compares terms by their subsequences of three characters, each weighted by DECAY to the power of its span, so that
inserted, doubled or separated characters leave most of it in place. Terms come from labelled sentences: a term is an
example of toxicity if too many distinct sentences of toxic rows, and none or too few of others, have it; terms of clean
sentences are counterexamples, the hardest of which join in a second fit. Landmark similarities, whitened, are the features
of a linear machine. Since the kernel is a product of explicit subsequence vectors, the machine folds into one weight for each
subsequence, and a text is scored in one pass over its distinct terms. A text's largest value, within LIMITS, gives its probability: one insult is enough.

Null and empty texts have no terms and score as a text without any insult; repeated rows score alike; an empty table gives no
rows; without labelled rows of both kinds every score is the share of label 1, or zero. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold, kind, labelled_sample, map_batches, table, texts

DECAY, SPAN, LANDMARKS, THRESHOLD = 0.6, 5, 128, 0.7
#: Two gaps for each span: offsets of a subsequence's second and third character.
GAPS = [(i, j) for i in range(1, SPAN) for j in range(i + 1, SPAN + 1)]
SYMBOLS = 64
#: Terms whose values a worker remembers, and characters valued at once: bounds on memory only.
REMEMBERED, AT_ONCE = 200_000, 1 << 19
#: Value of a text without terms, and the least value of any.
FLOOR = -2.0
#: Values beyond say no more about a text.
LIMITS = (-1.0, 3.0)
#: What the second and third largest value add if they are above zero.
MORE = 0.4
_ALIKE = str.maketrans("013457@$", "oieastas")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\w)\w(?:[ .*_\-]{1,2}\w){2,}(?!\w)")


def terms_of(token: str) -> tuple[str, ...]:
    """What a token of lower-cased text is compared as: its letters together, and its parts."""
    if token.isalpha():
        return (token,)
    whole = _NOT_LETTERS.sub("", token)
    if not whole:
        return ()
    parts = [p for p in _NOT_LETTERS.split(token) if len(p) > 2]
    out = [whole, *(parts if len(parts) > 1 else ())]
    if any(c in "013457@$" for c in token.strip(".,;:!?\"'()")):
        out.append(_NOT_LETTERS.sub("", token.translate(_ALIKE)))
    return tuple(dict.fromkeys(out))


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of a text, and runs of single characters put together."""
    lower = (text or "").lower()
    out = set(lower.split())
    out.update("".join(c for c in m.group() if c.isalnum()) for m in _SPELLED.finditer(lower))
    return out


def symbols(text: str) -> np.ndarray:
    """Characters as numbers below SYMBOLS; 0 is the edge of a term, 27 and up hold all characters but a-z."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 97) & (points <= 122), points - 96, np.where(points == 10, 0, 27 + points % (SYMBOLS - 27))).astype(np.int64)


def subsequences(terms: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: the term's number and subsequence at every place, and their weight. A term has an edge on either side."""
    text = "".join(f"\n{t}\n" for t in terms)
    s = symbols(text)
    owner = np.repeat(np.arange(len(terms)), [len(t) + 2 for t in terms])
    for i, j in GAPS:
        if len(s) > j:
            same = owner[:-j] == owner[j:]
            code = (s[: len(s) - j] * SYMBOLS + s[i : len(s) - j + i]) * SYMBOLS + s[j:]
            yield owner[:-j][same], code[same], DECAY**j


def length(n: int, terms: list[str]) -> np.ndarray:
    out = np.zeros(n)
    for owner, _, w in subsequences(terms):
        out += np.bincount(owner, minlength=n) * w * w
    return np.sqrt(np.maximum(out, 1e-9))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Similarities of terms a with terms b, scaled by their lengths."""
    table_ = np.zeros((SYMBOLS**3, 8), np.float32)
    out = np.zeros((len(a), len(b)))
    parts = list(subsequences(a))
    for k in range(0, len(b), 8):
        some = b[k : k + 8]
        table_[:] = 0
        for owner, code, w in subsequences(some):
            np.add.at(table_, (code, owner), w)
        for owner, code, w in parts:
            for c in range(len(some)):
                out[:, k + c] += w * np.bincount(owner, table_[code, c], minlength=len(a))
    return out / length(len(a), a)[:, None] / length(len(b), b)[None, :]


def values(terms: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each term."""
    n = len(terms)
    total, square = np.zeros(n), np.zeros(n)
    for owner, code, w in subsequences(terms):
        total += w * np.bincount(owner, weights[code], minlength=n)
        square += w * w * np.bincount(owner, minlength=n)
    return np.maximum(total / np.sqrt(np.maximum(square, 1e-9)) + bias, FLOOR)


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 1200, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine by subgradient descent over all examples, averaged over the second half."""
    w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    weight = weight / weight.sum()
    for t in range(rounds):
        active = weight * y * (y * (x @ w + b) < 1)
        rate = 20 / (1 + t / 20)
        w += rate * (x.T @ active - reg * w)
        b += rate * 0.2 * active.sum()
        if t >= rounds // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (rounds - rounds // 2), mean_b / (rounds - rounds // 2)


#: Variants of each toxic term that join the fit.
INSERTED, DOUBLED = 4, 1


def varied(term: str, rng: np.random.Generator) -> list[str]:
    """The term with a character inserted at some places, and with one doubled."""
    put = lambda i, c: term[:i] + c + term[i:]
    at = rng.integers(1, len(term), INSERTED + DOUBLED)
    return [put(i, chr(rng.integers(97, 123))) for i in at[:INSERTED]] + [put(i, term[i - 1]) for i in at[INSERTED:]]


#: Terms that begin with the same STEM letters as a toxic one are toxic on a RELATED-th of the evidence.
STEM, RELATED = 5, 4


def examples(sample: list[str], labels: list[int]) -> tuple[dict[str, int], dict[str, int]]:
    """Toxic terms, and the terms of the other sentences, with the number of distinct sentences that have them."""
    sentence: dict[str, int] = {}
    for text, y in zip(sample, labels, strict=True):
        for s in re.split(r"[.!?\n]+", text.lower()):
            if s := s.strip():
                sentence[s] = min(sentence.get(s, 1), y)
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for s, y in sentence.items():
        for term in {t for token in tokens_of(s) for t in terms_of(token)}:
            seen[term][y] += 1
    share = max(1e-3, sum(sentence.values()) / max(1, len(sentence)))
    need = np.log(1e-3 / max(1, len(seen)))  # few terms would reach this by chance
    chance = {t: n[1] * (np.log(share) - np.log(n[1] / (n[0] + n[1]))) for t, n in seen.items() if len(t) > 2 and n[1] > 8 * n[0]}
    stems = {t[:STEM] for t, c in chance.items() if c < need and len(t) >= STEM}
    toxic = {t: seen[t][1] for t, c in chance.items() if c < (need / RELATED if t[:STEM] in stems else need)}
    return toxic, {t: n[0] for t, n in sorted(seen.items()) if n[0] and t not in toxic}


def train(sample: list[str], labels: list[int], landmarks: int = LANDMARKS, seed: int = 1) -> dict:
    """weights and bias of the machine over terms, and the two numbers that turn a text's largest value into a probability."""
    share = float(np.mean(labels)) if labels else 0.0
    none = {"weights": np.zeros(SYMBOLS**3, np.float32), "bias": FLOOR, "scale": (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0)}
    if len(set(labels)) < 2:
        return none
    rng = np.random.default_rng(seed)
    toxic, count = examples(sample, labels)
    clean = list(count)
    if not toxic or not clean:
        return none
    plus = sorted(toxic, key=lambda t: (-toxic[t], t))  # all are examples; the most frequent are landmarks
    wider = [*plus, *(v for t in plus for v in varied(t, rng))]
    often = np.sqrt([toxic[t] for t in plus] + [toxic[t] / 4 for t in plus for _ in range(INSERTED + DOUBLED)])
    minus = [clean[i] for i in rng.choice(len(clean), min(len(clean), 1500), replace=False)]
    model: dict = {}
    for _ in range(3):
        first = plus[: landmarks // 2]
        marks = [*first, *minus[-(landmarks - len(first)) :]]
        own = kernel(marks, marks)
        val, vec = np.linalg.eigh(own + 1e-3 * np.eye(len(marks)))
        white = vec / np.sqrt(np.maximum(val, 1e-3)) @ vec.T
        terms = [*wider, *minus]
        y = np.array([1.0] * len(wider) + [-1.0] * len(minus))
        usual = np.sqrt([count[t] for t in minus])
        w, b = hinge(kernel(terms, marks) @ white, y, np.concatenate([len(minus) * often / often.mean(), len(wider) * usual / usual.mean()]))
        beta = white @ w / length(len(marks), marks)
        weights = np.zeros(SYMBOLS**3)
        for owner, code, k in subsequences(marks):
            np.add.at(weights, code, k * beta[owner])
        model = {"weights": weights.astype(np.float32), "bias": float(b)}
        hard = np.concatenate([values(clean[i : i + 20_000], weights, b) for i in range(0, len(clean), 20_000)])
        known = set(minus)
        minus += [clean[i] for i in np.argsort(-hard)[:400] if clean[i] not in known and hard[i] > -1]
    x = np.column_stack([np.ones(len(sample)), np.clip(list(largest(sample, model, {})), *LIMITS)])
    y, at = np.array(labels, float), np.zeros(2)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        at = at + np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * at)
    return model | {"scale": tuple(at.tolist())}


def remember(tokens: set[str], model: dict, known: dict[str, float]) -> None:
    """Values tokens that known has not: each token by the largest of its terms."""
    if len(known) > REMEMBERED:
        known.clear()
    new = [t for t in tokens if t not in known]
    names = [terms_of(t) for t in new]
    flat = [x for name in names for x in name]
    found, i = [], 0
    while i < len(flat):
        j, chars = i, 0
        while j < len(flat) and (j == i or chars < AT_ONCE):
            chars += len(flat[j])
            j += 1
        found += values(flat[i:j], model["weights"], model["bias"]).tolist()
        i = j
    v = iter(found)
    for t, name in zip(new, names, strict=True):
        known[t] = max((next(v) for _ in name), default=FLOOR)


def largest(some_texts, model: dict, known: dict[str, float], together: int = 64) -> Iterator[float]:
    """The largest value of each text's distinct tokens, and MORE of the next two if they speak for toxicity; known remembers those of tokens."""
    some_texts = list(some_texts)
    for i in range(0, len(some_texts), together):
        sets = [tokens_of(t) for t in some_texts[i : i + together]]
        remember(set().union(*sets), model, known)
        for tokens in sets:
            some = sorted((x for x in map(known.__getitem__, tokens) if x > 0), reverse=True)
            yield some[0] + MORE * sum(some[1:3]) if some else max(map(known.__getitem__, tokens), default=FLOOR)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text). The model has SYMBOLS ** 3 weights, whatever the input."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    known: dict[str, float] = {}  # each task's own, once it has arrived there

    def apply(batch: pa.RecordBatch) -> dict:
        top = np.clip(np.fromiter(largest(texts(batch), held.value, known), float), *LIMITS)
        a, b = held.value["scale"]
        return {"score": 1 / (1 + np.exp(-np.clip(a + b * top, -50, 50)))}

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind(docs)}, score double", apply)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(*labelled_sample(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic"))
    out = score(docs, model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
