"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

Texts are cut into overlapping windows; both directions run over every window, overlapping scores are averaged, and one
Viterbi decoding of the whole text reconciles the windows. A place where "outside" leads by more than any transitions could
win back is outside on the best path, so that only the places between have to be decoded; the result is that of decoding all.
The net is trained from labelled spans in made-up sentences (fixed seed), which hold the base kinds, their bracketed,
spelled-out and national forms, and secrets (access keys, tokens, passwords), among numbers, dates, versions and codes that are none.
It is fitted once: its weights are kept in the shared folder, under a hash of all that the fit depends on.

Base spans stay as they are; a span of the net is added if it overlaps none of them. Null texts are empty and have no spans; repeated
rows are read each for itself; an empty table gives no rows. redact() passes other columns through.
"""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import exists, kept_path
from .base import map_batches, table, texts

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = len(KINDS) + 1
#: Characters a window adds, and those it shares with each neighbour: as many as the longest span that the net is trained on.
CORE, CONTEXT = 480, 64
#: Windows that run together, and rows in one Arrow batch: bounds on a worker's memory.
TOGETHER, ROWS = 1536, 250
EMBED, HIDDEN, STEPS, BATCH, LENGTH, RATE = 10, 10, 900, 48, 96, 0.02
#: Made-up texts that the fit goes through again and again.
POOL = 200
#: Shorter spans of the net are dropped.
MIN_SPAN = 6

# --- base patterns ---

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern: each belongs to one @, from the start of the run of local characters before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            free = m.end()
            yield start, free
        elif start < at:
            free = max(free, at)  # a run is looked at once
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in that order."""
    out = [(a, 0, b) for a, b in emails(text)]
    digits = lambda s: "".join(filter(str.isdigit, s))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


# --- labelled spans ---


def example(rng: np.random.Generator, length: int) -> tuple[str, list[int]]:
    """A made-up text of at least this length, and the tag of each of its characters."""
    pick = lambda *x: x[rng.integers(len(x))]
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    some = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, up, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

    def word() -> str:
        r = rng.random()
        if r < 0.4:
            w = pick(*"the of and to in at on is it an be by for with as from that a at la de que el en un los der die und zu les et est du me my go no or at".split())
        elif r < 0.75:  # syllables, now and then many
            w = "".join(some("bcdfghklmnprstvwz", rng.integers(0, 3)) + some("aeiou" + pick("", "éèàüöäßñóíçê"), rng.integers(1, 3)) + some("nrstdl", rng.integers(0, 3)) for _ in range(rng.integers(1, pick(3, 5, 8))))
        else:
            w = some("eeetaoinshrdlucmfwypvbgkjqxz" + pick("", "éèàüöäßñóíçê"), rng.integers(1, 12))
        w = pick(w, w, w, w, w.capitalize(), w.upper())
        return w + pick("", "", "", "", "", "", ",", ".", ";", "!", "?", "!!", ":", "***", "%%%", "###", " |", "&&&", "$$$")

    def name() -> str:
        return some(low, rng.integers(2, 9)) + pick("", "", "." + some(low, rng.integers(2, 8)), "_" + some(low, 3), digit(2), "." + digit(2), "-" + some(low, 4), "+" + some(low, 3))

    def domain(dot: str = ".") -> str:
        return dot.join([some(low, rng.integers(2, 10)) + pick("", "", digit(1)) for _ in range(rng.integers(1, 3))] + [pick("com", "org", "net", "de", "fr", "es", "io", "co", "edu", "info")])

    def email() -> str:
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", "."), (" @ ", "."), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "))
        who = name()
        return (who if at == "@" else who.replace(".", pick(".", dot))) + at + domain(dot)

    def ip() -> str:
        if rng.random() < 0.2:
            return ":".join(some(hexa, 4).lstrip("0") or "0" for _ in range(8)) if rng.random() < 0.5 else "2001:db8::" + ":".join(some(hexa, 4) for _ in range(3))
        return ".".join(str(x) for x in rng.integers(1, 256, 4))

    def card() -> str:
        body = pick("4", "5", "37", "6011") + digit(15)
        body = body[:15]
        body += next(c for c in "0123456789" if luhn(body + c))
        return pick("", "", " ", "-", ".").join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+{digit(2)} {digit(2)} {digit(4)} {digit(4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digit(2)}{digit(9)}", f"{a}.{b}.{c}", f"0049 {digit(2)} {digit(7)}", f"+1-{a}-{b}-{c}", f"00{digit(2)} {digit(3)} {digit(3)} {digit(3)}")

    def secret() -> str:
        key = pick("token", "password", "api_key", "secret", "passwd", "access_token", "pwd")
        value = pick(some(hexa, rng.integers(16, 41)), some(hexa, 18), some(low + up + "0123456789", rng.integers(12, 33)), some(low + "0123456789!", rng.integers(8, 16)))
        return pick("AKIA" + some(up + "234567", 16), f'{key} = "{value}"', f"{key}={value}", f"{key}: {value}", "sk-" + some(low + up + "0123456789", 32), "ghp_" + some(low + up + "0123456789", 36), f"{key}='{value}'", "AKIA" + some(up + "0123456789", 16))

    def other() -> str:
        return pick(
            digit(rng.integers(1, 6)), f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(0, 24)}:{digit(2)}", f"{digit(1)}.{digit(1)}", f"{digit(1)}.{digit(1)}.{digit(2)}", f"version {digit(1)}.{digit(1)}.",
            f"{digit(2)}%", f"${digit(3)}.{digit(2)}", some(low, 5) + "_" + some(low, 6), f"https://{domain()}/{some(low, 5)}", f"{some(low, 6)}.{pick('py', 'txt', 'html')}", some(up, rng.integers(2, 7)), f"({digit(4)})", f"{some(low, 4)}()", f"x = {digit(2)}", f"page {digit(2)}",
            f"{digit(3)},{digit(3)}", "at the", "meet at noon", "dot", "password", "the token of", "look at", f"{some(up, 2)}-{digit(3)}", some(hexa, 7), f"{digit(2)}/{digit(2)}/{rng.integers(1990, 2030)}", f"No. {digit(3)}", "cc by 4.0.", "...", "--", some(up, 1) + "." + some(up, 1) + ".", f"{digit(2)} + {digit(2)}", f"@{some(low, 6)}",
        )

    text, tags = "", []
    makers = (email, ip, card, phone, secret)
    while len(text) < length:
        r = rng.random()
        kind = int(rng.integers(len(makers))) + 1 if r < 0.05 else 0
        piece = makers[kind - 1]() if kind else other() if r < 0.13 else word()
        text, tags = text + piece, tags + [kind] * len(piece)
        gap = (pick(" ", ". ", ", ", "\n", ") ") if kind else pick(*" " * 12, "\n")) if rng.random() < 0.98 else "  "
        text, tags = text + gap, tags + [0] * len(gap)
    return text, tags


# --- the net ---

VOCABULARY = 128


def codes(text: str) -> np.ndarray:
    """Characters as numbers: ASCII as it is, white space as one, all others by letter or not; 0 is outside the text."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(p < 128, p, np.where((p >= 0xC0) & (p < 0x2000), 1, 2)).astype(np.uint8)
    out[(out >= 9) & (out <= 13)] = 10
    out[out == 0] = 2
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters: an embedding, an LSTM for either direction (gates i, f, o, g), a layer to the tags, transitions."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (VOCABULARY, EMBED))}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN)), f"u{d}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.p |= {"v": r.normal(0, HIDDEN**-0.5, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _run(self, ids: np.ndarray, d: str) -> tuple:
        """One direction over ids (time, batch), in order of time for it; what the way back needs."""
        x = self.p["e"][ids]
        z0 = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        c, u, keep = h.copy(), self.p[f"u{d}"], []
        hs = np.zeros((len(ids) + 1, ids.shape[1], HIDDEN), np.float32)
        for t in range(len(ids)):
            z = z0[t] + h @ u
            s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t + 1] = h
            keep.append((i, f, o, g, before, tc))
        return x, hs, keep

    def _back(self, d: str, saved: tuple, dh: np.ndarray, grads: dict, ids: np.ndarray) -> None:
        x, hs, keep = saved
        dz = np.zeros((*dh.shape[:2], 4 * HIDDEN), np.float32)
        later, dc, u = np.zeros_like(dh[0]), np.zeros_like(dh[0]), self.p[f"u{d}"]
        for t in range(len(keep) - 1, -1, -1):
            i, f, o, g, before, tc = keep[t]
            a = dh[t] + later
            dc = dc + a * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), a * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dc = dc * f
            later = dz[t] @ u.T
        flat = dz.reshape(-1, 4 * HIDDEN)
        grads[f"u{d}"] = hs[:-1].reshape(-1, HIDDEN).T @ flat
        grads[f"w{d}"] = x.reshape(-1, EMBED).T @ flat
        grads[f"b{d}"] = flat.sum(axis=0)
        per = flat @ self.p[f"w{d}"].T
        for k in range(EMBED):
            grads["e"][:, k] += np.bincount(ids.ravel(), per[:, k], minlength=VOCABULARY)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the tags (time, batch) for each character, and its gradients."""
        forward, backward = self._run(ids, "f"), self._run(ids[::-1], "b")
        h = np.concatenate([forward[1][1:], backward[1][1:][::-1]], axis=2)
        e = (h @ self.p["v"] + self.p["c"]).astype(np.float64)
        n, batch, tr = len(ids), ids.shape[1], self.p["t"].astype(np.float64)
        most = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = most(alpha[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = most(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = most(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        pairs = np.exp(alpha[:-1, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
        b = np.arange(batch)
        gold = sum(e[t, b, tags[t]] for t in range(n)) + sum(tr[tags[t - 1], tags[t]] for t in range(1, n))
        for t in range(n):
            de[t, b, tags[t]] -= 1
        np.subtract.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        de = (de / (batch * n)).astype(np.float32)
        grads = {"e": np.zeros_like(self.p["e"]), "t": pairs / (batch * n), "v": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "c": de.sum(axis=(0, 1))}
        dh = de @ self.p["v"].T
        self._back("f", forward, dh[:, :, :HIDDEN], grads, ids)
        self._back("b", backward, dh[::-1, :, HIDDEN:], grads, ids[::-1])
        return float((z - gold).mean() / n), grads

    def fit(self, steps: int = STEPS, seed: int = 5) -> Net:
        """Adam on made-up texts; a batch is cut from one at any place, so that windows begin and end within spans too."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x, np.float64) for k, x in self.p.items()} for _ in range(2))
        pool = [example(rng, BATCH * LENGTH) for _ in range(min(steps, POOL))]
        for step in range(1, steps + 1):
            text, tags = pool[step % len(pool)]
            at = int(rng.integers(0, LENGTH))  # other cuts each time
            cut = lambda x: np.concatenate([x[at:], x[:at]])[: BATCH * LENGTH].reshape(BATCH, LENGTH).T  # noqa: B023, E731
            _, grads = self.gradients(cut(codes(text)), cut(np.array(tags)))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            rate = RATE * (1 - step / steps * 0.95)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict:
        """What reading needs: for each direction and gate the input for every character, halved for the sigmoids, so that one tanh serves all gates."""
        half = np.array([0.5, 0.5, 0.5, 1.0], np.float32)[:, None, None]
        by_gate = lambda x: np.ascontiguousarray(x.reshape(-1, 4, HIDDEN).transpose(1, 0, 2) * half, np.float32)
        out = {d: (by_gate(self.p["e"] @ self.p[f"w{d}"] + self.p[f"b{d}"]), by_gate(self.p[f"u{d}"]), self.p["v"][i * HIDDEN : (i + 1) * HIDDEN].copy()) for i, d in enumerate("fb")}
        return out | {"c": self.p["c"], "t": self.p["t"].astype(np.float64)}


@lru_cache(maxsize=1)
def trained() -> dict:
    return Net().fit().tables()


@lru_cache(maxsize=1)
def _name() -> str:
    """A hash of what the fit depends on: settings, generator and net."""
    settings = (KINDS, EMBED, HIDDEN, STEPS, BATCH, LENGTH, RATE, POOL, VOCABULARY, np.__version__)
    return hashlib.sha256(repr(settings).encode() + b"".join(inspect.getsource(f).encode() for f in (example, codes, luhn, Net))).hexdigest()[:16]


def net_of(spark: SparkSession) -> dict:
    """The trained net: that in the shared folder, or else fitted and written there. Writers of the same net may meet; whichever comes first stays."""
    if not trained.cache_info().currsize:
        path = kept_path(spark, f"pii-{_name()}")
        if not exists(spark, f"{path}/_SUCCESS"):
            net = Net().fit()
            names = sorted(net.p)
            rows = [(n, list(net.p[n].shape), net.p[n].astype("<f4").tobytes()) for n in names]
            spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("ignore").parquet(path)
        if exists(spark, f"{path}/_SUCCESS"):
            net = Net()
            net.p = {r["name"]: np.frombuffer(bytes(r["data"]), "<f4").reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
        return net.tables()
    return trained()


def scores(windows: np.ndarray, net: dict) -> np.ndarray:
    """Scores of the tags for windows of characters (time, batch) -> (time, batch, tags)."""
    n, batch = windows.shape
    out = np.broadcast_to(net["c"], (n, batch, TAGS)).copy()
    for d in "fb":
        inputs, u, v = net[d]
        h, c, g = np.zeros((3, batch, HIDDEN), np.float32)
        z, zu = np.empty((2, 4, batch, HIDDEN), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            np.take(inputs, windows[t], axis=1, out=z, mode="clip")
            np.matmul(h, u, out=zu)
            z += zu
            np.tanh(z, out=z)
            s = z[:3]
            s *= 0.5
            s += 0.5
            c *= s[1]
            np.multiply(s[0], z[3], out=g)
            c += g
            np.tanh(c, out=h)
            h *= s[2]
            out[t] += h @ v
    return out


def stretches(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """(first, end) of the places in a text that may have another tag than 0 on the best path; e: scores (characters, tags).

    A stretch of other tags in place of 0 gains at most what they lead by there, with the best transitions inside, plus the best ones
    at its ends. A place is 0 if no stretch around it can gain: its best sum is that to the highest sum ahead from the lowest behind.
    """
    stay, enter, leave = tr[1:, 1:].max() - tr[0, 0], tr[0, 1:].max() - tr[0, 0], tr[1:, 0].max() - tr[0, 0]
    gain = e[:, 1:].max(axis=1).astype(np.float64) - e[:, 0] + stay
    if len(gain):
        gain[0] += max(0, -enter)
        gain[-1] += max(0, -leave)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
    return np.flatnonzero(np.diff(best - stay + enter + leave >= -1e-6, prepend=False, append=False)).reshape(-1, 2)


def decode(scores_: list[np.ndarray], tr: np.ndarray) -> list[np.ndarray]:
    """The best path of each text, from its scores (characters, tags). Stretches of all texts are decoded side by side, in order of length."""
    tags = [np.zeros(len(e), np.int8) for e in scores_]
    where = [(b - a, k, a, b) for k, e in enumerate(scores_) for a, b in stretches(e, tr).tolist()]
    where.sort(reverse=True)
    if not where:
        return tags
    n = np.array([w[0] for w in where])
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    e = np.concatenate([scores_[k][a:b] for _, k, a, b in where]).astype(np.float64)
    e[start] += np.array([tr[0] if a else tr[0] * 0 for _, _, a, _ in where])
    e[start + n - 1] += np.array([tr[:, 0] if b < len(scores_[k]) else tr[0] * 0 for _, k, _, b in where])
    back = np.zeros((len(e), TAGS), np.int8)
    best, still = e[start], len(n)
    for t in range(1, n[0]):
        still = int(np.searchsorted(-n, -t))  # stretches longer than t
        x = best[:still, :, None] + tr
        back[start[:still] + t] = x.argmax(axis=1)
        best[:still] = x.max(axis=1) + e[start[:still] + t]
    k, path = best.argmax(axis=1), np.zeros(len(e), np.int8)
    for t in range(n[0]):
        still = int(np.searchsorted(-n, -t))
        at = start[:still] + n[:still] - 1 - t
        path[at] = k[:still]
        k[:still] = back[at, k[:still]]
    for (_, text, a, b), s in zip(where, start, strict=True):
        tags[text][a:b] = path[s : s + b - a]
    return tags


def read(some: list[str], net: dict) -> Iterator[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the net finds, for each text. A window has CONTEXT characters more on both sides than it adds."""
    wide = CORE + 2 * CONTEXT
    every = [codes(t) for t in some]
    cut, owner = [], []
    for k, c in enumerate(every):
        for start in range(0, len(c), CORE):
            cut.append(start)
            owner.append(k)
    total = [np.zeros((len(c), TAGS), np.float32) for c in every]
    order = sorted(range(len(cut)), key=lambda w: len(every[owner[w]]) - cut[w])
    for i in range(0, len(order), TOGETHER):
        now = order[i : i + TOGETHER]
        longest = min(wide, max(len(every[owner[w]]) - cut[w] for w in now) + CONTEXT)
        ids = np.zeros((longest, len(now)), np.uint8)
        for b, w in enumerate(now):
            part = every[owner[w]][max(0, cut[w] - CONTEXT) : cut[w] + longest - CONTEXT]
            at = max(0, CONTEXT - cut[w])
            ids[at : at + len(part), b] = part
        e = scores(ids, net)
        for b, w in enumerate(now):
            c, first = total[owner[w]], max(0, cut[w] - CONTEXT)
            last = min(len(c), cut[w] + longest - CONTEXT)
            c[first:last] += e[CONTEXT - cut[w] + first : CONTEXT - cut[w] + last, b]
    for c in total:  # where two windows overlap, their scores are averaged
        for start in range(CORE, len(c), CORE):
            c[start - CONTEXT : start + CONTEXT] *= 0.5
    for k, tags in enumerate(decode(total, net["t"])):
        edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
        found = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if tags[a]:
                piece = some[k][a:b]
                a, b = a + len(piece) - len(piece.lstrip(" \n.,;:!?")), b - (len(piece) - len(piece.rstrip(" \n.,;:!?")))
                if b - a >= MIN_SPAN:
                    found.append((int(a), int(tags[a]) - 1, int(b)))
        yield found


#: What an address has at least, in any of its forms.
_ADDRESS = re.compile(r"(?:@|[(\[]at[)\]])\s?[\w-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[\w-]+)+|\w at [\w-]+(?: dot [\w-]+)* dot [a-z]{2,6}\Z", re.I)


def plausible(piece: str, kind: int) -> bool:
    """Whether a span of the net holds what its kind cannot do without."""
    digits = sum(c.isdigit() for c in piece)
    if KINDS[kind] == "email":
        return bool(_ADDRESS.search(piece))
    if KINDS[kind] == "ip":
        return digits >= 4 and (piece.count(".") == 3 or piece.count(":") >= 2)
    if KINDS[kind] == "card":
        return 12 <= digits <= 19 and luhn("".join(c for c in piece if c.isascii() and c.isdigit()))
    if KINDS[kind] == "phone":  # 15 digits at most; digits alone are a number like any other, unless they begin as calls abroad do
        return 7 <= digits <= 15 + 2 * piece.startswith("00") and (not piece.isdigit() or piece.startswith("00"))
    return digits > 0 or "=" in piece or ":" in piece


@lru_cache(maxsize=1)
def _could() -> re.Pattern:
    """What some plausible span holds at least, whatever its kind: a digit, one of @ = :, or an address in words."""
    more = "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal())  # \d has the decimal ones
    return re.compile(rf"[\d{more}@=:]|[(\[]at[)\]]|\w at [\w-]+(?: dot [\w-]+)* dot [a-z]", re.I)


def all_spans(some: list[str], net: dict) -> Iterator[tuple[list, list]]:
    """Base spans, and all spans: plausible ones of the net are added where they overlap no base span. Texts that cannot hold a plausible span, as
    they have nothing of what each kind needs, are not read by the net; the result is that of reading all."""
    could = _could()
    held = [k for k, text in enumerate(some) if could.search(text)]
    found = dict(zip(held, read([some[k] for k in held], net), strict=True))
    for k, text in enumerate(some):
        base = base_spans(text)
        free = [s for s in found.get(k, ()) if plausible(text[s[0] : s[2]], s[1]) and all(s[2] <= b[0] or b[2] <= s[0] for b in base)]
        yield base, sorted([*base, *free])


def find(docs: DataFrame, net: dict | None = None) -> DataFrame:
    """docs with base and spans (arrays of kind, start, end in code points) beside its own columns. The net's size is fixed, whatever the input."""
    held = docs.sparkSession.sparkContext.broadcast(net or net_of(docs.sparkSession))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans")))
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = rows.select("*", F.lit(None).cast(span).alias("base"), F.lit(None).cast(span).alias("spans")).schema

    def apply(batch: pa.RecordBatch) -> dict:
        found = list(all_spans([t or "" for t in texts(batch)], held.value))
        return {name: [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f[i]] for f in found] for i, name in enumerate(("base", "spans"))}

    return map_batches(rows, schema, apply, ROWS)


def redact(docs: DataFrame, net: dict | None = None) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first kind."""
    held = docs.sparkSession.sparkContext.broadcast(net or net_of(docs.sparkSession))

    def apply(batch: pa.RecordBatch) -> dict:
        own = texts(batch)
        found = all_spans([t or "" for t in own], held.value)
        return {"text": [None if t is None else replaced(t, spans) for t, (_, spans) in zip(own, found, strict=True)]}

    return map_batches(docs, docs.schema, apply, ROWS)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
