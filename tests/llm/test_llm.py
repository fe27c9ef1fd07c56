import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import chat, decontaminate, licences, mixing, pii, quality_rules, queries, simhash, subwords, templates, toxicity
from logloom.llm.base import BROADCAST_BYTES, join_small, written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORDS, ALNUM_WORDS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, fp string, size string, items int, base int, spans int, positions int"


def words(text, pattern=SPACE_WORDS):
    return pattern.findall((text or "").translate(LOWER))


def made(rng, n, sep=" "):
    return sep.join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows; the other columns have names that operators use themselves."""
    rng = random.Random(7)
    long, base = made(rng, 30_000), made(rng, 400)
    near = [" ".join(base.split()[:k] + ["zzz"] + base.split()[k + 1 :]) for k in range(0, 400, 40)]
    texts = [None, "", " \n\t", "one", "one two", "Ünïcode Wörds\x85here\xa0too", long, base, base, *near, "a b c " * 40, "\n".join(["same line here"] * 5 + ["x"]), made(rng, 60) + " #$% <b>|&", "A\x1cB\x00C"]
    rows = [(i if i != 4 else None, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2", "", None])) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, None, None, None), (None, "null id", "en", "s0"), (None, None, None, None)]
    return [(*r, None, "clash", 1, "clash", "clash", 2, 3, 4, 5) for r in rows]


@pytest.fixture(scope="module")
def edge(spark, edge_rows):
    return written(spark.createDataFrame(edge_rows, DOCS).repartition(3), "edge")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_text(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# --- 1 ---


def test_templates_find_slots(spark):
    rng = random.Random(1)
    page = lambda i, body: f"<html><head><title>T{i}</title></head><body><div class='top'>Welcome to the site</div><div class='x'><h2>H{i}</h2><p>{body}</p></div><div class='legal'>All of it is ours</div></body></html>"
    bodies = [made(rng, 20) for _ in range(12)]
    rows = [(i, f"https://a.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"H{i}\n{b}" for i, b in enumerate(bodies)}
    found = templates.tokens(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert found.where("path = ''").first()["pages"] == 12
    assert templates.classes(found).where("text IS NOT NULL").count() == 2  # what all pages share: the greeting and the notice


def test_main_elements_of_a_minority_of_pages(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(20):
        intro, body = made(rng, 5), [made(rng, 20) for _ in range(2)]
        article = f"<article class='post kind-{rng.choice('abc')}'><h1>H{i}</h1><p>{body[0]}</p><p>{body[1]}</p></article>" if i < 6 else ""
        rows.append((i, f"https://a.example/{i}", f"<html><body><nav>Menu</nav><div class='top'>Welcome to the site</div><div class='intro'><p>{intro}</p></div>{article}</body></html>"))
        want[i] = "\n".join([intro, *([f"H{i}", *body] if i < 6 else [])])
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_lists_tables_and_sections_in_slots(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(20):
        text, parts = [made(rng, 6) for _ in range(9)], []
        parts += [f"<ul>{''.join(f'<li>{t}</li>' for t in text[:2])}</ul>"] * (i % 4)  # as often as not the same
        parts += [f"<table><tr><td>{text[2]}</td></tr></table>"] * (i % 3 == 0)
        parts += [f"<section><h2>{text[3]}</h2><p>{text[4]}</p></section>"] * (i % 5 == 0)
        wrapped = f"<div class='wrap'><section class='part'><p>{text[5]}</p></section></div>" if i % 2 else f"<div class='wrap'><figure><p>{text[5]}</p></figure><ol><li>{text[8]}</li></ol></div>"
        rows.append((i, f"https://a.example/{i}", f"<html><body><div class='top'>Welcome to the site</div><div class='content'><p>{text[6]}</p>{''.join(parts)}<div class='note'><p>Read with care</p></div></div>{wrapped}<div class='by'>{text[7]}</div><div class='legal'>All of it is ours</div></body></html>"))
        want[i] = "\n".join([text[6], *text[:2] * (i % 4), *[text[2]] * (i % 3 == 0), *text[3:5] * (i % 5 == 0), text[5], *[text[8]] * (i % 2 == 0), text[7]])
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("around", ["article", "div class='content'"])
def test_fixed_blocks_in_articles_are_taken_out(spark, around):
    rng = random.Random(13)
    rows, want = [], {}
    for i in range(12):
        text, notice = [made(rng, 20) for _ in range(2)], "<p>Write to us for more</p><div class='letter'><p>Our letter is free</p></div>"
        rows.append((i, f"https://a.example/{i}", f"<html><body><div class='top'>Welcome</div><{around}><h1>H{i}</h1><p>{text[0]}</p>{notice}<p>{text[1]}</p></{around.split()[0]}></body></html>"))
        want[i] = "\n".join([f"H{i}", *text])
    copied = made(rng, 30)  # a host that has one article under many addresses keeps it
    rows += [(i, f"https://b.example/{i}", f"<html><body><article><h1>Same</h1><p>{copied}</p><p>read {i} times</p></article></body></html>") for i in range(20, 24)]
    want |= {i: f"Same\n{copied}\nread {i} times" for i in range(20, 24)}
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_equals_plain_extraction(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in templates.op1_html_extraction(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_roles_and_edges(spark):
    body = """<header>Site</header><nav>Menu</nav><div id="site-header">Logo</div><main><div class="entry-header"><h1>Title &amp; more</h1></div><!-- x --><p>One<br>two &lt;b&gt;<p>Three <a href="y">four</a><script>var x="</p>";</script><ul><li>i<li>j</ul>
      <form>Search</form><div class="comments"><p>Reader says</p></div><aside>Also</aside><table><tr><td>c1<td>c2</table></main><div id="cookie-notice">Accept</div><footer>End</footer>"""
    rows = [(1, "http://x/1", body), (2, None, None), (3, "", ""), (None, "http://y", "plain text, no tags"), (3, "", ""), (5, "http://z/", "<p>open <b>bold"), (6, "http://z/", "<<< > <a <p>x</p")]
    got = [tuple(r) for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).select("page_id", "text").collect()]
    assert dict(got)[1] == "Title & more\nOne two <b>\nThree four\ni\nj\nc1\nc2"
    assert got[1:5] == [(2, ""), (3, ""), (None, "plain text, no tags"), (3, "")] and dict(got)[5] == "open bold" and len(got) == 7
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 2 ---


def plain_fingerprint(text):
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, roots=False):
    prints = {f: None for f in {plain_fingerprint(t) for _, t in rows}}
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        root = find(plain_fingerprint(t))
        least[root] = min((x for x in (i, least.get(root)) if x is not None), default=None)
    if roots:
        return list(least.values())
    return [(i, f"{plain_fingerprint(t):016x}", least[find(plain_fingerprint(t))]) for i, t in rows]


def test_simhash_equals_brute_force(spark, edge, edge_rows, sf_dir):
    key = lambda r: tuple((x is None, x) for x in r)
    found = simhash.near_duplicates(edge).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_components([r[:2] for r in edge_rows]), key=key)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op2_simhash(spark, sf_dir).collect())) == sorted(plain_components(rows))


def test_posting_lists_meet_all_pairs():
    assert len(simhash.POSITIONS) == 14
    for differ in itertools.combinations(range(8), 3):
        assert any(not set(p) & set(differ) for p in simhash.POSITIONS)


def test_links_of_a_dense_list(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    cloud = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 4), replace=False))) for c in centre for _ in range(300)])
    want = plain_links(cloud)
    df = spark.createDataFrame(pd.DataFrame({"fp": cloud.view(np.int64)}))
    posted = df.select(F.explode(simhash.posting_keys(F.col("fp"))).alias("key"), "fp").repartition(3, "key").sortWithinPartitions("key")
    edges = posted.mapInPandas(simhash.links, "a bigint, b bigint")
    assert edges.count() < 14 * len(cloud)
    groups = collections.defaultdict(set)
    for r in simhash.components(edges).distinct().collect():
        groups[r["root"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(want)


def plain_links(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if int(prints[i] ^ prints[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i, p in enumerate(prints.view(np.int64).tolist()):
        out[find(i)].append(p)
    return [sorted(g) for g in out.values() if len(g) > 1]


def test_keep_one(edge, edge_rows, empty):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    groups = plain_components([r[:2] for r in edge_rows], roots=True)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(groups, key=str)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i != 20], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(51)}


# --- 3 ---


def plain_leaks(text, items, size=13):
    w, hit, found = words(text, ALNUM_WORDS), set(), set()
    for item, t in items:
        v = words(t, ALNUM_WORDS)
        for window in {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1) if v else 0)}:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 60])
def test_leaks_equal_brute_force(spark, edge, edge_rows, block):
    rng = random.Random(3)
    base = edge_rows[8][1].split()
    items = [(1, " ".join(base[5:30])), (2, "ONE"), (3, None), (4, ""), (None, " ".join(base[40:60])), (10, " ".join(base[20:33]).upper() + "!"), (11, made(rng, 20)), (10, "null, ID")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_leaks(edge, benchmark, block_chars=block))
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = collections.Counter((r[0], *plain_leaks(r[1], items)) for r in edge_rows)
    assert by_text(got, "doc_id", *columns) == want
    for r in got.where("size(char_spans) > 0").collect():
        for (a, b), (c, d) in zip(r["word_spans"], r["char_spans"], strict=True):
            assert words(r["text"][c:d], ALNUM_WORDS) == words(r["text"], ALNUM_WORDS)[a:b]


def test_leaks_edges(spark, edge, empty, sf_dir):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(edge, none).count() == edge.count()
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(edge, some)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 1 and kept.first()["n_words"] == "clash"
    assert decontaminate.drop_contaminated(empty, some).count() == 0


# --- 4 ---


def plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", "x.y+z%w@", "d-e.f", "1.2.3.4", "300.1.1.1", ".5.6", "4111 1111 1111 1111", "4111-1111-1111-1111", "12", "+1 (555) 010-9999", "+", "(", ")", "-", " ", "é", "a", "9", "\n", "@b", ".c", "..", "+12345678", "0" * 13, "@x@y.zz@q.r"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@" * 1000 + "1" * 200_000) == []  # in linear time


def test_gradients():
    net = pii.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 128, (7, 3)), rng.integers(0, pii.TAGS, (7, 3))
    _, grads = net.gradients(ids, tags)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, ends = net.p[k][at], []
        for step in (1e-4, -1e-4):
            net.p[k][at] = old + step
            ends.append(net.gradients(ids, tags)[0])
        net.p[k][at] = old
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=1e-2, abs=1e-6), k


def plain_viterbi(e, tr):
    best, back = e[0].astype(float), []
    for row in e[1:]:
        x = best[:, None] + tr
        back.append(x.argmax(0))
        best = x.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return float(best.max()), path[::-1]


def test_decoding_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        tr = rng.normal(0, 2, (pii.TAGS, pii.TAGS))
        texts = [rng.normal(0, 2, (int(rng.integers(0, 30)), pii.TAGS)).astype(np.float32) for _ in range(4)]
        for e in texts:
            e[:, 0] += rng.uniform(0, 8)
        for e, path in zip(texts, pii.decode(texts, tr), strict=True):
            if len(e):
                got = float(e[np.arange(len(e)), path].sum() + tr[path[:-1], path[1:]].sum())
                assert got == pytest.approx(plain_viterbi(e, tr)[0], abs=1e-3)


def test_net_on_texts_of_its_own():
    net, rng = pii.trained(), np.random.default_rng(99)
    found = total = wrong = 0
    for _ in range(40):
        text, tags = pii.example(rng, 1500)
        edge = np.flatnonzero(np.diff(np.array(tags[: len(text)]), prepend=0, append=0))
        gold = [(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if tags[a]]
        _, spans = next(pii.all_spans([text], net))
        total += len(gold)
        found += sum(any(a < e and s < b for s, _, e in spans) for a, b in gold)
        wrong += sum(not any(s < b and a < e for a, b in gold) for s, _, e in spans)
    assert found >= 0.93 * total and wrong <= 0.05 * total


def test_windows_agree_with_one_window():
    net, rng = pii.trained(), np.random.default_rng(5)
    text = "".join(pii.example(rng, 700)[0] for _ in range(3))
    alone = next(pii.read([text], net))
    assert alone == list(pii.read(["x", text, "", text], net))[1]  # other texts beside it change nothing
    assert alone and max(e for _, _, e in alone) > 3 * pii.CORE


def test_pii_rows(edge, edge_rows, empty):
    rows = pii.find(edge).select("doc_id", "text", "base", "spans", "n_words").collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        base = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["base"]]
        assert base == plain_spans(r["text"] or "") and set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) and r["n_words"] == "clash"
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
    text = "mail me@home.org, call +1 (555) 010-9999"
    assert pii.replaced(text, pii.base_spans(text)) == "mail <email>, call <phone>"


def test_pii_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op4_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == i for x in base) for i in range(4)]


# --- 5 ---


def plain_counts(text):
    text = text or ""
    w = SPACE_WORDS.findall(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(edge, edge_rows):
    got = quality_rules.judge(edge)
    want = collections.Counter()
    for r in edge_rows:
        c = plain_counts(r[1])
        want[r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert by_text(got, "doc_id", *quality_rules.COUNTS, "base_failed") == want
    assert quality_rules.keep(edge).columns == edge.columns
    assert quality_rules.keep(edge).count() == got.where("kept").count()


def test_quality_outliers(spark, sf_dir, empty):
    rng = random.Random(5)
    clean = [(i, "\n".join(made(rng, 30).capitalize() + "." for _ in range(4)), "en", "s0" if i % 3 else "s1") for i in range(700)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in made(rng, 120).split()), "en", "s0") for i in range(40)] + [(2000 + i, made(rng, 120).upper(), "en", "s1") for i in range(40)]
    docs = written(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string"), "quality")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert kept == {r[0] for r in clean} == {r["doc_id"] for r in quality_rules.keep(docs).collect()}
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [r for r in quality_rules.op5_quality_rules(spark, sf_dir).collect() if not r["base_failed"] and r["doc_id"] in labels]
    assert not [r["doc_id"] for r in judged if labels[r["doc_id"]] == 1 and not r["kept"]]


def test_estimates_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, quality_rules.DIM)) @ np.diag([0.3, 0.2, 0.4, 0.3, 0.1, 0.2])
    x[:60] += 5
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "g string, x array<double>")
    got = quality_rules.fit(written(rows, "x")).first()
    mean, precision = np.array(got["mean"]), np.array(got["precision"]).reshape(quality_rules.DIM, -1)
    d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
    assert np.abs(mean).max() < 0.1 and (d[:60] > quality_rules.CUTOFF).all() and (d[60:] < quality_rules.CUTOFF).all()
    assert quality_rules.chi2_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)


# --- 6, 10 ---


def folds(spark, sf_dir, query, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    return [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_held_out_accuracy(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    for query, label, least in ((toxicity.op6_toxicity, "toxic", 0.93), (subwords.op10_quality_classifier, "quality", 0.97)):
        pairs = folds(spark, larger, query, label)
        assert len(pairs) > 50 and sum(a == b for a, b in pairs) >= least * len(pairs)
    assert query(spark, larger).collect() == query(spark, larger).collect()


def test_toxicity_ranks_held_out_rows(sf_dir):
    """Recall at the threshold and the area under the curve; accuracy alone says little where one row in ten is toxic."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs = pd.read_parquet(f"{larger}/documents.parquet").merge(pd.read_parquet(f"{larger}/labels.parquet"), on="doc_id")[["doc_id", "text", "toxic"]]
    docs = list(docs.dropna().drop_duplicates("doc_id").astype({"toxic": int}).itertuples(index=False))
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs]
    model = toxicity.train(*map(list, zip(*((t, y) for h, (_, t, y) in zip(held, docs, strict=True) if not h), strict=True)))
    rows = [(t, y) for h, (_, t, y) in zip(held, docs, strict=True) if h]
    a, b = model["scale"]
    top = np.clip(list(toxicity.largest([t for t, _ in rows], model, {})), *toxicity.LIMITS)
    score, y = 1 / (1 + np.exp(-(a + b * top))), np.array([y for _, y in rows])
    pairs = score[y == 1][:, None] - score[y == 0][None, :]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.88
    assert (score[y == 1] >= toxicity.THRESHOLD).mean() > 0.75 and (score[y == 0] >= toxicity.THRESHOLD).mean() < 0.02


def test_terms_of_a_toxic_stem_need_less_evidence():
    clean = [f"{a}{b}" for a in ("mora", "teli", "sodu", "vani") for b in ("ne", "co", "ra", "ti")]
    rows = [(f"{clean[i % 16]} {clean[i // 16 % 16]} {i}", 0) for i in range(400)]
    rows += [(f"{clean[i % 16]} quexor{['ta', 'mi'][i >= 30]} {i}", 1) for i in range(33)] + [(f"{clean[i]} brilum {i}", 1) for i in range(3)]
    toxic, count = toxicity.examples(*zip(*rows, strict=True))
    assert toxic == {"quexorta": 30, "quexormi": 3} and count["morane"] > 1 and "quexormi" not in count


def test_rare_toxic_terms_are_examples(monkeypatch):
    rng = random.Random(6)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    insults, clean = {word("qxzjkv", 7): 20 + (i < 70) * 12 for i in range(90)}, [word("abcdeilmnorst", 6) for _ in range(300)]
    sentence = lambda: " ".join(rng.sample(clean, 6))
    rows = [(f"{sentence()} {t}", 1) for t, n in insults.items() for _ in range(n)] + [(sentence(), 0) for _ in range(3000)]
    toxic, _ = toxicity.examples(*zip(*rows, strict=True))
    assert set(insults) <= set(toxic)
    given = []
    monkeypatch.setattr(toxicity, "hinge", lambda x, y, weight: given.append(int((y > 0).sum())) or (np.zeros(x.shape[1]), 0.0))
    toxicity.train(*map(list, zip(*rows, strict=True)))
    assert set(given) == {len(toxic) * (1 + toxicity.INSERTED + toxicity.DOUBLED)}


def plain_kernel(a, b):
    def vector(t):
        s = toxicity.symbols(f"\n{t}\n")
        out, norm = collections.Counter(), 0.0
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i <= toxicity.SPAN:
                w = toxicity.DECAY ** (k - i)
                out[s[i], s[j], s[k]] += w
                norm += w * w
        return out, norm**0.5

    (x, n), (y, m) = vector(a), vector(b)
    return sum(v * y[k] for k, v in x.items()) / n / m


def test_kernel_equals_its_definition():
    a, b = ["idiot", "idxiot", "ab", "résumé", "aaaa"], ["idiot", "riot", "aa", "x"]
    got = toxicity.kernel(a, b)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        assert got[i, j] == pytest.approx(plain_kernel(a[i], b[j]), abs=1e-5)


def test_folded_machine_equals_landmarks():
    marks, beta, rng = ["idiot", "stupid", "table", "green"], np.array([1.0, 0.7, -0.5, -0.6]), np.random.default_rng(0)
    weights = np.zeros(toxicity.SYMBOLS**3)
    for owner, code, k in toxicity.subsequences(marks):
        np.add.at(weights, code, k * (beta / toxicity.length(4, marks))[owner])
    terms = ["idxiot", "stupidly", "tab", "word"]
    assert toxicity.values(terms, weights, 0.1) == pytest.approx(toxicity.kernel(terms, marks) @ beta + 0.1, abs=1e-5)


def test_insults_with_gaps():
    rng = random.Random(6)
    insults = ["idiot", "worthless", "pathetic"]
    texts, labels = [], []
    for i in range(400):
        w = made(rng, 30).split()
        if i % 5 == 0:
            w[rng.randrange(30)] = rng.choice(insults)
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    model = toxicity.train(texts, labels)
    a, b = model["scale"]
    p = lambda t: 1 / (1 + np.exp(-(a + b * np.clip(next(toxicity.largest([t], model, {})), *toxicity.LIMITS))))
    clean = made(rng, 30)
    assert p(clean) < 0.3 and p("") < 0.3 and p(None) < 0.3
    for bad in ("idiot", "i.d.i.o.t", "i d i o t", "Worthless!", "wortthless", "path-etic", "patheetic"):
        assert p(f"{clean} {bad} {clean}") >= 0.7, bad
    assert toxicity.train([], [])["scale"][1] == 0 and toxicity.train(["a"], [1])["scale"][1] == 0


def test_features_of_pieces():
    text = made(random.Random(8), 3000)
    whole = collections.Counter(np.concatenate([subwords.features(p) for p in subwords.pieces(text)]).tolist())
    cut = collections.Counter(np.concatenate([subwords.features(p) for p in subwords.pieces(text, 500)]).tolist())
    assert whole == cut
    assert subwords.features(b" ab ").tolist() and not len(subwords.features(b"  "))


def test_classifiers_on_edges(spark, edge, edge_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, sample in ((subwords, "quality"), (toxicity, "toxic")):
        model = module.train(*module.labelled_sample(edge, none, sample))
        assert module.score(edge, model).count() == len(edge_rows) and module.score(empty, model).count() == 0
        some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
        scores = [r["score"] for r in module.score(edge, module.train(*module.labelled_sample(edge, some, sample))).collect()]
        assert len(scores) == len(edge_rows) and all(0 <= s <= 1 for s in scores)


# --- 7 ---


def test_targets_equal_filling(spark):
    rng = random.Random(9)
    for _ in range(5):
        sizes = [(f"s{i:02}", rng.choice([0, 1, 5, 40, 1000, 9])) for i in range(rng.randint(1, 9))] + [(None, 7)]
        got = {r["source"]: (r["target"], r["source_size"]) for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
        total, capped = sum(n for _, n in sizes), {}
        while True:
            rest = [s for s, _ in sizes if s not in capped]
            share = {s: weight[s] * (total - sum(capped.values())) / sum(weight[x] for x in rest) for s in rest}
            over = [s for s in rest if share[s] > 3 * dict(sizes)[s] + 1e-9]
            if not over:
                break
            capped |= {s: 3.0 * dict(sizes)[s] for s in over}
        for s, n in sizes:
            assert got[s][0] == pytest.approx((capped | share)[s], abs=1e-6) and got[s][0] <= 3 * n + 1e-6


def test_mix(edge, edge_rows, empty):
    mix = mixing.mix(edge).collect()
    assert len(mix) == len(edge_rows) and all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] for r in mix)
    by = collections.defaultdict(list)
    for r in mix:
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"] and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
    order = [(r["positions"] or [2.0])[0] for r in mix]
    assert order == sorted(order) and mix == mixing.mix(edge).collect()
    copies = mixing.training_order(edge, carry=("text", "positions", "spans")).collect()
    assert len(copies) == sum(r["copies"] for r in mix) and [r["position"] for r in copies] == sorted(r["position"] for r in copies)
    assert mixing.mix(empty).count() == 0 and mixing.training_order(empty).count() == 0


def test_schedule_positions(spark):
    df = spark.createDataFrame([(a, b, s / 10) for a, b in ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5), (0.0, 2.0)) for s in range(11)], "a double, b double, s double")
    for r in df.select("*", mixing.position(F.col("s"), F.col("a"), F.col("b")).alias("t")).collect():
        assert 0 <= r["t"] <= 1 + 1e-9 and r["a"] * r["t"] + (r["b"] - r["a"]) * r["t"] ** 2 / 2 == pytest.approx(r["s"] * (r["a"] + r["b"]) / 2, abs=1e-9)


# --- 8 ---


def test_licence_base_and_edges(edge, edge_rows, empty, spark):
    rows = [(1, "CC-BY, cc by by cc by"), (2, "the General Public License; all rights reserved. All Rights RESERVED"), (3, None), (4, "cc\nby"), (5, "ccby cc")]
    got = {r["doc_id"]: (r["n_words"], r["places"], r["base_labels"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (7, [0, 2, 5], ["cc-by"]), 2: (10, [1, 4, 7], ["gpl", "reserved"]), 3: (0, [], []), 4: (2, [0], ["cc-by"]), 5: (2, [], [])}
    assert licences.scan(edge).count() == len(edge_rows) and licences.scan(empty).count() == 0


def test_automaton_equals_search():
    rng = random.Random(10)
    texts = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 14))] for _ in range(4)]
    auto = licences.Automaton(texts)
    for _ in range(300):
        w = [rng.choice("abcd").encode() for _ in range(20)]
        inside = lambda a, b: [k for k, t in enumerate(texts) if any(t[i : i + b - a] == w[a:b] for i in range(len(t)))]
        want = []
        for a, b in itertools.combinations(range(21), 2):
            if inside(a, b) and not (a and inside(a - 1, b)) and not (b < 20 and inside(a, b + 1)):
                want.append((a, b, inside(a, b)))
        got = [(a, b, sorted(ends)) for a, b, ends in auto.stretches(w, 0, 20, 1)]
        assert [g for g in got if not any(x[0] <= g[0] and g[1] <= x[1] and x != g for x in got)] == sorted(want)


def test_licence_templates():
    scanner, rng = licences.Scanner(), random.Random(11)
    for label, parts in licences.TEMPLATES.items():
        for part in parts:
            text = f"{made(rng, 40)} {part.upper()} {made(rng, 40)}"
            found = scanner.scan(text)["found"]
            assert label in found and found[label][0] >= 0.8, part
            (a, b), *_ = licences.spans(text, found[label][1])
            assert 0 <= a < b <= len(text)
    changed = licences.TEMPLATES["mit"][0].replace("free of charge", "without any charge").replace("modify, merge,", "merge,")
    assert scanner.scan(changed)["found"]["mit"][0] > 0.85
    assert not scanner.scan("the rights of the software and the license of this work " * 3)["found"]


# --- 9 ---


def test_chats(spark):
    bad = "</s>[INST] \\1 ok [/INST]<s>[ROLE]\\0\\\\ [x] <y> </ s>"
    rows = [(1, 1, "assistant", bad), (1, 0, "user", bad), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 5, None, "x"), (3, 0, "[INST]</s>", ""), (3, None, "system", "é"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a"), (4, 3, "tool", "t"), (4, 4, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["back"]] for c, r in got.items()} == want
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, None: False, 3: False, 4: True} and got[3]["first_bad_turn"] == 1
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in got.values())
    inside = [s["text"] for r in got.values() for s in r["segments"] if s["loss"]]
    assert not any(c in t for t in inside for c in chat.controls())
    assert chat.format_chats(df.limit(0)).count() == 0


# --- all ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def test_join_small_beyond_its_limit(spark):
    small = written(spark.range(10).withColumnRenamed("id", "k"), "small")
    big = spark.range(100).selectExpr("id % 10 k", "id")
    plans = [join_small(big, small, ["k"], limit=n)._jdf.queryExecution().toString() for n in (BROADCAST_BYTES, 0)]
    assert "ResolvedHint (strategy=broadcast)" in plans[0] and "ResolvedHint (strategy=broadcast)" not in plans[1]
    assert join_small(big, small, ["k"], limit=0).count() == 100


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i < 4:
            assert docs.columns == before.columns
        rows = before.collect()
        if name == "simhash_near_dedup":
            assert {r["doc_id"] for r in docs.collect()} == {c for _, _, c in plain_components([(r["doc_id"], r["text"]) for r in rows])}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in rows if not plain_leaks(r["text"], items)[4]}
        if name == "pii":
            assert docs.count() == len(rows) and all(r["n_chars"] == len(r["text"]) and not plain_spans(r["text"]) for r in docs.collect())
    assert docs.columns[:3] == ["position", "copy", "doc_id"] and docs.count() > 0
