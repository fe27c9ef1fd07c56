"""HTML extraction by equivalence classes: tokens of the pages of a host that share an occurrence vector form its template.

Tokens are elements at their path (tag and class names; start and end count as two) and text blocks at their path. A token's
occurrence vector over the pages of its host is kept as the sum of one hash for each page and count, next to the number of
pages, so that vectors of any length meet in a partial aggregate. Tokens of one vector form a class, if they recur on SUPPORT of
the host's other pages or more. A class is valid if its tokens stand in one order on every page, in which they are read off one
cycle after another, and if each of its cycles ends in the gap of the class in which it began: tokens that break the
order, and classes that break the nesting, are taken out. What is left with two tokens or more is the template.

Text belongs to the slot of the nearest template element around it; template text is fixed, all other varies. A slot is no
text if most of what varies in it is links, or lies in elements that are no article by role, over all pages together. The core is the
deepest element that holds over half of the text that varies; text slots are the core, and those in it, or of at least MINOR of that
text elsewhere, that are not mostly fixed. A page's text is what stands in text slots, less template text, and less what
roles rule out below a slot, where the template has no element. Template text that makes up FIXED_SHARE of what a page's text
slots hold stays: it is an article that most pages repeat, rather than a notice in it. Only a page without text in such slots,
or of a host without a template (one of one page, say), is read by roles and main elements (article, main) alone.

Null and empty pages have the empty text; a null url is a host of its own; repeated rows are pages of their own. An empty table
gives no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import BROADCAST_BYTES, join_small, kind, map_batches, table, texts, utf8, written

#: Share of a host's other pages that a class of the template is on; share of a slot's text that may be fixed; of its varying text that
#: may be links; and of all varying text that a slot outside the core holds at least.
SUPPORT, FIXED_SHARE, LINKS, MINOR = 0.5, 0.5, 0.7, 0.05

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"<]*"|'[^'<]*'|[^<>"']|["'])*+)>|<[!?][^>]*>|[^<]+|<""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())
_MAIN = frozenset(("article", "main"))
#: Elements whose text is no article.
_OUT = frozenset("head nav footer aside form button select option menu dialog object".split())
_OUT_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disclaimer|footer|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: The same, but for what stands in a main element, where it holds the title.
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: What an opening tag ends if it is still open (up to the nearest other block).
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's name in paths, whether it is out by role, whether it is a header, and whether it is a main element."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = re.sub(r"\d+", "0", found.get("class", "")).replace("/", "|")
    role = found.get("role", "").lower()
    called = "" if tag in ("html", "body", *_MAIN) else f"{found.get('class', '')} {found.get('id', '')}"
    out = tag in _OUT or role in _OUT_ROLES or bool(_OUT_NAMES.search(called))
    return ("main" if role == "main" else tag) + "".join(f".{n}" for n in sorted(names.split())), out, tag == "header" or bool(_HEADER_NAMES.search(called)), tag in _MAIN or role == "main"


class Block(NamedTuple):
    container: str
    out: bool
    main: bool
    text: str
    links: int


def parse(page: str | None) -> tuple[list[Block], list[str]]:
    """Text blocks in page order: container path, out by role, inside a main element, text, characters of it that are links. And the
    page's elements by path and its blocks (as None) in order."""
    blocks: list[Block] = []
    order: list[str | None] = []
    #: tag, path, path as a container, out, main
    stack: list[tuple[str, str, str, bool, bool]] = [("", "", "", False, False)]
    text: list[str] = []
    links, link = 0, False
    muted: list[str] = []  # inline elements inside one that is out

    def end() -> None:
        nonlocal links, link
        if text:
            if joined := _SPACE.sub(" ", "".join(text)).strip():
                _, _, container, out, main = stack[-1]
                blocks.append(Block(container, out, main, joined, min(links, len(joined))))
                order.append(None)
            text.clear()
        links, link = 0, False
        muted.clear()

    def close(to: int) -> None:
        end()
        del stack[to:]

    for m in _TOKEN.finditer(page or ""):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not muted:
                    piece = entities.unescape(piece)
                    text.append(piece)
                    links += len(piece) if link else 0
            elif m[1] and m[1].lower() in ("title", "textarea"):
                end()
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            elif m[2]:
                if tag in muted:
                    while muted.pop() != tag:
                        pass
                link = link and tag != "a"
            else:
                link = link or tag == "a"
                if tag not in _VOID and (muted or m[4] and "=" in m[4] and tag != "a" and _element(tag, m[4])[1]):
                    muted.append(tag)
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                end()
            continue
        end()
        if tag in _VOID:
            continue
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        elif tag in _ENDS:
            while stack[-1][0] in _ENDS[tag]:
                close(len(stack) - 1)
        name, out, header, main = _element(tag, m[4])
        _, above, container, was_out, was_main = stack[-1]
        path = f"{above}/{name}"
        out = was_out or out or header and not was_main
        stack.append((tag, path, container if tag in _LEAF else path, out, was_main or main))
        order.append(path)
    end()
    return blocks, order


@lru_cache(maxsize=1 << 16)
def element(path: str) -> int:
    """The number of an element at its path; token() is that of a text block."""
    return xxhash.xxh64_intdigest(utf8(path), 1) - (1 << 63)


def token(container: str, text: str) -> int:
    """The number of a text block at its path."""
    return xxhash.xxh64_intdigest(utf8(f"{container}\0{text}")) - (1 << 63)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def sequence(page: str | None) -> list[tuple[str, int, Block | None]]:
    """The page's tokens in order: path, number, and the block, None for an element."""
    blocks, order = parse(page)
    left = iter(blocks)
    return [(path, element(path), None) if path is not None else ((b := next(left)).container, token(b.container, b.text), b) for path in order]


def tokens(pages: DataFrame) -> DataFrame:
    """host, path, key (the token's number), text (the same for a block, null for an element) -> pages, vector (two sums), place (sum of first places in
    the pages), chars, and of these links and outs (by role); the path of a page itself is empty."""
    types = (("host", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("text", pa.int64()))
    sums = ("pages", "low", "high", "place", "chars", "links", "outs")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for host, url, page, number in zip(*(texts(batch, c) for c in ("host", "url", "html", "page_id")), strict=True):
                own: dict[tuple, list[int]] = {(host, "", 0, None): [1, 0, 0, 0, 0]}
                for place, (path, key, b) in enumerate(sequence(page)):
                    x = own.setdefault((host, path, key, None if b is None else key), [0, place, 0, 0, 0])
                    x[0] += 1
                    if b is not None:
                        x[2] += len(b.text)
                        x[3] += b.links
                        x[4] += len(b.text) * b.out
                hashes: dict[int, int] = {}
                for name, (n, *rest) in own.items():
                    if n not in hashes:
                        hashes[n] = xxhash.xxh64_intdigest(f"{number}|{url}|{n}".encode("utf-8", "surrogatepass"))
                    x = seen.setdefault(name, [0] * len(sums))
                    for i, v in enumerate((1, hashes[n] & 0xFFFFFFFF, hashes[n] >> 32, *rest)):
                        x[i] += v
            yield pa.RecordBatch.from_pydict({c: pa.array([k[i] for k in seen], t) for i, (c, t) in enumerate(types)} | {c: pa.array([v[i] for v in seen.values()], pa.int64()) for i, c in enumerate(sums)})

    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    rows = rows.mapInArrow(apply, "host string, path string, key bigint, text bigint, " + ", ".join(f"{c} bigint" for c in sums))
    return rows.groupBy("host", "path", "key", "text").agg(F.struct(F.sum("low").alias("low"), F.sum("high").alias("high")).alias("vector"), *(F.sum(c).alias(c) for c in sums if c not in ("low", "high")))


def _size() -> Column:
    """Tokens of a class: an element has a start and an end."""
    return F.sum(F.when(F.col("text").isNull(), 2).otherwise(1))


def classes(found: DataFrame) -> DataFrame:
    """tokens() -> its rows that recur on SUPPORT of their host's other pages, with the size of their equivalence class."""
    hosts = written(found.where("path = ''").select("host", F.col("pages").alias("n")), "hosts")
    often = join_small(found, hosts, ["host"], "inner").where((F.col("pages") > 1) & (F.col("pages") - 1 >= (F.col("n") - 1) * SUPPORT))
    sizes = written(often.groupBy("host", "vector", "pages").agg(_size().alias("class_size")), "classes")
    return join_small(often, sizes, ["host", "vector", "pages"], "inner")


def broken(order: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """The tokens of a page (class, index) that break the order of their class, and the classes (class, -1) that break the nesting.

    order: class, index and the class's size for each token. Classes whose cycles are open form a stack: a token goes on with
    its class's cycle, and what is open above that did not end in the gap in which it began.
    """
    bad: set[tuple[int, int]] = set()
    stack: list[list[int]] = []
    at: dict[int, int] = {}
    for c, i, n in order:
        if c not in at:
            if i:
                bad.add((c, i))
                continue
            at[c] = len(stack)
            stack.append([c, -1])
        while stack[-1][0] != c:
            bad.add((stack[-1][0], -1))
            del at[stack.pop()[0]]
        if i <= stack[-1][1]:
            bad.add((c, i))
            continue
        stack[-1][1] = i
        if i == n - 1:
            del at[stack.pop()[0]]
    bad.update((c, -1) for c, _ in stack)
    return bad


def template(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, path, key, text of the template: elements that recur, and text blocks that recur in a valid class of two tokens or more.

    What breaks the order or the nesting on any page leaves its class; an element's start and end are a class of their own then. Only hosts with
    text in some class are read again for it.
    """
    often = written(classes(found).where("path != ''"), "often")
    places = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "key")))
    grouped = often.where("class_size > 1").groupBy("host", "vector", "pages").agg(F.transform(places, lambda t: t["key"]).alias("keys"), F.count("text").alias("blocks"))
    known = written(grouped.groupBy("host").agg(F.collect_list("keys").alias("known"), F.sum("blocks").alias("blocks")).where("blocks > 0").drop("blocks"), "known")
    rows = join_small(pages.select("html", host_of().alias("host")), known, ["host"], "inner")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, dict] = {}
            out: set[tuple] = set()
            for i, (host, page) in enumerate(zip(texts(batch, "host"), texts(batch, "html"), strict=True)):
                if host not in held:
                    held[host] = {key: (c, k, len(keys)) for c, keys in enumerate(batch.column("known")[i].as_py()) for k, key in enumerate(keys)}
                place = held[host]
                out.update((host, c, k) for c, k in broken([place[key] for _, key, _ in sequence(page) if key in place]))
            yield pa.RecordBatch.from_pydict({n: pa.array([x[j] for x in out], t) for j, (n, t) in enumerate((("host", pa.string()), ("c", pa.int64()), ("k", pa.int64())))})

    bad = written(rows.mapInArrow(apply, "host string, c bigint, k bigint").distinct(), "broken")
    each = known.select("host", F.posexplode("known").alias("c", "keys")).select("host", F.col("c").cast("long"), F.posexplode("keys").alias("k", "key"))
    good = each.join(bad, (each["host"] == bad["host"]) & (each["c"] == bad["c"]) & ((bad["k"] == -1) | (bad["k"] == each["k"])), "left_anti")
    good = written(good.select("host", "key", "c"), "good")
    texts_ = often.where("text IS NOT NULL").join(good, ["host", "key"])
    sizes = often.join(good, ["host", "key"]).groupBy("host", "c").agg(_size().alias("size")).where("size > 1")
    return written(often.where("text IS NULL").select("host", "path", "key", "text").union(texts_.join(sizes, ["host", "c"]).select("host", "path", "key", "text")), "template")


def _around(path: str = "path") -> Column:
    """A path and those above it, down to that of the page."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def nearest(paths: DataFrame, elements: DataFrame) -> DataFrame:
    """host, path -> slot: the longest path of elements around a path or the path itself; that of the page if there is none."""
    around = paths.select("host", "path", F.posexplode(F.transform(_around(), lambda p: F.xxhash64(p))).alias("depth", "number"))
    named = written(elements.select("host", F.xxhash64("path").alias("number"), F.col("path").alias("slot")), "elements")
    held = join_small(around, named, ["host", "number"]).where("slot IS NOT NULL OR depth = 0")
    return held.groupBy("host", "path").agg(F.max_by(F.coalesce("slot", F.lit("")), "depth").alias("slot"))


def slots(pages: DataFrame) -> DataFrame:
    """host -> slots: the paths of its template's text slots; others: those of its other elements; fixed: its text blocks.
    At most a page's number of elements and blocks / SUPPORT for a host. Hosts without a template are left out."""
    found = written(tokens(pages), "tokens")
    valid = template(pages, found)
    fixed = valid.where("text IS NOT NULL").select("host", "key", F.lit(True).alias("is_fixed"))
    sums = found.where("text IS NOT NULL").join(fixed, ["host", "key"], "left")
    varies = lambda c: F.sum(F.when(F.col("is_fixed").isNull(), F.col(c)).otherwise(0))
    sums = written(sums.groupBy("host", "path").agg(F.sum("chars").alias("total"), *(varies(c).alias(c) for c in ("chars", "links", "outs"))), "totals")
    held = nearest(sums.select("host", "path"), valid.where("text IS NULL"))
    held = sums.join(held, ["host", "path"]).groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("total", "chars", "links", "outs")))
    held = written(held.withColumn("out", (F.col("outs") * 2 > F.col("chars")) | (F.col("links") > F.col("chars") * LINKS)), "held")
    inner = held.where("NOT out AND chars > 0").select("host", "slot", "chars", F.posexplode(_around("slot")).alias("depth", "element"))
    inner = inner.groupBy("host", "depth", "element").agg(F.sum("chars").alias("inside"))
    core = inner.groupBy("host").agg(F.max(F.when(F.col("depth") == 0, F.col("inside"))).alias("all"), F.collect_list(F.struct("depth", "element", "inside")).alias("every"))
    most = F.array_max(F.filter("every", lambda e: e["inside"] * 2 > F.col("all")))["element"]
    known = held.join(core.select("host", "all", most.alias("core")), "host")
    inside = (F.col("slot") == F.col("core")) | F.startswith("slot", F.concat("core", F.lit("/")))
    text = ~F.col("out") & (inside | (F.col("chars") >= F.col("all") * MINOR)) & ((F.col("slot") == F.col("core")) | (F.col("chars") > F.col("total") * FIXED_SHARE))
    rows = known.where(text & (F.col("chars") > 0)).select("host", F.col("slot").alias("path"), F.lit(None).cast("bigint").alias("text"), F.lit(True).alias("slot"))
    rows = rows.unionByName(valid.select("host", "path", "text").withColumn("slot", F.lit(False)))
    path = lambda slot: F.collect_set(F.when((F.col("slot") == slot) & F.col("text").isNull(), F.col("path")))
    out = rows.groupBy("host").agg(F.sort_array(path(True)).alias("slots"), F.sort_array(path(False)).alias("elements"), F.collect_set("text").alias("fixed"))
    return written(out.where("size(slots) > 0 AND size(elements) > 0"), "slots")


def text_of(page: str | None, slots: frozenset[str], elements: frozenset[str] = frozenset(), fixed: frozenset[int] = frozenset(), known: dict[str, str] | None = None) -> str:
    """A page's text by its host's template; by roles and main elements if that has none or finds none. known remembers the slots of paths."""
    blocks, _ = parse(page)
    known = {} if known is None else known

    def slot_of(path: str) -> str:
        if path not in known:
            known[path] = path if not path or path in elements or path in slots else slot_of(path.rpartition("/")[0])
        return known[path]

    held = [b for b in blocks if (at := slot_of(b.container)) in slots and (not b.out or at == b.container)] if slots else []
    if fixed:
        varying = [b for b in held if token(b.container, b.text) not in fixed]
        if sum(len(b.text) for b in varying) > (1 - FIXED_SHARE) * sum(len(b.text) for b in held):
            held = varying
    if not held:
        held = [b for b in blocks if not b.out]
        held = [b for b in held if b.main] or held
    return "\n".join(b.text for b in held)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, slots for every row of pages (page_id, url, html)."""
    rows = join_small(pages.select("page_id", "url", "html", host_of().alias("host")), slots(pages), ["host"], limit=BROADCAST_BYTES)

    def apply(batch: pa.RecordBatch) -> dict:
        held: dict[str, tuple] = {}
        out = []
        for i, (host, page) in enumerate(zip(texts(batch, "host"), texts(batch, "html"), strict=True)):
            if host not in held:
                held[host] = (*(frozenset(batch.column(c)[i].as_py() or ()) for c in ("slots", "elements", "fixed")), {})
            out.append(text_of(page, *held[host]))
        return {"text": out}

    return map_batches(rows, f"page_id {kind(pages, 'page_id')}, url string, text string, slots array<string>", apply)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
