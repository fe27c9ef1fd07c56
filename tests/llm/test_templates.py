"""op1: templates that decide, without main elements or telling names."""

import random

from logloom.llm import templates

PAGES = "page_id long, url string, html string"


def made(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_site(rng, n=14):
    """Pages of one host in which no tag or class name tells what is text: links and a short line that vary, a fixed notice in the text and below it."""
    rows, want = [], {}
    for i in range(n):
        links = "".join(f"<li><a href='/{k}'>{made(rng, 2)}</a></li>" for k in range(5))
        body = [made(rng, 25) for _ in range(3)]
        text = f"<h2>{body[0][:20].strip()}</h2><p>{body[0]}</p><p>Write to us for more</p><p>{body[1]}</p><div class='e5'><p>{body[2]}</p></div>"
        rows.append((i, f"https://a.example/{i}", f"<html><body><div class='a1'><ul>{links}</ul></div><div class='b2'>{made(rng, 2)}</div><div class='c3'>{text}</div><div class='d4'>All of it is ours and nothing may be taken</div></body></html>"))
        want[i] = "\n".join([body[0][:20].strip(), body[0], body[1], body[2]])
    return rows, want


def test_the_template_decides(spark):
    rows, want = plain_site(random.Random(21))
    got = {r["page_id"]: r for r in templates.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[0]["slots"] == ["/html/body/div.c0", "/html/body/div.c0/div.e0"]
    # the same pages without their template, and each on a host of its own: all of the text is left
    assert all(templates.text_of(page, frozenset()) != want[i] for i, _, page in rows)
    alone = templates.extract(spark.createDataFrame([(i, f"https://{i}.example/", page) for i, _, page in rows], PAGES)).collect()
    assert all(r["text"] == templates.text_of(rows[r["page_id"]][2], frozenset()) and r["slots"] is None for r in alone)


def test_copies_of_pages_do_not_cancel(spark):
    rows, want = plain_site(random.Random(22), 8)
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows], f"{PAGES}, text string").withColumnRenamed("text", "host")
    out = templates.extract(df).collect()
    assert len(out) == 16 and all(r["text"] == want[r["page_id"]] for r in out)
    vectors = templates.tokens(df).where("path = ''").first()
    assert vectors["pages"] == 16 and vectors["vector"]["low"] > 0


def test_order_and_nesting():
    order = lambda s, sizes: [("abcd".index(x.lower()), i, sizes[x.lower()]) for x, i in zip(s[::2], map(int, s[1::2]), strict=True)]
    sizes = {"a": 3, "b": 2, "c": 1}
    assert templates.broken(order("a0b0b1a1b0b1a2", sizes)) == set()
    assert templates.broken(order("a0a2a1", {"a": 4})) == {(0, 1), (0, -1)}  # a cycle that does not end
    assert templates.broken(order("a0a2a1", {"a": 3})) == {(0, 1)}
    assert templates.broken(order("a0b0a1b1a2", sizes)) == {(1, -1), (1, 1)}  # b begins in one gap of a and ends in another
    assert templates.broken(order("c0a0c0a1c0a2c0", sizes)) == set()


def test_text_out_of_order_is_not_fixed(spark):
    rng, rows = random.Random(23), []
    for i in range(10):
        two = ["<p>Here comes the first</p>", "<p>There goes the second</p>"]
        rows.append((i, f"https://a.example/{i}", f"<html><body><div class='x'>{''.join(two[:: 1 if i % 2 else -1])}<p>{made(rng, 30)}</p><p>Always the third</p></div></body></html>"))
    df = spark.createDataFrame(rows, PAGES)
    found = templates.template(df, templates.tokens(df)).where("text IS NOT NULL").collect()
    keys = {templates.token("/html/body/div.x", t) for t in ("Here comes the first", "There goes the second", "Always the third")}
    assert {r["key"] for r in found} < keys and templates.token("/html/body/div.x", "Always the third") in {r["key"] for r in found}


def test_two_pages_and_mixed_hosts(spark):
    rng = random.Random(24)
    text = [made(rng, 40) for _ in range(4)]
    page = lambda t: f"<html><body><div class='x'><p>{t}</p></div><div class='y'>All of it is ours</div></body></html>"
    rows = [(0, "https://a.example/0", page(text[0])), (1, "HTTPS://A.example/1", page(text[1])), (2, "https://b.example/", page(text[2])), (3, "https://a.example/3", "<p>Another kind</p>")]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: text[0], 1: text[1], 2: f"{text[2]}\nAll of it is ours", 3: "Another kind"}


def test_inline_adverts():
    assert templates.text_of("<p>One <span class='ad'>buy <b>this</b> now</span>two <span>three</span></p><p>four</p>", frozenset()) == "One two three\nfour"
    assert templates.text_of("<p>One <span class='promo'>buy</p><p>four</p>", frozenset()) == "One\nfour"
