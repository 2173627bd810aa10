import time
import itertools
import random

from tercet.llm.html_extract import Model, blocks_of, extract, graph_of, labelled, min_cut, model_of

SCHEMA = "page_id long, url string, html string"


def page(i, semantic=True):
    r = random.Random(i)
    sentence = lambda: " ".join(r.choice(["the", "river", "runs", "slowly", "past", "old", "mills"]) for _ in range(14)) + "."
    nav = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(6))
    outer, inner = ("nav", "article") if semantic else ("div", "div")
    body = "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(5))
    return f"<html><head><title>T{i} &amp; x</title><script>var a='<p>';</script></head><body><{outer}><ul>{nav}</ul></{outer}><{inner}><h2>Head {i}</h2>{body}</{inner}><footer>&copy; all rights</footer></body></html>"


def test_min_cut_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 8)
        s, t = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        e = [(a, b, r.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(y):
            return sum(t[i] if y[i] else s[i] for i in range(n)) + sum(c for a, b, c in e if y[a] != y[b])

        y = min_cut(s, t, e)
        assert (cost(y), sum(y)) == min((cost(z), sum(z)) for z in itertools.product([0, 1], repeat=n))


def test_pages_without_semantic_elements(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", page(i)) for i in range(60)], SCHEMA)
    model = model_of(pages)
    out = extract(spark.createDataFrame([(i, "u", page(i, False)) for i in range(100, 130)], SCHEMA), model).collect()
    for r in out:
        lines = r["text"].split("\n")
        assert "item" not in r["text"] and "rights" not in r["text"] and sum("mills" in x or "river" in x for x in lines) == 5
        assert r["title"] == f"T{r['page_id']} & x"


def test_labelling_is_the_least_cost(spark):
    blocks = blocks_of(page(3))[1][:12]
    s, t, e = graph_of(blocks, Model())

    def cost(y):
        return sum(t[i] if y[i] else s[i] for i in range(len(y))) + sum(c for a, b, c in e if y[a] != y[b])

    assert cost(labelled(blocks, Model())) == min(cost(z) for z in itertools.product([False, True], repeat=len(blocks)))


def test_malformed_markup():
    title, blocks = blocks_of("<div>a<p>b<a href=x>link</a><p>c<b>d<br>e</div>f<!-- x --><script>y")
    assert [b.text for b in blocks] == ["a", "blink", "cd\ne", "f"] and blocks[1].linked == 4 and title == ""
    for text in ("<" * 5000, "<a href='x" * 3000, "<p" * 5000, "</p>" * 5000, "<!--", "<div>" * 20_000 + "deep", "a\0b", "&#0; &nbsp; &bogus;"):
        blocks_of(text)


def test_deep_pages():
    """Memory and time in proportion to the page, whatever its depth."""
    for text in ("<div>x" * 40_000, "<div>x" * 20_000 + "</div>y" * 20_000, "<p>x</li>" * 40_000, "<section><p>x" * 20_000):
        began = time.process_time()
        blocks = blocks_of(text)[1]
        graph_of(blocks, Model())
        assert len(blocks) >= 20_000 and time.process_time() - began < 20


def test_distances_are_those_of_the_tree():
    _, blocks = blocks_of("<div>a<section>b<p>c</section><section>d</section></div>e<ul><li>f<li>g</ul>")
    paths = [(1,), (1, 2), (1, 2, 3), (1, 4), (), (5, 6), (5, 7)]
    assert [b.text for b in blocks] == list("abcdefg") and [b.depth for b in blocks] == [len(p) for p in paths]
    for p, q, b in zip(paths, paths[1:], blocks[1:]):
        assert b.common == sum(1 for k in range(min(len(p), len(q))) if p[: k + 1] == q[: k + 1])


def test_odd_rows(spark):
    long = "<article>" + "<p>some long text, with words.</p>" * 3000 + "</article>"
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p></p>"), (3, "u", page(1)), (3, "u", page(1)), (4, "u", long), (5, "u", "plain text only")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as text", "'own' as title", "1 as n_blocks")
    out = {(r["page_id"], r["url"]): r for r in extract(pages, model_of(pages)).collect()}
    assert extract(pages, Model()).count() == 7
    assert out[None, None]["text"] == "" and out[1, "u"]["n_blocks"] == 0 and out[2, None]["title"] == ""
    assert out[4, "u"]["n_blocks"] == 3000 == out[4, "u"]["n_content"]


def test_empty(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert extract(pages, model_of(pages)).count() == 0
