import html
import re
import time

import numpy as np
import pytest

from larder.llm.labelled_pages import LABELLED_PAGES
from larder.llm.page_text import Model, Node, extract, labels_of, main_text, marginals, parse, train

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return train(LABELLED_PAGES)


def text_of(model, page):
    nodes = parse(page)
    return main_text(nodes, marginals(model, [nodes])[0])[0]


def test_given_pages(spark):
    """The generated pages keep their articles apart, so a plain search knows the answer."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    by_id = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", by_id[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_layouts_that_were_left_out():
    """Each labelled page read by a model of all others: nearly every block is told right."""
    right = total = 0
    for k, page in enumerate(LABELLED_PAGES):
        nodes = parse(page)
        labels = labels_of(nodes)
        bare = parse(re.sub(r" ?data-(?:keep|drop)", "", page))
        p = marginals(train(LABELLED_PAGES[:k] + LABELLED_PAGES[k + 1 :]), [bare])[0]
        for node, label, q in zip(bare, labels, p, strict=True):
            total += len(node.texts)
            right += len(node.texts) * ((q > 0.5) == bool(label))
    assert right / total > 0.85


def test_messages_give_exact_marginals():
    """Against summing over all labellings of small random trees."""
    rng = np.random.default_rng(8)
    kinds = {"other": 0, "a": 1, "b": 2}  # of these only "other" is neutral, and it is the root
    for _ in range(20):
        child = rng.random((3, 2, 2)) + 0.1
        child /= child.sum(axis=2, keepdims=True)
        seen = [np.log(rng.random((n, 2)) + 0.1) for n in (5, 4, 3)]
        root = np.log(np.array([0.3, 0.7]))
        model = Model(kinds, np.log(child), seen, root)
        nodes = [Node("other", -1, 0)]
        for i in range(1, 8):
            parent = int(rng.integers(0, i))
            nodes.append(Node("ab"[int(rng.integers(0, 2))], parent, nodes[parent].depth + 1))
            nodes[i].texts, nodes[i].chars = [(i, "Some text here.")], 15
        total = np.zeros((8, 2))
        for code in range(256):
            y = [code >> i & 1 for i in range(8)]
            w = root[y[0]]
            for i in range(1, 8):
                w += model.child[kinds[nodes[i].kind], y[nodes[i].parent], y[i]]
                w += seen[0][1, y[i]] + seen[1][0, y[i]] + seen[2][1, y[i]]
            for i in range(8):
                total[i, y[i]] += np.exp(w)
        want = total[:, 1] / total.sum(axis=1)
        # Batches of trees do not touch one another.
        for got in marginals(model, [nodes, nodes[:1], nodes]):
            assert np.allclose(got, want) if len(got) == 8 else True


def test_markup(model):
    page = (
        "<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<article><h1>The  boats &amp; the&nbsp;sea</h1><p>One<br>two <b>three</b>four.<p>Then it was &lt;over&gt; &eacute;&#233; and &copy 2024."
        "<script>var x = '<p>never</p>';</script><!-- not <p>this</p> --><ul><li>First thing.<li>Second thing.</ul>"
        "<form><p>Write to us, please.</p><input value='x'><textarea>never</textarea></form></article>"
        "<div class='comments'><p>I think so too. Indeed.</p></div><div id='cookie-notice'>We use cookies. Accept them.</div>"
        "<aside><p>Also read this piece. It is good.</p></aside><footer><p>All rights reserved.</p></footer>"
    )
    assert text_of(model, page) == (
        "The boats & the sea\n\nOne two threefour.\n\nThen it was <over> éé and © 2024.\n\nFirst thing.\n\nSecond thing."
    )


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("just text", "just text"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>never closed", "never closed"),
        ("<a href='x>quote never closed <p>Text.", None),
        ("<", "<"),
        ("<!-- never closed", ""),
        ("<script>never closed", ""),
        ("</p></div>text</b>", "text"),
        ("<div>" * 1000 + "<p>deep down, there was text.</p>", "deep down, there was text."),
    ],
)
def test_broken_pages(model, page, text):
    got = text_of(model, page)
    assert text is None or got == text


def test_tables(spark, model):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>Hello there, world.</p>", None), (3, "u", "<p>Hello there, world.</p>", None)]
    rows += [(4, "u", "<article>" + "<p>A line, and another.</p>" * 40_000 + "</article>", "x"), (None, "u", "<p>No id, no harm.</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(extract(frame).collect(), key=lambda r: (r.page_id or 0))
    assert [r.text for r in out[:5]] == ["No id, no harm.", "", "", "Hello there, world.", "Hello there, world."]
    assert out[5].text.count("A line, and another.") == 40_000 and out[5].n_blocks == 40_000
    assert extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("page", ['<a "x' * 40_000, "> " + '<a "x' * 40_000, "<div>" * 40_000 + "</p>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<p><button>" + "<div>" * 40_000])
def test_hostile_pages_take_time_in_proportion(page):
    started = time.perf_counter()
    parse(page)
    assert time.perf_counter() - started < 5


def test_unclosed_comments_reach_the_end():
    texts = lambda page: [t for _, t in sorted(x for n in parse(page) for x in n.texts)]
    assert texts("<p>seen</p><!-- hidden <b> and hidden") == ["seen"]
    assert texts("<p>a > b <!-- hidden") == ["a > b"]
    assert texts("<p>one</p> tail <b") == ["one", "tail <b"]
