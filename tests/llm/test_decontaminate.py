import random
import re

import pytest
from edges import LONG, documents, nothing

from larder.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items):
    own, hit, named = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(own) - k + 1):
            if windows and tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                named.add(name)
    return len(own), len(hit), sorted(str(n) for n in named if n is not None)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    vocab = ["a", "b", "c", "Da", "é", "x1", "the", "of", "zz"]
    draw = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, draw(rng.randrange(10, 40))) for i in range(25)]
    items += [(40, "one, two; three"), (41, "Solo"), (42, ""), (43, None), (44, "..."), (None, "hidden four words here"), (45, draw(9))]
    items += [(40, "one, two; three"), (50, items[0][1]), (51, items[0][1] + " and more words of its own that go on")]
    texts = []
    for k in range(150):
        text = draw(rng.randrange(0, 60))
        if k % 3 == 0:
            w = items[k % 25][1].split()
            a = rng.randrange(len(w) - 8)
            text += " " + "-".join(w[a : a + rng.randrange(7, 25)]).upper() + "! " + draw(5)
        if k % 10 == 0:
            text += " ONE two three"
        if k % 17 == 0:
            text += " (solo) hidden FOUR words here"
        texts.append(text)
    return items, texts


def test_against_every_window(spark, case):
    items, texts = case
    frame = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    by_id = {r.doc_id: r.text for r in frame.collect()}
    out = decontaminate(frame, bench).collect()
    assert len(out) == frame.count()
    for r in out:
        n, hit, named = brute(by_id[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items) == (n, hit, named), r.doc_id
        assert r.contaminated == (hit > 0) and sum(s.stop - s.start for s in r.spans) == hit
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate(documents(spark), empty).collect())
    assert decontaminate(nothing(spark), empty).collect() == []


def test_every_window_of_a_long_text(spark):
    item = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    row = next(r for r in decontaminate(documents(spark), item).collect() if r.doc_id == 4)
    assert row.n_hit == row.n_words == len(words(LONG)) and len(row.spans) == 1
