import itertools
import random

import numpy as np
import pytest
from edges import documents, nothing

from larder.llm.near_duplicates import block_links, near_duplicates


def brute(rows, n, percent):
    """component of each doc_id by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
        words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        full = set(zip(*[words[k:] for k in range(n)], strict=False)) if len(words) >= n else {tuple(words)} if words else set()
        sets[i] = full
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(90)]
    texts = []
    for k in range(120):  # one large group of near copies, at every distance
        words = list(base)
        for _ in range(k % 12):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [texts[0]] * 30 + [texts[0].upper()] * 5
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(100)]
    texts += ["one two", "one  two", "one two three", "three two one"]
    return texts


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80), (2, 60)])
def test_against_all_pairs(spark, corpus, words, percent):
    frame = documents(spark, corpus)
    rows = {(r.doc_id, r.text) for r in frame.collect() if r.doc_id is not None}
    component, size = brute(rows, words, percent)
    for r in near_duplicates(frame, words=words, percent=percent).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == (component[r.doc_id], size[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_every_row_comes_back(spark):
    out = near_duplicates(documents(spark), words=5, percent=80)
    assert sorted((r.doc_id or 0, r.kept) for r in out.collect()) == [
        (0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (5, False), (7, True)
    ]
    assert near_duplicates(nothing(spark)).collect() == []


def test_blocks_find_spanning_links():
    rng = np.random.default_rng(1)
    base = np.arange(200, dtype=np.int64)
    sets = [np.sort(np.concatenate((base[: 200 - k % 30], rng.integers(10**6, 10**9, k % 30)))) for k in range(60)]
    names = np.arange(60)

    def groups(links):
        root = list(range(60))

        def find(x):
            return x if root[x] == x else find(root[x])

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(60)]

    pairs = [
        (a, b)
        for a, b in itertools.combinations(range(60), 2)
        if 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))
    ]
    whole = list(block_links(names, names, sets, 0, 85))
    assert len(whole) < 60 and groups(whole) == groups(pairs)
    cut = list(block_links(names, names, sets, 30, 85))
    assert groups(cut) == groups([(a, b) for a, b in pairs if a < 30 <= b])
