import random
from hashlib import sha256

import pytest

from larder.llm.prefix_trie import decompose, ordered_turns, prefix_trie
from larder.llm.queries import shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def sequences(rows):
    """Turns (role, text) of each conversation, in order."""
    key = lambda r: (r[1] is not None, r[1] or 0, sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def brute(talks):
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes}
    out = []
    for p, convs in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(convs) if len(talks[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        parent = min(nodes[p[:-1]]) if p else None
        leaves = sum(not kids[q] for q in below)
        out.append((min(convs), len(p), parent, len(convs), len(kids[p]), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(turns, **options):
    members = turns.select("conv_id").distinct()
    rows = turns.withColumn("depth", turns.position + 1)
    return sorted(map(tuple, prefix_trie(rows, members, **options).collect()), key=str)


def talk(rng):
    rows, word = [], lambda: rng.choice(["hello", "", None, "é", "yes", "no " * 50])
    for c in [*range(60), -7, 250]:
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t, rng.choice(["user", "user", None]), word(), "x", "x"))
    rows += [(300, None, "user", "first", "x", "x"), (300, None, None, None, "x", "x"), (300, 2, "user", "a", "x", "x")]
    rows += [(300, 2, "user", "a", "x", "x"), (None, 1, "user", "nobody", "x", "x")]
    for c in (400, 401, 402):  # long, alike for a long way, one the beginning of another
        rows += [(c, t, "user", f"turn {t}" if t < 30 else f"{c}", "x", "x") for t in range(20 + 10 * (c - 400))]
    rows += [(500 + i, 0, "user", "hub", "x", "x") for i in range(40)] + [(500 + i, 1, "user", str(i % 20), "x", "x") for i in range(40)]
    return rows


# Every component split by joins; none; some.
@pytest.mark.parametrize("weight", [1, 60, 50_000])
def test_against_brute_force(spark, weight):
    rows = talk(random.Random(3))
    got = trie(ordered_turns(spark.createDataFrame(rows, SCHEMA)), local_weight=weight)
    assert got == brute(sequences(rows))


def test_long_conversation_in_blocks(spark):
    rows = [(c, t, "user", "again" if t % 2 else "and", "x", "x") for c in (1, 2) for t in range(2500 + c)]
    got = trie(ordered_turns(spark.createDataFrame(rows, SCHEMA)), local_weight=1000)
    sizes = [0, *(5 if t % 2 else 3 for t in range(2502))]
    assert len(got) == 2503 and sorted(r[1] for r in got) == list(range(2503))
    for name, depth, parent, convs, kids, leaves, saved, _ in got:
        assert (name, parent) == (1 if depth < 2502 else 2, None if depth == 0 else 1)
        assert (convs, kids, leaves) == (2 if depth < 2502 else 1, 1 if depth < 2502 else 0, 1)
        assert saved == sum(sizes[max(depth, 1) : 2502])


def test_shared_heads(spark):
    rng = random.Random(8)
    rows = [(c, t, "user", f"{c} {t}", "x", "x") for c in [*range(95, 130), 200, 205, 305, 999, -130, -100] for t in range(rng.randrange(1, 9))]
    from zlib import crc32

    own = sequences(rows)
    talks = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        source = c - (c % 100 if c >= 0 else -(-c % 100))
        talks[c] = own.get(source, [])[:h] + turns[h:]
    turns, members = shared_heads(ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(tuple, prefix_trie(turns, members).collect()), key=str) == brute(talks)


def test_nothing(spark):
    assert trie(ordered_turns(spark.createDataFrame([], SCHEMA))) == []
    nobody = spark.createDataFrame([(None, 1, "user", "x", "x", "x")], SCHEMA)
    assert trie(ordered_turns(nobody)) == []


def test_decompose_is_a_subtree_sum():
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 200):
        for kind in ("chain", "star", "random"):
            parent = [-1] + [{"chain": i - 1, "star": 0}.get(kind, rng.randrange(i)) for i in range(1, n)]
            depth = [0] * n
            for i in range(1, n):
                depth[i] = depth[parent[i]] + 1
            own = [(rng.randrange(10),) for _ in range(n)]
            want, weight = [x for (x,) in own], [1] * n
            for i in range(n - 1, 0, -1):
                want[parent[i]] += want[i]
                weight[parent[i]] += weight[i]
            sums = [[0] for _ in range(n)]
            decompose(sorted(range(n), key=lambda i: (depth[i], i)), parent, weight, own, sums)
            assert [x for (x,) in sums] == want
