"""Fingerprints and components against plain Python; all cases of odd rows."""

import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from arcline.llm import simhash as S


def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    hs = [xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(nodes, radius=4):
    """nodes: {id: print}; the smallest id of each component."""
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(nodes)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bin(nodes[a] ^ nodes[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def rows(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(r.randint(1, 120))]
        texts.append(" ".join(words))
        for _ in range(r.randint(0, 4)):
            w = list(words)
            w[r.randrange(len(w))] = word()
            texts.append("\n".join(w))
    return texts + [None, "", " \t\n", "A", "a", "One two", "x " * 40000, texts[0], texts[0].upper()]


@pytest.mark.parametrize("bucket", [S.BUCKET, 0])
def test_near_copies(table, bucket):
    texts = rows()
    docs = table([(i * 3 + 1, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in S.near_copies(docs, bucket=bucket).collect()}
    prints = {i * 3 + 1: plain_print(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints)


@pytest.mark.parametrize("radius,segments", [(4, 2), (4, 3), (3, 3), (5, 4), (2, 5)])
def test_links_are_whole(spark, radius, segments):
    r = random.Random(radius)
    values = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(4):
            values.add(x)
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
    got = {(x["a"], x["b"]) for x in S.links(prints, radius, segments).collect()}
    assert got <= want and {frozenset(p) for p in got} == {frozenset(p) for p in want}
    stars = {(x["a"], x["b"]) for x in S.ball_links(prints, radius).collect()} if radius < 5 else want
    assert stars <= want

    def groups(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(v for v in signed if find(v) == find(w)) for w in signed}

    assert groups(stars) == groups(want)


def test_one_of_each_and_odd_rows(table, spark):
    docs = table([(5, "a b c d e f"), (5, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, "q w e r t z"), (9, None), (8, ""), (7, "k l m n o p")])
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(False, 2, "A B C D E F"), (False, 7, "k l m n o p"), (False, 8, ""), (True, 0, "q w e r t z")]
    assert S.near_copies(docs).count() == 8
    empty = table([]).filter(F.lit(False))
    assert S.near_copies(empty).count() == 0 and S.one_of_each(empty).count() == 0
