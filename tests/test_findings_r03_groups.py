"""Rounds of linking meet only what is not yet settled."""

import random

from arcline.operators import groups as G


def test_settled_groups_are_left_alone(spark, monkeypatch):
    r, sizes, cut = random.Random(5), [], G.cut_lineage

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", counted)
    names = list(range(100))
    r.shuffle(names)
    links = [(1, *pair) for pair in zip(names, names[1:])] + [(2, 2 * i, 2 * i + 1) for i in range(100)]
    got = {(x.k, x.node): x.label for x in G.linked_groups(spark.createDataFrame(links, "k long, a long, b long"), ["k"]).collect()}
    assert got == {**{(1, i): 0 for i in range(100)}, **{(2, i): i // 2 * 2 for i in range(200)}}
    # a pass over all 300 nodes for each round made 10 and more of them
    assert sum(n >= 200 for n in sizes) <= 7 and sizes[-1] == 300
