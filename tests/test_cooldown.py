"""Suppression by linked chains against one pass over the rows, over many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from arcline.operators import cooldown as C
from arcline.operators import ordered


def table(spark, rows):
    return spark.createDataFrame(rows, "session_id long, frame long, z double")


def dense(n, seed=3):
    """Candidates two or three frames apart, so that no cooldown of ten ends by itself."""
    r, f, rows = random.Random(seed), 0, []
    for _ in range(n):
        f += r.randint(2, 3)
        rows.append((1, f, round(r.random(), 2)))
    return rows


def first(rows, gap):
    out, last = [], None
    for _, f, _ in rows:
        if last is None or f - last >= gap:
            out.append(f)
            last = f
    return out


def better(rows, gap):
    out, last = [], None
    for _, f, s in rows:
        if last and f - last[0] < gap:
            if s > last[1]:
                last = (f, s)
            continue
        if last:
            out.append(last[0])
        last = (f, s)
    return out + [last[0]]


def lowest(rows, span):
    out, group = [], None
    for _, f, z in rows:
        if group and f - group[0] <= span:
            if z < group[2]:
                group = (group[0], f, z)
            continue
        if group:
            out.append(group[1])
        group = (f, f, z)
    return out + [group[1]]


@pytest.mark.parametrize("gap", [1, 4, 10])
def test_rules_equal_one_pass(spark, monkeypatch, gap):
    monkeypatch.setattr(ordered, "BLOCK", 50)
    rows = dense(180) + [(1, f, 0.5) for f in (900, 903, 912, 950)] + [(2, 7, 0.1)]
    t = table(spark, rows)
    got = lambda df: [r.frame for r in df.orderBy("session_id", "frame").collect()]
    one = [r for r in rows if r[0] == 1]
    assert got(C.first_wins(t, ["session_id"], gap)) == first(one, gap) + [7]
    assert got(C.last_better(t, ["session_id"], gap, F.col("z"))) == better(one, gap) + [7]
    assert got(C.lowest_in_group(t, ["session_id"], gap, "z")) == lowest(one, gap) + [7]
    assert C.first_wins(t.limit(0), ["session_id"], gap).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """Ten, twenty and forty blocks of dense candidates: a doubled chain costs one more round of three tables."""
    monkeypatch.setattr(ordered, "BLOCK", 50)
    cut, counts = C.cut_lineage, []

    def counted(df):
        counts[-1] += 1
        return cut(df)

    monkeypatch.setattr(C, "cut_lineage", counted)
    for blocks in (10, 20, 40):
        rows = dense(blocks * 20)
        counts.append(0)
        assert [r.frame for r in C.first_wins(table(spark, rows), ["session_id"], 10).orderBy("frame").collect()] == first(rows, 10)
    assert counts[1] - counts[0] <= 3 and counts[2] - counts[1] <= 3, counts
