"""Third round, F12: folds over many keys, sides of equal variance."""

import random
import statistics

from arcline.operators import fold as FO
from arcline.operators import smooth as S


def test_blocks_pass_through_a_task_one_after_the_other(spark, monkeypatch):
    plans = []
    keep = FO.cut_lineage
    monkeypatch.setattr(FO, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().toString()) or keep(d))
    rows = [(k, f, None if f % 3 else float(f), [{"v": f}] if f % 2 else None) for k in range(40) for f in range(k, 60)]
    df = spark.createDataFrame(rows, "k long, frame long, x double, c array<struct<v: long>>")

    def step(state, row):
        state["n"] += 1 if row.x != row.x else 10
        state["n"] += sum(c["v"] for c in row.c) if row.c is not None else 0
        return [(int(row.frame), state["n"])]

    want = {}
    for k in range(40):
        n = 0
        for f in range(k, 60):
            n += (1 if f % 3 else 10) + (f if f % 2 else 0)
            want[k, f] = n
    for block in (7, 1000):
        got = FO.fold(df, ["k"], "frame", {"n": 0}, step, "at long, n long", block=block)
        assert {(r["k"], r["at"]): r["n"] for r in got.collect()} == want
    assert plans and not any("FlatMapGroupsInPandas" in p for p in plans)


def test_steadiest_side_is_the_exact_one():
    draw = random.Random(5)
    for n in range(400):
        base = draw.choice([0.0, 1e3, 1e6])
        side = lambda: [(0, base + draw.randint(0, 3) / 10, base + draw.randint(0, 3) / 10) for _ in range(draw.randint(2, 5))]  # noqa: E731, B023
        a, b = side(), side()
        sides = [a, b if n % 3 else [*reversed(a)], [*a, *b]]
        exact = min(sides, key=lambda ps: sum(statistics.pvariance([p[k] for p in ps]) for k in (1, 2)))
        assert S.steadiest(sides) is exact
