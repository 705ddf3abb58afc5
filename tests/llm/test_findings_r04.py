"""Faults that a review of the fourth round found."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arcline.llm import lmscore
from arcline.llm import simhash as S
from arcline.llm.common import settled


def test_exploded_tables_are_not_broadcast(spark):
    r = random.Random(4)
    prints = settled(spark.createDataFrame([(r.getrandbits(63),) for _ in range(2000)], "fp long"))
    plan = S.links(prints)._jdf.queryExecution().executedPlan().toString()  # 43 probes each, taken for as small as the prints
    crowd = S.ball_links(prints)._jdf.queryExecution().executedPlan().toString()  # 2,081 points each
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "SortMergeJoin" in crowd and "Broadcast" not in crowd


def test_lm_counts_are_exact(table, monkeypatch):
    """More distinct pairs than the 2 ** 19 cells they shared before, dealt over many chunks; ids beyond a float, one null."""
    monkeypatch.setattr(lmscore, "LEAST_BITS", 20)
    monkeypatch.setattr(lmscore, "CHARS", 1 << 20, raising=False)
    r = random.Random(8)
    texts = [" ".join(str(r.randrange(20_000)) for _ in range(4000)) for _ in range(200)]
    texts += [texts[0], texts[1] + " one more", None]
    big = 1 << 60
    docs = table([(big + i, t) for i, t in enumerate(texts)] + [(None, "1 2 3")])
    targets = set(range(0, 200, 5))
    got = {x["doc_id"]: x for x in lmscore.score(docs, docs.filter((F.col("doc_id") - big).isin(*targets)).select("doc_id")).collect()}
    assert set(got) == {big + i for i in range(len(texts))} | {None} and got[big + 202]["words"] == 0 and got[big + 202]["score"] is None
    every = [*texts[:202], "1 2 3"]
    whole = sum(len(texts[i].split()) for i in targets)
    for i in (0, 1, 3, 200, 201):
        w = texts[i].split()
        for name, pool in (("target_loss", [texts[k] for k in targets if k != i]), ("background_loss", [t for k, t in enumerate(every) if k != i])):
            words, pairs = Counter(), Counter()
            for t in pool:
                x = t.split()
                words.update(x)
                pairs.update(zip([None, *x], x))
            scale = whole / words.total()
            loss = 0.0
            for v, x in zip([None, *w], w):
                one = (scale * words[x] + 0.05 * whole / (1 << 20)) / (whole * 1.05)
                cv = scale * words[v] if v is not None else 0.0
                loss -= math.log((min(scale * pairs[v, x], cv) + 20 * one) / (cv + 20))
            assert got[big + i][name] == pytest.approx(loss / len(w), abs=1e-9)
