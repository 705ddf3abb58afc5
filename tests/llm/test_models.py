"""Learned operators: held-out accuracy, brute-force versions and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.llm import ann, langid, lmscore, toxicity
from arcline.llm.common import held_out
from tests.conftest import SF

BIG = SF.replace("0.001", "0.01")


def test_held_out(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(200).withColumn("h", held_out(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(table):
    learn = [(i, t, lang, None) for i, (t, lang) in enumerate([("abc abd abe abf", "aa"), ("xyz xyw xyv xyu", "xx")] * 6)]
    odd = [(100, None, "aa", None), (101, "", "aa", None), (102, "123 ... \n", "xx", None), (103, "abc abd", None, None), (104, "xyz " * 90000, None, None), (None, "abe", "xx", None), (103, "abc abd", None, None)]
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(table(learn + odd)).collect()}
    assert [rows[i][0] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "aa", "xx"] and rows[100][1] == 0
    assert langid.predict(table(learn + odd)).count() == len(learn + odd)
    assert {r["lang_pred"] for r in langid.predict(table([(1, "abc", None, None)])).collect()} == {"und"}
    assert langid.predict(table(learn).filter(F.lit(False))).count() == 0


def test_mixture_brute_force():
    """Shares against a fine grid, and a text of two languages holds both."""
    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(40), 2).T
    n = r.poisson(30 * (0.3 * p[:, 0] + 0.7 * p[:, 1]) * 40).astype(float)
    share, likelihood = langid._mixture(p, n)
    grid = np.linspace(0.001, 0.999, 999)
    each = [n @ np.log(p @ np.array([g, 1 - g])) for g in grid]
    assert abs(share[0] - grid[int(np.argmax(each))]) < 0.03 and likelihood >= max(each) - 1


def test_nearest_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8) * (10.0 ** (i % 3))]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] + [1.0] * 7), (205, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (206, [1.0, 2.0]), (207, [2.0, 1.0])]
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [rows[7], (40, [float(x) for x in r.normal(size=8)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("dim", F.lit("x"))
    got = {}
    for x in ann.nearest(df, df.filter("vec_id % 20 = 0 or vec_id in (206, 207)"), k=10, tables=4, probes=16).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    fine = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want_ids = {i for i, _ in fine if i % 20 == 0 or i in (206, 207)}
    assert set(got) == want_ids
    hit = total = 0
    for q in want_ids:
        best = {}
        for qi, qv in fine:
            if qi == q:
                for i, v in fine:
                    if i != q and len(v) == len(qv):
                        best[i] = max(best.get(i, -math.inf), float((np.array(v) * np.array(qv)).sum()))
        top = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        rank = sorted(got[q])
        assert [x[0] for x in rank] == list(range(1, len(top) + 1))
        assert all(abs(s - best[i]) < 1e-9 for _, i, s in rank)
        assert [(-round(s, 9), i) for _, i, s in rank] == sorted((-round(s, 9), i) for _, i, s in rank)
        hit += len({i for _, i, _ in rank} & {i for i, _ in top})
        total += len(top)
    assert hit / total >= 0.9
    assert ann.nearest(df.filter(F.lit(False)), df).count() == 0 and ann.nearest(df, df.filter(F.lit(False))).count() == 0


def test_nearest_recall_and_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    monkeypatch.setattr(ann, "BLOCK", 3)
    rows = ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    data = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in found:
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -9
        hit += len(found[q] & set(ids[np.lexsort((ids, -s))[:20]]))
    assert len(found) == sum(ids % 20 == 0) and hit / (20 * len(found)) >= 0.9


def test_lm_brute_force(table, monkeypatch):
    """Against dictionaries of words and pairs, in cells so many that none is shared."""
    monkeypatch.setattr(lmscore, "LEAST_BITS", 19)
    texts = ["a b c a b", "b c d", "a a a a", None, "", "x y z x y z", "A B c", "q", "a b c a b"]
    targets = {0, 1, 6}
    docs = table(list(enumerate(texts)))
    wanted = docs.filter(F.col("doc_id").isin(*targets)).select("doc_id")
    got = {r["doc_id"]: r for r in lmscore.score(docs, wanted).collect()}
    size = 1 << 19

    def counts(skip, only):
        words, heads, pairs = Counter(), Counter(), Counter()
        for i, t in enumerate(texts):
            w = (t or "").lower().split()
            if i != skip and (only is None or i in only):
                words.update(w)
                pairs.update(zip([None] + w, w))
        heads.update(words)
        return words, heads, pairs

    whole = sum(len((texts[i] or "").split()) for i in targets)
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        assert got[i]["words"] == len(w)
        if not w:
            assert got[i]["score"] is None
            continue
        loss = []
        for only in (targets, None):
            words, heads, pairs = counts(i, only)
            total = sum(words.values())
            scale = whole / total if total else 0
            out = 0.0
            for v, x in zip([None] + w, w):
                net = lambda c, cells: max(0.0, c - (total - c) / cells) * scale
                one = (net(words[x], size) + 0.05 * whole / size) / (whole * 1.05)
                cv = net(heads[v] if v is not None else 0, size)
                out -= math.log((min(net(pairs[v, x], size), cv) + 20 * one) / (cv + 20))
            loss.append(out / len(w))
        assert got[i]["target_loss"] == pytest.approx(loss[0], abs=2e-3) and got[i]["background_loss"] == pytest.approx(loss[1], abs=2e-3)
    assert lmscore.score(docs.filter(F.lit(False)), wanted).count() == 0
    assert lmscore.score(docs, wanted.filter(F.lit(False))).count() == len(texts)


def test_lm_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(1000))
    whole = [lmscore._cells(p, 18, 18) for p in lmscore._ids(text)]
    monkeypatch.setattr(lmscore, "CHUNK", 64)
    parts = [lmscore._cells(p, 18, 18) for p in lmscore._ids(text)]
    assert all((np.concatenate(a) == np.concatenate(b)).all() for a, b in zip(zip(*whole), zip(*parts)))


def test_toxicity(spark, table):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = toxicity.predict(docs, labels).join(labels, "doc_id").collect()
    known = [r for r in rows if not r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in known)
    assert hit / max(1, sum(r["toxic"] for r in known)) > 0.6 and hit / max(1, sum(r["predicted"] for r in known)) > 0.6  # of about 300 rows to learn from
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_odd_rows(spark, table):
    docs = table([(1, None), (2, ""), (3, "you idiot " * 30000), (None, "x"), (1, "y"), (4, "!!! 0O *")])
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (4, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = toxicity.predict(docs, labels).collect()  # one class only
    assert len(rows) == 6 and {r["score"] for r in rows} == {0.0}
    assert toxicity.predict(docs, labels.filter(F.lit(False))).count() == 6
    assert toxicity.predict(docs.filter(F.lit(False)), labels).count() == 0
    one = toxicity._features("you 1d1ot, st*pid id-iot", {"=idiot": 2.0})
    named = dict(zip(toxicity.NAMES, one))
    assert named["plain_lexicon"] == 0.5 and named["near_second"] > 0 and named["second"] == 0.25 and named["obfuscated"] > 0
