"""Repair, licence scans and the prefix trie against their SQL twins, brute force and odd rows."""

import random
from itertools import product

import pytest

from arcline.llm import licenses, repair, trie
from tests.check import connect, differ
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, place long, idx long"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with conversations (and documents) of these rows, and a connection to it."""

    def make(turns=(), docs=()):
        spark.createDataFrame([(*r, 7, 8) for r in turns], TURNS).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, score double").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def twin(con_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{con_dir}/{t}.parquet/*.parquet'")
    return con, sql


def mixed(seed, convs, longest):
    r = random.Random(seed)
    texts = ["a b.", "a b", "", "  ", "c!", "d e f?", "x"]
    return [(c, t if r.random() < 0.9 else None, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), r.choice([*texts, None]))
            for c in range(convs) for t in range(r.randint(0, longest))]


def test_repair_equals_its_twin(spark, con):
    assert differ(repair.op11_repair(spark, SF), con, repair.OP11_SQL) is None


def test_repair_in_pieces(spark, folder, monkeypatch):
    """Conversations of many pieces over three levels, null turns, roles, texts and blank ones, repeats."""
    d = folder(mixed(3, 12, 60) + [(40, 0, "user", "hi."), (40, 0, "user", "hi."), (41, 5, "system", "s.")])
    monkeypatch.setattr(repair, "PIECE", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    con, sql = twin(d, repair.OP11_SQL)
    assert differ(repair.op11_repair(spark, d), con, sql) is None


def test_search_against_all_edits():
    """Cheapest and least among all edits of short conversations, with up to two turns put in at each place."""
    r = random.Random(5)

    def best(rows):
        n, found = len(rows) // 2, None
        for ops in product("DKR", repeat=n):
            for ins in product(range(3), repeat=n + 1):
                q, cost, text = 0, 0, ""
                for i in range(n + 1):
                    for _ in range(ins[i]):
                        q, cost, text = repair.FOLLOWS[q][1], cost + 2, text + "I"
                    if i < n:
                        op, role, fault = ops[i], rows[2 * i], rows[2 * i + 1]
                        if op == "D":
                            cost += 3
                        elif fault == "x" or op == "K" and (q, role) not in repair.KEPT:
                            cost = 999
                            break
                        else:
                            cost += (fault == "t") + 2 * (op == "R")
                            q = repair.KEPT[q, role] if op == "K" else repair.FOLLOWS[q][1]
                        text += op
                if cost < 999 and q in repair.ACCEPTED and (found is None or (cost, text) < found):
                    found = cost, text
        return found

    for _ in range(25):
        rows = "".join(r.choice("suua?") + r.choice("..tx") for _ in range(r.randint(0, 4)))
        assert repair.search(rows, 0, repair.ACCEPTED, True) == best(rows), rows


def test_repair_odd_rows(spark, folder):
    d = folder([(None, None, None, None), (None, 1, "user", "a."), (3, 2**40, "assistant", "x" * 300_000), (3, -5, "user", "y.")])
    got = {r.conv_id: r for r in repair.op11_repair(spark, d).collect()}
    assert set(got) == {None, 3} and got[3].gaps == 2**40 + 4
    assert repair.op11_repair(spark, folder()).count() == 0


def test_trie_equals_its_twin(spark, con):
    assert differ(trie.op13_prefix_trie(spark, SF), con, trie.OP13_SQL) is None


@pytest.mark.parametrize("settings", [{"band": 2}, {"partition_bytes": 500}, {"band": 3, "partition_bytes": 300}])
def test_trie_over_borders(spark, folder, settings):
    """Long shared beginnings, copies and beginnings of each other, over bands and partitions."""
    r = random.Random(1)
    turns = []
    for c in range(40):
        turns += [(c + (c > 20), t, r.choice("ua"), r.choice(["p q", "r", ""])) for t in range(r.choice([1, 2, 3, 6, 9, 12]))]
    turns += [(100 + c, t, "u", "same words here") for c in range(12) for t in range(7)]
    d = folder(turns)
    con, sql = twin(d, trie.OP13_SQL)
    assert differ(trie.op13_prefix_trie(spark, d, **settings), con, sql) is None


def test_trie_odd_rows(spark, folder):
    d = folder([(None, None, None, None), (5, 1, "user", "a b"), (5, 1, "user", "a b"), (5, None, None, "z" * 100_000)])
    got = trie.op13_prefix_trie(spark, d).collect()
    root = [r for r in got if r.depth == 0]
    assert len(root) == 1 and root[0].n_convs == 2 and root[0].parent_conv_id is None and root[0].conv_id == 5
    assert trie.op13_prefix_trie(spark, folder()).count() == 0


def test_forest_merges_in_any_cut():
    """One list of sorted strings, cut in two anywhere: the parts of open nodes add up to the uncut nodes."""
    r = random.Random(2)
    texts = sorted({"".join(r.choice("ab") * 32 for _ in range(r.randint(1, 5))) for _ in range(25)})
    items = [(0, 0, 0, s, [1] * (len(s) // 32), r.randint(1, 3), i, False) for i, s in enumerate(texts)]
    whole = {tuple(x[:3]): x[3:9] for x in trie.forest(items, -1, -1)}
    for cut in range(1, len(items)):
        shared = trie.common(texts[cut - 1], texts[cut])
        parts = {}
        for x in [*trie.forest(items[:cut], -1, shared), *trie.forest(items[cut:], shared, -1)]:
            was = parts.get(tuple(x[:3]))
            parts[tuple(x[:3])] = x[3:9] if was is None else [min(was[0], x[3]), *[a + b for a, b in zip(was[1:5], x[4:8])], x[8]]
        assert parts == whole


def test_licenses_equal_their_twin(spark, con):
    assert differ(licenses.op12_licenses(spark, SF), con, licenses.OP12_SQL) is None


def test_licenses_with_edits(spark, folder):
    """Notices with words put in, left out and changed; phrases at every place; odd rows."""
    notice = licenses.NOTICES[0][1].split(" ")
    edited = notice[:10] + ["very", "new"] + notice[10:25] + notice[26:]
    wrong = [w if i % 3 else f"w{i}" for i, w in enumerate(notice)]
    filler = " ".join(f"word{i}" for i in range(30_000))
    docs = [(1, "Under THE mit-license, under the MIT license!"), (2, " ".join(edited)), (3, " ".join(wrong)), (4, None), (5, ""), (None, "cc by nc cc by nc"), (None, "cc by nc cc by nc"),
            (6, f"{filler} CC BY-NC {filler}"), (6, "not a licence"), (7, "cc by"), (8, "ünder the mit license"), (9, "cc by nc " * 3000)]
    d = folder(docs=docs)
    con, sql = twin(d, licenses.OP12_SQL)
    df = licenses.op12_licenses(spark, d)
    assert differ(df, con, sql) is None
    got = {r.doc_id: r for r in df.collect() if r.doc_id not in (None, 6)}
    assert got[1].n_base == 2 and got[1].first_word == 0 and got[1].last_word == 4 and got[1].labels == "mit"
    assert got[2].labels == "mit" and got[2].base_labels == "" and got[3].labels == "" and got[8].n_base == 0 and got[9].n_base == 3000
    assert licenses.op12_licenses(spark, folder()).count() == 0
