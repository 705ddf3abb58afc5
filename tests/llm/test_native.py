"""Operators with an SQL twin on small tables with odd rows: nulls, empty texts, ties, repeats, clashing names."""

import duckdb
import pytest
from pyspark.sql import functions as F

from arcline.llm import chat, decontam, kdshard, linededup, mixing
from arcline.llm.queries import ORACLES, QUERIES
from tests.check import differ
from tests.conftest import SF

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert differ(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def twin(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas()  # noqa: F841
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
    return con, sql


def odd_docs(table):
    long = " ".join(WORDS * 30)
    return table([(1, long, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "one two", "de", "b"), (5, long + " x", "en", None), (6, "\n\n \t", "fr", "c"), (7, "ONE, two!", "de", "b"),
                  (8, "Ünï çødé " * 20, "xx", "é"), (9, long, "en", "a")])


def test_contained(table, spark):
    docs = odd_docs(table).unionByName(odd_docs(table).filter("doc_id = 1"))
    item = " ".join(WORDS)
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "..."), (5, item.upper()), (None, "two one"), (6, " ".join(WORDS[:9]) + " other words that are not there at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["size"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(d, i): (6, 6) for d in (1, 5, 9) for i in (1, 5)} | {(4, 2): (1, 1), (7, 2): (1, 1)}
    none = docs.filter(F.lit(False))
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.filter(F.lit(False))).count() == 0


def test_sketch_loses_no_match(spark, table):
    """Documents that lack as many shingles as allowed, wherever they are."""
    words = [f"w{i}" for i in range(24)]  # 20 shingles; 4 may be missing
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = []
    for i in range(24):
        w = list(words)
        w[i] = "other"
        rows.append((i, "begin " * 50 + " ".join(w) + " end" * 50))
    got = {r["doc_id"] for r in decontam.contaminated(table(rows), bench).collect()}
    assert got == {0, 1, 2, 3, 20, 21, 22, 23}


def test_mix_odd_rows(table):
    docs = odd_docs(table).unionByName(odd_docs(table).filter("doc_id in (1, 2)"))
    con, sql = twin(mixing.OP9_SQL, documents=odd_docs(table))
    assert differ(mixing.mix(odd_docs(table)).docs.select("doc_id", "size", "source_size", "target", "taken"), con, sql) is None
    out = mixing.mix(docs)
    rows = out.docs.collect()
    assert len(rows) == 11 and all(r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r["src"]: r["target"] for r in rows}.values()) - total) < 1e-6
    for s, block_rows in {r["src"]: [x for x in rows if x["src"] == r["src"]] for r in rows}.items():
        assert abs(sum(x["taken"] for x in block_rows) - block_rows[0]["target"]) <= 2 * 64
    # every slot is filled by one block, and no block of a source is used twice more often than another
    assert out.slots.join(out.blocks.select("src", "block").distinct(), ["src", "block"]).count() == out.slots.count()
    uses = out.slots.groupBy("src", "block").count().groupBy("src").agg((F.max("count") - F.min("count")).alias("gap")).agg(F.max("gap")).first()[0]
    assert uses <= 1
    empty = docs.filter(F.lit(False))
    assert mixing.mix(empty).docs.count() == 0
    assert {r["taken"] for r in mixing.mix(docs.filter("text is null")).docs.collect()} == {0}


def test_targets_fill_up(spark):
    """Against the rule as stated: share by weight, stop at three times the size, share the rest again."""
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, "e": 0, "é": 700, None: 20}
    order = sorted((x for x in sizes if x is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {s: 0.0 for s in sizes}, float(sum(sizes.values())), set(sizes)
    while left > 1e-9:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in set(open_):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in target)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("n"))
    got = [r["x"] for r in mixing.permuted("x", "n", F.lit(5).cast("long"), df).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_shards_brute_force(table, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = kdshard.shard(docs, shards=16).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(16))
    biggest, mean = max(r["size"] for r in rows), sum(r["size"] for r in rows) / 16
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
        assert abs(sum(r["size"] for r in s) - mean) <= 2 * biggest


def test_shards_odd_rows(table):
    docs = odd_docs(table).unionByName(table([(None, "x", None, None), (1, "y", "en", "a"), (1, "y", "en", "a")]))
    rows = kdshard.shard(docs, shards=3).collect()
    assert len(rows) == 12 and {r["shard"] for r in rows} == {0, 1, 2}
    assert next((r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 2) == (1, 0)
    assert {r["shard"] for r in kdshard.shard(docs, target_bytes=1 << 20).collect()} == {0}
    assert kdshard.shard(docs.filter(F.lit(False)), shards=4).count() == 0
    small = kdshard.shard(docs, target_bytes=4000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(small) > 1


def test_line_dedup_odd_rows(table):
    run = "\n".join(f"line {i} " + " ".join(WORDS[:6]) for i in range(12))
    docs = table([(1, "start\n" + run + "\nend"), (2, run), (3, "own first line here\n\n" + run.replace("line 3", "  line 3") + "\nown last"), (4, None), (5, ""), (6, "short\nshort\nshort"), (7, "again and again\n" * 60),
                  (8, run.split("\n", 2)[2] + "\n\ntail"), (9, run)])
    con, sql = twin(linededup.OP10_SQL, documents=docs)
    out = linededup.without_repeats(docs)
    assert differ(out, con, sql) is None
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["removed_lines"] == 0 and got[2]["text"] == "" and got[3]["text"] == "own first line here\n\nown last" and got[8]["text"] == "\ntail"
    assert got[6]["removed_lines"] == 0 and got[7]["text"] == "again and again\n" and got[4]["text"] is None and got[5]["text"] == ""
    more = docs.unionByName(docs.filter("doc_id in (1, 2)")).unionByName(table([(None, run), (None, "x")]))
    rows = linededup.without_repeats(more).collect()
    assert len(rows) == 13 and all(r["removed_lines"] == 0 for r in rows if r["doc_id"] == 1) and {r["text"] for r in rows if r["doc_id"] is None} == {"", "x"}
    assert linededup.without_repeats(docs.filter(F.lit(False))).count() == 0


def test_chat_round_trip(spark):
    odd = ["", None, "<|im_end|>", "\\", "\\<|", "<|<|im_start|>x", "a\\|b\\\\|c", "line\nbreak", "é😀", "<\\|", "\\n", "\\\\n"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, "ro\nle\\n<|", "x"), (2, 0, "user", "tie"), (2, None, None, "first"), (None, 1, "assistant", "y"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(3)).withColumn("n", F.lit(1))
    segments = chat.format_turns(df)
    back = sorted(((r["conv_id"] or 0, r["place"], r["role"], r["text"], r["loss"]) for r in chat.read_back(segments).collect()))
    want = [(0, 0, "assistant", "y", "y"), (0, 1, "assistant", "y", "y")]
    want += [(1, i, "assistant" if i % 2 else "user", t or "", (t or "") if i % 2 else None) for i, t in enumerate(odd)]
    want += [(2, 0, "", "first", None), (2, 1, "ro\nle\\n<|", "x", None), (2, 2, "user", "tie", None)]
    assert back == want
    whole = {c: "".join(r["segment"] for r in sorted(segments.filter(F.col("conv_id") == c).collect(), key=lambda r: r["place"])) for c in (1, 2)}
    made = chat.render(segments).filter("conv_id = 1").collect()
    spans = {(r["place"]): r for r in chat.examples(segments).filter("conv_id = 1").collect()}
    assert len(made) == len(spans) == 6
    for r in made:
        s = spans[r["place"]]
        assert r["context"] + r["target"] == whole[1][:s["loss_end"]] and len(r["context"]) == s["loss_start"]
    assert chat.format_turns(df.filter(F.lit(False))).count() == 0
