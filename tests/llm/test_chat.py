"""Digests of conversations that pass turn by turn."""

import hashlib

from arcline.llm import chat


def test_conversation_is_never_one_row(spark, tmp_path):
    turns = [(c, i, "assistant" if i % 2 else "user", f"é😀 {c} {i}" * (i % 5)) for c in (7, 8, None) for i in range(50 if c == 7 else 3)] + [(9, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 4)
    try:
        out = chat.op6_chat(spark, str(tmp_path))
        assert "collect_list" not in out._jdf.queryExecution().toString()
        got = {r["conv_id"]: r for r in out.collect()}
    finally:
        spark.conf.set(name, before)
    assert set(got) == {7, 8, None, 9, -1}
    for c in (7, 8, None, 9):
        own = [(r, t or "") for k, _, r, t in turns if k == c]
        loss, size, expanded = "".join(t for r, t in own if r == "assistant"), 0, 0
        for r, t in own:
            size += len(chat.START) + len(r) + 1 + len(t) + len(chat.END)
            expanded += size * (r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[c])[1:] == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), size, expanded)
