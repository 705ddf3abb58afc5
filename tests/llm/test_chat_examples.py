"""What is trained on comes from the examples of a conversation."""

from arcline.llm import chat


def test_loss_is_read_from_examples(spark, tmp_path, monkeypatch):
    turns = [(c, i, "assistant" if i % 2 else "user", f"\\<|é😀 {c}\n{i}") for c in (7, None) for i in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    segments = chat.format_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    made = {(r["conv_id"], r["place"]): r for r in chat.render(segments).collect()}
    read = {(r["conv_id"], r["place"]): r for r in chat.read_back(segments, chat.examples(segments)).collect()}
    assert len(read) == 16 and len(made) == 8
    for k, r in read.items():
        assert r["text"] == turns[k[1] + 8 * (k[0] is None)][3]
        assert r["loss"] == (r["text"] if k in made else None)
        assert r["example_chars"] == (len(made[k]["context"]) + len(made[k]["target"]) + len(chat.END) if k in made else None)
    # the query trains on the examples it made, on nothing else
    every = chat.examples
    monkeypatch.setattr(chat, "examples", lambda s: every(s).filter("place > 4"))
    got = {r["conv_id"]: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    assert got[-1]["loss_chars"] == 0
    for c in (7, None):
        own = [t for k, i, _, t in turns if k == c and i in (5, 7)]
        assert got[c]["loss_chars"] == sum(map(len, own)) and got[c]["n_turns"] == 8
