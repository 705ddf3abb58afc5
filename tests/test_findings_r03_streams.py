"""Many short series pass a stream together."""

from collections import Counter

from pyspark.sql import functions as F

from arcline.streaming import inorder as I
from arcline.streaming import reports as RP


def _counted() -> I.Rule:
    def step(state, row):
        if row.frame is None:
            return []
        out = end(state) if state["t"] is not None and row.t > state["t"] + 3 else []
        state["n"] += 1
        state["t"] = row.t
        return [*out, ("row", state["n"], row.frame)]

    def end(state):
        n, state["n"], state["t"] = state["n"], 0, None
        return [("end", n, None)]

    return I.Rule("kind string, n long, frame long", {"n": 0, "t": None}, step, lambda s: None if s["t"] is None else s["t"] + 3, end)


def _rows(spark, series=30, frames=40):
    # series 0 to 29 of two names each pause at a frame of their own
    t = spark.range(series * frames).select((F.col("id") % series).alias("s"), F.floor(F.col("id") / series).alias("frame"))
    t = t.withColumn("name", F.when(F.col("s") % 2 == 0, "even"))
    return t.withColumn("t", F.col("frame").cast("double") + F.when(F.col("frame") > F.col("s"), 5.0).otherwise(0.0))


def test_series_share_a_call(spark):
    want = Counter()
    for s in range(30):
        name = "even" if s % 2 == 0 else None
        for k in range(40):
            want[s, name, "row", k + 1 if k <= s else k - s, k] += 1
        want[s, name, "end", s + 1, None] += 1
        want[s, name, "end", 39 - s, None] += 1
    for buckets in (1, 7):
        stream = I.in_order(I.replayed(_rows(spark), "t", 3, keys=("s", "name")), ["s", "name"], _counted(), buckets=buckets)
        got = Counter((r.s, r.name, r.kind, r.n, r.frame) for r in I.drained(stream, "shared").collect())
        assert got == want


def test_reports_run_the_stream_once_a_batch(spark):
    schema = "session_id long, rally long, start_t double, end_t double, strokes long, bounces long"
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    path = f"{I.shared_folder(spark)}/reports-once"
    spark.createDataFrame([(1, k, float(k), k + 0.5, 2, 1) for k in range(1, 7)], schema).coalesce(1).write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(schema).parquet(path).mapInPandas(seen, schema)
    got = sorted((r.session_id, r.rallies, r.strokes, r.bounces, r.play_s) for r in RP.reports(stream, every=2).collect())
    assert got == [(1, n, 2 * n, n, 0.5 * n) for n in (2, 4, 6)]
    assert calls.value == 6
