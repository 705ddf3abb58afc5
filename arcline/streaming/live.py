"""Live processing with Structured Streaming: the batch rules on event time.

Event time is the capture time; a watermark bounds every join and state, late rows are dropped.
Order-dependent rules reuse the batch step functions, with the state kept per session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import triangulated
from ..operators.fold import _typed
from ..session import shared_folder


def pair_streams(a: DataFrame, b: DataFrame, cam_a: tuple, cam_b: tuple, delay: str = "10 seconds", slack: str = "2 seconds") -> DataFrame:
    """Stream-stream join of the two cameras on frame within a time band, triangulated.

    Both sides carry ``event_time``; the band lets Spark drop old join state.
    """
    l = a.select("session_id", "frame", F.col("event_time").alias("time_a"), F.col("world_x").alias("a_x"), F.col("world_y").alias("a_y"))
    r = b.select(F.col("session_id").alias("_s"), F.col("frame").alias("_f"), F.col("event_time").alias("time_b"), F.col("world_x").alias("b_x"), F.col("world_y").alias("b_y"))
    l, r = l.withWatermark("time_a", delay), r.withWatermark("time_b", delay)
    band = F.expr(f"time_b BETWEEN time_a - INTERVAL {slack} AND time_a + INTERVAL {slack}")
    j = l.join(r, (F.col("session_id") == F.col("_s")) & (F.col("frame") == F.col("_f")) & band)
    return triangulated(j.drop("_s", "_f", "time_b"), "a", "b", cam_a, cam_b)


def activity_sessions(points: DataFrame, gap: str = "1 second", delay: str = "5 seconds") -> DataFrame:
    """Stretches of points without a pause, closed by the watermark."""
    return (points.withWatermark("event_time", delay).groupBy("session_id", F.session_window("event_time", gap).alias("w"))
            .agg(F.count("*").alias("n"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
            .select("session_id", "start_frame", "end_frame", "n"))


def stateful(df: DataFrame, keys: Sequence[str], order: str, init: dict, step: Callable[[dict, tuple], Iterable[tuple]], schema: str) -> DataFrame:
    """Run a batch fold's step function on a stream; rows of one micro-batch are ordered first."""
    keys = list(keys)
    out_fields = T.StructType.fromDDL(schema).fields
    key_fields = [f for k in keys for f in df.schema.fields if f.name == k]
    full = T.StructType([*key_fields, *out_fields])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(init))
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order)
        out = [(*key, *t) for row in rows.itertuples(index=False) for t in step(s, row)]
        state.update((json.dumps(s),))
        yield _typed(pd.DataFrame(out, columns=full.names, dtype=object), full)

    return df.groupBy(*keys).applyInPandasWithState(run, full, "s string", "append", GroupStateTimeout.NoTimeout)


def crossing_step(state: dict, row, cap: float = 280.0, band: tuple[float, float] = (30.0, 150.0), keep: int = 5) -> list[tuple]:
    """Net crossing with the median of the last plausible step speeds, whole km/h."""
    t, p = float(row.t), (float(row.x), float(row.y), float(row.z))
    last, state["p"] = state["p"], [t, *p]
    if last is None:
        return []
    dt = t - last[0]
    if dt > 0.001:
        v = sum((a - b) ** 2 for a, b in zip(p, last[1:])) ** 0.5 / dt * 3.6
        if v <= cap:
            state["v"] = [*state["v"], v][-keep:]
    was, now = last[2], p[1]
    if not ((was < 0 <= now) or (was > 0 >= now)) or len(state["v"]) < 2:
        return []
    s = sorted(state["v"])
    mid = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    if not band[0] <= mid <= band[1]:
        return []
    return [(int(row.frame), int(round(mid)), "near_to_far" if now > was else "far_to_near")]


CROSSING_STATE = {"p": None, "v": []}
CROSSING_SCHEMA = "frame long, speed_kmh long, direction string"


def gate_step(state: dict, row, percentile: float = 20, size: int = 500, every: int = 50) -> list[tuple]:
    """Drop repeated pixel quadruples and pairs below a confidence threshold learnt from recent pairs.

    The threshold is renewed whenever the history length is a multiple of ``every``; once the
    history is full its length stays a multiple, so it is renewed on every pair.
    """
    quad = [float(v) for v in (row.a_px, row.a_py, row.b_px, row.b_py)]
    if quad == state["q"]:
        return []
    conf = (float(row.a_conf) + float(row.b_conf)) / 2
    hist = state["h"] = [*state["h"], conf][-size:]
    if len(hist) >= every and len(hist) % every == 0:
        state["th"] = sorted(hist)[int(len(hist) * percentile / 100)]
    if conf < state["th"]:
        return []
    state["q"] = quad
    return [(int(row.frame), conf, state["th"])]


GATE_STATE = {"q": None, "h": [], "th": 0.0}
GATE_SCHEMA = "frame long, conf double, threshold double"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain the stream into a parquet table in the shared folder (exactly once) and return it."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def emit_unseen(stream: DataFrame, name: str, keys: Sequence[str], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Micro-batch rule: recompute on everything received, append only rows with unseen keys.

    Early results are never taken back. The received rows and results are tables in the shared
    folder, so a restarted batch finds them again (batch ids make both writes idempotent).
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")
        seen_rows = spark.read.parquet(f"{base}/rows").where(F.col("batch") <= batch_id).drop("batch")
        new = transform(seen_rows)
        if batch_id > 0:
            done = spark.read.parquet(f"{base}/out").where(F.col("batch") < batch_id).select(*keys)
            new = new.join(done, list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def closed_rallies_with_rows(rallies: DataFrame, play: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows of each closed rally for export; ``max_rows`` keeps only the newest ones of a rally."""
    from pyspark.sql import Window

    from ..operators.joins import interval_join

    j = interval_join(play, rallies.select("session_id", "rally", "start_frame", "end_frame"), ["session_id"], "frame", "start_frame", "end_frame", 256)
    if max_rows is None:
        return j
    w = Window.partitionBy("session_id", "rally").orderBy(F.desc("frame"))
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_rows).drop("_rn")
