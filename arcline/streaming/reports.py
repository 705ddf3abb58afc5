"""A report after every so many closed rallies, counted exactly once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .inorder import STORE

SUMS = ("strokes", "bounces", "play_s")


def reports(rallies: DataFrame, every: int = 10, base: str | None = None) -> DataFrame:
    """(session_id, rallies, strokes, bounces, play_s) of the first ``every``, twice ``every``, ... rallies of each session.

    ``rallies``: a stream of session_id, rally, start_t, end_t, strokes, bounces. Each micro-batch reads the running
    totals that the batch before left (one row a session) and leaves its own; both tables are named by the batch id,
    so a batch that runs again after a failure writes the same rows over. ``base`` names the folder to go on in.
    Which batch a rally comes with changes nothing: reports are cut by the count. 0 turns reports off.
    """
    spark: SparkSession = rallies.sparkSession
    base = base or f"{shared_folder(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    schema = "session_id long, rallies long, strokes long, bounces long, play_s double"

    def batch(df: DataFrame, batch_id: int) -> None:
        here = df.sparkSession
        totals, came = f"{base}/totals", f"{base}/came/batch={batch_id}"
        df.write.mode("overwrite").parquet(came)  # read three times below: the stream's operators must not run again for each
        df = here.read.schema(df.schema).parquet(came)
        old = here.read.schema(schema).parquet(f"{totals}/batch={batch_id - 1}") if batch_id else here.createDataFrame([], schema)
        old = old.select("session_id", *[F.col(c).alias(f"_{c}") for c in ("rallies", *SUMS)])
        run = Window.partitionBy("session_id").orderBy("rally").rowsBetween(Window.unboundedPreceding, 0)
        new = df.withColumn("play_s", F.col("end_t") - F.col("start_t")).join(old, "session_id", "left")
        new = new.select("session_id", (F.coalesce("_rallies", F.lit(0)) + F.count("*").over(run)).alias("rallies"),
                         *[(F.coalesce(f"_{c}", F.lit(0)) + F.sum(c).over(run)).alias(c) for c in SUMS])
        last = new.groupBy("session_id").agg(F.max("rallies").alias("rallies"), *[F.max_by(c, "rallies").alias(c) for c in SUMS])
        quiet = old.join(last, "session_id", "left_anti").toDF("session_id", "rallies", *SUMS)
        last.unionByName(quiet).write.mode("overwrite").parquet(f"{totals}/batch={batch_id}")
        due = new.where(F.col("rallies") % every == 0) if every > 0 else new.limit(0)
        due.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        q = rallies.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
