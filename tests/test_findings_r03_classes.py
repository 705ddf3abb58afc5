"""Third round, F13: rows are not dealt to tasks by their class."""

from pyspark.sql import functions as F

from arcline.operators.features import balance_classes


def test_classes_are_not_dealt_by_label(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(600).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("frame"), F.when(F.col("id") % 10 == 0, "a").otherwise("view").alias("label"))
        out = balance_classes(df, "label", "view", 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        n = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert n["a"] == 120 and 80 < n["view"] < 160
