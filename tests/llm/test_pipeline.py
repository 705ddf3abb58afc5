"""The stages one after the other: columns, planted cases, odd rows."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from arcline.llm import decontam
from tests.conftest import SF


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0] + 1
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    clean = "Some words that no other text of this table holds, said once and never again in any language here."
    planted = [(top, "123 ... 456", "en", "src0", 11), (top + 1, None, "en", "src0", 0), (top + 2, f"begin here {clean} {item} and on it goes {clean}", "en", "src1", 9), (top + 3, clean, "en", "src1", 9),
               (top + 4, clean.upper(), None, None, 9)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    columns, ids = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(P.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {top, top + 1} & ids["language"] and {top + 2, top + 3, top + 4} <= ids["language"]
    assert top + 4 not in ids["near_copies"] and {top + 2, top + 3} <= ids["near_copies"]
    assert top + 2 not in ids["decontamination"] and top + 3 in ids["decontamination"]
    kept = spark.read.parquet(str(tmp_path / "near_copies"))
    assert ids["near_copies"] - ids["decontamination"] == {r["doc_id"] for r in decontam.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    mixed = spark.read.parquet(str(tmp_path / "mixture"))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixed.join(spark.read.parquet(str(tmp_path / "decontamination")), columns, "left_anti").count() == 0
    slots = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("kinds")).collect()
    assert docs.count() == mixed.count() and all(r["n"] == r["top"] + 1 == r["kinds"] for r in slots)


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
