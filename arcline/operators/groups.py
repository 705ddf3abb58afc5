"""Groups of linked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Kept


def linked_groups(links: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", kept: Kept | None = None) -> DataFrame:
    """(keys, node, label): the least node that links (both ways, within equal keys) lead to, for every node of ``links``.

    Each round points every node to its least neighbour, follows the pointers to their ends in doubling steps, and
    goes on with the links between those ends alone. So a round meets only what is not yet settled, and the longest
    chain costs small rounds; the answers of all rounds are put together from the last one back. A node with very
    many links is a pre-aggregated key. Tables of a round go when it ends; the answer is one of ``kept``.
    """
    keys, kept = list(keys), kept or Kept(links.sparkSession)
    e = links.select(*keys, F.col(a).alias("node"), F.col(b).alias("other"))
    e = kept.keep(e.unionByName(e.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    rounds: list[DataFrame] = []
    while not rounds or not e.isEmpty():
        label = kept.keep(e.groupBy(*keys, "node").agg(F.least(F.col("node"), F.min("other")).alias("label")).withColumn("moved", F.lit(True)))
        while not label.where("moved").isEmpty():
            ahead = label.select(*keys, F.col("node").alias("label"), F.col("label").alias("next"))
            label = kept.keep(label.drop("moved").join(ahead, [*keys, "label"]).select(*keys, "node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), label)
        rounds.append(label)
        ends = label.drop("moved")
        own, theirs = ends.withColumnRenamed("label", "from"), ends.toDF(*keys, "other", "to")
        left = e.join(own, [*keys, "node"]).join(theirs, [*keys, "other"]).where(F.col("from") != F.col("to"))
        e = kept.keep(left.select(*keys, F.col("from").alias("node"), F.col("to").alias("other")).distinct(), e)
        kept.tidy()
    kept.drop(e)
    last = rounds.pop()
    while rounds:
        first, later = rounds.pop(), last.drop("moved").toDF(*keys, "label", "end")
        last = kept.keep(first.join(later, [*keys, "label"], "left").select(*keys, "node", F.coalesce("end", "label").alias("label"), "moved"), first, last)
    return last.select(*keys, "node", "label")
