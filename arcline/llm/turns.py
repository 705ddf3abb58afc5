"""Turns of conversations in order, without gathering a conversation in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Turn numbers that are counted together; a long conversation is counted piece by piece.
PIECE = 1024


def numbered(turns: DataFrame, order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """``turns`` with ``place``: the number of each row in its conversation from 0, nulls first.

    Rows equal in ``order`` are repeated turns. A null ``conv_id`` is one conversation of its own. Windows hold
    the rows of ``PIECE`` turn numbers; rows that share one number (or have none) are in one window.
    """
    t = turns.withColumn("_piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62))))
    sizes = t.groupBy("conv_id", "_piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("conv_id").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("_piece").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    t = t.withColumn("_row", F.row_number().over(W.partitionBy("conv_id", "_piece").orderBy(*order)) - 1)
    t = t.join(sizes, t["conv_id"].eqNullSafe(sizes["_c"]) & (t["_piece"] == sizes["_p"]))
    return t.withColumn("place", F.col("_before") + F.col("_row")).drop("_piece", "_row", "_c", "_p", "_before")


def crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def crc_sql(text: str) -> str:
    """crc32 of an ASCII string in DuckDB: bytes and bit steps (-1) folded over the checksum."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
