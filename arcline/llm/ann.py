"""Nearest neighbours by cross-polytope hashing (Andoni et al., 2015), for the largest inner product.

A unit vector is rotated by three rounds of random signs and a Hadamard transform and hashes to the nearest
signed axis. Several tables have rotations of their own, and a query looks into the buckets of its nearest few
axes in each (multiprobe). Inner products are exact, in double precision, on the vectors as given.

Vectors of any length: rows are banded by norm (powers of two below the largest), and in a band x becomes
(x / U, sqrt(1 - |x|^2 / U^2)) with the band's bound U, a query q becomes (q / |q|, 0): unit vectors whose
inner products have the order of the given ones. Queries probe every band.

Buckets are worked on in blocks of bounded size (rows by queries), so a bucket of very many rows or queries is
spread over tasks; no candidate is left out. Queries that find fewer than asked for are compared with all rows,
in blocks of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settled

#: Rows and queries of a block.
BLOCK = 4096
KEY = ["dim", "band", "tab", "bucket"]
BANDS = 60  # norms below 2^-60 of the largest share the last band


def _hadamard(a: np.ndarray) -> np.ndarray:
    n, d = a.shape
    h = 1
    while h < d:
        a = a.reshape(n, d // (2 * h), 2, h)
        a = np.concatenate([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return a / np.sqrt(d)


def _rotated(x: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    d = 1 << int(np.ceil(np.log2(max(2, x.shape[1]))))
    a = np.zeros((len(x), d))
    a[:, :x.shape[1]] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, d))
    for s in signs:
        a = _hadamard(a * s)
    return a


def _buckets(x: np.ndarray, table: int, functions: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the ``probes`` nearest buckets of each row."""
    best, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for f in range(functions):
        r = _rotated(x, (table, f))
        near = np.concatenate([r, -r], axis=1)  # axis i, then axis i with the other sign
        m = min(probes, near.shape[1])
        top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < near.shape[1] else np.tile(np.arange(m), (len(x), 1))
        score = np.take_along_axis(near, top, 1)
        both = (best[:, :, None] + score[:, None, :]).reshape(len(x), -1)
        codes = (code[:, :, None] * near.shape[1] + top[:, None, :]).reshape(len(x), -1)
        m = min(probes, both.shape[1])
        keep = np.argsort(-both, axis=1, kind="stable")[:, :m]
        best, code = np.take_along_axis(both, keep, 1), np.take_along_axis(codes, keep, 1)
    return np.repeat(np.arange(len(x)), code.shape[1]), code.ravel()


def _by_dim(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, g in b.groupby(b["vec"].map(len)):
        yield g, np.stack(g["vec"].to_list()).astype(float)


def _nearest(key, rows: pd.DataFrame, asks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a block for each of its queries."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
    if rows.empty or asks.empty:
        return none
    x, ids = np.stack(rows["vec"].to_list()), rows["vec_id"].to_numpy()
    out = []
    for q, v in zip(asks["query_id"].to_numpy(), asks["vec"]):
        s = x @ v
        own = ids == q
        s[own] = -np.inf
        n = min(k, len(s) - int(own.sum()))
        if not n:
            continue
        # products of equal vectors may differ in the last bits here: whatever is that near the k-th is summed again in one order
        least = np.partition(s, len(s) - n)[len(s) - n]
        at = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least) + np.abs(v).sum() * np.abs(x).max())) & ~own)
        exact = (x[at] * v).sum(axis=1)
        first = np.lexsort((ids[at], -exact))[:n]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][first], "score": exact[first]}))
    return pd.concat(out) if out else none


def _in_blocks(index: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each block of a bucket; both tables have KEY and vec."""
    n = index.groupBy(KEY).agg(F.count("*").alias("n")).join(asks.groupBy(KEY).agg(F.count("*").alias("m")), KEY)
    n = n.select(*KEY, F.ceil(F.col("n") / BLOCK).alias("rows"), F.ceil(F.col("m") / BLOCK).alias("cols"))
    grid = settled(n)
    left = index.join(grid, KEY).withColumn("i", F.pmod(F.xxhash64("vec_id"), "rows")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    right = asks.join(grid, KEY).withColumn("j", F.pmod(F.xxhash64("query_id"), "cols")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    by = [*KEY, "i", "j"]
    left, right = left.select(*by, "vec_id", "vec"), right.select(*by, "query_id", "vec")
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(lambda key, a, b: _nearest(key, a, b, k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 8, probes: int = 32, functions: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k found with the largest inner product for each query row.

    ``queries`` has the columns of ``vectors``; a query's own id is no candidate. Ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no
    part. Vectors are compared with those of their dimension. Repeated rows count once; if an id has several
    vectors, its best one counts. A query without candidates gets no row; empty tables give none.
    ``functions`` rotations together make a bucket. One gives 256 buckets for 64 dimensions, which random
    directions need (their nearest are hardly nearer than the rest): with 8 tables of 32 probes a recall of 0.97
    was measured on 500 such rows and 0.99 on 51,282. Clustered vectors can do with two and shorter buckets.
    """

    def clean(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias(name), v.alias("vec")).filter(F.col(name).isNotNull() & F.col("vec").isNotNull())
        fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
        return df.filter(fine).withColumn("dim", F.size("vec")).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c * c)))

    rows, asks = clean(vectors, "vec_id"), clean(queries, "query_id")
    top = settled(rows.groupBy("dim").agg(F.max("norm").alias("top"), F.count("*").alias("n")))
    band = F.least(F.floor(F.log2(F.col("top") / F.col("norm"))), F.lit(BANDS)).cast("int")
    rows = rows.join(top, "dim").withColumn("band", F.greatest(band, F.lit(0)))
    bands = settled(rows.select("dim", "band", "top").distinct())

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, x in _by_dim(b):
                u = (g["top"] / 2.0 ** g["band"]).to_numpy()[:, None]
                unit = np.concatenate([x / u, np.sqrt(np.maximum(0, 1 - (x / u) ** 2 @ np.ones((x.shape[1], 1))))], axis=1)
                for t in range(tables):
                    at, bucket = _buckets(unit, t, functions, 1)
                    yield pd.DataFrame({"dim": x.shape[1], "band": g["band"].to_numpy()[at], "tab": t, "bucket": bucket, "vec_id": g["vec_id"].to_numpy()[at], "vec": [x[i] for i in at]})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, x in _by_dim(b):
                unit = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
                for t in range(tables):
                    at, bucket = _buckets(unit, t, functions, probes)
                    yield pd.DataFrame({"dim": x.shape[1], "tab": t, "bucket": bucket, "query_id": g["query_id"].to_numpy()[at], "vec": [x[i] for i in at]})

    kind = "dim int, tab int, bucket long, {}, vec array<double>"
    index = settled(rows.select("vec_id", "vec", "band", "top").mapInPandas(hashed, kind.format("band int, vec_id long")))
    looks = asks.select("query_id", "vec").mapInPandas(probed, kind.format("query_id long"))
    looks = settled(looks.join(bands.select("dim", "band"), "dim"))
    found = settled(_best(_in_blocks(index, looks, k), k))
    # queries that found too few meet all rows
    few = asks.join(found.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left").filter(F.coalesce("found", F.lit(0)) < k)
    few = few.join(top.select("dim", "n"), "dim").filter(F.coalesce("found", F.lit(0)) < F.col("n") - 1)
    one = [F.lit(0).alias("band"), F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("bucket")]
    few = settled(few.select("dim", *one, "query_id", "vec"))
    if few.isEmpty():
        return found
    rest = _in_blocks(rows.drop("band").select("dim", *one, "vec_id", "vec"), few, k)
    return _best(found.select("query_id", "vec_id", "score").unionByName(rest), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
