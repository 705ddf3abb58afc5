"""Order-dependent logic over long keys, run in parallel chunks with exact results.

Each key is cut into blocks of the order column. All blocks run at once, each warmed up on the
last rows of the block before it; then every block whose predecessor ended in another state than
the one it started from is run again from that state, until nothing changes. A fold that forgets
(timeouts, cooldowns, resets) is right at once, and no task ever holds more than one block and
its warm-up.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import ordered
from .ordered import BLK, OWN, block_of

#: Rows that leave a task together.
BATCH = 1 << 14

Step = Callable[[dict, tuple], Iterable[tuple]]


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    init: dict,
    step: Step,
    schema: str,
    flush: Callable[[dict], Iterable[tuple]] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Run ``step(state, row)`` along each key in order; it mutates the JSON-able state and
    returns output tuples of ``schema``. ``flush(state)`` may emit more at the end of the key.
    """
    keys = list(keys)
    part = [*keys, BLK]
    block = block or ordered.BLOCK
    rows = df.withColumn(BLK, block_of(order, block))
    warmed = ordered.spread(df, order, max(block // 4, 1), 0, block)
    out_fields = T.StructType.fromDDL(schema).fields
    names = [f.name for f in out_fields]
    key_fields = [f for f in rows.schema.fields if f.name in part]
    key_fields.sort(key=lambda f: part.index(f.name))
    full = T.StructType([*key_fields, T.StructField("_in", T.StringType()), T.StructField("_end", T.StringType()), *out_fields])
    start = json.dumps(init, sort_keys=True)
    empty = (None,) * len(names)
    columns = df.columns
    kind = namedtuple("Row", columns, rename=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks pass one after the other, so one batch is held, whatever the number of blocks and their length.

        A row without a mark of its own tells the state that its block starts from, copies warm it up.
        """
        made, at, state, text, types = [], None, None, None, None

        def end() -> list[tuple]:
            return [] if text is None else [(*at, text, json.dumps(state, sort_keys=True), *empty)]

        for b in batches:
            types = types or [b.schema.field(k).type for k in part]
            cols = [values(b.column(c), True) for c in columns]
            ids = zip(*(values(b.column(k)) for k in part))
            for key, own, told, row in zip(ids, values(b.column(OWN)), values(b.column("_prev")), map(kind._make, zip(*cols))):
                if key != at:
                    made += end()
                    at, state, text = key, json.loads(told or start), None
                if own is None:
                    continue
                if own and text is None:
                    text = json.dumps(state, sort_keys=True)
                got = step(state, row)
                if own:
                    made += [(*key, None, None, *t) for t in got]
                if len(made) >= BATCH:
                    yield _batch(made, full, types)
                    made = []
        made += end()
        if made:
            yield _batch(made, full, types)

    def through(t: DataFrame) -> DataFrame:
        return t.repartition(*part).sortWithinPartitions(*part, order).mapInArrow(run, full)

    done = cut_lineage(through(warmed.withColumn("_prev", F.lit(None).cast("string"))))
    frozen = None
    chain = Window.partitionBy(*keys).orderBy(BLK)
    while True:
        ends = done.where(F.col("_end").isNotNull()).select(*part, "_in", F.lag("_end").over(chain).alias("_prev"))
        stale = ends.where(F.coalesce("_prev", F.lit(start)) != F.col("_in")).select(*part, F.coalesce("_prev", F.lit(start)).alias("_prev"))
        if stale.isEmpty():
            break
        frozen = frozen if frozen is not None else cut_lineage(rows)
        todo = frozen.join(stale.select(*part), part, "left_semi")
        redo = through(todo.withColumn(OWN, F.lit(True)).unionByName(stale, allowMissingColumns=True))
        done = cut_lineage(done.join(stale.select(*part), part, "left_anti").select(*full.names).unionByName(redo))
    out = done.where(F.col("_end").isNull()).select(*keys, *names)
    if flush is None:
        return out
    last = done.where(F.col("_end").isNotNull()).groupBy(*keys).agg(F.max_by("_end", BLK).alias("end_state"))
    tail_schema = T.StructType([*[f for f in key_fields if f.name != BLK], *out_fields])

    def closing(it):
        for pdf in it:
            recs = [(*[getattr(row, k) for k in keys], *t)
                    for row in pdf.itertuples(index=False) for t in flush(json.loads(row.end_state))]
            yield _typed(pd.DataFrame(recs, columns=tail_schema.names, dtype=object), tail_schema)

    return out.unionByName(last.mapInPandas(closing, tail_schema))


def values(a: pa.Array, top: bool = False) -> list:
    """Python values of a column, structs as dicts; missing numbers of the column itself (``top``) are NaN."""
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        inner, out, n = values(a.flatten()), [], 0
        for k in pc.list_value_length(a).to_pylist():
            out.append(None if k is None else inner[n:n + k])
            n += k or 0
        return out
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        out = [dict(zip(names, v)) for v in zip(*(values(f) for f in a.flatten()))]
        return out if not a.null_count else [v if ok else None for v, ok in zip(out, a.is_valid().to_pylist())]
    number = pa.types.is_integer(a.type) or pa.types.is_floating(a.type)
    if number and not a.null_count:
        return a.to_numpy(zero_copy_only=False).tolist()
    out = a.to_pylist()
    return [float("nan") if v is None else v for v in out] if number and top else out


def _batch(rows: list[tuple], schema: T.StructType, keys: list[pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch; NaN is missing, as in ``_typed``."""
    as_type = {T.LongType: int, T.IntegerType: int, T.DoubleType: float, T.BooleanType: bool}
    kinds = [*keys, *[_arrow(f.dataType) for f in schema.fields[len(keys):]]]
    out = []
    for col, f, t in zip(zip(*rows), schema.fields, kinds):
        to = as_type.get(type(f.dataType))
        out.append(pa.array([None if v is None or v != v else to(v) for v in col] if to else col, t))
    return pa.RecordBatch.from_arrays(out, names=schema.names)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}[type(t)]


def _typed(pdf: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """Nullable pandas types, so that missing integers and booleans survive."""
    kind = {T.LongType: "Int64", T.IntegerType: "Int32", T.DoubleType: "Float64", T.BooleanType: "boolean"}
    pdf = pdf[schema.names]
    return pdf.astype({f.name: kind[type(f.dataType)] for f in schema.fields if type(f.dataType) in kind})
