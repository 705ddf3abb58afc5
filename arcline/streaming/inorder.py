"""Order-dependent rules on streams, exact at any split into micro-batches.

Rows of a series wait in state until the watermark has passed them and then go through the rule in event-time
order, so the answer is that of one pass over the whole series. State holds what waits (the rows inside the
watermark's delay) and what the rule remembers; a timer lets the rule end things, and drops its state, when rows
stay away. Several such operators may follow each other in one plan: each stamps its rows with the event time at
which it emits them.

Rows that come after the watermark are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import _typed
from ..session import shared_folder

AT = "event_time"
#: Replayed series begin a day after the epoch, where the first watermark stands.
DAY = 86400
#: Groups of series that pass together.
BUCKETS = 96
#: A series that no time wakes.
NEVER = (1 << 63) - 1
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Rule:
    """``step(state, row)`` yields tuples of ``schema``; ``deadline(state)`` is the second after which ``expire(state)``
    ends what is open (None: nothing is). A state equal to ``init`` is not kept."""

    schema: str
    init: dict
    step: Callable[[dict, Any], Iterable[tuple]]
    deadline: Callable[[dict], float | None] | None = None
    expire: Callable[[dict], Iterable[tuple]] | None = None
    ties: tuple[str, ...] = ("frame",)


class _InOrder(StatefulProcessor):
    """The series of one bucket pass in one call, as a call costs far more than the rows of a short series.

    State is one row for each series: when it next has something to do, its key, what the rule remembers and the
    rows that wait. Series with nothing to do are put back unread.
    """

    def __init__(self, rule: Rule, keys: list[str], row_schema: T.StructType, out: T.StructType, zero: float):
        self.rule, self.keys, self.rows_as, self.out, self.zero = rule, keys, row_schema, out, zero

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getListState("series", "wake long, key binary, memory string, rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[tuple, list[tuple]] = {}
        for pdf in rows:
            at = _micros(pdf[AT])
            columns = [at if n == AT else _column(pdf[n]) for n in self.rows_as.names]
            for k, r in zip(zip(*(_column(pdf[c]) for c in self.keys)), zip(*columns)):
                new.setdefault(k, []).append(r)
        yield from self._go(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go({}, timerValues.getCurrentWatermarkInMs())

    def _go(self, new: dict[tuple, list[tuple]], mark: int) -> Iterator[pd.DataFrame]:
        kept, out, wakes = [], [], []
        for wake, name, memory, rows in self.series.get():
            key = pickle.loads(name)
            more = new.pop(key, None)
            if more is None and wake > mark:
                kept.append((wake, name, memory, rows))
            else:
                kept += self._pass(key, json.loads(memory), pickle.loads(rows), more or [], mark, out)
        for key, more in new.items():
            kept += self._pass(key, json.loads(json.dumps(self.rule.init)), [], more, mark, out)
        wakes = [k[0] for k in kept if k[0] < NEVER]
        self.series.put(kept) if kept else self.series.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if wakes:
            self.handle.registerTimer(min(wakes))
        if out:
            pdf = pd.DataFrame(out, columns=self.out.names, dtype=object)
            yield _typed(pdf.assign(**{AT: pd.to_datetime(pdf[AT].astype("int64"), unit="us").astype("datetime64[us]")}), self.out)

    def _pass(self, key: tuple, state: dict, held: list[tuple], new: list[tuple], mark: int, out: list) -> list[tuple]:
        """One series: rows that are due go through the rule; the row of state that stays, if any."""
        names, rule = self.rows_as.names, self.rule
        at, ties = names.index(AT), [names.index(c) for c in rule.ties]
        kind = NamedTuple("Row", [(n, Any) for n in names]) if self.kind is None else self.kind  # noqa: UP014  names are known at run time only
        self.kind = kind
        held = [*held, *new]
        held.sort(key=lambda r: (_ms(r[at]), *[r[i] for i in ties]))
        due = sum(_ms(r[at]) <= mark for r in held)
        keep = held[due:]
        for r in held[:due]:
            out += [(*key, r[at], *t) for t in rule.step(state, kind(*r))]
        until = rule.deadline(state) if rule.deadline else None
        while until is not None and self._stamp(until) <= mark and not (keep and _ms(keep[0][at]) <= self._stamp(until)):
            when = self._stamp(until) * 1000
            out += [(*key, when, *t) for t in rule.expire(state)]
            until = rule.deadline(state)
        if not keep and state == rule.init:
            return []
        wake = min([NEVER, *([_ms(keep[0][at])] if keep else []), *([self._stamp(until)] if until is not None else [])])
        return [(wake if wake == NEVER else max(wake, mark + 1), pickle.dumps(key), json.dumps(state), pickle.dumps(keep))]

    kind = None

    def _stamp(self, second: float) -> int:
        """The first millisecond of event time at which no row of ``second`` or before can come."""
        return int((second + self.zero) * 1000) + 2

    def close(self) -> None:
        pass


def _plain(v):
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and v != v or v is pd.NaT or v is pd.NA else v


def _column(s: pd.Series) -> list:
    if s.dtype.kind in "iub":
        return s.tolist()
    if s.dtype.kind == "f":
        return [None if v != v else v for v in s.tolist()]
    return [_plain(v) for v in s]


def _micros(s: pd.Series) -> list[int]:
    return s.astype("datetime64[us]").astype("int64").tolist()


def _ms(micros: int) -> int:
    """Milliseconds of an event time, never rounded down past a watermark of whole milliseconds."""
    return -(-micros // 1000)


def in_order(stream: DataFrame, keys: Sequence[str], rule: Rule, delay: str | None = "1 second", zero: float = DAY, buckets: int = BUCKETS) -> DataFrame:
    """Apply ``rule`` to each key of ``stream`` in the order of ``event_time``.

    ``delay`` None takes the watermark of an operator before; ``zero``: seconds of event time where the rule's
    own seconds begin. Series are grouped in ``buckets`` by a hash of their keys; a call holds the rows and the memory
    of one bucket, so give more for more series. A stream goes on with the number it began with.
    """
    keys = list(keys)
    s = stream.withWatermark(AT, delay) if delay else stream
    row_schema = T.StructType([f for f in s.schema.fields if f.name not in keys])
    out = T.StructType([*[s.schema[k] for k in keys], T.StructField(AT, T.TimestampType()), *T.StructType.fromDDL(rule.schema).fields])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return s.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(_InOrder(rule, keys, row_schema, out, zero), out, "append", "eventTime", eventTimeColumnName=AT)


def replayed(df: DataFrame, seconds: str, files: int = 4, ends: bool = True, keys: Sequence[str] = ("session_id",), name: str = "replay") -> DataFrame:
    """A stream over ``df`` cut into files by time (one micro-batch each), with ``event_time`` a day after column ``seconds``.

    The files are written to the shared folder. A last file with one row for each key (all other columns null, an
    hour later) says that time has gone on, so that what is open can end; ``beats`` drops those rows again.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(seconds), F.max(seconds)).first()
    low, span = (low or 0.0), max((high or 0.0) - (low or 0.0), 1e-9)
    t = df.withColumn(AT, F.timestamp_micros(F.round((F.col(seconds) + DAY) * 1e6).cast("long"))).withColumn("part", F.least(F.lit(files - 1), F.floor((F.col(seconds) - low) / span * files)).cast("int"))
    t.write.partitionBy("part").parquet(f"{base}/cut")
    fields = T.StructType([f for f in t.schema.fields if f.name != "part"])
    for k in range(files):
        spark.read.schema(t.schema).parquet(f"{base}/cut").where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
    if ends:
        last = F.timestamp_micros(F.lit(int(((high or 0.0) + DAY + 3600) * 1e6)))
        beat = df.select(*keys).distinct().withColumn(AT, last)
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in (*keys, AT)]
        beat.select(*keys, AT, *rest).select(*fields.names).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def drained(stream: DataFrame, name: str, late: list[int] | None = None) -> DataFrame:
    """Run the stream to its end into a table in the shared folder and return it; ``late`` gets the number of dropped rows."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    if late is not None:
        late.append(sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators))
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
