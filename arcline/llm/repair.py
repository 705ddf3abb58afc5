"""Repair of conversation structure by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn and then user and assistant in turn. Rows may be
kept, given another role, deleted, and empty turns may be put in; the cheapest edits win, ties by the least
string of their initials (D, I, K, R).

The search runs depth first in that order under a bound on the cost that grows by one until a path is accepted,
so the first path accepted is the answer; states that failed with a budget are not entered again with as little.
It sees ``PIECE`` rows at most. A longer conversation is searched piece by piece for every pair of states at its
ends, neighbouring pieces are composed ``FAN`` at a time until one is left, and the states on the best path are
told back down; no task holds more than ``FAN`` pieces of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settled
from .turns import crc, crc_sql, numbered

PIECE, FAN = 64, 64
#: Costs of the edits; an undeleted truncated row adds one.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States by what was last: nothing, system, user, assistant. The turn that may follow each, and the state after a kept one.
FOLLOWS = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


@lru_cache(100_000)
def search(rows: str, entry: int, exits: tuple[int, ...], last: bool) -> tuple[int, str] | None:
    """(cost, initials) of the cheapest edits that lead from state ``entry`` to one of ``exits``, or None.

    ``rows``: two characters a row, the role's initial and ``x`` (must go), ``t`` (truncated) or ``.``. Turns are
    put in before a row, and behind the last row if ``last``.
    """
    n = len(rows) // 2
    seen_s = any(rows[2 * i] == "s" and rows[2 * i + 1] != "x" for i in range(n))
    reach = {q for q in exits if q == entry or q == 1 and entry == 0 and seen_s or q in (2, 3) and (n or last)}
    if not reach:
        return None
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + {"x": DELETE, "t": TRUNCATED}.get(rows[2 * i + 1], 0)
    failed: dict[tuple[int, int], int] = {}

    def path(i: int, q: int, left: int) -> str | None:
        if left < rest[i] or failed.get((i, q), -1) >= left:
            return None
        if i == n and q in reach:
            return ""
        role, to = FOLLOWS[q]
        if i < n and left >= DELETE and (p := path(i + 1, q, left - DELETE)) is not None:
            return "D" + p
        if (i < n or last) and left >= INSERT and (p := path(i, to, left - INSERT)) is not None:
            return "I" + p
        if i < n and rows[2 * i + 1] != "x":
            more = TRUNCATED if rows[2 * i + 1] == "t" else 0
            kept = KEPT.get((q, rows[2 * i]))
            if kept is not None and (p := path(i + 1, kept, left - more)) is not None:
                return "K" + p
            if rows[2 * i] != role and (p := path(i + 1, to, left - more - REROLE)) is not None:
                return "R" + p
        failed[i, q] = left
        return None

    for bound in range(rest[0], DELETE * n + 3 * INSERT + 1):
        found = path(0, entry, bound)
        if found is not None:
            return bound, found
    return None


def steps(rows: str, entry: int, audit: str) -> list[tuple[str, str, str]]:
    """(roles put in before, edit, new role's initial) of each row; inserts behind the last row have an empty edit."""
    out, q, ins, i = [], entry, "", 0
    for edit in audit:
        role, to = FOLLOWS[q]
        if edit == "I":
            ins, q = ins + role, to
            continue
        out.append((ins, edit, role if edit == "R" else ""))
        q = q if edit == "D" else to if edit == "R" else KEPT[q, rows[2 * i]]
        ins, i = "", i + 1
    return out + [(ins, "", "")] if ins else out


@lru_cache(10_000)
def table(rows: str, last: bool) -> tuple[list[int], list[int]]:
    """For every (entry, exit): the cost (-1: no way), and the rank of its initials among the exits of that entry."""
    cost, rank = [-1] * 16, [-1] * 16
    for e in range(4):
        found = {x: f for x in range(4) if (f := search(rows, e, (x,), last))}
        for k, x in enumerate(sorted(found, key=lambda x: found[x][1])):
            cost[4 * e + x], rank[4 * e + x] = found[x][0], k
    return cost, rank


def routes(pieces: list[tuple[list[int], list[int]]], entry: int) -> dict[int, tuple[int, tuple, tuple]]:
    """By exit: (cost, ranks, exits of each piece) of the best way from ``entry`` through ``pieces``.

    Ways part where they stand in one state, so the ranks there order their strings.
    """
    best = {entry: (0, (), ())}
    for cost, rank in pieces:
        now: dict[int, tuple] = {}
        for q, (c, ranks, way) in best.items():
            for x in range(4):
                if cost[4 * q + x] >= 0:
                    one = (c + cost[4 * q + x], ranks + (rank[4 * q + x],), way + (x,))
                    if x not in now or one[:2] < now[x][:2]:
                        now[x] = one
        best = now
    return best


def composed(pieces: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    cost, rank = [-1] * 16, [-1] * 16
    for e in range(4):
        found = routes(pieces, e)
        for k, x in enumerate(sorted(found, key=lambda x: found[x][1])):
            cost[4 * e + x], rank[4 * e + x] = found[x][0], k
    return cost, rank


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with place and fault: blank, duplicate, truncated or null; the first that holds.

    Nulls in role and text count as one space; rows go by turn (nulls first), then role and text.
    """
    t = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    t = numbered(t).withColumn("sym", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    t = settled(t)
    again = t.groupBy("conv_id", "sym").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("sym").alias("s"), "first")
    t = t.join(again, t["conv_id"].eqNullSafe(again["c"]) & (t["sym"] == again["s"]), "left")
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return t.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """(conv_id, idx, codes, after, last): up to PIECE rows of a conversation as one string; ``after`` is the next row's initial."""
    code = F.concat(F.rpad(F.substring("role", 1, 1), 1, "?"), F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("."))
    code = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), code).otherwise(F.concat(F.lit("?"), F.substring(code, 2, 1)))
    p = rows.groupBy("conv_id", F.floor(F.col("place") / PIECE).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))).alias("l"))
    by = W.partitionBy("conv_id").orderBy("idx")
    p = p.select("conv_id", "idx", F.array_join("l.code", "").alias("codes"))
    return p.withColumns({"after": F.substring(F.lead("codes").over(by), 1, 1), "last": F.lead("idx").over(by).isNull()})


def _mapped(df: DataFrame, fn, schema: str, types: list[pa.DataType | None]) -> DataFrame:
    """Each row (its first column handed on with its type) through ``fn``, in Arrow batches."""
    names = [x.strip().split(" ")[0] for x in schema.split(";")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in fn(*row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t or b.schema.types[0]) for c, t in zip(zip(*out), types)], names)

    return df.mapInArrow(each, schema.replace(";", ","))


LEGAL = ("su", "ua", "au")


def _solved(conv, idx, codes, after, last, entry, exits):
    cost, audit = search(codes, entry, tuple(exits), last)
    roles = codes[::2] + (after or "")
    illegal = sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
    done = steps(codes, entry, audit)
    return [(conv, idx, cost, audit, illegal, [{"ins": a, "edit": b, "role": c} for a, b, c in done])]


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, idx, cost, audit, illegal, steps) of each piece of ``rows`` (see with_faults): the edits of its rows in order.

    ``illegal`` counts neighbouring rows before repair whose initials are not su, ua or au. A role without an
    initial s, u or a can't be kept. A null conversation is one of its own.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    p = settled(pieces_of(rows))
    ask = p.filter("idx = 0 and last").select("*", F.lit(0).alias("entry"), F.array(*map(F.lit, ACCEPTED)).alias("exits"))
    top = p.agg(F.max("idx")).first()[0]
    if top:
        ask = ask.unionByName(_long(p.filter("idx > 0 or not last"), top, kind))
    spec = f"conv_id {kind}; idx long; cost long; audit string; illegal long; steps array<struct<ins:string,edit:string,role:string>>"
    step = pa.list_(pa.struct([("ins", pa.string()), ("edit", pa.string()), ("role", pa.string())]))
    return _mapped(ask, _solved, spec, [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), step])


def _long(p: DataFrame, top: int, kind: str) -> DataFrame:
    """Pieces of conversations of several, with the states at their ends on the best path."""
    ints, spec = pa.list_(pa.int32()), f"conv_id {kind}; idx long; cost array<int>; rank array<int>"
    types = [None, pa.int64(), ints, ints]
    level = settled(_mapped(p.select("conv_id", "idx", "codes", "last"), lambda conv, idx, codes, last: [(conv, idx, *table(codes, last))], spec, types))
    groups = []
    while top:
        up = level.groupBy("conv_id", F.floor(F.col("idx") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "cost", "rank"))).alias("parts"))
        groups.append(settled(up))
        level = settled(_mapped(groups[-1], lambda conv, idx, parts: [(conv, idx, *composed([(x["cost"], x["rank"]) for x in parts]))], spec, types))
        top //= FAN

    def start(conv, idx, cost, rank):
        x = min((x for x in ACCEPTED if cost[x] >= 0), key=lambda x: (cost[x], rank[x]))
        return [(conv, idx, 0, x)]

    def down(conv, up, parts, entry, leave):
        at = entry
        for x, end in zip(parts, routes([(x["cost"], x["rank"]) for x in parts], entry)[leave][2]):
            yield conv, x["idx"], at, end
            at = end

    spec, types = f"conv_id {kind}; idx long; entry int; leave int", [None, pa.int64(), pa.int32(), pa.int32()]
    told = _mapped(level, start, spec, types)
    for g in reversed(groups):
        t = told.select(F.col("conv_id").alias("c"), F.col("idx").alias("i"), "entry", "leave")
        told = _mapped(g.join(t, g["conv_id"].eqNullSafe(t["c"]) & (g["up"] == t["i"])).select("conv_id", "up", "parts", "entry", "leave"), down, spec, types)
    told = told.select(F.col("conv_id").alias("c"), F.col("idx").alias("i"), "entry", F.array("leave").alias("exits"))
    return p.join(told, p["conv_id"].eqNullSafe(told["c"]) & (p["idx"] == told["i"])).drop("c", "i")


def repaired_turns(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, place, part, role, text): the repaired conversations, in the order of place and part."""
    e = pieces.select(F.col("conv_id").alias("c"), "idx", F.posexplode("steps").alias("k", "step")).select("c", (F.col("idx") * PIECE + F.col("k")).alias("at"), "step.*")
    e = e.withColumnRenamed("role", "to")
    j = e.join(rows.select("conv_id", "place", "role", "text"), e["c"].eqNullSafe(rows["conv_id"]) & (e["at"] == rows["place"]), "left")
    full = lambda c: F.when(c == "u", "user").otherwise("assistant")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    put = F.transform(F.filter(F.split("ins", ""), lambda x: x != ""), lambda x: turn(full(x), F.lit("")))
    own = F.when(F.col("edit") == "K", F.array(turn(F.col("role"), F.col("text")))).when(F.col("edit") == "R", F.array(turn(full(F.col("to")), F.col("text"))))
    own = F.coalesce(own, F.array().cast("array<struct<role:string,text:string>>"))
    return j.select(F.col("c").alias("conv_id"), F.col("at").alias("place"), F.posexplode(F.concat(put, own)).alias("part", "turn")).select("conv_id", "place", "part", "turn.*")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of each conversation's ``role:text`` lines, turn by turn; one hash is held."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, t = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], t), pa.array([digest.hexdigest()])], ["conv_id", "sha"])
        for b in batches:
            t = b.schema.types[0]
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                line = f"{role}:{text}"
                if at != (conv,):
                    if at is not None:
                        yield done()
                    at, digest = (conv,), hashlib.sha256(line.encode())
                else:
                    digest.update(f"\n{line}".encode())
        if at is not None:
            yield done()

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "role", "text").mapInArrow(each, f"conv_id {kind}, sha string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the damage of their id's checksum: dropped, emptied, stripped of ends, repeated or given the role user; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = crc(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    t = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return t.drop("copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = settled(with_faults(damaged(turns)))
    pieces = settled(repaired(rows))
    kinds = ("blank", "duplicate", "truncated")
    seen = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    seen = seen.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    found = pieces.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("idx", "audit")))["audit"], "").alias("audit"))
    sha = digests(repaired_turns(rows, pieces))
    out = turns.select(F.col("conv_id").alias("c")).distinct()
    for part in (seen, found, sha):
        out = out.join(part, out["c"].eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *kinds, "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by dynamic programming over the rows: for each state the least [cost and initials, text so far]."""
    add = lambda v, cost, edit, line="''": f"CASE WHEN {v} IS NULL THEN NULL ELSE [lpad(CAST(CAST(substr({v}[1], 1, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({v}[1], 7) || '{edit}', {v}[2] || {line}] END"
    line = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    ins = lambda v, role: add(v, INSERT, "I", line(f"'{role}'"))
    one = f"least(v2, {ins('v0', 'user')}, {ins('v1', 'user')}, {ins('v3', 'user')}) AS i2, least(v3, {ins('v2', 'assistant')}) AS i3"
    two = f"least(i2, {ins('i3', 'user')}) AS w2, least(i3, {ins('i2', 'assistant')}) AS w3"
    keep = lambda v, role: f"CASE WHEN x = 0 AND ini = '{role}' THEN {add(v, 't', 'K', line('role', 'text'))} END"
    rerole = lambda v, role: f"CASE WHEN x = 0 AND ini <> '{role[0]}' THEN {add(v, f'{REROLE} + t', 'R', line(repr(role), 'text'))} END"
    drop = lambda v: add(v, DELETE, "D")
    gap = lambda source: f"(SELECT *, {two} FROM (SELECT *, {one} FROM {source}))"
    n2 = ", ".join([drop("w2"), *[keep(v, "u") for v in ("v0", "v1", "w3")], *[rerole(v, "user") for v in ("v0", "v1", "w3")]])
    n3 = ", ".join([drop("w3"), keep("w2", "a"), rerole("w2", "assistant")])
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(key)} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS c FROM o WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(regexp_replace(text, '[ \t-\r]+$', ''), 1) AS fin, substr(role, 1, 1) AS ini,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM n),
r AS (SELECT *, CASE WHEN fin = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  CASE WHEN fin = '' OR again THEN 1 ELSE 0 END AS x, CASE WHEN fin <> '' AND NOT again AND fin NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS t FROM e),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, ['000000', ''] AS v0, CAST(NULL AS VARCHAR[]) AS v1, CAST(NULL AS VARCHAR[]) AS v2, CAST(NULL AS VARCHAR[]) AS v3 FROM r
  UNION ALL
  SELECT conv_id, i, {drop("v0")}, least({drop("v1")}, {keep("v0", "s")}), least({n2}), least({n3})
  FROM {gap("(SELECT s.conv_id, r.i, v0, v1, v2, v3, role, text, ini, x, t FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1)")}),
f AS (SELECT conv_id, least(v0, w3) AS v FROM {gap("(SELECT * FROM s QUALIFY i = max(i) OVER (PARTITION BY conv_id))")}),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(v[1], 1, 6) AS BIGINT), 0) AS cost, coalesce(substr(v[1], 7), '') AS audit, sha256(coalesce(substr(v[2], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP11_SQL = _sql()
