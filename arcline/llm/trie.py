"""Prefix trie of conversations by union-find over sorted neighbours.

Turns become symbols (md5 of role and text), conversations strings of symbols. The distinct strings are sorted
over range partitions. In a partition the edges between neighbours, each as deep as their longest common prefix,
are taken in descending depth: every merge of two components is a branching node, and the component's own path
down to that depth is a chain of nodes. A node that reaches over a partition's border is left open: only these
contracted nodes of all forests meet again, summed by their key, and each counts as new in the partition where
it starts.

A string holds at most ``BAND`` turns. Longer conversations go on in further bands: their strings belong to the
sub-trie of the prefix before, so no row grows with a conversation, and what lies in deeper bands is added to
the nodes above along the path of one member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, broadcast_if_small, settled
from .turns import crc, crc_sql, numbered

#: Turns of one sorted string.
BAND = 256
#: Length of a symbol, and bytes of strings in one partition.
SYMBOL, PARTITION_BYTES = 32, 16 << 20

ITEM = "p int, b long, r1 long, r2 long, syms string, ws array<long>, n long, conv {kind}, ext boolean, left int, right int"
NODE = "k1 long, k2 long, depth long, conv {kind}, n long, kids long, leaves long, saved long, w long, open boolean, parent {kind}, pk1 long, pk2 long"


def _halves(digest: str) -> tuple[int, int]:
    return int(digest[:15], 16), int(digest[15:30], 16)


def key_columns(band: Column, syms: Column) -> tuple[Column, Column]:
    """Both halves of a band's hash, as ``_halves`` makes them; the key of a prefix is these of all its bands, xor-ed."""
    digest = F.md5(F.concat(band.cast("string"), F.lit(":"), syms))
    half = lambda at: F.when(syms == "", 0).otherwise(F.conv(F.substring(digest, at, 15), 16, 10).cast("long"))
    return half(1), half(16)


def common(a: str, b: str) -> int:
    """Symbols of the longest common prefix."""
    low, high = 0, min(len(a), len(b)) // SYMBOL
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * SYMBOL] == b[: mid * SYMBOL]:
            low = mid
        else:
            high = mid - 1
    return low


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


def forest(items: list[tuple], left: int, right: int, band: int = BAND) -> list[list]:
    """Nodes of one partition's sorted (b, r1, r2, syms, ws, n, conv, ext); ``left`` and ``right``: depth shared with the neighbours.

    Rows are as NODE, the parent as its place in the list. Sums of open nodes hold this partition's part.
    """
    m, out = len(items), []
    head, depth, lo, hi = list(range(m)), [len(x[4]) for x in items], list(range(m)), list(range(m))
    n, conv = [x[5] for x in items], [x[6] for x in items]
    kids, leaves, saved, hang = [0] * m, [0] * m, [0] * m, [[] for _ in items]

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    def node(a: int, key: tuple, deep: int, w: int, opened: bool) -> None:
        for r in hang[a]:
            out[r][10] = len(out)
        hang[a] = [len(out)]
        out.append([*key, deep, conv[a], n[a], kids[a], leaves[a], saved[a], w, opened, None])

    def lift(a: int, d: int) -> None:
        """The nodes of component ``a`` below depth ``d``; it stands at ``d`` afterwards."""
        if depth[a] <= d:
            return
        b, r1, r2, syms, ws, _, _, ext = items[lo[a]]
        digest, keys = hashlib.md5(f"{b}:{syms[: d * SYMBOL]}".encode()), []
        for t in range(d, depth[a]):
            digest.update(syms[t * SYMBOL : (t + 1) * SYMBOL].encode())
            x, y = _halves(digest.hexdigest())
            keys.append((r1 ^ x, r2 ^ y))
        for t in range(depth[a], d, -1):
            before, after, on = lo[a] == 0 and t <= left, hi[a] == m - 1 and t <= right, t == band and ext
            if lo[a] == hi[a] and t == depth[a] == len(ws) and not (before or after or on):
                leaves[a] = 1
            saved[a] += (n[a] - (not before)) * ws[t - 1]
            node(a, keys[t - d - 1], b * band + t, ws[t - 1], before or after or on)
            kids[a] = 0 if before else 1
        depth[a] = d

    same = [items[i][:3] == items[i - 1][:3] for i in range(1, m)]
    edges = [(-common(items[i - 1][3], items[i][3]), i) for i in range(1, m) if same[i - 1]]
    for d, i in sorted(edges):
        a, b = find(i - 1), find(i)
        lift(a, -d)
        lift(b, -d)
        if hi[a] - lo[a] < hi[b] - lo[b]:
            a, b = b, a
        head[b] = a
        n[a], kids[a], leaves[a], saved[a] = n[a] + n[b], kids[a] + kids[b], leaves[a] + leaves[b], saved[a] + saved[b]
        conv[a], lo[a], hi[a] = least(conv[a], conv[b]), min(lo[a], lo[b]), max(hi[a], hi[b])
        hang[a] += hang[b]
        hang[b] = []
    for a in range(m):
        if head[a] == a:
            lift(a, 0)
            b, r1, r2 = items[lo[a]][:3]
            if b:  # the node itself belongs to the band above: only its children are told here
                n[a], conv[a], leaves[a], saved[a] = 0, None, 0, 0
            node(a, (r1, r2), b * band, 0, True)
    return out


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _grown(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    kind = None

    def seen():
        nonlocal kind
        for b in batches:
            kind = b.schema.field("conv").type
            yield from zip(*(c.to_pylist() for c in b.columns))

    for _, part in groupby(seen(), lambda r: r[0]):
        part = list(part)
        nodes = forest([r[1:9] for r in part], part[0][9], part[0][10], band)
        for r in nodes:
            up = None if r[10] is None else nodes[r[10]]
            r[10:] = [None, None, None] if up is None else [None, up[0], up[1]] if up[9] else [up[3], None, None]
        longs = ["k1", "k2", "depth", "n", "kids", "leaves", "saved", "w", "pk1", "pk2"]
        names = [x.strip().split(" ")[0] for x in NODE.split(",")]
        schema = pa.schema([(x, pa.int64() if x in longs else pa.bool_() if x == "open" else kind) for x in names])
        for at in range(0, len(nodes), 10_000):
            yield _batch(nodes[at : at + 10_000], schema)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, left, right): depth shared with the neighbouring partitions, -1 where they hold another sub-trie."""
    deep = lambda x, y: -1 if x is None or y is None or [x[c] for c in ("b", "r1", "r2")] != [y[c] for c in ("b", "r1", "r2")] else common(x["syms"], y["syms"])
    for b in batches:
        rows = b.to_pylist()
        yield pa.RecordBatch.from_pydict({"p": pa.array([r["p"] for r in rows], pa.int32()), "left": pa.array([deep(r["before"], r["lo"]) for r in rows], pa.int32()),
                                          "right": pa.array([deep(r["hi"], r["after"]) for r in rows], pa.int32())})


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key in order; only one hash is held."""
    at, digest = None, None
    done = lambda: pa.RecordBatch.from_pydict({"k1": pa.array([at[0]], pa.int64()), "k2": pa.array([at[1]], pa.int64()), "sha": [digest.hexdigest()]})
    for b in batches:
        for k1, k2, c in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "conv"))):
            if at != (k1, k2):
                if at is not None:
                    yield done()
                at, digest = (k1, k2), hashlib.sha256()
                digest.update(str(c).encode())
            else:
                digest.update(f",{c}".encode())
    if at is not None:
        yield done()


def prefix_trie(turns: DataFrame, convs: DataFrame, band: int = BAND, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, place from 0, role, text) of all ``convs`` (conv_id, distinct).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Conversations without turns are members of the root. A null conv_id is a conversation like any
    other and counts as larger than all others; its decimal is ``None``. Null roles and texts are empty. No
    conversations give no nodes. Equal conversations are members of the same nodes; other columns are not looked at.
    """
    kind = convs.schema["conv_id"].dataType.simpleString()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = turns.select(F.col("conv_id").alias("conv"), F.col("place").cast("long").alias("place"),
                     F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("sym"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    bands = t.groupBy("conv", F.floor(F.col("place") / band).alias("b")).agg(F.array_sort(F.collect_list(F.struct("place", "sym", "w"))).alias("l"))
    bands = bands.select("conv", "b", F.array_join("l.sym", "").alias("syms"), F.col("l.w").alias("ws"))
    some = bands.filter("b = 0").select(F.col("conv").alias("_c"))
    none = convs.join(some, convs["conv_id"].eqNullSafe(some["_c"]), "left_anti").select(F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("b"), F.lit("").alias("syms"), F.array().cast("array<long>").alias("ws"))
    h1, h2 = key_columns(F.col("b"), F.col("syms"))
    by = W.partitionBy("conv").orderBy("b")
    ahead = by.rowsBetween(W.unboundedPreceding, -1)
    bands = bands.unionByName(none).withColumns({"h1": h1, "h2": h2})
    bands = bands.withColumns({"r1": F.coalesce(F.bit_xor("h1").over(ahead), F.lit(0).cast("long")), "r2": F.coalesce(F.bit_xor("h2").over(ahead), F.lit(0).cast("long")), "goes": F.lead("b").over(by).isNotNull()})
    bands = settled(bands)

    # distinct strings, sorted over range partitions
    items = bands.groupBy("b", "r1", "r2", "syms").agg(F.first("ws").alias("ws"), F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("goes").alias("ext"))
    volume, deepest = bands.agg(F.sum(F.length("syms") + 64), F.max("b")).first()
    parts = max(2 * turns.sparkSession.sparkContext.defaultParallelism if (volume or 0) > partition_bytes else 1, -(-(volume or 0) // partition_bytes))
    order = ["b", "r1", "r2", "syms"]
    items = settled(items.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()))
    item = F.struct(*order)
    across = W.orderBy("p")  # one row for each partition
    borders = items.groupBy("p").agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
    borders = borders.withColumns({"before": F.lag("hi").over(across), "after": F.lead("lo").over(across)}).mapInArrow(_borders, "p int, left int, right int")
    names = [x.strip().split(" ")[0] for x in ITEM.replace("{kind}", "").split(",")]
    rows = items.join(F.broadcast(borders), "p").select(*names)
    grown = settled(rows.repartition("p").sortWithinPartitions("p", *order).mapInArrow(lambda batches: _grown(batches, band), NODE.format(kind=kind)))

    # open nodes meet across partitions and bands
    met = grown.filter("open").groupBy("k1", "k2").agg(F.max("depth").alias("depth"), F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")],
                                                        *[F.max(c).alias(c) for c in ("w", "parent", "pk1", "pk2")])
    met = settled(met)
    nodes = grown.filter("not open").drop("open").unionByName(met)
    up = met.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("up"))
    nodes = nodes.join(broadcast_if_small(up), (F.col("pk1") == F.col("u1")) & (F.col("pk2") == F.col("u2")), "left").withColumn("parent", F.coalesce("parent", "up")).drop("u1", "u2", "up")
    if deepest:
        nodes = _with_deeper(nodes, bands, band)
    # conversations that end at a node
    ends = bands.filter("not goes").select((F.col("r1").bitwiseXOR(F.col("h1"))).alias("k1"), (F.col("r2").bitwiseXOR(F.col("h2"))).alias("k2"), "conv")
    ends = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("conv").asc_nulls_last()).mapInArrow(_end_digests, "k1 long, k2 long, sha string")
    nodes = nodes.join(ends, ["k1", "k2"], "left")
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _with_deeper(nodes: DataFrame, bands: DataFrame, band: int) -> DataFrame:
    """Leaves and savings of deeper bands, added along the path of the member that a deeper node is named after."""
    nodes = settled(nodes)
    own = nodes.filter(F.col("depth") > band).groupBy(F.col("conv").alias("c"), F.floor((F.col("depth") - 1) / band).alias("at"))
    own = own.agg(F.sum((F.col("n") - 1) * F.col("w")).alias("s"), F.count_if(F.col("kids") == 0).alias("l"))
    below = W.partitionBy("conv").orderBy("b").rowsBetween(1, W.unboundedFollowing)
    long = bands.join(own, bands["conv"].eqNullSafe(own["c"]) & (bands["b"] == own["at"]), "left").withColumns({"s": F.sum("s").over(below), "l": F.sum("l").over(below)})
    long = long.filter("s > 0 or l > 0")
    at = F.explode(F.sequence(F.when(F.col("b") == 0, 0).otherwise(1), F.size("ws"))).alias("t")
    paths = long.select("b", "r1", "r2", "syms", "s", "l", at).withColumn("syms", F.expr(f"substring(syms, 1, t * {SYMBOL})"))
    h1, h2 = key_columns(F.col("b"), F.col("syms"))
    more = paths.select(F.col("r1").bitwiseXOR(h1).alias("k1"), F.col("r2").bitwiseXOR(h2).alias("k2"), "s", "l").groupBy("k1", "k2").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    nodes = nodes.join(more, ["k1", "k2"], "left")
    return nodes.withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))}).drop("s", "l")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that share their beginning: the first h turns of conversation c - c % 20, then the own turns after the first h.

    h is the checksum of the id modulo 4; a null conversation keeps its own turns.
    """
    t = numbered(turns)
    h = F.coalesce(crc(F.col("conv_id").cast("string")) % 4, F.lit(0))
    base = F.col("conv_id") - F.col("conv_id") % 20
    convs = t.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base"))
    first = t.filter("place < 3").select(F.col("conv_id").alias("base"), "place", "role", "text")
    lead = convs.join(first, "base").filter("place < h").select("conv_id", "place", "role", "text")
    taken = lead.groupBy("conv_id").agg(F.count("*").alias("taken"))
    own = t.withColumn("h", h).filter("place >= h").join(taken, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("place"), "role", "text")
    return lead.unionByName(own)


def op13_prefix_trie(spark, sf_dir: str, **settings: int) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return prefix_trie(settled(rebuilt(turns)), turns.select("conv_id").distinct(), **settings)


OP13_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT c.conv_id, 0 AS own, t.place, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d FROM r),
p AS (SELECT conv_id, d, list(struct_pack(r := role, x := text)) OVER (PARTITION BY conv_id ORDER BY d) AS k, len(regexp_extract_all(text, '{WORD}')) AS w FROM s
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
last AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
under AS (SELECT p.d, p.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.d, p.k),
ends AS (SELECT p.d, p.k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN last USING (conv_id, d) GROUP BY p.d, p.k)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(under.n_leaves AS BIGINT) AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM f JOIN under USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN n up ON up.d = f.d - 1 AND up.k = f.k[1:f.d - 1] AND f.d > 0
"""
