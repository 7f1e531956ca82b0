"""The prefix trie of conversations, from their sorted order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import checkpoint
from .common import WORD, table
from .crc import short_crc32

#: Bytes that stand for a turn: 16 of a digest of its role and text, and its number of words.
TURN = 20
#: Closed nodes that wait for their parent at most, and rows that are sent on at once.
WAITING, ROWS = 1 << 12, 1 << 13
NODE = (
    "part int, depth int, first long, side string, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, words long, ends string, ids string, "
    "parent_first long, parent_conv long, wanted boolean, turn_key binary, first_key binary, last_key binary"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_key"]


def turn_key(role: Column, text: Column) -> Column:
    """TURN bytes of a turn, as hexadecimal digits; null role and text are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0"))


def turn_lists(conversations: DataFrame, *keys: str) -> DataFrame:
    """(keys, turns): the turn keys of each conversation in the order of (turn, key), null turns first. keys end with conv_id."""
    c = conversations.filter("conv_id is not null").select(*keys, "turn", turn_key(F.col("role"), F.col("text")).alias("d"))
    g = c.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "d"))).alias("t"))
    return g.select(*keys, F.transform("t", lambda x: x["d"]).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key) of (conv_id, turns): the turn keys end to end, whose order as bytes is that of the lists."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join("turns", "")).alias("key"))


@dataclass
class Span:
    """A run of conversations of a block with the same first turns, still open on its right."""

    first: int
    turn: bytes
    n: int = 0
    conv: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    ids: list[int] = field(default_factory=list)
    waiting: list[tuple] = field(default_factory=list)
    wanted: bool = False


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from the start."""
    i, most = 0, min(len(a), len(b))
    while i < most and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


def block_nodes(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    """Rows of NODE for one block of sorted conversations: the Cartesian tree of its common prefix lengths, by one stack.

    The lengths that neighbours have in common close all deeper spans (their next smaller value is
    found) and every depth up to a conversation's own is a span, so equal lengths share one and missing
    depths are made. A span that ends inside the block and does not begin with it is a node of the
    whole trie, with its sums. Others touch an edge of the block: side S begins with it, E ends with it,
    W does both; their sums are those of the nodes inside the block.
    """
    stack: list[Span] = []
    out: list[tuple] = []
    place, before, start = 0, b"", b""

    def close(end: bool = False) -> None:
        s, depth = stack.pop(), len(stack)
        parent = stack[-1] if stack else None
        if parent is not None:
            parent.n += s.n
            parent.conv = s.conv if parent.conv is None else min(parent.conv, s.conv)
        words = int.from_bytes(s.turn[16:], "big")
        edge = s.first == 0 or end
        out.extend((*row, None if edge else s.conv, *rest) for row, rest in s.waiting)
        side = ids = None
        ends, leaves, saved = s.ends, s.leaves, s.saved
        if edge:
            side = "E" if s.first else "W" if end else "S"
            if s.ids:
                ids = _joined(s.ids)
        else:
            ends = _sha(_joined(s.ids)) if s.ids else ends
            leaves, saved = leaves or 1, saved + (s.n - 1) * words
        if parent is not None:
            parent.leaves += leaves
            parent.saved += saved
        row = (part, depth, s.first, side, s.n, s.conv, s.children, leaves, saved, words, ends, ids, parent.first if parent else None)
        rest = (s.wanted, s.turn, start if depth == 0 else None, before if depth == 0 else None)
        if edge or parent.first == 0:
            out.append((*row, None, *rest))  # the parent touches an edge
            return
        parent.waiting.append((row, rest))
        if len(parent.waiting) > WAITING:
            out.extend((*r, None, *x) for r, x in parent.waiting)
            parent.waiting, parent.wanted = [], True

    for conv, key in rows:
        same = common_turns(before, key)
        if not stack:
            stack.append(Span(0, bytes(TURN)))
            start = key
        while len(stack) - 1 > same:
            close()
        for at in range(same * TURN, len(key), TURN):
            top = stack[-1]
            top.children += 1
            if top.first and top.ids:  # longer conversations follow, so all that end here are known
                top.ends, top.ids = _sha(_joined(top.ids)), []
            stack.append(Span(place, key[at : at + TURN]))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ids.append(conv)
        before, place = key, place + 1
        if len(out) >= ROWS:
            yield from out
            out.clear()
    while stack:
        close(True)
    yield from out


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield flush()
            held.clear()
    if held:
        yield flush()


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODE.split(", "))])
    rows = ((c.as_py(), k.as_py()) for b in batches for c, k in zip(b.column(0), b.column(1)))
    yield from _batched(block_nodes(TaskContext.get().partitionId(), rows), schema)


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, chain, ends) of sorted rows (depth, chain, ids): the digest of a chain's ids, read part by part."""
    schema = pa.schema([("depth", pa.int32()), ("chain", pa.int64()), ("ends", pa.string())])

    def rows() -> Iterator[tuple]:
        at, state = None, None
        for b in batches:
            for d, c, ids in zip(*(b.column(i) for i in range(3))):
                here = (d.as_py(), c.as_py())
                if here != at:
                    if at is not None:
                        yield *at, state.hexdigest()
                    at, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if at is not None:
            yield *at, state.hexdigest()

    yield from _batched(rows(), schema)


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lcp = [-1 if p is None else common_turns(p, k) for k, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lcp, pa.int32())], names=["part", "lcp"])


def trie_of(keys: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, key), as RESULT; conv_ids are unique.

    Conversations are dealt by range of (key, conv_id) and sorted, so equal ones of which there are many
    are dealt over tasks, too. Each block gives the nodes that lie inside it and the spans that touch its
    edges, at most as many as its first and last conversation have turns. What two neighbouring
    blocks have in common (the block's minimum at its edge) says which of these go on in the next block:
    at each depth, runs of spans that go on are one node. These few rows are then summed: by block
    and side from the deepest span up, and by node. Nodes inside blocks are moved only if their parent
    touches an edge. The digest of ids that reach over blocks is read part by part in their order.
    """
    deal = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    raw = checkpoint(deal.mapInArrow(_in_blocks, NODE))
    edge = raw.filter("side is not null")
    roots = edge.filter("depth = 0").select("part", "first_key", F.lag("last_key").over(Window.orderBy("part")).alias("prev"))  # a row for each block
    edge = edge.join(roots.mapInArrow(_boundaries, "part int, lcp int"), "part").drop("first_key", "last_key", "parent_conv", "wanted")
    begins = F.col("side") != "E"
    on = begins & (F.col("depth") <= F.col("lcp"))
    edge = edge.withColumns({"new": (~on).cast("long"), "n_children": F.col("n_children") - (begins & (F.col("depth") < F.col("lcp"))).cast("long")})
    edge = checkpoint(edge.withColumn("chain", F.sum("new").over(Window.partitionBy("depth").orderBy("part", "first").rowsBetween(Window.unboundedPreceding, 0))))
    whole = edge.groupBy("depth", "chain").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.max("words").alias("words"), F.max("ends").alias("ends"), F.max("turn_key").alias("turn_key"))
    whole = checkpoint(whole)
    own = edge.drop("n_convs", "conv_id", "n_children", "words", "ends", "turn_key").join(whole, ["depth", "chain"])
    is_new = F.col("new") == 1
    own = own.withColumns({"leaf": (is_new & (F.col("n_children") == 0)).cast("long"), "saving": F.when(is_new, (F.col("n_convs") - 1) * F.col("words")).otherwise(F.lit(0))})
    deeper, block = Window.partitionBy("part", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part")
    below = lambda c: F.sum(c).over(deeper) + F.when(F.col("side") == "W", F.coalesce(F.sum(F.when(F.col("side") != "W", F.col(c))).over(block), F.lit(0))).otherwise(F.lit(0))
    own = own.withColumns({"n_leaves": F.col("n_leaves") + below("leaf"), "saved_tokens": F.col("saved_tokens") + below("saving")})
    place = F.max(F.when(is_new, F.struct("part", "parent_first"))).alias("at")
    sums = own.groupBy("depth", "chain").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), place)
    parts = edge.filter("ids is not null").repartition("depth", "chain").sortWithinPartitions("depth", "chain", "part", "first").select("depth", "chain", "ids")
    digests = parts.mapInArrow(_streamed_digests, "depth int, chain long, ends string").withColumnRenamed("ends", "_ends")
    merged = whole.join(sums, ["depth", "chain"]).join(digests, ["depth", "chain"], "left").withColumn("ends", F.coalesce("_ends", "ends"))
    columns = ["part", "depth", "parent_first", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "turn_key"]
    merged = merged.withColumns({"part": F.col("at.part"), "parent_first": F.col("at.parent_first")}).select(*columns)
    inside = raw.filter("side is null")
    parents = edge.select("part", "depth", "first", "chain").join(whole.select("depth", "chain", "conv_id"), ["depth", "chain"]).select("part", "depth", "first", "conv_id")
    parents = parents.union(inside.filter("wanted").select("part", "depth", "first", "conv_id"))
    parents = parents.select("part", (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent_first"), F.col("conv_id").alias("parent_conv"))
    asking = inside.filter("parent_conv is null").select(*columns).union(merged).join(parents, ["part", "depth", "parent_first"], "left")
    found = inside.filter("parent_conv is not null").select(*columns, "parent_conv").unionByName(asking)
    long = lambda c: F.col(c).cast("long").alias(c)
    ends = F.coalesce("ends", F.lit(_sha(""))).alias("ends_sha256")
    return found.select("conv_id", long("depth"), F.col("parent_conv").alias("parent_conv_id"), *(long(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ends, "turn_key")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text): RESULT, one row for each distinct sequence of first turns.

    conv_id is a node's smallest member, depth its number of turns, 0 for the root, of which all are
    members; saved_tokens are the words that its subtree need not repeat; ends_sha256 is the digest of
    the members that end there; turn_key is the last turn's, by which turn_texts gives its text.

    Turns are ordered by number, null first, ties by their digest; a null role or text is empty; repeated
    rows are turns of their own; rows with a null conv_id belong to no conversation and are left out;
    other columns play no part. Texts are not moved: a turn is TURN bytes, and a conversation's turns
    must fit in a row as such. An empty table has no node.
    """
    return trie_of(sequences(turn_lists(conversations, "conv_id")))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(turn_key, role, text) of all distinct turns."""
    c = conversations.select(F.unhex(turn_key(F.col("role"), F.col("text"))).alias("turn_key"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.dropDuplicates(["turn_key"])


def rebuilt(conversations: DataFrame, family: int = 20, lead: int = 4) -> DataFrame:
    """(conv_id, turns) of conversations that begin like the first of their family of ids.

    Conversation c gets the first h turns of conversation c - c % family, and then its own turns after
    its first h, with h the CRC-32 of c modulo lead. Conversations are dealt by family once.
    """
    c = conversations.withColumn("_family", F.col("conv_id") - F.col("conv_id") % family).repartition("_family")
    t = turn_lists(c, "_family", "conv_id")
    first = F.max(F.when(F.col("conv_id") == F.col("_family"), F.slice("turns", 1, lead))).over(Window.partitionBy("_family"))
    h = (F.crc32(F.col("conv_id").cast("string")) % lead).cast("int")
    t = t.withColumns({"_lead": F.coalesce(first, F.array().cast("array<string>")), "_h": h})
    return t.select("conv_id", F.concat(F.slice("_lead", F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt ``conversations``."""
    return trie_of(sequences(rebuilt(table(spark, sf_dir, "conversations")))).drop("turn_key")


OP13_SQL = rf"""
WITH q AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text)[1:32] || lpad(format('{{:X}}', len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 8, '0') AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM k),
s AS (SELECT conv_id, count(*) AS len FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {short_crc32("conv_id::VARCHAR")} % 4 AS h FROM s),
r AS (SELECT c.conv_id, i AS d, key, words FROM c JOIN t ON t.conv_id = base AND i <= h
  UNION ALL SELECT c.conv_id, least(h, coalesce(s.len, 0)) + i - h, key, words FROM c JOIN t ON t.conv_id = c.conv_id AND i > h LEFT JOIN s ON s.conv_id = base),
p AS (SELECT conv_id, d, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (d = len), '') AS ends FROM p JOIN l USING (conv_id) GROUP BY ALL),
u AS (SELECT d - 1 AS d, path[1:len(path) - 40] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u USING (d, path)),
a AS (SELECT p.d, p.path, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN a USING (d, path) LEFT JOIN n o ON o.d = m.d - 1 AND o.path = m.path[1:len(m.path) - 40]
"""
