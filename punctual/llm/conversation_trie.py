"""The prefix trie of rebuilt conversations, by a skeleton of splitter paths.

A turn is a digest of its role and text, a conversation the sequence of its digests: its path. Paths are cut
into parts by sampled splitters, as sorted by path and conversation. A node of the trie whose conversations
stand in more than one part is a beginning of a splitter, so the trie of the splitters (the
skeleton, of bounded size, known to every task) has all such nodes. Every other node is finished in its part by
one walk over the sorted paths; of the skeleton's nodes a part gives what it knows of them, these
sums meet in one row a node, and a fold over the skeleton alone ends it.

The hash of the conversations that end at a node of the skeleton takes them in order, as SHA-256 can't be
put together from parts: their sorted ids pass through one task as text, in pieces.

Conversations: turns are ordered by turn (null first), then by role and text, so ties and repeated rows have one order
and each counts. Null roles and texts are empty. Rows without a conv_id belong to no conversation and take no part.
A table without conversations has no node. Texts of any length go into the digest whole and travel
no further. Other columns aren't read. One conversation is one row of 24 bytes a turn, which Spark holds up to some
80 million turns; its texts aren't gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import NOT_SPACE, ship, written
from punctual.llm.ranges import parts_for, shard_of, splitters

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of a splitter at most, which bounds the skeleton; a longer one is cut, and then ends before its conversations.
SPLITTER_TURNS = 1024
#: Rebuilding: conversations of one block begin with the first turns of its first one.
BLOCK = 20
HEADS = 4
#: Conversations of a part.
PER_PART = 50_000
#: Ids in a piece of a hash.
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

WALKED = "node int, conv_id long, depth long, parent int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, shard int, piece int, ids string"
NAMES = [x.split()[0] for x in WALKED.split(", ")]
KINDS = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in WALKED.split(", ")]


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, keys (digests of its turns in order) and words (of each turn's text) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    clean = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), 1, WIDTH)
    each = clean.select("conv_id", place.alias("place"), digest.alias("key"), F.regexp_count("text", F.lit(f"{NOT_SPACE}+")).alias("words"))
    gathered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "words"))).alias("t"))
    return gathered.select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, path (the digests one after another) and words of every conversation as it is rebuilt.

    The first h turns are those of the first conversation of its block, h being crc32 of its id modulo HEADS; then
    its own turns after its first h.
    """
    own = written(turns(rows), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    first = own.where(F.col("conv_id") == block).select(F.col("conv_id").alias("block"), F.slice("keys", 1, HEADS - 1).alias("first_keys"), F.slice("words", 1, HEADS - 1).alias("first_words"))
    both = own.withColumns({"h": h, "block": block}).join(first, "block", "left")

    def joined(head: str, tail: str, kind: str) -> Column:
        heads = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(kind))
        rest = F.when(F.size(tail) > F.col("h"), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail) - F.col("h"), F.lit(1)))).otherwise(F.array().cast(kind))
        return F.concat(heads, rest)

    keys = joined("first_keys", "keys", "array<binary>")
    path = F.unhex(F.array_join(F.transform(keys, F.hex), ""))
    return both.select("conv_id", F.coalesce(path, F.lit(b"")).alias("path"), joined("first_words", "words", "array<int>").alias("words"))


class Skeleton:
    """The trie of the splitters: node 0 is the root; `child` gives the node below a node by digest."""

    def __init__(self, cuts: list[tuple]):
        self.cuts, self.child, self.parent, self.depth = cuts, {}, [-1], [0]
        for path, _ in cuts:
            at = 0
            for s in range(0, len(path), WIDTH):
                key = (at, path[s : s + WIDTH])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]


class Node:
    __slots__ = ("bone", "children", "conv", "ends", "held", "hash", "key", "leaves", "n", "pieces", "saved", "words")

    def __init__(self, key: bytes, words: int, bone: int):
        self.key, self.words, self.bone = key, words, bone
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.hash, self.pieces = [], None, 0
        self.held: list[tuple] = []  # its children's rows, until its own conv_id is known


def _walk(batches: Iterator[pa.RecordBatch], skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    """Over rows (shard, path, conv_id, words) sorted by these: rows of finished nodes (node is null), what the part
    knows of the skeleton's (node set), and pieces of the latter's ids (ids set)."""
    out: list[tuple] = []
    stack: list[Node] = []
    shard = None

    def flush(x: Node) -> None:
        if x.ends:
            text = ",".join(map(str, x.ends))
            if x.bone >= 0:
                out.append((x.bone, *[None] * 10, shard, x.pieces, text))
                x.pieces += 1
            elif x.hash is None:
                x.hash = hashlib.sha256(text.encode())
            else:
                x.hash.update(b"," + text.encode())
            x.ends = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            flush(x)
            d, above = len(stack), stack[-1] if stack else None
            if above:
                above.n += x.n
                above.conv = x.conv if above.conv is None else min(above.conv, x.conv)
            if x.bone >= 0:  # the skeleton's own children are counted with the skeleton
                out.append((x.bone, x.conv, d, *[None] * 2, x.n, x.children, x.leaves, x.saved, None, x.words, shard, None, None))
            else:
                x.leaves += x.children == 0
                x.saved += (x.n - 1) * x.words
                above.children += 1
                above.leaves += x.leaves
                above.saved += x.saved
                row = (None, x.conv, d, above.bone if above.bone >= 0 else None, None, x.n, x.children, x.leaves, x.saved, x.hash.hexdigest() if x.hash else NO_ENDS, *[None] * 4)
                (out if above.bone >= 0 else above.held).append(row)
                out.extend((*r[:4], x.conv, *r[5:]) for r in x.held)

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

    for b in batches:
        for s, path, conv, words in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")), strict=True):
            if s != shard:
                close(0)
                shard = s
                stack.append(Node(b"", 0, 0))
            keys = [path[i : i + WIDTH] for i in range(0, len(path), WIDTH)]
            same = 0
            while same < len(keys) and same + 1 < len(stack) and stack[same + 1].key == keys[same]:
                same += 1
            close(same + 1)
            for d in range(same, len(keys)):
                bone = skeleton.child.get((stack[-1].bone, keys[d]), -1) if stack[-1].bone >= 0 else -1
                stack.append(Node(keys[d], words[d], bone))
            top = stack[-1]
            top.n += 1
            top.conv = conv if top.conv is None else min(top.conv, conv)
            top.ends.append(conv)
            if len(top.ends) >= PIECE:
                flush(top)
            if len(out) > 10_000:
                yield batch()
    close(0)
    if out:
        yield batch()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, from pieces sorted by node, part and piece."""
    node = digest = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends"])

    for b in batches:
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n != node:
                if node is not None:
                    yield row()
                node, digest = n, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield row()


def trie(paths: DataFrame, *, per_part: int = PER_PART) -> DataFrame:
    """Every node of the trie of rows (conv_id, path, words); see the module."""
    spark = paths.sparkSession
    ship(spark)
    parts = parts_for(paths.count(), per_part, spark)
    short = paths.withColumns({"path": F.substring("path", 1, WIDTH * SPLITTER_TURNS), "conv_id": F.when(F.length("path") <= WIDTH * SPLITTER_TURNS, F.col("conv_id"))})
    # a splitter that was cut has no id and comes before all that begin with it
    cuts = splitters(short.select("path", "conv_id"), ["path", "conv_id"], parts, lambda r: (bytes(r[0]), -(1 << 63) if r[1] is None else r[1]))
    skeleton = Skeleton(cuts)

    @F.arrow_udf("int")
    def shard(path: pa.Array, conv: pa.Array) -> pa.Array:
        return pa.array([shard_of(x, cuts) for x in zip(path.to_pylist(), conv.to_pylist(), strict=True)], pa.int32())

    dealt = paths.withColumn("shard", shard("path", "conv_id")).repartitionById(len(cuts) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "path", "conv_id").select("shard", "path", "conv_id", "words")
    found = written(ordered.mapInArrow(lambda b: _walk(b, skeleton), WALKED), "nodes")

    pieces = found.where("ids is not null").select("node", "shard", "piece", "ids")
    ends = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").mapInArrow(_hashes, "node int, ends string")
    known = found.where("node is not null and ids is null").groupBy("node").agg(
        F.min("conv_id").alias("conv"), F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    got = {r["node"]: r.asDict() for r in known.collect()}  # at most as many rows as the skeleton has nodes
    none = {"conv": None, "words": 0, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0}
    rows = [none | got.get(k, {}) for k in range(len(skeleton.parent))]
    for k in reversed(range(len(rows))):  # children have larger numbers than their parents
        x, above = rows[k], skeleton.parent[k]
        x["n_leaves"] += x["n_children"] == 0
        if k:
            x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
            rows[above]["n_children"] += 1
            rows[above]["n_leaves"] += x["n_leaves"]
            rows[above]["saved_tokens"] += x["saved_tokens"]
    if not rows[0]["n_convs"]:
        rows = []
    told = [(k, x["conv"], skeleton.depth[k], rows[skeleton.parent[k]]["conv"] if k else None, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]) for k, x in enumerate(rows)]
    columns = "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    bones = spark.createDataFrame(told, columns)
    top = bones.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
    above = F.broadcast(bones.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    rest = found.where("node is null").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return top.select(*shown).unionAll(rest.select(*shown))


def conversation_trie(rows: DataFrame, *, per_part: int = PER_PART) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of rebuilt conversations."""
    ship(rows.sparkSession)
    return trie(written(rebuilt(rows), "paths"), per_part=per_part)


#: The same in SQL, with every path written out.
SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(i))),
h AS (SELECT c, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::bigint)), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 4 AS h FROM ids, tab),
r AS (SELECT h.c, 0 AS part, p, role, text FROM h JOIN t ON t.c = h.b AND p <= h UNION ALL SELECT h.c, 1, p, role, text FROM h JOIN t ON t.c = h.c AND p > h),
k AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
path AS (SELECT c, d, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS node, w FROM k UNION ALL SELECT c, 0, '', 0 FROM ids),
deep AS (SELECT c, max(d) AS deepest FROM path GROUP BY c),
nodes AS (SELECT node, d, min(c) AS conv, count(*) AS n, max(w) AS w, string_agg(c::varchar, ',' ORDER BY c) FILTER (d = deepest) AS ends FROM path JOIN deep USING (c) GROUP BY node, d),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
pairs AS (SELECT DISTINCT a.node AS top, b.node AS node FROM path a JOIN path b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top AS node, sum((n - 1) * w)::bigint AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM pairs JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT x.conv AS conv_id, x.d AS depth, a.conv AS parent_conv_id, x.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes a ON x.d > 0 AND a.node = left(x.node, length(x.node) - 32)
"""
