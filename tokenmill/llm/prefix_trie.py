"""The trie of conversation prefixes, by range-partitioned sorted paths and a skeleton of splitters.

A conversation is a path: the 128-bit digests of its (role, text) turns, one
after the other.  Paths are range-partitioned and sorted with their ids, so
the members of a node are neighbours.  A node spans shards only if it lies on
a splitter path: it is a prefix of the last path of one shard and of the first
of the next.  How deep each splitter path is shared goes to all shards (two
numbers a shard).  A shard walks its sorted paths once, with the nodes of the
current path open, and finishes all nodes of its own; of a skeleton node it
gives a partial aggregate.  The partials of a node are summed by a shuffle on
its key, and the skeleton (at most a path per shard) is folded bottom-up.  The
digest of a skeleton node's ids is streamed over pieces that its shards have
joined already, in order, so a group of copies of any size is held nowhere.

Texts stay where they are read; only digests and byte counts (24 bytes a turn)
are moved.  The one thing held whole is a single conversation's path.

Defined results: rows with a null id take no part; a null turn comes first,
rows of the same turn are ordered by their digest (repeated rows count); a
null role or text is empty; a conversation without turns belongs to the root
alone; an empty table has no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.common import cut, table
from tokenmill.llm.registry import query

UNIT = 16
SHARD_BYTES = 32 << 20
CHUNK_IDS = 4096
OUT_ROWS = 8192
BROADCAST_NODES = 1 << 20

_NODE = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),  # 0 finished, 1 partial of a skeleton node, 2 ids of a skeleton node
        T.StructField("key", T.BinaryType()),
        T.StructField("parent_key", T.BinaryType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("parent_conv_id", T.LongType()),
        T.StructField("n_convs", T.LongType()),
        T.StructField("n_children", T.LongType()),
        T.StructField("n_leaves", T.LongType()),
        T.StructField("saved_tokens", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("ends", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("chunk", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string()),
        ("shard", pa.int32()), ("chunk", pa.int64()),
    ]
)


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order, as (turn, digest, text bytes)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    each = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt_turns(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its group.

    ``h = crc32(id) % most`` turns of conversation ``id - id % group`` (fewer if
    it has fewer) come before the conversation's own turns after its first ``h``.
    """
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    )
    joined = own.join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: the digests of all turns as one binary value, and the texts' bytes."""
    hexed = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    return convs.select("conv_id", F.unhex(hexed).alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """How many whole turns two paths have in common at their start."""
    n = min(len(a), len(b)) // UNIT
    if a[: n * UNIT] == b[: n * UNIT]:
        return n
    low, high = 0, n  # the first ``low`` are equal, the first ``high`` are not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * UNIT : mid * UNIT] == b[low * UNIT : mid * UNIT]:
            low = mid
        else:
            high = mid
    return low


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * UNIT]).digest()


class _Open:
    """A node on the current path."""

    __slots__ = ("depth", "key", "skeleton", "bytes", "least", "members", "children", "leaves", "saved", "ends", "waiting", "ids")

    def __init__(self, depth: int, size: int, skeleton: bool):
        self.depth, self.bytes, self.skeleton = depth, size, skeleton
        self.key = None
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting, self.ids = None, [], []


class ShardWalk:
    """One walk over a shard's sorted paths; ``left`` and ``right`` are the depths that its ends share with its neighbours."""

    def __init__(self, shard: int, left: int, right: int, last_path: bytes):
        self.shard, self.left, self.right, self.last = shard, left, right, last_path
        self.stack: list[_Open] = []
        self.path, self.out, self.chunk = b"", [], 0

    def _skeleton(self, path: bytes, depth: int, first: bool) -> bool:
        if first and depth <= self.left:
            return True
        return depth <= self.right and path[: depth * UNIT] == self.last[: depth * UNIT]

    def _flush_ids(self, node: _Open) -> None:
        if node.ids:
            joined = ",".join(node.ids)
            self.out.append((2, node.key, None, None, node.depth, None, 0, 0, 0, 0, 0, joined, self.shard, self.chunk))
            self.chunk += 1
            node.ids = []

    def _close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.members += node.members
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if node.skeleton:
            self._flush_ids(node)
            up = parent.key if parent is not None else None
            self.out.append(
                (1, node.key, up, node.least, node.depth, None, node.members, node.children, node.leaves, node.saved,
                 node.bytes, None, self.shard, 0)
            )
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.bytes
        ends = (node.ends or hashlib.sha256()).hexdigest()
        row = [0, None, None, node.least, node.depth, None, node.members, node.children, leaves, saved, 0, ends, self.shard, 0]
        for child in node.waiting:
            child[5] = node.least
            self.out.append(child)
        if parent is None:
            self.out.append(row)
            return
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        if parent.skeleton:
            row[2] = parent.key
            self.out.append(row)
        else:
            parent.waiting.append(row)

    def add(self, path: bytes, conv: int, sizes) -> None:
        first = not self.stack
        if first:
            root = _Open(0, 0, self._skeleton(path, 0, True))
            root.key = _key(b"", 0) if root.skeleton else None
            self.stack.append(root)
        depth = len(path) // UNIT
        same = shared(self.path, path)
        while len(self.stack) - 1 > same:
            self._close()
        for d in range(len(self.stack), depth + 1):
            node = _Open(d, sizes[d - 1], self.stack[-1].skeleton and self._skeleton(path, d, first))
            if node.skeleton:
                node.key = _key(path, d)
            self.stack.append(node)
        self.path = path
        node = self.stack[-1]
        node.members += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.skeleton:
            node.ids.append(str(conv))
            if len(node.ids) >= CHUNK_IDS:
                self._flush_ids(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(b",%d" % conv)

    def end(self) -> None:
        while self.stack:
            self._close()


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _splitters(sorted_paths: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each shard that holds rows, the depths that its first and its last path share with its neighbours.

    Only numbers reach the driver: neighbours meet in a join on the shard.
    """
    ends = cut(
        sorted_paths.groupBy("shard").agg(
            F.min("path").alias("first_path"), F.max("path").alias("last_path")
        )
    )
    held = sorted(r.shard for r in ends.select("shard").collect())
    after = dict(zip(held, held[1:]))
    links = ends.sparkSession.createDataFrame(list(after.items()), "shard int, at int")  # at most a row per shard
    met = (
        ends.select(F.col("shard").alias("at"), F.lit(0).alias("side"), F.col("first_path").alias("path"))
        .unionByName(
            ends.join(F.broadcast(links), "shard").select("at", F.lit(1).alias("side"), F.col("last_path").alias("path"))
        )
    )

    def depth(key, rows):
        by = dict(zip(rows.column("side").to_pylist(), rows.column("path").to_pylist()))
        n = shared(by[0], by[1]) if len(by) == 2 else -1
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64())})

    left = {r["at"]: r["n"] for r in met.groupBy("at").applyInArrow(depth, "at int, n bigint").collect()}
    return {s: (left.get(s, -1), left.get(after.get(s), -1)) for s in held}


def _fold(rows):
    """Skeleton nodes, reduced by key, with what their skeleton descendants add; deepest first."""
    nodes = {r["key"]: r for r in rows.to_pylist()}
    kept = []
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        leaves = r["n_leaves"] if r["n_children"] else 1
        saved = r["saved_tokens"] + (r["n_convs"] - 1) * r["bytes"]
        r["n_leaves"], r["saved_tokens"] = leaves, saved
        parent = nodes.get(r["parent_key"])
        r["parent_conv_id"] = parent["conv_id"] if parent is not None else None
        if parent is not None:
            parent["n_children"] += 1
            parent["n_leaves"] += leaves
            parent["saved_tokens"] += saved
        kept.append(r)
    names = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    types = [pa.binary()] + [pa.int64()] * 7
    return pa.table({n: pa.array([r[n] for r in kept], t) for n, t in zip(names, types)})


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each key; pieces arrive sorted by key and place, across batches."""
    key, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    yield done()
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if key is not None:
        yield done()


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """``convs``: (conv_id, turns) as of ``conversation_turns``; one row per node.

    ``shards`` is the number of range partitions (by default the session's
    parallelism, or as many as hold the paths at ``SHARD_BYTES`` each).
    """
    spark = convs.sparkSession
    rows = cut(paths(convs))
    if shards is None:
        size = rows.agg(F.sum(F.length("path") + 4 * F.size("sizes") + 16)).first()[0] or 0
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    placed = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    placed = cut(placed.withColumn("shard", F.spark_partition_id()))
    shares = _splitters(placed)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard's last path is needed from its start; a shard holds 24 bytes a turn, some SHARD_BYTES in all
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = held[0].column("shard")[0].as_py()
        left, right = shares[shard]
        walker = ShardWalk(shard, left, right, held[-1].column("path")[-1].as_py())
        for batch in held:
            for path, conv, sizes in zip(
                batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("sizes").to_pylist()
            ):
                walker.add(path, conv, sizes)
                if len(walker.out) >= OUT_ROWS:
                    yield _batch(walker.out)
                    walker.out = []
        walker.end()
        if walker.out:
            yield _batch(walker.out)

    found = cut(placed.mapInArrow(walk, _NODE))
    partial = found.where("kind = 1").groupBy("key", "parent_key", "depth", "bytes").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    schema = "key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    skeleton = cut(partial.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fold, schema))
    pieces = found.where("kind = 2").select("key", "shard", "chunk", "ends")
    digests = (
        pieces.repartition("key").sortWithinPartitions("key", "shard", "chunk").select("key", "ends")
        .mapInArrow(_stream_digests, "key binary, ends_sha256 string")
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    spanning = skeleton.join(digests, "key", "left").select(*names, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    tops = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    if skeleton.count() <= BROADCAST_NODES:  # at most a path per shard, but paths may be very long
        tops = F.broadcast(tops)
    local = (
        found.where("kind = 0").join(tops, "parent_key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        .select(*names, F.col("ends").alias("ends_sha256"))
    )
    return spanning.unionByName(local)


def rebuilt_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(conversation_turns(table(spark, sf_dir, "conversations"))))


_ORACLE = """
with recursive bits(i, k, v) as (
  select i, 0, i::bigint from range(256) r(i)
  union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as t from bits where k = 8),
own as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       order by turn nulls first, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
  from conversations where conv_id is not null group by conv_id),
short as (
  select conv_id, turns,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h
  from own, crc),
rebuilt as (
  select s.conv_id, coalesce(b.turns, [])[1:s.h] || s.turns[s.h + 1:] as turns
  from short s left join own b on b.conv_id = s.conv_id - s.conv_id % 5),
prefixes as (
  select conv_id, len(turns) as n, d, turns[1:d] as node, case when d > 0 then strlen(turns[d].t) else 0 end as size,
    case when d > 0 then turns[1:d - 1] end as above
  from (select *, unnest(range(len(turns) + 1)) as d from rebuilt)),
nodes as (
  select node, d as depth, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256
  from prefixes group by node, d),
ids as (
  select n.*, p.conv_id as parent_conv_id, coalesce(c.n_children, 0) as n_children
  from nodes n left join nodes p on p.node = n.above
  left join (select above, count(*) as n_children from nodes where above is not null group by above) c on c.above = n.node),
sums as (
  select top, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * size)::bigint as saved_tokens
  from (select n_children, n_convs, size, node[1:unnest(range(depth + 1))] as top from ids) group by top)
select i.conv_id, i.depth::bigint as depth, i.parent_conv_id, i.n_convs, i.n_children, s.n_leaves, s.saved_tokens, i.ends_sha256
from ids i join sums s on s.top = i.node
"""


@query("op12_prefix_trie", _ORACLE)
def op12_prefix_trie(spark, sf_dir):
    return rebuilt_trie(spark, sf_dir)
