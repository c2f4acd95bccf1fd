"""Operator 11: prefix trie of conversations by a splitter skeleton.

A turn is 24 bytes: a 128-bit digest of role and text, and the words of the text. A conversation is the path of its
turns, so the byte order of paths is the order of a depth-first walk. Paths are dealt to shards by splitter paths
(drawn by hash from the distinct paths, cut at `DEPTH` turns). Splitters are broadcast; together they are the
skeleton: a node that stands in two shards is a prefix of the splitter between them. Each shard is sorted
and walked once, and finishes all nodes that are no prefix of its two splitters. The others give one partial row
a shard, and these are reduced by node and rolled up to their ancestors.

Memory of a walk: one path, and the finished children of open nodes that lie in this shard alone. Broadcasts: fewer
than shards x `DEPTH` nodes of at most 24 x `DEPTH` bytes. Equal paths are packed by task before they move: one
row for each 65,536 ids of a piece of 16 MB, not one for each conversation. One conversation is one path of 24 bytes a
turn in memory. The ids that end in one node pass through one task as a stream, as one hash of all of them in order asks for.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from macropanel.session import cut_lineage

from .common import WORD, land, shard_count, table

TURN = 24  # bytes of a turn
DEPTH = 32  # turns of a splitter
SAMPLE = 16  # drawn paths for each splitter
PIECE = 16_000_000
SLICE = 16  # bits of an id within a slice
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_paths(conversations: DataFrame, *, heads: int = 20, most: int = 4) -> DataFrame:
    """`(conv_id, path)`: each conversation with the first turns of its family's head in place of its own.

    Conversation c takes the first h turns of conversation c - c % heads (all if that has fewer, none if there is none),
    then its own behind its first h; h is crc32 of the decimal c modulo `most`. `heads=1` leaves all as they are.
    Turns are ordered by `turn`, nulls first, equal ones by their digest. A null role or text is empty. Rows
    without `conv_id` are left out. Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 16, "0")
    conv = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id is not null").select(
        conv.alias("conv_id"), (conv - conv % heads).alias("head"), "turn", F.concat(digest, words).alias("key")
    )
    # One exchange: conversations of a family stay together for the join with its head.
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "key"))), lambda t: t["key"])
    own = rows.repartition("head").groupBy("head", "conv_id").agg(turns.alias("turns"))
    first = own.where("conv_id = head").select("head", F.slice("turns", 1, most).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    behind = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    whole = F.concat(F.slice(F.coalesce("shared", F.array().cast("array<string>")), F.lit(1), h), behind)
    return own.join(first, "head", "left").select("conv_id", F.unhex(F.array_join(whole, "")).alias("path"))


def splitters(paths: DataFrame, shards: int) -> list[bytes]:
    """At most `shards` - 1 paths in order that cut the distinct paths into about equal parts."""
    n = paths.agg(F.approx_count_distinct("path")).first()[0]
    share = min(1.0, SAMPLE * shards / max(1, n))
    drawn = paths.where(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.select(F.substring("path", 1, TURN * DEPTH).alias("path")).distinct().limit(2 * SAMPLE * shards)
    found = sorted(bytes(r.path) for r in drawn.collect())
    return sorted({found[i * len(found) // shards] for i in range(1, shards)} - {b""}) if found else []


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TURN
    low, high = 0, most // TURN
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * TURN] == b[: middle * TURN] else (low, middle)
    return low


def _dealt(paths: DataFrame, cuts) -> DataFrame:
    """`(shard, path, slice, ids)`: the ids of equal paths of a task packed together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = cuts.value, defaultdict(list), 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = [(bisect_right(at, p), p, s, np.array(ids, "<i8").tobytes()) for (p, s), ids in held.items()]
            for i in range(0, len(rows), 4096):
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "path", "slice", "ids"])

        for batch in batches:
            for conv, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()):
                held[path, conv >> SLICE].append(conv)
                size += len(path) + 100
                if size > PIECE:
                    yield from packed()
                    held.clear()
                    size = 0
        yield from packed()

    return paths.mapInArrow(run, "shard int, path binary, slice long, ids binary")


class _Node:
    """An open node of a walk. `shared`: other shards may hold it too."""

    __slots__ = ("path", "depth", "shared", "n", "low", "children", "leaves", "saved", "ends", "done")

    def __init__(self, path: bytes, depth: int, shared: bool):
        self.path, self.depth, self.shared = path, depth, shared
        self.n, self.low, self.children, self.leaves, self.saved, self.ends, self.done = 0, None, 0, 0, 0, None, []

    def words(self) -> int:
        end = TURN * self.depth
        return int.from_bytes(self.path[end - 8 : end], "big") if self.depth else 0


_NODES = {
    "path": pa.binary(), "shared": pa.bool_(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}


class _Walk:
    """A walk over one shard's paths in order; `out` holds finished rows as tuples in the order of `_NODES`."""

    def __init__(self, cuts: list[bytes], shard: int):
        self.near = [cuts[i] for i in (shard - 1, shard) if 0 <= i < len(cuts)]
        self.open: list[_Node] = []
        self.out: list[tuple] = []
        self.last = b""

    def path(self, path: bytes, n: int, low: int, ends: str) -> None:
        """The next larger path, in which `n` conversations end, of which `low` is the smallest."""
        shared = max((_common(path, cut) for cut in self.near), default=0)
        if not self.open:
            self.open.append(_Node(path, 0, True))
        else:
            self._close(_common(path, self.last) + 1)
        for depth in range(len(self.open), len(path) // TURN + 1):
            self.open.append(_Node(path, depth, depth <= shared))
        node = self.open[-1]
        node.n, node.low, node.ends = n, low, ends
        self.last = path

    def _close(self, keep: int) -> None:
        """Finish all open nodes but the first `keep`."""
        while len(self.open) > keep:
            node = self.open.pop()
            up = self.open[-1] if self.open else None
            if up:
                up.n += node.n
                up.low = node.low if up.low is None else min(up.low, node.low)
            self.out.extend((None, False, *row[:2], node.low, *row[2:]) for row in node.done)
            if node.shared:
                self.out.append((node.path[: TURN * node.depth], True, node.low, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends))
                continue
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n - 1) * node.words()
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            row = (node.low, node.depth, node.n, node.children, leaves, saved, node.ends or NOTHING)
            if up.shared:  # its smallest member is known after the reduction
                self.out.append((up.path[: TURN * up.depth], False, *row[:2], None, *row[2:]))
            else:
                up.done.append(row)

    def end(self) -> None:
        self._close(0)


def _walked(dealt: DataFrame, cuts, shards: int) -> DataFrame:
    """The nodes that each shard finishes, and its parts of the skeleton's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, shard, path, part, ids = None, None, None, None, []
        n, low, hashed = 0, None, None

        def flush_ids() -> None:
            nonlocal n, low, ids
            if ids:
                all_ids = np.sort(np.concatenate(ids))
                hashed.update((("," if n else "") + ",".join(map(str, all_ids.tolist()))).encode())
                low = int(all_ids[0]) if low is None else low
                n += len(all_ids)
                ids = []

        def flush_path() -> None:
            flush_ids()
            if path is not None:
                walk.path(path, n, low, hashed.hexdigest())

        def rows() -> pa.RecordBatch:
            out, walk.out = walk.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NODES.values())], names=list(_NODES))

        for batch in batches:
            for s, p, k, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "slice", "ids"))):
                if s != shard or p != path:
                    flush_path()
                    if s != shard:
                        if walk:
                            walk.end()
                            yield rows()
                        walk, shard = _Walk(cuts.value, s), s
                    path, part, n, low, hashed = p, k, 0, None, hashlib.sha256()
                elif k != part:
                    flush_ids()
                    part = k
                ids.append(np.frombuffer(packed, "<i8"))
                if len(walk.out) > 10_000:
                    yield rows()
        if walk:
            flush_path()
            walk.end()
            yield rows()

    kind = ", ".join(f"{n} {'binary' if t == pa.binary() else 'boolean' if t == pa.bool_() else 'string' if t == pa.string() else 'long'}" for n, t in _NODES.items())
    by_shard = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "slice")
    return by_shard.mapInArrow(run, kind)


def _skeleton(parts: DataFrame) -> DataFrame:
    """The nodes that several shards may hold, from their parts; `up` is the path of the parent."""
    nodes = cut_lineage(parts.groupBy("path", "depth").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends")
    ))
    words = F.conv(F.hex(F.substring("path", TURN * F.col("depth") - 7, F.lit(8))), 16, 10).cast("long")
    nodes = nodes.withColumn("up", F.when(F.col("depth") > 0, F.substring("path", F.lit(1), TURN * (F.col("depth") - 1))))
    below = nodes.where("depth > 0").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("below"))
    nodes = nodes.join(below, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
    own = (F.col("n_convs") - 1) * F.when(F.col("depth") > 0, words).otherwise(0)
    shares = nodes.select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("depth")), lambda d: F.substring("path", F.lit(1), TURN * d))).alias("path"),
        (F.col("saved_tokens") + own).alias("saved_tokens"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
    )
    rolled = shares.groupBy("path").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    return cut_lineage(nodes.drop("saved_tokens", "n_leaves", "below").join(rolled, "path"))


def prefix_trie(paths: DataFrame, *, shards: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the paths `(conv_id, path)`, the empty one included.

    `conv_id`, the smallest conversation that starts with it; `depth`; `parent_conv_id` (null for the root); `n_convs`;
    `n_children`; `n_leaves`, childless nodes of the subtree; `saved_tokens`, words that need not be read again when
    each node of the subtree is read once; `ends_sha256` of the ids that end here, in order, joined by commas.
    An empty table gives no rows, not even a root.
    """
    spark = paths.sparkSession
    paths = land(paths)
    shards = shards or shard_count(spark)
    cuts = spark.sparkContext.broadcast(splitters(paths, shards))
    walked = land(_walked(_dealt(paths, cuts), cuts, shards))
    skeleton = _skeleton(walked.where("shared"))
    columns = [F.col(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    upper = skeleton.select(F.col("path").alias("up"), F.col("conv_id").alias("of_up"))  # fewer than shards x DEPTH rows
    inner = walked.where("not shared").withColumnRenamed("path", "up").join(F.broadcast(upper), "up", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_up")).select("conv_id", *columns)
    outer = skeleton.join(F.broadcast(upper), "up", "left").withColumn("parent_conv_id", F.col("of_up"))
    outer = outer.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).select("conv_id", *columns)
    return inner.unionByName(outer)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(turn_paths(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, md5(concat(strlen(role), ':', role, text))) as t,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384)), 4294967295) % 4 as h
  from turns group by conv_id),
rebuilt as (
  select o.conv_id, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) as t
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 20),
places as (select conv_id, len(t) as n, d, t[1:d] as p from (select *, unnest(range(0, len(t) + 1)) as d from rebuilt)),
nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256,
    (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) end as saved
  from places group by p, d),
children as (select p[1:d - 1] as p, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all),
whole as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (p, d)),
below as (
  select p[1:k] as p, k as d, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves
  from (select *, unnest(range(0, d + 1)) as k from whole) group by all)
select w.conv_id, w.d::bigint as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, w.ends_sha256
from whole w join below b using (p, d) left join whole u on u.d = w.d - 1 and u.p = w.p[1:w.d - 1]"""
