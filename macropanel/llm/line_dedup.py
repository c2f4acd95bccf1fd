"""Operator 8: line dedup with sharded cuckoo filters over exact reference counts.

The state is one row of each shard of line keys: all keys with the number of documents that hold
them, the keys that have reached the threshold, and a cuckoo filter of those. Inserting or deleting
documents sends `(key, +1)` or `(key, -1)`, summed within each task, to the shards; a key that passes
the threshold in either direction is put into the filter or taken out. Deleting what was inserted
gives the former state back.

Texts are probed in blocks: a block asks once for each of its keys, so a line that many texts share does not
make its shard larger than others. What the filter lets pass is compared with the exact keys; the block's
table, written to the shared folder, tells which of its texts have the keys found.
Keys are 128-bit hashes of the stripped, lower-cased line.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACE, keyed_texts, land, mix, shard_count, sliced, table, texts_of

PIECE = 16_000_000
STATE = "shard int, keys binary, counts binary, repeated binary, filter binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key is in one of two buckets or in the exact overflow."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, 4), buckets a power of two; 0: free

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, n) / 4 / 0.8))))
        return cls(np.zeros((buckets, 4), np.uint16))

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        last = np.uint64(len(self.slots) - 1)
        one = h & last
        return mark, one.astype(np.int64), (one ^ (mix(mark.astype(np.uint64)) & last)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._at(keys)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if one found no place: the caller then builds a larger filter."""
        last = len(self.slots) - 1
        for mark, one, two in zip(*(x.tolist() for x in self._at(keys))):
            place = one if 0 in self.slots[one] else two
            for kick in range(500):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = mark
                    break
                out = kick & 3
                mark, self.slots[place, out] = int(self.slots[place, out]), mark
                place ^= int(mix(np.array([mark], np.uint64))[0]) & last
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self._at(keys))):
            for place in (one, two):
                hit = np.flatnonzero(self.slots[place] == mark)
                if len(hit):
                    self.slots[place, hit[0]] = 0
                    break


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where it has fewer than `min_chars` code points."""
    digest = xxhash.xxh3_128_digest
    if min_chars <= 1:
        return [digest(k) if (k := line.strip(SPACE).lower()) else None for line in text.split(b"\n")]
    keys = (line.strip(SPACE).lower() for line in text.split(b"\n"))
    return [digest(k) if len(k.decode()) >= min_chars else None for k in keys]


def _pairs(keys: bytes | list[bytes]) -> np.ndarray:
    """Keys as two big-endian halves, so that rows sort as the bytes do."""
    data = keys if isinstance(keys, bytes) else b"".join(keys)
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)


def _packed(pairs: np.ndarray) -> bytes:
    return pairs.astype(">u8").tobytes()


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), part


def _deltas(docs: DataFrame, sign: int, shards: int, min_chars: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, PIECE):
            count: Counter[bytes] = Counter()
            for text in texts_of(batch):
                count.update({k for k in line_keys(text, min_chars) if k})
            if not count:
                continue
            pairs = _pairs(list(count))
            n = np.fromiter(count.values(), np.int64, len(count)) * sign
            rows = [(s, _packed(pairs[i]), n[i].astype("<i8").tobytes()) for s, i in _by_shard(pairs[:, 0] % np.uint64(shards))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

    return keyed_texts(docs).select("text").mapInArrow(run, "shard int, keys binary, counts binary")


def _total(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    pairs, n = _pairs(keys), np.frombuffer(b"".join(counts), "<i8")
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, n = pairs[order], n[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return pairs[at], np.add.reduceat(n, at) if len(at) else n


def _find(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which rows of `keys` stand in `among`, whose rows are in order and distinct."""
    def pack(pairs: np.ndarray) -> np.ndarray:
        return np.frombuffer(_packed(pairs), "S16")

    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    have, want = pack(among), pack(keys)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return have[at] == want


def _apply(state: pa.Table, deltas: pa.Table, min_docs: int) -> pa.Table:
    """A shard's state after its deltas."""
    pairs, n = _total([*state["keys"].to_pylist(), *deltas["keys"].to_pylist()], [*state["counts"].to_pylist(), *deltas["counts"].to_pylist()])
    live = n > 0
    pairs, n = pairs[live], n[live]
    now = pairs[n >= min_docs]
    before = _pairs(state["repeated"].to_pylist())
    packed = state["filter"][0].as_py() if state.num_rows else b""
    filter = CuckooFilter(np.frombuffer(packed, np.uint16).reshape(-1, 4).copy()) if packed else CuckooFilter.sized(len(now))
    filter.delete(before[~_find(before, now), 1])
    if len(now) > 3.6 * len(filter.slots) or not filter.insert(now[~_find(now, before), 1]):
        size = 2 * len(filter.slots)
        while True:
            filter = CuckooFilter(np.zeros((max(size, len(CuckooFilter.sized(len(now)).slots)), 4), np.uint16))
            if filter.insert(now[:, 1]):
                break
            size *= 2
    shard = (state if state.num_rows else deltas)["shard"].to_pylist()[:1]
    return pa.table({
        "shard": pa.array(shard, pa.int32()), "keys": pa.array([_packed(pairs)], pa.binary()),
        "counts": pa.array([n.astype("<i8").tobytes()], pa.binary()), "repeated": pa.array([_packed(now)], pa.binary()),
        "filter": pa.array([filter.slots.tobytes()], pa.binary()),
    })


def insert(docs: DataFrame, shards: int, state: DataFrame | None = None, *, min_docs: int = 10, min_chars: int = 1, sign: int = 1) -> DataFrame:
    """The state after the documents of `docs` came in (`sign` 1) or went (-1).

    The number of shards, `min_docs` and `min_chars` belong to the state: give the same each time.
    """
    deltas = _deltas(docs, sign, shards, min_chars)
    if state is None:
        empty = pa.table({n: pa.array([], t) for n, t in (("shard", pa.int32()), *((c, pa.binary()) for c in ("keys", "counts", "repeated", "filter")))})
        return deltas.groupBy("shard").applyInArrow(lambda rows: _apply(empty, rows, min_docs), STATE)
    return state.groupBy("shard").cogroup(deltas.groupBy("shard")).applyInArrow(lambda old, new: _apply(old, new, min_docs), STATE)


def delete(docs: DataFrame, shards: int, state: DataFrame, *, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The state after documents that were inserted before are taken out again."""
    return insert(docs, shards, state, min_docs=min_docs, min_chars=min_chars, sign=-1)


_BLOCK = {"block": pa.int64(), "rows": pa.binary(), "counts": pa.binary(), "at": pa.binary(), "keys": pa.binary()}


def _blocks(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row of each block of texts: its distinct keys, and where they stand among them for each text.

    `rows` packs the texts' row keys, `counts` how many keys each has, `at` their places in `keys`. Only the
    table that this is written to may be read further: a block's number holds for that one run.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for nth, batch in enumerate(sliced(batches, PIECE)):
            place: dict[bytes, int] = {}
            at, counts = [], []
            for text in texts_of(batch):
                own = {k for k in line_keys(text, min_chars) if k}
                at.append(np.fromiter((place.setdefault(k, len(place)) for k in own), "<u4", len(own)))
                counts.append(len(own))
            if place:
                rows = np.array(batch.column("row_key").to_pylist(), "<i8")
                one = (first + nth, rows.tobytes(), np.array(counts, "<u4").tobytes(), np.concatenate(at).tobytes(), b"".join(place))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(one, _BLOCK.values())], names=list(_BLOCK))

    return keyed_texts(docs).select("row_key", "text").mapInArrow(run, "block long, rows binary, counts binary, at binary, keys binary")


def _asked(blocks: DataFrame, shards: int) -> DataFrame:
    """`(shard, block, keys)`: each block asks once for a key, however many of its texts have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist()):
                pairs = _pairs(keys)
                out = [(s, block, _packed(pairs[i])) for s, i in _by_shard(pairs[:, 0] % np.uint64(shards))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["shard", "block", "keys"])

    return blocks.select("block", "keys").mapInArrow(run, "shard int, block long, keys binary")


def _answered(asked: DataFrame, state: DataFrame) -> DataFrame:
    """`(block, found)`: the repeated ones of the keys asked for, by shard."""

    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        blocks, found = [], []
        if held.num_rows:
            repeated = _pairs(held["repeated"][0].as_py())
            filter = CuckooFilter(np.frombuffer(held["filter"][0].as_py(), np.uint16).reshape(-1, 4))
            for block, key in zip(asks["block"].to_pylist(), asks["keys"].to_pylist()):
                pairs = _pairs(key)
                maybe = pairs[filter.holds(pairs[:, 1])]
                hit = maybe[_find(maybe, repeated)]
                if len(hit):
                    blocks.append(block)
                    found.append(_packed(hit))
        return pa.table({"block": pa.array(blocks, pa.int64()), "found": pa.array(found, pa.binary())})

    slim = state.select("shard", "repeated", "filter")
    return asked.groupBy("shard").cogroup(slim.groupBy("shard")).applyInArrow(run, "block long, found binary")


def _hits(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """`(row_key, keys)`: the repeated keys of each text that has some."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, keys = [], []
        if blocks.num_rows and answers.num_rows:
            block = {c: blocks[c][0].as_py() for c in ("rows", "counts", "at", "keys")}
            pairs, at = _pairs(block["keys"]), np.frombuffer(block["at"], "<u4")
            found = _pairs(answers["found"].to_pylist())
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            hit = _find(pairs, found)[at]
            text = np.repeat(np.arange(len(block["rows"]) // 8), np.frombuffer(block["counts"], "<u4"))[hit]
            row = np.frombuffer(block["rows"], "<i8")
            for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1):
                if len(part):
                    rows.append(int(row[text[part[0]]]))
                    keys.append(_packed(pairs[at[hit][part]]))
        return pa.table({"row_key": pa.array(rows, pa.int64()), "keys": pa.array(keys, pa.binary())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "row_key long, keys binary")


def drop_repeated_lines(docs: DataFrame, state: DataFrame, shards: int, *, min_chars: int = 1, texts: bool = False) -> DataFrame:
    """`doc_id, n_lines, n_dropped, kept_sha256` (and with `texts` the rest as `kept_text`) of every row.

    Null and empty texts are one empty line, which is never dropped. Rows without an id and
    rows that repeat one are documents of their own. An empty table gives no rows.
    """
    blocks = land(_blocks(docs, min_chars))
    # Rows of one key are of one text, so they have the same keys.
    found = _hits(blocks, _answered(_asked(blocks, shards), state)).groupBy("row_key").agg(F.first("keys").alias("keys"))
    rows = keyed_texts(docs).join(found, "row_key", "left").select("doc_id", "text", "keys")
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept_text"] * texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, PIECE):
            out = []
            for doc, text, packed in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("keys").to_pylist()):
                n, kept, dropped = text.count(b"\n") + 1, text, 0
                if packed:
                    drop = {packed[i : i + 16] for i in range(0, len(packed), 16)}
                    stay = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars)) if key not in drop]
                    kept, dropped = b"\n".join(stay), n - len(stay)
                out.append((doc, n, dropped, hashlib.sha256(kept).hexdigest(), kept.decode())[: len(names)])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = shard_count(spark, docs)
    return drop_repeated_lines(docs, insert(docs, shards, min_docs=10, min_chars=1), shards, min_chars=1)


OP8_SQL = r"""
with lines as (
  select doc_id, u.line, u.nr, lower_key.key from documents,
    lateral (select unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nr) u,
    lateral (select translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key) lower_key),
repeated as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(r.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by nr) filter (where r.key is null), '')) as kept_sha256
from lines l left join repeated r on l.key = r.key group by doc_id"""
