"""Operator 5: removal of long passages that an earlier text has, by suffix arrays.

A passage of `least` (50) bytes is looked at as the start of a suffix. All suffixes of all texts would be many
times the input, so they are dealt by content: the smallest hash among the 16-byte strings inside a passage
is the passage's key. Equal passages have equal keys, and neighbouring passages mostly share theirs: such a
stretch of passages is a run, and is handled as one.

1. Each task sends the keys of its runs, once or twice each, to the shards of keys. Shards give back to the
   texts the keys that at least two unlike texts have; keys that already two texts of a task have don't need
   to ask. So most of the input is never sent anywhere.
2. The bytes under the runs that are left are sent to shards of keys, equal bytes of a task once, for the
   smallest id that has them; the task's other texts lose them without asking.
3. A shard keeps a logarithmic family of suffix arrays for one part of its keys after the other (equal passages have
   equal keys), so what it holds besides the runs is that of one part. Runs come in batches by growing id; each batch gets
   the sorted array of its suffixes (cut at `least` bytes), is merged with every level to find the passages that
   they hold already, and becomes a level; levels of like size are merged, and the smaller id stays.
4. Each text learns the smallest id that has each of its passages, and drops the bytes under those that an
   earlier text has.

Equal texts are one text in steps 1 to 3. Nothing is kept in a task but a batch of texts or one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import give_back, mix, raw_texts, shard_count, sliced, table

PIECE = 1_000_000  # bytes of text that are hashed at once
GRAM = 16
BATCH = 200_000  # suffixes of a batch of a shard
PARTS = 32  # of a shard, by key, each with arrays of its own
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one integer."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    raw = data.tobytes()
    for i in range(8):
        part = out[i::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), i)
    return out


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


class Runs:
    """The runs of a few texts: stretches of passages with one key.

    `text`, `start`, `count`, `key`: number of the text, position in the data, number of passages, key
    (48 bits: a key that unlike passages share only costs work).
    """

    def __init__(self, begin: np.ndarray, end: np.ndarray, data: memoryview, least: int):
        low, high = int(begin[0]), int(end[-1])
        self.data = np.frombuffer(data, np.uint8)[low:high]
        begin, end = begin - low, end - low
        self.begin, self.end = begin, end
        n = high - low - least + 1
        if n <= 0:
            self.text = self.start = self.count = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        eights = _eights(self.data)
        key = _smallest(mix(eights[:-8] * _A ^ mix(eights[8:] + _B)), least - GRAM + 1)
        text = np.repeat(np.arange(len(begin)), end - begin)[:n]
        inside = np.arange(n) + least <= end[text]
        first = np.ones(n, bool)
        first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        # Long stretches of one key (one letter repeated) are cut, so that a run's bytes are bounded.
        at = np.flatnonzero(first)
        since = np.arange(n) - np.repeat(at, np.diff(at, append=n))
        first |= since % (4 * least) == 0
        at = np.flatnonzero(first & inside)
        last = np.append(np.flatnonzero(first), n)
        stop = last[np.searchsorted(last, at, side="right")]
        self.text, self.start, self.key = text[at], at, key[at] >> np.uint64(16)
        self.count = np.minimum(stop, end[self.text] - least + 1) - at


def _texts(docs: DataFrame) -> DataFrame:
    """`(doc_id, sum, text)`; `sum` tells unlike texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sum"), text.alias("text"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of ordered columns differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _parts(shard: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return np.split(order, _starts(shard[order])[1:]) if len(order) else []


def _batch(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.values())], names=list(names))


_ASKED = {"shard": pa.int32(), "local": pa.bool_(), "docs": pa.binary(), "rows": pa.binary()}


def _gathered(batches: Iterable[pa.RecordBatch], least: int, most: int = 16_000_000) -> Iterator[tuple]:
    """`(ids, sums, keys, texts)` of up to `most` bytes of text and 65,536 texts, each key of a text once."""
    held: list[list[np.ndarray]] = [[], [], [], []]
    size = n = 0
    for batch in sliced(batches, PIECE):
        if n and (size > most or n + batch.num_rows > 1 << 16):
            yield tuple(map(np.concatenate, held))
            held, size, n = [[], [], [], []], 0, 0
        for at in range(0, batch.num_rows, 1 << 15):
            part = batch.slice(at, 1 << 15)
            if n + part.num_rows > 1 << 16:
                yield tuple(map(np.concatenate, held))
                held, size, n = [[], [], [], []], 0, 0
            begin, end, data = raw_texts(part.column("text"))
            runs = Runs(begin, end, data, least)
            order = np.lexsort((runs.text, runs.key))
            order = order[_starts(runs.key[order], runs.text[order])]
            for to, x in zip(held, (part.column("doc_id").to_numpy(), part.column("sum").to_numpy(), runs.key[order], runs.text[order] + n)):
                to.append(x)
            n += part.num_rows
            size += int(end[-1] - begin[0])
    if n:
        yield tuple(map(np.concatenate, held))


def _ask(docs: DataFrame, shards: int, least: int) -> DataFrame:
    """Step 1, tasks: `docs` packs `(id, sum)`, `rows` packs `key << 16 | number of the pair`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sum_, key, text in _gathered(batches, least):
            own = sum_[text]
            # Ids inside equal sums, so that of equal texts of a task the smallest id asks.
            order = np.lexsort((doc[text], own, key))
            k, s = key[order], own[order]
            at = _starts(k)
            size = np.diff(at, append=len(k))
            unlike = np.zeros(len(k), np.int64)
            unlike[1:] = (k[1:] == k[:-1]) & (s[1:] != s[:-1])
            which = np.cumsum(unlike) - np.repeat(np.cumsum(unlike)[at], size)  # 0 for the first sum of a key, and so on
            shared = np.repeat(np.maximum.reduceat(which, at) > 0, size) if len(at) else np.zeros(0, bool)
            out = [(int(mix(doc[:1].view(np.uint64))[0] % np.uint64(shards)), True, order[shared])] if shared.any() else []
            # One row of each key goes to its shard, or two of unlike texts.
            few = order[np.union1d(at, np.flatnonzero((unlike == 1) & (which == 1)))]
            shard = (mix(key[few]) % np.uint64(shards)).astype(np.int64)
            out += [(int(shard[p[0]]), False, few[p]) for p in _parts(shard)]
            rows = []
            for to, local, pick in out:
                used, number = np.unique(text[pick], return_inverse=True)
                rows.append((to, local, np.stack([doc[used], sum_[used]], axis=1).tobytes(), (key[pick] << np.uint64(16) | number.astype(np.uint64)).tobytes()))
            if rows:
                yield _batch(rows, _ASKED)
        give_back()

    return _texts(docs).where("doc_id is not null").mapInArrow(run, "shard int, local boolean, docs binary, rows binary")


_ANSWER = {"bucket": pa.int32(), "docs": pa.binary(), "sizes": pa.binary(), "data": pa.binary()}
_ANSWER_DDL = "bucket int, docs binary, sizes binary, data binary"


def _by_doc(doc: np.ndarray, sum_: np.ndarray, value: np.ndarray, buckets: int) -> list[tuple]:
    """Rows `_ANSWER`: for texts of one bucket `(id, sum)`, how many values each has, and the values."""
    out = []
    bucket = (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((sum_, doc, bucket))
    for part in np.split(order, _starts(bucket[order])[1:]) if len(order) else []:
        at = _starts(doc[part], sum_[part])
        pairs = np.stack([doc[part][at], sum_[part][at]], axis=1)
        out.append((int(bucket[part[0]]), pairs.astype("<i8").tobytes(), np.diff(at, append=len(part)).astype("<u4").tobytes(), value[part].tobytes()))
    return out


def _unpacked(rows: pa.Table, width: int, name: str) -> pa.Table:
    """`(doc_id, sum, name)` of one bucket, the values of each text packed."""
    docs = np.frombuffer(b"".join(rows["docs"].to_pylist()), "<i8").reshape(-1, 2)
    size = np.frombuffer(b"".join(rows["sizes"].to_pylist()), "<u4").astype(np.int64) * width
    data = b"".join(rows["data"].to_pylist())
    end = np.cumsum(size)
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    at = _starts(docs[order, 0], docs[order, 1])
    values = [b"".join([data[end[i] - size[i] : end[i]] for i in part]) for part in (np.split(order, at[1:]) if len(order) else [])]
    return pa.table({"doc_id": docs[order[at], 0], "sum": docs[order[at], 1], name: pa.array(values, pa.binary())})


def _shared_keys(docs: DataFrame, shards: int, least: int) -> DataFrame:
    """Step 1, shards: `(doc_id, sum, keys)`: the keys of each text that unlike texts have.

    Of equal texts, the one with the smallest id answers for all: in each task the smallest id that has a text
    asks for its keys, so the smallest of all is among those that asked.
    """

    def run(rows: pa.Table) -> pa.Table:
        pairs, keys, number, known, n = [], [], [], [], 0
        for d, r, local in zip(rows["docs"].to_pylist(), rows["rows"].to_pylist(), rows["local"].to_pylist()):
            own, both = np.frombuffer(d, "<i8").reshape(-1, 2), np.frombuffer(r, "<u8")
            pairs.append(own), keys.append(both >> np.uint64(16)), number.append((both & np.uint64(0xFFFF)).astype(np.int64) + n)
            known.append(np.full(len(both), local))
            n += len(own)
        pair, key, number, known = (np.concatenate(x) for x in (pairs, keys, number, known))
        # Ids first, so that of each key and sum the smallest id comes first.
        order = np.lexsort((pair[number, 0], pair[number, 1], key))
        key, number, known = key[order], number[order], known[order]
        doc, sum_ = pair[number, 0], pair[number, 1]
        at = _starts(key)
        shared = np.repeat((np.maximum.reduceat(sum_, at) != np.minimum.reduceat(sum_, at)) | np.logical_or.reduceat(known, at), np.diff(at, append=len(key)))
        first = np.zeros(len(key), bool)
        first[_starts(key, sum_)] = True
        stay = np.flatnonzero(first & shared)
        out = _by_doc(doc[stay], sum_[stay], key[stay].astype("<u8"), shards)
        del pair, key, number, known, order, doc, sum_, shared, first
        give_back()
        return pa.Table.from_batches([_batch(out, _ANSWER)] if out else [], pa.schema(list(_ANSWER.items())))

    answers = _ask(docs, shards, least).groupBy("shard").applyInArrow(run, _ANSWER_DDL)
    return answers.groupBy("bucket").applyInArrow(lambda rows: _unpacked(rows, 8, "keys"), "doc_id long, sum long, keys binary")


_SPAN = np.dtype([("start", "<u4"), ("size", "<u4")])
_HEAD = np.dtype([("doc", "<i8"), ("sum", "<i8"), ("start", "<u4"), ("size", "<u4"), ("part", "u1")])
_SENT = {"shard": pa.int32(), "head": pa.binary(), "bytes": pa.binary(), **{k: v for k, v in _ANSWER.items() if k != "bucket"}}


def _send(texts: DataFrame, shards: int, least: int) -> DataFrame:
    """Step 2: `head` and `bytes` (compressed) of the runs that go to a shard; or, in rows without `head`, spans of
    texts that lose them already, with the bucket as `shard`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, 4 * PIECE):
            begin, end, data = raw_texts(batch.column("text"))
            runs = Runs(begin, end, data, least)
            bounds = np.searchsorted(runs.text, np.arange(batch.num_rows + 1))
            wanted = [np.flatnonzero(np.isin(runs.key[a:b], np.frombuffer(k or b"", "<u8"))) + a for a, b, k in zip(bounds, bounds[1:], batch.column("keys").to_pylist())]
            pick = np.concatenate(wanted)
            if not len(pick):
                continue
            # Rows without an id have no keys: what stands for their id is never used.
            doc, sum_ = pc.fill_null(batch.column("doc_id"), 0).to_numpy(), batch.column("sum").to_numpy()
            text = runs.text[pick]
            pick = pick[np.argsort(doc[text], kind="stable")]
            text = runs.text[pick]
            raw = runs.data.tobytes()
            start, size = runs.start[pick], runs.count[pick] + least - 1
            content = [raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]
            first: dict[bytes, int] = {}
            ids = doc[text].tolist()
            lost = np.fromiter((first.setdefault(c, d) < d for c, d in zip(content, ids)), bool, len(ids))
            inside = start - (runs.begin[text])
            out = []
            go = np.flatnonzero(~lost)
            head = np.zeros(len(go), _HEAD)
            head["doc"], head["sum"], head["start"], head["size"] = doc[text[go]], sum_[text[go]], inside[go], size[go]
            mixed = mix(runs.key[pick[go]])
            shard = (mixed % np.uint64(shards)).astype(np.int64)
            head["part"] = mixed // np.uint64(shards) % np.uint64(PARTS)
            for p in _parts(shard):
                p = p[np.argsort(head["part"][p], kind="stable")]
                out.append((int(shard[p[0]]), squeeze.compress(head[p].tobytes()), squeeze.compress(b"".join([content[i] for i in go[p].tolist()])), None, None, None))
            span = np.zeros(int(lost.sum()), _SPAN)
            span["start"], span["size"] = inside[lost], size[lost]
            out += [(b, None, None, *rest) for b, *rest in _by_doc(doc[text[lost]], sum_[text[lost]], span, shards)]
            yield _batch(out, _SENT)
        give_back()

    return texts.mapInArrow(run, "shard int, head binary, bytes binary, docs binary, sizes binary, data binary")


class Levels:
    """A logarithmic family of suffix arrays: each level has its suffixes in order, with the smallest id of each."""

    def __init__(self, least: int):
        self.kind = f"S{least}"
        self.least = least
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def suffixes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The suffixes at positions `at`, cut at the passage length."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.least)[at]).view(self.kind).ravel()

    def add(self, suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Add a batch whose ids are not below those of earlier batches; the smallest id of each of its suffixes."""
        order = np.argsort(suffix, kind="stable")
        ordered = suffix[order]
        at = _starts(ordered)
        size = np.diff(at, append=len(ordered))
        unlike, first = ordered[at], np.minimum.reduceat(doc[order], at)
        new = np.ones(len(unlike), bool)
        for have, earlier in self.levels:  # merge-scan
            place = np.minimum(np.searchsorted(have, unlike), len(have) - 1)
            hit = np.flatnonzero(have[place] == unlike)
            first[hit] = np.minimum(first[hit], earlier[place[hit]])
            new[hit] = False
        level = (unlike[new], first[new])
        while len(level[0]) and self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = self._merged(self.levels.pop(), level)
        if len(level[0]):
            self.levels.append(level)
        out = np.empty(len(suffix), np.int64)
        out[order] = np.repeat(first, size)
        return out

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two levels as one; no suffix is in both."""
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def _fed(head: np.ndarray, count: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, Levels]]:
    """Batches of runs by growing id, one part of the keys after the other, with the arrays of their part."""
    for own in _parts(head["part"]):
        family = Levels(least)
        order = own[np.argsort(head["doc"][own], kind="stable")]
        for batch in np.split(order, _starts(np.cumsum(count[order]) // BATCH)[1:]):
            yield batch, family


def _spans(sent: DataFrame, least: int, buckets: int) -> DataFrame:
    """Step 3: `(doc_id, sum, spans)`: the stretches of each text that earlier texts have."""

    def run(rows: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        known = rows.filter(pc.is_null(rows["head"])).select(["shard", "docs", "sizes", "data"])
        known = [tuple(r.values()) for r in known.to_pylist()]
        rows = rows.filter(pc.is_valid(rows["head"]))
        if not rows.num_rows:
            return pa.Table.from_batches([_batch(known, _ANSWER)])
        head = np.concatenate([np.frombuffer(expand.decompress(h), _HEAD) for h in rows["head"].to_pylist()])
        data = np.frombuffer(b"".join([expand.decompress(b) for b in rows["bytes"].to_pylist()]), np.uint8)
        size = head["size"].astype(np.int64)
        start = np.cumsum(size) - size
        count = size - least + 1
        found = []
        for part, family in _fed(head, count, least):
            n = count[part]
            to = np.cumsum(n)
            inside = np.arange(int(to[-1])) - np.repeat(to - n, n)
            doc = np.repeat(head["doc"][part], n)
            lost = np.flatnonzero(family.add(family.suffixes(data, np.repeat(start[part], n) + inside), doc) < doc)
            run_of = np.repeat(np.arange(len(part)), n)[lost]
            at = _starts(run_of, lost - np.arange(len(lost)))  # stretches of neighbouring passages
            if len(at):
                last = np.append(at[1:], len(lost)) - 1
                span = np.zeros(len(at), _SPAN)
                mine = head[part[run_of[at]]]
                span["start"] = mine["start"] + inside[lost[at]]
                span["size"] = inside[lost[last]] - inside[lost[at]] + least
                found.append((mine["doc"], mine["sum"], span))
        out = known + (_by_doc(*(np.concatenate(x) for x in zip(*found)), buckets) if found else [])
        del data, head, found
        give_back()
        return pa.Table.from_batches([_batch(out, _ANSWER)] if out else [], pa.schema(list(_ANSWER.items())))

    return sent.groupBy("shard").applyInArrow(run, _ANSWER_DDL).groupBy("bucket").applyInArrow(lambda rows: _unpacked(rows, 8, "spans"), "doc_id long, sum long, spans binary")


def _copies(docs: DataFrame) -> DataFrame:
    """`(doc_id, sum)` of texts that a smaller id has as a whole."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sum"), F.xxhash64(F.lit(1), text).alias("more")).where("doc_id is not null")
    first = rows.groupBy("sum", "more").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return rows.join(first, ["sum", "more"]).where("doc_id > first").select("doc_id", "sum")


def drop_repeated_passages(docs: DataFrame, *, least: int = 50, texts: bool = False) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` (with `texts` the remaining bytes as `kept`) of every row.

    Null texts are empty. Rows without an id neither lose bytes nor take any from others. Rows that
    repeat an id don't take from each other. `least` is at least 17. An empty table gives no rows. Other
    columns are not looked at.
    """
    shards, few = shard_count(docs.sparkSession, docs), shard_count(docs.sparkSession, docs, 4)
    keys = _shared_keys(docs, few, least)
    rows = _texts(docs)  # both joins take the same side, so Spark moves the texts once
    with_keys = rows.join(keys, ["doc_id", "sum"], "left")
    spans = _spans(_send(with_keys, shards, least), least, few)
    marks = spans.withColumn("whole", F.lit(False)).unionByName(_copies(docs).select("doc_id", "sum", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole")))
    marks = marks.groupBy("doc_id", "sum").agg(F.collect_list("spans").alias("spans"), F.bool_or("whole").alias("whole"))
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    names |= {"kept": pa.binary()} if texts else {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8 * PIECE):
            begin, end, data = raw_texts(batch.column("text"))
            out = []
            for doc, a, b, packed, whole in zip(batch.column("doc_id").to_pylist(), begin, end, batch.column("spans").to_pylist(), batch.column("whole").to_pylist()):
                text, n = bytes(data[a:b]), int(b - a)
                removed = spans_ = 0
                if whole and n >= least:
                    text, removed, spans_ = b"", n, 1
                elif packed:
                    span = np.frombuffer(b"".join(packed), _SPAN)
                    span = span[np.argsort(span["start"])]
                    low, high = span["start"].astype(np.int64), np.maximum.accumulate(span["start"].astype(np.int64) + span["size"])
                    at = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                    low, high = low[at], high[np.append(at[1:], len(high)) - 1]
                    removed, spans_ = int((high - low).sum()), len(low)
                    text = b"".join([text[x:y] for x, y in zip([0, *high.tolist()], [*low.tolist(), n])])
                out.append((doc, n, removed, spans_, hashlib.sha256(text).hexdigest(), text)[: len(names)])
            yield _batch(out, names)
        give_back()

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.join(marks, ["doc_id", "sum"], "left").mapInArrow(run, ddl)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"), least=50)


OP5_SQL = r"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
places as (select doc_id, h, unnest(range(0, len(h) // 2)) as p from texts),
passages as (select doc_id, p, substr(h, 2 * p + 1, 2) as byte, case when 2 * p + 100 <= len(h) then hash(substr(h, 2 * p + 1, 100)) end as w from places),
first as (select w, min(doc_id) as low from passages where w is not null group by w),
judged as (select doc_id, p, byte, coalesce(low < doc_id, false) as hit from passages left join first using (w)),
covered as (select doc_id, p, byte, bool_or(hit) over (partition by doc_id order by p rows between 49 preceding and current row) as gone from judged),
ends as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as begins from covered),
counted as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_spans,
  string_agg(byte, '' order by p) filter (not gone) as kept from ends group by doc_id)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256 from texts left join counted using (doc_id)"""
