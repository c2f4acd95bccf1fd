"""Operator 3: n-gram Jaccard join.

A text's set are its distinct word n-grams (64-bit hashes). Texts of equal sets become one class. The
n-grams of a class are put in one order for all: rare first, by counts in a table of fixed size (counts of
hash buckets over all texts), then by hash. Two sets that reach the similarity share one of their first
n - ceil(t n) + 1 n-grams, so classes are joined on these; a pair then has to pass the length filter, the
positional filter (what can stand before and behind the shared prefix n-gram), the suffix filter (what the
counts of 128 partitions of both sets allow), and is verified once on the texts. A pair moves the text of one side; the
other side's text comes once for `PARTNERS` pairs.

A prefix n-gram that many classes share would give the square of their number. So the classes of an n-gram
are first only compared with pivots, in rounds, one pair each. What is linked is one component, within which no pair
is looked at again (the first pivot of a round is the class with most shared prefix n-grams, others are drawn by hash);
what is left after the rounds is compared in full between components, in blocks
inside tasks. There pairs are verified as well, on the texts of the classes that have a partner left, and a task gives
back a forest of what is linked, so no list of pairs is ever made. The rounds only need to know some of what is connected
(one step of the components' rounds); the components themselves are found once, at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from macropanel.session import cut_lineage

from .common import Bloom, gathered, give_back, land, mix, shard_count, sliced, table, task_count, texts_of
from .components import connected_components, forest, roots

PIECE = 1_000_000
BITS = 20  # of the table of counts
PART = 1 << 16
PARTITIONS = 128  # of the suffix filter
REMEMBERED = 200_000
PAIRS = 200_000  # pairs that a task looks at together
PARTNERS = 512  # pairs of one class that are verified in one place
VERIFIED = 4096  # pairs that a task verifies
PIVOTS = (1, 2, 2)  # of an n-gram, in each round
BLOCK = 512  # classes of one n-gram that are compared with others at once
ROWS = 100_000  # classes of n-grams with one lead that go to one shard
MEMBERS = 1_000_000  # of sets that are looked up together
TESTED = 4_000_000  # pairs that a shard remembers
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, width: int, words: Words) -> np.ndarray:
    """The distinct n-gram hashes in order; with fewer words than `width` one for all; none without words."""
    split = text.lower().split()  # bytes: A-Z, and the six white-space characters
    n = len(split)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, n)
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out * _PRIME + h[j : n - width + 1 + j])
    return np.unique(out)


def bucket_levels(docs: DataFrame, width: int) -> np.ndarray:
    """For each hash bucket a level that grows with the number of texts whose n-grams fall into it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(1 << BITS, np.int64)
        for batch in sliced(batches, PIECE):
            found = [shingles(t, width, words) for t in texts_of(batch)]
            np.add.at(total, (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), 1)
        for at, part in enumerate(np.split(total, (1 << BITS) // PART)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.astype("<u4" if part.max() < 2**32 else "<i8").tobytes()], pa.binary())], names=["part", "counts"])
        words.clear()
        give_back()

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for c in rows["counts"].to_pylist():
            total += np.frombuffer(c, "<u4" if len(c) == 4 * PART else "<i8").astype(np.int64)
        return pa.table({"part": rows["part"].slice(0, 1), "counts": pa.array([np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8).tobytes()], pa.binary())})

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    kind = "part int, counts binary"
    levels = np.zeros(((1 << BITS) // PART, PART), np.uint8)
    for r in texts.mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect():  # 1 MB
        levels[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return levels.ravel()


def _least_overlap(both: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest intersection of two sets with `both` members together that reaches num / den."""
    return -(-both * num // (num + den))


def _sets(docs: DataFrame, width: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """`(doc_id, n, digest, prefix, parts)` of every row; a text without n-grams has n 0 and a null digest."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level = Words(), shared.value
        for batch in sliced(batches, PIECE):
            sizes, digest, prefix, parts = [], [], [], []
            for text in texts_of(batch):
                own = shingles(text, width, words)
                n = len(own)
                sizes.append(n)
                if not n:
                    digest.append(None), prefix.append(None), parts.append(None)
                    continue
                digest.append(hashlib.md5(own.tobytes()).digest())
                first = n - -(-n * num // den) + 1
                order = np.lexsort((own, level[(own >> np.uint64(64 - BITS)).astype(np.int64)]))[:first]
                prefix.append(own[order].tobytes())
                parts.append(np.minimum(np.bincount((own & np.uint64(PARTITIONS - 1)).astype(np.int64), minlength=PARTITIONS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, prefix, parts))],
                names=["doc_id", "n", "digest", "prefix", "parts"],
            )
        words.clear()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, prefix binary, parts binary")


_PACKED = {"shard": pa.int32(), "local": pa.bool_(), "nodes": pa.binary(), "grams": pa.binary(), "places": pa.binary()}
_FAR = (1 << 15) - 1  # a place at or behind this one is not known
_TOLD = 1 << 15  # marks a row that only tells its shard that the gram is shared


def _shared_grams(classes: DataFrame, shards: int) -> DataFrame:
    """`(gram, cid, n, place)`: the prefix n-grams that two classes or more have, and their place in each prefix.

    A gram goes to its shard once for each task, however many of the task's classes have it; if two have
    it, that row only tells, and the classes' rows pass through shards dealt by task. So no shard grows
    with the number of classes that a gram has.
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1 << 16) for b in batches for at in range(0, b.num_rows, 1 << 16)):
            prefix = batch.column("prefix").to_pylist()
            size = np.fromiter((len(p) // 8 for p in prefix), np.int64, len(prefix))
            gram = np.frombuffer(b"".join(prefix), "<u8")
            own = np.repeat(np.arange(len(size), dtype=np.int32), size)
            place = np.minimum(np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size), _FAR).astype(np.uint16)
            order = np.argsort(gram, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(gram[order]) != 0)) if len(order) else order
            count = np.diff(first, append=len(order))
            nth = np.arange(len(order)) - np.repeat(first, count)
            node = np.stack([batch.column("cid").to_numpy(), batch.column("n").to_numpy()], axis=1)
            several = np.repeat(count > 1, count)
            known, some = order[several], order[nth == 0]
            told = np.zeros(len(gram), np.uint16)
            told[order[several]] = _TOLD
            shard = (mix(gram[some]) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            parts = [(int(shard[p[0]]), False, some[p]) for p in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1) if len(p)]
            if len(known):
                parts.append((int(mix(node[:1, 0].astype(np.int64).view(np.uint64))[0] % np.uint64(shards)), True, known))
            rows = []
            for to, local, pick in parts:
                used, number = np.unique(own[pick], return_inverse=True)
                places = np.stack([number, place[pick] | (0 if local else told[pick])], axis=1).astype("<u2")
                rows.append((to, local, node[used].astype("<i8").tobytes(), gram[pick].tobytes(), places.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.values())], names=list(_PACKED))
        give_back()

    def keep(rows: pa.Table) -> pa.Table:
        nodes, grams, numbers, places, known, n = [], [], [], [], [], 0
        for own, gram, place, local in zip(*(rows[c].to_pylist() for c in ("nodes", "grams", "places", "local"))):
            node, at = np.frombuffer(own, "<i8").reshape(-1, 2), np.frombuffer(place, "<u2").reshape(-1, 2).astype(np.int64)
            nodes.append(node), grams.append(np.frombuffer(gram, "<u8"))
            numbers.append(at[:, 0] + n), places.append(at[:, 1]), known.append(np.full(len(at), local))
            n += len(node)
        node, gram, number, place, known = (np.concatenate(x) for x in (nodes, grams, numbers, places, known))
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(gram[order]) != 0))
        count = np.diff(first, append=len(order))
        told = (place & _TOLD) > 0
        shared = np.logical_or.reduceat(told[order], first) | (count > 1)
        stay = known.copy()
        stay[order[np.repeat(shared, count)]] = True
        stay &= ~told
        return pa.table({"gram": gram[stay].view(np.int64), "cid": node[number[stay], 0], "n": node[number[stay], 1], "place": place[stay]})

    packed = classes.select("cid", "n", "prefix").mapInArrow(send, "shard int, local boolean, nodes binary, grams binary, places binary")
    return packed.groupBy("shard").applyInArrow(keep, "gram long, cid long, n long, place long")


def _may_reach(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Length and positional filter of two sets that share the n-grams at these places of their prefixes."""
    most = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    enough = (most * (num + den) >= (n1 + n2) * num) | (F.greatest(p1, p2) >= _FAR)
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & enough


def _parts_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTITIONS)


def _passes(a: dict, b: dict, num: int, den: int) -> np.ndarray:
    """Length and suffix filter of aligned pairs."""
    na, nb = a["n"], b["n"]
    ok = (na * den >= nb * num) & (nb * den >= na * num)
    at = np.flatnonzero(ok)
    apart = np.abs(a["parts"][at].astype(np.int16) - b["parts"][at]).sum(axis=1)
    both = na[at] + nb[at]
    ok[at] = both - apart >= 2 * _least_overlap(both, num, den)
    return ok


_PAIR = "a long, b long, na long, nb long"


def _filtered(pairs: DataFrame, classes: DataFrame, num: int, den: int, rows: int) -> DataFrame:
    """The pairs `(a, b)` that pass the suffix filter, and their ids `na` and `nb`. `rows` is the larger of the numbers
    of pairs and classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [{"n": batch.column(f"n{s}").to_numpy(), "parts": _parts_matrix(batch.column(f"parts{s}"))} for s in ("_a", "_b")]
            at = pa.array(np.flatnonzero(_passes(*side, num, den)))
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    def side(s: str) -> DataFrame:
        return classes.select(F.col("cid").alias(s), F.col("node").alias(f"n{s}"), F.col("n").alias(f"n_{s}"), F.col("parts").alias(f"parts_{s}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").coalesce(task_count(rows)).mapInArrow(run, _PAIR)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int, count: int) -> DataFrame:
    """The `count` pairs whose texts reach the similarity. An id may have several texts: one of them has to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group, own = Words(), None, {}
        for batch in sliced(batches, PIECE):
            hits = []
            for at, (a, salt, b, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), texts_of(batch))):
                if (a, salt) != group:
                    group, own = (a, salt), {}
                this = shingles(text, width, words)
                if b is None:  # a text of the class that the rows behind it are compared with
                    own[hashlib.md5(this.tobytes()).digest()] = this
                    continue
                for other in own.values():
                    if not len(other) or not len(this):
                        continue
                    place = np.minimum(np.searchsorted(other, this), len(other) - 1)
                    common = int((other[place] == this).sum())
                    if common * den >= num * (len(other) + len(this) - common):
                        hits.append(at)
                        break
            if hits:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hits)) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])
        words.clear()
        give_back()

    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "na", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", "nb")
    right = dealt.join(texts.withColumnRenamed("doc_id", "nb"), "nb").select("a", "salt", "b", "na", "nb", "text")
    left = dealt.select("a", "na", "salt").distinct().join(texts.withColumnRenamed("doc_id", "na"), "na")
    none = F.lit(None).cast("long")
    both = left.select("a", "salt", none.alias("b"), "na", none.alias("nb"), "text").unionByName(right)
    return both.repartition("a", "salt").sortWithinPartitions("a", "salt", "b").coalesce(task_count(count, VERIFIED)).mapInArrow(run, _PAIR)


class Blocks:
    """The classes of some n-grams of `_between`, as pairs that share one.

    Rows of a group (n-gram and two blocks) stand together, those of its low block first, so that each row's
    partners are a stretch behind it. `cid` is by row; `member` numbers the classes, whose ids are `cids`.
    """

    def __init__(self, rows: pa.Table):
        gram, low, high, own = (rows[c].to_numpy() for c in ("gram", "low", "high", "own"))
        self.order = order = np.lexsort((own, high, low, gram))
        self.component, self.n, self.place = (rows[c].to_numpy()[order] for c in ("component", "n", "place"))
        self.cids, self.member = np.unique(rows["cid"].to_numpy()[order], return_inverse=True)
        self.parts = _parts_matrix(rows["parts"])[order]
        gram, low, high, own = (x[order] for x in (gram, low, high, own))
        self.at = at = np.arange(len(order))
        new = np.flatnonzero(np.any([np.append(True, x[1:] != x[:-1]) for x in (gram, low, high)], axis=0))
        size = np.diff(new, append=len(order))
        end = np.repeat(new + size, size)
        lows = np.repeat(np.add.reduceat((own == low).astype(np.int64), new), size)
        self.begin = np.where(low == high, at + 1, np.repeat(new, size) + lows)
        self.count = np.where((low == high) | (own == low), end - self.begin, 0)

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of classes of unlike components that pass length, positional and suffix filter; of a pair with
        several n-grams mostly the first."""
        n, place, component = self.n, self.place, self.component
        tested = np.zeros(0, np.int64)
        for some in np.split(self.at, np.flatnonzero(np.diff(np.cumsum(self.count) // PAIRS)) + 1):
            k = self.count[some]
            i = np.repeat(some, k)
            j = np.repeat(self.begin[some] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
            most = np.minimum(place[i], place[j]) + 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)
            ok = (most * (num + den) >= (n[i] + n[j]) * num) | (np.maximum(place[i], place[j]) >= _FAR)
            ok &= (component[i] != component[j]) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
            i, j = i[ok], j[ok]
            a, b = self.member[i], self.member[j]
            code, first = np.unique(np.minimum(a, b) * len(self.cids) + np.maximum(a, b), return_index=True)
            fresh = np.ones(len(code), bool)
            if len(tested):
                fresh = tested[np.minimum(np.searchsorted(tested, code), len(tested) - 1)] != code
            code, first = code[fresh], first[fresh]
            if not len(code):
                continue
            tested = np.union1d(tested, code) if len(tested) < TESTED else code
            for part in range(0, len(first), PAIRS // 4):
                a, b = i[first[part : part + PAIRS // 4]], j[first[part : part + PAIRS // 4]]
                ok = _passes({"n": n[a], "parts": self.parts[a]}, {"n": n[b], "parts": self.parts[b]}, num, den)
                if ok.any():
                    yield a[ok], b[ok]


class Sets:
    """The sets of numbered classes, for the sizes of their intersections."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.cumsum(self.size) - self.size
        names, self.member = np.unique(np.concatenate(sets), return_inverse=True)
        self.width = len(names)
        self.key = np.repeat(np.arange(len(sets)), self.size) * self.width + self.member  # in order, as each set is

    def similar(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether the sets of aligned pairs reach the similarity; empty ones do not."""
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), bool)
        upto = np.cumsum(self.size[a])
        for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(upto // MEMBERS)) + 1):
            k = self.size[a[some]]
            total = int(k.sum())
            if not total:
                continue
            own = self.member[np.repeat(self.start[a[some]] - np.cumsum(k) + k, k) + np.arange(total)]
            want = np.repeat(b[some] * self.width, k) + own
            hit = self.key[np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)] == want
            common = np.bincount(np.repeat(np.arange(len(some)), k), hit, len(some)).astype(np.int64)
            out[some] = (common > 0) & (common * den >= num * (k + self.size[b[some]] - common))
        return out


def _slotted(dealt: DataFrame, shared: DataFrame) -> DataFrame:
    """`dealt` with `slot`, which differs only among the n-grams of a lead with very many rows.

    Only leads with several slots are looked up, at most one for each `ROWS` rows of `shared`; so they go to all tasks, and
    the rows of a lead never meet in one.
    """
    slots = shared.groupBy("gram").agg(F.min("lead").alias("lead"), F.least(F.min("size"), F.lit(2 * BLOCK)).alias("size"))
    slots = slots.groupBy("lead").agg(F.ceil(F.sum("size") / ROWS).alias("slots")).where("slots > 1")
    slot = F.pmod(F.xxhash64("gram"), F.coalesce("slots", F.lit(1)))
    return dealt.join(F.broadcast(slots), "lead", "left").withColumn("slot", slot).drop("slots")


def _between(shared: DataFrame, classes: DataFrame, texts: DataFrame, shards: int, width: int, num: int, den: int) -> DataFrame:
    """A forest of links `(a, b, na, nb)` between classes of unlike components that share a prefix n-gram.

    `shared` has `(gram, cid, n, place, component, size, lead)`. The classes of a gram are dealt to blocks; blocks meet
    in tasks. Grams with one `lead`, their smallest class, mostly share the others too and go to the same shards. The first
    pass only finds the rows of classes with a partner that passes the filters; the second one verifies with their texts.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "cid"), blocks).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("gram", "cid", "n", "place", "component", "lead", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = _slotted(dealt, shared).withColumn("shard", F.pmod(F.xxhash64("lead", "low", "high", "slot"), F.lit(8 * shards)).cast("int"))
    dealt = dealt.drop("lead", "slot").join(classes.select("cid", "parts"), "cid")
    names = ["shard", "gram", "cid", "n", "place", "component", "own", "low", "high", "parts"]

    def partners(rows: pa.Table) -> pa.Table:
        blocks_ = Blocks(rows)
        stay = np.zeros(rows.num_rows, bool)
        for i, j in blocks_.pairs(num, den):
            stay[i] = stay[j] = True
        return rows.select(names).filter(pa.array(stay[np.argsort(blocks_.order)]))

    left = land(dealt.select(*names).groupBy("shard").applyInArrow(partners, dealt.select(*names).schema))
    wanted = left.select(F.col("shard").alias("to"), F.col("cid").alias("of")).distinct().join(classes.select(F.col("cid").alias("of"), "node", "digest"), "of")
    near = texts.where(Bloom.of(wanted.select(F.col("node").alias("id")).distinct(), "doc_id"))
    # An id may have several texts; that of the class tells itself by the digest.
    wanted = wanted.join(near.withColumnRenamed("doc_id", "node"), "node")

    def linked(rows: pa.Table, given: pa.Table) -> pa.Table:
        out = np.zeros((4, 0), np.int64)
        if rows.num_rows and given.num_rows:
            blocks_ = Blocks(rows)
            m = len(blocks_.cids)
            node, words, sets = np.zeros(m, np.int64), Words(), [np.zeros(0, np.uint64)] * m
            for batch in given.to_batches():
                member = np.searchsorted(blocks_.cids, batch.column("of").to_numpy())
                for at, of, digest, text in zip(member.tolist(), batch.column("node").to_pylist(), batch.column("digest").to_pylist(), texts_of(batch)):
                    this = shingles(text, width, words)
                    if not len(sets[at]) and hashlib.md5(this.tobytes()).digest() == digest:
                        sets[at], node[at] = this, of
            of_all, label = Sets(sets), np.arange(m)
            links = [np.zeros((2, 0), np.int64)]
            for i, j in blocks_.pairs(num, den):
                for part in range(0, len(i), 4096):
                    a, b = blocks_.member[i[part : part + 4096]], blocks_.member[j[part : part + 4096]]
                    apart = label[a] != label[b]  # what is linked here is looked at no more
                    a, b = a[apart], b[apart]
                    hit = of_all.similar(a, b, num, den)
                    if hit.any():
                        links = [np.concatenate([*links, np.stack([a[hit], b[hit]])], axis=1)]
                        links = [np.stack(forest(*links[0]))]
                        label = roots(*links[0], m)
            a, b = links[0]
            out = np.stack([blocks_.cids[a], blocks_.cids[b], node[a], node[b]])
            words.clear()
            give_back()
        return pa.table(dict(zip(("a", "b", "na", "nb"), out)))

    return left.groupBy("shard").cogroup(wanted.groupBy("to")).applyInArrow(linked, _PAIR)


def similar_texts(docs: DataFrame, *, width: int = 5, num: int = 4, den: int = 5, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row of `docs`: texts whose n-grams reach a Jaccard of num / den link.

    Null texts and texts without words have no n-grams and link with nothing. Equal sets link. Rows that
    repeat an id are one node: linked with what one of them is linked with. Rows without an id link with
    nothing, and their component is null. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    levels = bucket_levels(docs, width)
    sets = land(_sets(docs, width, num, den, levels))
    known = sets.where("digest is not null and doc_id is not null")
    # Classes have numbers of their own, as an id may stand for unlike texts; they hold as the table is written.
    classes = land(known.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("parts").alias("parts")
    ).withColumn("cid", F.monotonically_increasing_id()))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = land(_shared_grams(classes, shard_count(spark)))
    # What many others are variants of has few n-grams that no other has, so more of its prefix is shared: a good pivot.
    degrees = shared.groupBy("cid").agg(F.count("*").cast("int").alias("degree"))
    shared = shared.join(degrees, "cid").withColumn("component", F.col("cid"))
    links, tested, known_classes = None, None, classes.count()
    for turn, count in enumerate([*pivots, 0]):
        # Grams whose classes are all in one component are done.
        chosen = [F.min_by(F.struct("cid", "n", "place"), F.struct(-F.col("degree") if not k else F.lit(0), F.xxhash64(F.lit(turn), F.lit(k), "cid"))) for k in range(count)]
        grams = shared.groupBy("gram").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.min("cid").alias("lead"), *([F.array(*chosen).alias("pivots")] if count else [])
        ).where("low <> high").drop("low", "high")
        shared = land(shared.drop("size", "lead", "pivots").join(grams, "gram"))
        if turn and shared.isEmpty():
            break
        if count:
            p = F.col("pivot")
            pairs = shared.withColumn("pivot", F.explode("pivots")).where((F.col("cid") != p["cid"]) & _may_reach(F.col("n"), F.col("place"), p["n"], p["place"], num, den))
            pairs = pairs.select(F.least("cid", p["cid"]).alias("a"), F.greatest("cid", p["cid"]).alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            pairs = cut_lineage(pairs)
            pairs = gathered(_filtered(pairs, classes, num, den, max(pairs.count(), known_classes)))
            tested = pairs if tested is None else tested.unionByName(pairs)
            ids = pairs.select(F.explode(F.array("na", "nb")).alias("id")).distinct()
            found = _verified(pairs, source.where(Bloom.of(ids, "doc_id")), width, num, den, pairs.count())
        else:
            found = _between(shared, classes, source, shard_count(spark, docs), width, num, den)
        links = gathered(found if links is None else links.unionByName(found))
        if count:
            some = connected_components(links, rounds=1).withColumnRenamed("id", "cid")
            # The pivots have met all others of their gram.
            shared = shared.where(~F.exists("pivots", lambda p: p["cid"] == F.col("cid"))).drop("component")
            shared = shared.join(some, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # From classes to ids: an id that stands for unlike texts connects their classes.
    mark = F.xxhash64("digest")
    unlike = known.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("doc_id")
    repeated = known.join(unlike, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    components = cut_lineage(connected_components(links.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(repeated)))
    # From rows to classes to components.
    of_class = classes.select("digest", "node").join(components.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = sets.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the smallest id of each component; rows without an id stay. Columns and values are untouched."""
    found = similar_texts(docs.select("doc_id", "text"), **options)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.alias("l").join(gone.alias("r"), F.col("l.doc_id").cast("long") == F.col("r.doc_id"), "left_anti").select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


OP3_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
sizes as (select doc_id, len(s) as n from sets),
grams as (select doc_id, n, unnest(s) as g from sets join sizes using (doc_id)),
common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n group by a.doc_id, b.doc_id),
links as (select a, b from common where 100 * c >= 90 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select doc_id, n as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id
from sizes left join (select a as doc_id, min(b) as low from reach group by a) using (doc_id)"""
