"""Operator 1: byte-level BPE encoding and decoding.

Lookup has two tiers. A minimal perfect hash resolves every pre-token that is a word of the
vocabulary by one probe and a comparison of bytes. The others are merged: their bytes form a
linked list, a heap holds the ranks of adjacent pairs, and the lowest rank, leftmost first, is
merged until no pair is in the vocabulary.

Encoding is a map over rows: nothing is shuffled. A task holds the chunks of `PIECE` bytes of text, or
of one longer text, and resolves them block by block. A pre-token never reaches past a space that
stands before something else than white space; so texts are cut there first. A worker numbers the chunks
it meets and keeps their ids, so that equal chunks go through pattern and merge once while they are
remembered. After `PIECE` bytes that leave more than `CHUNKS` (`MANY` in `token_report`) or eight times as
many ids, the most used ones stay, half as many of each, and none that is `LONG`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import count, islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import give_back, sliced, table, unused
from .perfect_hash import PerfectHash

BLOCK = 500_000  # chunks of a text that are in memory at once
CHUNKS = 150_000  # chunks that a worker remembers, and thrice the merged pre-tokens in each of their two generations
MANY = 400_000  # the same where memory is not shared with other work
LONG = 64  # ids of a chunk that is not worth remembering: texts without spaces are a few long chunks
PIECE = 1_000_000  # bytes of text that are resolved together
NO_CUT = re.compile(r" (?:\s|\Z)")  # a space that begins no chunk


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


class Vocabulary:
    """Ranks, the perfect hash over their tokens, and the merge of what it does not hold."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        tokens = list(ranks)
        self.hash = PerfectHash(self._keys(tokens))
        self.token_at: list[bytes] = [b""] * len(tokens)
        self.id_at = np.zeros(len(tokens), np.uint32)
        for slot, token in zip(self.hash.slots(self._keys(tokens)).tolist(), tokens):
            self.token_at[slot] = token
            self.id_at[slot] = ranks[token]
        size = max(ranks.values(), default=-1) + 1
        parts: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.fromiter(map(len, parts), np.int64, size)
        self.first = np.cumsum(self.length) - self.length
        self.pair = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.forget()

    @staticmethod
    def _keys(tokens: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(t) for t in tokens), np.uint64, len(tokens))

    def resolve(self, pieces: list[bytes], remembered: int = CHUNKS // 3) -> list[bytes]:
        """The ids of each distinct pre-token, as little-endian unsigned 32-bit integers."""
        slots = self.hash.slots(self._keys(pieces))
        ids = self.id_at[slots].astype("<u4").tobytes()
        token_at = self.token_at
        out = []
        for at, (piece, slot) in enumerate(zip(pieces, slots.tolist())):
            if slot >= 0 and token_at[slot] == piece:
                out.append(ids[4 * at : 4 * at + 4])
                continue
            found = self.merged.get(piece)
            if found is None:
                found = self.older.get(piece)
                if found is None:
                    merged = self.merge(piece)
                    found = pack(f"<{len(merged)}I", *merged)
                if len(self.merged) >= remembered:
                    self.older, self.merged = self.merged, {}
                self.merged[piece] = found
            out.append(found)
        return out

    def forget(self) -> None:
        """Merged pre-tokens and chunks are remembered within a task: the worker may go on with other work."""
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self._remember([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _remember(self, chunks: list[str], ids: np.ndarray, length: np.ndarray, uses: np.ndarray) -> None:
        """These chunks and no others: their ids one behind the other, how many each has, and how often each was used."""
        self.number: dict[str, int] = defaultdict(count(len(chunks)).__next__, zip(chunks, range(len(chunks))))
        self.chunk_ids, self.chunk_length, self.uses = ids, length, uses

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Heap over linked bytes; an entry packs rank, start and end of the two parts it would join.

        An entry is stale if one of its ends was merged since.
        """
        rank, pair = self.ranks.get, self.pair
        n = len(piece)
        bits = n.bit_length()
        low = (1 << bits) - 1
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here any more
        before = list(range(-1, n))
        heap, at = [], 2
        for a, b in zip(piece, piece[1:]):
            if (r := pair[a << 8 | b]) >= 0:
                heap.append(r << 2 * bits | at)
            at += low + 2  # the next start and the next end
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry >> bits & low
            middle = end[i]
            stop = entry & low
            if not middle or middle >= stop or end[middle] != stop:
                continue
            end[i] = stop
            end[middle] = 0
            if stop < n:
                before[stop] = i
                after = end[stop]
                if (r := rank(piece[i:after])) is not None:
                    heappush(heap, (r << bits | i) << bits | after)
            p = before[i]
            if p >= 0 and (r := rank(piece[p:stop])) is not None:
                heappush(heap, (r << bits | p) << bits | stop)
        return tuple([self.ranks[piece[i:e]] for i, e in enumerate(end) if e])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut before each space that stands before something else than white space.

        These spaces are left out; the first chunk, which has none, gets one in front to tell it from the others.
        """
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        if not NO_CUT.search(text):
            return parts
        out = parts[:1]
        for p in islice(parts, 1, None):
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, texts: list[str], most: int = CHUNKS) -> Iterator[list[np.ndarray]]:
        """For each text the blocks of its ids. Chunks that are not remembered are resolved once for all texts given."""
        if len(self.number) != len(self.uses):  # an earlier call did not come to its end
            self.forget()
        codes: list[tuple[int, np.ndarray]] = []
        for row, text in enumerate(texts):
            chunks = self.chunks(text)
            for at in range(0, len(chunks), BLOCK):
                block = chunks[at : at + BLOCK]
                codes.append((row, np.fromiter(map(self.number.__getitem__, block), np.int32, len(block))))
        self._resolve_chunks([c[1:] if c[0] == " " else " " + c for c in islice(self.number, len(self.uses), None)], most // 3)
        first = np.cumsum(self.chunk_length) - self.chunk_length
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for row, code in codes:
            out[row].append(_gather(self.chunk_ids, first[code], self.chunk_length[code]))
            np.add.at(self.uses, code, 1)
        if len(self.number) > most or len(self.chunk_ids) > 8 * most:
            short = np.flatnonzero(self.chunk_length < LONG)
            kept = short[np.argsort(-self.uses[short], kind="stable")][: most // 2]
            kept = np.sort(kept[np.cumsum(self.chunk_length[kept]) <= 4 * most])
            chunks, length = list(self.number), self.chunk_length[kept]
            self._remember([chunks[k] for k in kept.tolist()], _gather(self.chunk_ids, first[kept], length), length, self.uses[kept] // 2)
        yield from out

    def _resolve_chunks(self, chunks: list[str], remembered: int) -> None:
        """The ids of new chunks, behind those of the chunks remembered."""
        pieces = [self.pattern.findall(c) for c in chunks]
        distinct = list({p for found in pieces for p in found})
        ids = dict(zip(distinct, self.resolve([p.encode() for p in distinct], remembered)))
        coded = [ids[found[0]] if len(found) == 1 else b"".join([ids[p] for p in found]) for found in pieces]
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        self.chunk_ids = np.concatenate([self.chunk_ids, np.frombuffer(b"".join(coded), "<u4")])
        self.chunk_length = np.concatenate([self.chunk_length, length])
        self.uses = np.concatenate([self.uses, np.zeros(len(coded), np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.bytes, self.first[ids], self.length[ids]).tobytes()


def _gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin at `first`, one behind the other."""
    to = np.cumsum(length)
    return flat[np.repeat(first - to + length, length) + np.arange(int(to[-1]) if len(to) else 0)]


_LOADED: dict[str, Vocabulary] = {}


class Shared:
    """A vocabulary file on its way to the tasks (of fixed size), and its name."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.ranks = spark.sparkContext.broadcast(ranks)
        self.pattern = pattern
        self.name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def load(self) -> Vocabulary:
        """One for each Python worker, kept from task to task."""
        if self.name not in _LOADED:
            _LOADED.clear()
            _LOADED[self.name] = Vocabulary(self.ranks.value, self.pattern)
        return _LOADED[self.name]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`: the token ids as little-endian unsigned 32-bit integers, in a binary column.

    Null and empty texts get no ids. Every other column passes unchanged; a column already named
    `ids` is replaced.
    """
    shared = Shared(docs.sparkSession, ranks, pattern)
    docs = docs.drop("ids")
    whole = unused(docs, "whole_text")
    source = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    names = docs.columns
    schema = docs.withColumn("ids", F.lit(b"")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.load()
        for batch in sliced(batches, PIECE, whole):
            ids = [b"".join(b.astype("<u4").tobytes() for b in blocks) for blocks in vocabulary.encode(batch.column(whole).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.binary())], names=[*names, "ids"])
        vocabulary.forget()
        give_back()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """`encoded` with the bytes that the ids of `column` stand for (null ids: no bytes)."""
    shared = Shared(encoded.sparkSession, ranks, pattern)
    encoded = encoded.drop(to)
    names, packed = encoded.columns, unused(encoded, "packed_ids")
    schema = encoded.withColumn(to, F.lit(b"")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.load()
        for batch in sliced(batches, PIECE, packed):
            texts = [vocabulary.decode(np.frombuffer(b, "<u4")) for b in batch.column(packed).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.binary())], names=[*names, to])
        give_back()

    return encoded.withColumn(packed, F.coalesce(F.col(column), F.lit(b""))).mapInArrow(run, schema)


def token_report(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of every row of `docs`.

    One row for each input row, whatever its id: null ids stay null and repeated rows stay
    repeated. A null or empty text has 0 tokens and the digests of no bytes. Encoding, decoding
    and both digests share one pass over the texts.
    """
    shared = Shared(docs.sparkSession, ranks, pattern)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.load()
        for batch in sliced(batches, PIECE):
            counts, coded, decoded = [], [], []
            for blocks in vocabulary.encode(batch.column("text").to_pylist(), MANY):
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for block in blocks:
                    ids.update(block.astype("<u4").tobytes())
                    back.update(vocabulary.decode(block))
                    n += len(block)
                counts.append(n)
                coded.append(ids.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of one of the installed public vocabularies."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), *public_vocabulary())
