"""Operator 4: exact dedup against a history.

The distinct digests of the history are dealt to shards. Each shard is one row: a minimal perfect
hash, and slots that hold the full digest, the winner's id and the number of copies. Incoming texts are
first grouped by digest with map-side counts, so a text that a third of all rows share arrives as one row
of each task. A shard's rows meet the shard's index: a slot whose digest agrees byte by byte makes them
repeats of its winner; the others stay groups of their own.

Only digests are shuffled, and the texts are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from macropanel.session import cut_lineage

from .common import SPACE_RUN, hex_sha256, shard_count, table, unused
from .perfect_hash import PerfectHash

INDEX = "shard int, hash binary, digests binary, winners binary, copies binary"
NO_ID = np.iinfo(np.int64).max


def digests(docs: DataFrame) -> DataFrame:
    """`(doc_id, digest, nth)`: SHA-256 of the normalised text, and the number among rows alike in both."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE_RUN, " ")
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    alike = Window.partitionBy("digest", "doc_id").orderBy(F.lit(1))
    return rows.withColumn("nth", F.row_number().over(alike))


def grouped(rows: DataFrame, shards: int) -> DataFrame:
    """`(shard, digest, first, copies)` of the distinct digests."""
    found = rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"), F.count("*").alias("copies"))
    return found.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _keys(matrix: np.ndarray) -> np.ndarray:
    """The first eight bytes of each digest: the key of the perfect hash."""
    return np.ascontiguousarray(matrix[:, :8]).view("<u8").ravel()


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row of each shard over `(digest, doc_id)` rows.

    Of digests with the same first eight bytes, the hash takes one; the others follow behind the
    slots and are compared one by one.
    """

    def build(rows: pa.Table) -> pa.Table:
        matrix = _matrix(rows["digest"])
        _, one = np.unique(_keys(matrix), return_index=True)
        found = PerfectHash(_keys(matrix[one]))
        rest = np.setdiff1d(np.arange(len(matrix)), one)
        order = np.concatenate([one[np.argsort(found.slots(_keys(matrix[one])))], rest])
        return pa.table({
            "shard": pa.array(rows["shard"].to_pylist()[:1], pa.int32()), "hash": [found.to_bytes()],
            "digests": [matrix[order].tobytes()],
            "winners": [rows["first"].to_numpy()[order].astype("<i8").tobytes()],
            "copies": [rows["copies"].to_numpy()[order].astype("<i8").tobytes()],
        })

    return grouped(history, shards).groupBy("shard").applyInArrow(build, INDEX)


def look_up(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """`(digest, keep_id, group_size, member)` of all digests of the index and of `incoming`.

    `member` is true for incoming digests that the index holds, false for its others, and null
    for digests of the index that do not come in.
    """

    def probe(new: pa.Table, old: pa.Table) -> pa.Table:
        matrix = _matrix(new["digest"])
        first, copies = new["first"].to_numpy().astype(np.int64), new["copies"].to_numpy().astype(np.int64)
        member = np.zeros(len(matrix), bool)
        held, winner, size = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if old.num_rows:
            held = _matrix(old["digests"])
            winner = np.frombuffer(old["winners"][0].as_py(), "<i8").copy()
            size = np.frombuffer(old["copies"][0].as_py(), "<i8").copy()
            slot = PerfectHash.from_bytes(old["hash"][0].as_py()).slots(_keys(matrix))
            member = (slot >= 0) & (held[slot] == matrix).all(axis=1)
            hashed = len(np.unique(_keys(held)))
            for extra in range(hashed, len(held)):
                same = ~member & (held[extra] == matrix).all(axis=1)
                slot[same], member = extra, member | same
            at = slot[member]  # each digest comes in once
            winner[at] = np.minimum(winner[at], first[member])
            size[at] += copies[member]
        seen = np.zeros(len(held), bool)
        if member.any():
            seen[at] = True
        digest = [*map(bytes, held), *map(bytes, matrix[~member])]
        keep = np.concatenate([winner, first[~member]])
        state = [*(True if s else None for s in seen), *[False] * int((~member).sum())]
        return pa.table({
            "digest": pa.array(digest, pa.binary()),
            "keep_id": pa.array(keep, pa.int64(), mask=keep == NO_ID),
            "group_size": pa.array(np.concatenate([size, copies[~member]]), pa.int64()),
            "member": pa.array(state, pa.bool_()),
        })

    return grouped(incoming, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(
        probe, "digest binary, keep_id long, group_size long, member boolean"
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256` of every row of `docs`.

    The lower half of the ids is taken as the history, the rest comes in. Null texts count as empty.
    Equal rows that repeat an id are copies of each other, of which one is kept. Rows without an
    id come after all others: they are kept only if no row with an id has their text, and then
    one of them. An empty table gives no rows. Other columns are not looked at.
    """
    shards = shard_count(docs.sparkSession, docs)
    rows = cut_lineage(digests(docs))
    middle = rows.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("id")).first()["id"]
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    index = build_index(rows.where(old), shards)
    classes = look_up(index, rows.where(~old), shards).drop("member")
    return rows.join(classes, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts; its columns and their values are untouched.

    The rows that stay are looked for by id and digest, so a text moves once.
    """
    sha, key, nth = (unused(docs, n) for n in ("kept_sha", "kept_id", "kept_nth"))
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE_RUN, " ")
    keyed = docs.withColumns({sha: hex_sha256(text), key: F.col("doc_id").cast("long")})
    alike = Window.partitionBy(sha, key).orderBy(F.lit(1))
    joined = keyed.alias("l").join(kept.alias("r"), (F.col(f"l.{sha}") == F.col("r.__sha")) & F.col(f"l.{key}").eqNullSafe(F.col("r.__id"))).select("l.*")
    return joined.withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1).select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with hashed as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = min(doc_id) over same as kept, text_sha256
from hashed window same as (partition by text_sha256)"""
