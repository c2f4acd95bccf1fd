"""Small helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from macropanel.session import cut_lineage

#: White space of the contracts: space and the five controls from tab to carriage return.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """`(row_key, doc_id, text)` with null texts empty.

    `row_key` hashes id and text, so that rows without an id and rows that repeat an id join
    with what was found for exactly their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("row_key"), F.col("doc_id").cast("long"), text.alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until `df` has no column of that name."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


#: Bytes of input files for which one more shard is made.
SHARD_BYTES = 32 * 1024 * 1024


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that `df` is read from, by Spark's own statistics; rows without files count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)  # more than that: not known


def shard_count(spark: SparkSession, docs: DataFrame | None = None, share: int = 1) -> int:
    """As many shards as a shuffle has partitions (a part of them, for `share` above 1), at least 8.

    With `docs`, more where a shard would else stand for over `SHARD_BYTES` of the files read, so that
    what one group holds does not grow with the input.
    """
    few = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)
    return max(few, -(-input_bytes(docs) // SHARD_BYTES)) if docs is not None else few


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (a bijection), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Start offsets, end offsets and the bytes of a string column without nulls."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at[:-1], at[1:], memoryview(data) if data is not None else memoryview(b"")


def sliced(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `most` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        begin, end, _ = raw_texts(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(end, begin[first] + most, side="right"))
            last = max(first + 1, last)
            yield batch.slice(first, last - first)
            first = last


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8."""
    return batch.column(column).cast(pa.binary() if not pa.types.is_large_string(batch.column(column).type) else pa.large_binary()).to_pylist()


def give_back() -> None:
    """Hand memory that this worker no longer uses back to the machine, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hex_sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


#: Rows of a small table that one task gets, and the least number of tasks.
TASK_ROWS, FEW_TASKS = 50_000, 8


def task_count(rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for so many rows. For `coalesce`: where a shuffle has many more partitions than its rows need, starting
    Python in each of them takes longer than the work."""
    return max(FEW_TASKS, -(-rows // each))


def gathered(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage, in as many tasks as its rows need."""
    cut = cut_lineage(df)
    return cut.coalesce(task_count(cut.count()))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    cut_lineage(spark.range(0))  # sets the folder where none is named
    return f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"


def land(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: lineage ends, columns stay prunable."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Bloom:
    """Which longs a set may hold. It passes others too, but never loses one."""

    @classmethod
    def of(cls, ids: DataFrame, column: str, most_bits: int = 26) -> Column:
        """A condition on `column` that is true for all values of the one column of `ids`.

        Sized by their number, up to 2**`most_bits` bits (8 MB).
        """
        count = ids.count()
        bits_ = min(most_bits, max(16, (16 * count).bit_length()))
        shift = np.uint64(64 - bits_)

        def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << bits_, bool)
            for batch in batches:
                x = batch.column(0).to_numpy().astype(np.uint64)
                for salt in (1, 2):
                    bits[mix(x + np.uint64(salt)) >> shift] = True
            # One row a part, so that parts are united by groups.
            for at, part in enumerate(np.split(np.packbits(bits), 16)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["at", "bits"])

        def united(rows: pa.Table) -> pa.Table:
            both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"].to_pylist()])
            return pa.table({"at": rows["at"].slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

        parts = ids.coalesce(task_count(count)).mapInArrow(marks, "at int, bits binary").groupBy("at").applyInArrow(united, "at int, bits binary").collect()
        whole = np.zeros((16, (1 << bits_) // 128), np.uint8)
        for r in parts:
            whole[r["at"]] = np.frombuffer(r["bits"], np.uint8)
        packed = ids.sparkSession.sparkContext.broadcast(whole.tobytes())

        @F.pandas_udf("boolean")
        def maybe(x: pd.Series) -> pd.Series:
            bits = np.frombuffer(packed.value, np.uint8)
            x = x.fillna(0).to_numpy().astype(np.int64).astype(np.uint64)
            hit = np.ones(len(x), bool)
            for salt in (1, 2):
                at = mix(x + np.uint64(salt)) >> shift
                hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            return pd.Series(hit)

        return maybe(F.col(column))
