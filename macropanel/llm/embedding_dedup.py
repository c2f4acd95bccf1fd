"""Operator 7: embedding near-dedup by int8 tiles with error bounds.

Vectors are scaled to length 1; equal ones become one representative that stands for all. Each is also
kept as int8 codes with a scale, and with the exact length of what the codes leave out. Blocks of
vectors meet in tiles: one integer product gives every pair's approximate cosine, and the lengths bound its
error rigorously (Cauchy-Schwarz). Pairs above the threshold by more than the bound are links, pairs below it
by more are not; only the rest is computed again from the vectors in double precision.

A tile returns sums and a forest of links, never its pairs, so a cluster that holds a third of all rows
costs no more than others. All pairs are looked at, as the method has it: work grows with the square of the
number of distinct vectors, spread over tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from macropanel.session import cut_lineage

from .common import table
from .components import connected_components, forest

BLOCK = 8192  # vectors of a block; a tile holds two blocks
STRIP = 256  # rows of a tile that are multiplied at once
SLACK = 1e-9  # for the rounding of the products themselves


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """`(vec_id, vec)` in doubles; null where a vector is null or empty, zero, or holds nulls or non-finite parts."""
    parts = F.transform(F.col(vec), lambda x: x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(parts, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(~bad & ~zero, parts).alias("vec"))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest part first, so that nothing over- or underflows."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, and the length of x - scale * codes, of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - codes * scale[:, None]
    return codes, scale, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-12)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of links between unit vectors, and how many had to be computed again. `same`: each pair once."""
    (ca, sa, ea), (cb, sb, eb) = quantise(a), quantise(b)
    # Products of codes and their sums are integers below 2**24 for up to 1040 dimensions, so single precision is exact.
    wide = np.float32 if a.shape[1] <= 1040 else np.float64
    right = cb.astype(wide).T
    left, again, out = ca.astype(wide), 0, []
    widest = eb.max(initial=0)
    sb32 = sb.astype(np.float32)
    for at in range(0, len(a), STRIP):
        rows = slice(at, at + STRIP)
        product = left[rows] @ right
        # x.y - near = q.f + e.y with |q| <= 1 + |e|, |y| = 1. First by the block's widest bound, in single
        # precision with its rounding allowed for; what passes by each pair's own.
        floor = (threshold - ((1 + ea[rows]) * widest + ea[rows] + SLACK)) / sa[rows]
        i, j = np.nonzero(product * sb32 >= (floor - 1e-5 * np.abs(floor)).astype(np.float32)[:, None])
        if same:
            i, j = i[j > i + at], j[j > i + at]
        near = product[i, j].astype(np.float64) * sa[i + at] * sb[j]
        bound = (1 + ea[i + at]) * eb[j] + ea[i + at] + SLACK
        maybe = near + bound >= threshold
        i, j, near, bound = i[maybe], j[maybe], near[maybe], bound[maybe]
        sure = near - bound >= threshold
        i += at
        check = np.flatnonzero(~sure)
        again += len(check)
        for part in np.array_split(check, max(1, len(check) // 100_000)):
            sure[part] = (a[i[part]] * b[j[part]]).sum(axis=1) >= threshold
        out.append((i[sure], j[sure]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out]), again


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<f8").reshape(len(column), -1)


def _representatives(good: DataFrame) -> DataFrame:
    """`(rep, n, dim, vec)`: distinct unit vectors as binary doubles, the smallest id and the number of each."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("vec")
                size = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = column.flatten().to_numpy()
                ends = np.cumsum(size)
                packed = [unit(flat[e - s : e][None, :].astype(np.float64)).astype("<f8").tobytes() for s, e in zip(size, ends)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "unit"])

    return good.mapInArrow(run, "vec_id long, dim int, unit binary")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row of `vectors`.

    Null, zero and non-finite vectors, and rows without an id, link with nothing: no links, and they are their
    own component. Vectors of unlike length are not compared. Rows that repeat an id are vectors of
    their own, but one node: their links add up, and links among them count. An empty table gives no rows.
    """
    rows = usable(vectors, vec)
    units = cut_lineage(_representatives(rows.where("vec is not null and vec_id is not null")))
    reps = units.groupBy("dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # Two unlike vectors may share an id, so a representative is named by its hash and vector, not by its id alone.
    reps = cut_lineage(reps.withColumn("node", F.xxhash64("dim", "unit")))
    blocks = max(1, -(-reps.count() // block))
    placed = reps.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = placed.withColumn("other", F.explode(others)).select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "dim", "node", "rep", "n", "unit"
    )
    tiles = dealt.groupBy("dim", "low", "high").applyInArrow(_tile(threshold), "node long, links long, a long, b long")
    tiles = cut_lineage(tiles)
    links = tiles.where("node is not null").groupBy("node").agg(F.sum("links").alias("others"))
    parts = connected_components(tiles.where("a is not null").select("a", "b"))
    # A representative's own copies are links when the vector's product with itself reaches the threshold, as 1 does.
    own = F.col("n") - 1 if threshold <= 1 - 1e-12 else F.lit(0)
    known = reps.join(links, "node", "left").select("dim", "unit", "rep", (F.coalesce("others", F.lit(0)) + own).alias("links"))
    by_row = units.join(known, ["dim", "unit"]).groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("rep").alias("rep"))
    # Ids that stand for several nodes tie these together.
    found = by_row.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "vec_id", "n_links", F.coalesce("component", "rep").alias("component")
    )
    return rows.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )


def _tile(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        block = rows["block"].to_numpy()
        low = int(rows["low"][0].as_py())
        same = low == int(rows["high"][0].as_py())
        matrix, node, rep, n = _matrix(rows["unit"]), rows["node"].to_numpy(), rows["rep"].to_numpy(), rows["n"].to_numpy()
        left = np.flatnonzero(block == low)
        right = left if same else np.flatnonzero(block != low)
        counts = np.zeros(len(node), np.int64)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            i, j, _ = tile_links(matrix[left], matrix[right], threshold, same)
            i, j = left[i], right[j]
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            if len(i):
                a, b = forest(rep[i], rep[j])
        hit = np.flatnonzero(counts)
        return pa.table({
            "node": pa.array([*node[hit].tolist(), *[None] * len(a)], pa.int64()), "links": pa.array([*counts[hit].tolist(), *[None] * len(a)], pa.int64()),
            "a": pa.array([*[None] * len(hit), *a.tolist()], pa.int64()), "b": pa.array([*[None] * len(hit), *b.tolist()], pa.int64()),
        })

    return run


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with recursive vectors as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b
  on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
found as (select a as vec_id, count(distinct b) as n_links from links group by a),
low as (select a as vec_id, min(b) as low from reach group by a)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join found using (vec_id) left join low using (vec_id)"""
