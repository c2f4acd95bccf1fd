"""Connected components of a table of links, and helpers for links inside tasks.

Links are first reduced to forests within partitions, then stars are formed alternately around the smaller and
the smallest neighbours until nothing changes. Nothing but counts reaches the driver; every round is written
to the checkpoint folder, and its tasks are as many as its links need, not as a shuffle has partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from macropanel.session import cut_lineage

from .common import task_count

BLOCK = 2_000_000  # links that a task reduces at once


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of the n nodes' components under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what (a, b) connect; fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(at[: len(a)], at[len(a) :], len(nodes))
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local(links: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def reduced() -> np.ndarray:
            both = np.concatenate(held)
            return np.stack(forest(both[:, 0], both[:, 1]), axis=1)

        for batch in batches:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()], axis=1))
            count += batch.num_rows
            if count > BLOCK:
                held = [reduced()]
                if len(held[0]) > BLOCK // 2:  # it does not shrink: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], names=["a", "b"])
                    held = []
                count = len(held[0]) if held else 0
        if held:
            out = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """`(id, component)` of every id in `links` (columns `a`, `b`); `component` is the smallest id that it reaches.

    With `rounds` it stops after so many: equal components are then connected, unlike ones may be too.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    pairs = _local(pairs)  # (a, b) with b < a
    pairs = cut_lineage(pairs.distinct())
    tasks = task_count(pairs.count())
    pairs = new = pairs.coalesce(tasks)
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        # Each node's larger neighbours, and itself, go to its smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Then its smaller neighbours do so as well.
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(small_low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        tree = large.groupBy("a").agg(F.min("b").alias("b"))
        new = cut_lineage(_local(tree.unionByName(small).coalesce(tasks)).distinct()).coalesce(tasks)
        if rounds is None and not new.groupBy("a").count().where("count > 1").take(1) and not new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").take(1):
            break
        pairs = new
    if rounds is not None:
        new = new.groupBy("a").agg(F.min("b").alias("b"))
        tops = new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_anti")
    else:
        tops = new.select("b").distinct()
    ids = new.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(tops.select(F.col("b").alias("id"), F.col("b").alias("component")))
