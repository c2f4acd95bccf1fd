"""Operator 9: mixing sources to target weights by fitting budgets of words.

Targets: sources share all words by weight; what a source cannot give (its documents repeated `most`
times) is reshared by weight until no source is above. That is one water level: a source gets the
smaller of its cap and level * weight.

Fitting: a source repeats all of its documents as often as they fit. For the rest of its budget, its
documents are counted by exact length. The same share of each length is taken first, longest lengths
fill up what is left, and a bounded-knapsack table over the last few thousand words finds the best
count of each length. Which documents of a length are taken is drawn by a seeded hash.

Only `(source, length)` counts meet in a group; documents are ranked within a 1/1024 part of one source and
length, so a source that holds a third of all rows is spread out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from macropanel.session import cut_lineage

from .common import WORD, table, unused

SLICES = 1024  # parts of the documents of one source and length
TABLE = 1 << 14  # words that the knapsack table spans


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """`(source, source_size, target)` of `(source, source_size)`: one row of each source.

    Sources by code point, null last, take the weights in turn. Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    # From the source that is capped first: if all before it are capped, the level is what the others share.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level)
    # The level rises while sources are capped below it; the first that is not fixes it for all behind it.
    free = F.col("cap") >= F.col("level") * F.col("weight")
    fixed = levelled.withColumn("free", free).withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    return fixed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each (distinct, positive) length to take so that their sum comes nearest below `budget`.

    The budget is at most the sum of all. Exact wherever the last `TABLE` words decide: the table covers
    what a greedy fill by falling length leaves, together with the documents it may exchange.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * taken).sum())
    while rest < 0:  # rounding of the share
        over = int(np.argmax(np.where(taken > 0, lengths, 0)))
        taken[over] -= 1
        rest += int(lengths[over])
    for i in np.argsort(-lengths):  # down to what the table spans
        if rest <= TABLE // 2:
            break
        n = min(int(counts[i] - taken[i]), max(0, rest - TABLE // 2) // int(lengths[i]))
        taken[i] += n
        rest -= n * int(lengths[i])
    # Give short documents back, so that the table can choose among them anew.
    for i in np.argsort(lengths):
        room = TABLE - 1 - rest
        if lengths[i] > room:
            break
        n = min(int(taken[i]), room // int(lengths[i]))
        taken[i] -= n
        rest += n * int(lengths[i])
    return taken + _knapsack(lengths, counts - taken, rest)


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the largest sum up to `budget`, as counts. Sums are the set bits of one integer."""
    out = np.zeros(len(lengths), np.int64)
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i in np.argsort(lengths):
        if lengths[i] > budget or reach >> budget & 1:
            break
        left, part = min(int(free[i]), budget // int(lengths[i])), 1
        while left > 0:
            n = min(part, left)
            steps.append((i, n, reach))
            reach |= reach << n * int(lengths[i]) & mask
            left, part = left - n, 2 * part
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            out[i] += n
            at -= n * int(lengths[i])
    return out


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of every row of `docs`, and `copies` = taken / size.

    `size` counts words; null and empty texts have none and are never taken. A null source is a
    source of its own. Rows with equal id are documents of their own. Reruns agree: ties of the seeded
    hash are broken by id; rows alike in source, size and id may stand for each other. An
    empty table gives no rows. Other columns are not looked at.
    """
    return _planned(_rows(docs, seed), weights, most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def _size() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return cut_lineage(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), draw.alias("draw")))


def _planned(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """`rows` with source_size, target and copies."""
    slices = rows.withColumn("slice", F.pmod("draw", F.lit(SLICES)).cast("int"))
    counted = cut_lineage(slices.groupBy("source", "size", "slice").agg(F.count("*").alias("n")))
    by_length = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    plan = cut_lineage(targets(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most))

    def fitted(lengths: pa.Table) -> pa.Table:
        size, n = lengths["size"].to_numpy(), lengths["n"].to_numpy()
        whole, budget = int(lengths["source_size"][0].as_py()), round(lengths["target"][0].as_py())
        times = min(most, budget // whole)
        extra = fit(size, n, budget - times * whole) if times < most else np.zeros(len(size), np.int64)
        return pa.table({"source": lengths["source"], "size": lengths["size"], "times": pa.array([times] * len(size), pa.int64()), "extra": pa.array(extra, pa.int64())})

    groups = by_length.where("size > 0").join(plan, by_length["source"].eqNullSafe(plan["source"])).select(by_length["source"], "size", "n", "source_size", "target")
    quota = groups.groupBy("source").applyInArrow(fitted, "source string, size long, times long, extra long")
    # Slices before the one where the extra documents end are taken whole, that one by rank, the others not.
    upto = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    share = counted.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    share = share.join(quota, share["source"].eqNullSafe(quota["source"]) & (share["size"] == quota["size"])).select(
        share["source"], share["size"], "slice", "times", (F.col("extra") - F.col("before")).alias("room")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id"))
    ranked = slices.withColumn("rank", rank)
    s, p = share.alias("s"), plan.alias("p")
    joined = ranked.alias("r").join(
        s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.slice") == F.col("s.slice")), "left"
    ).join(p, F.col("r.source").eqNullSafe(F.col("p.source")), "left")
    copies = F.coalesce(F.col("s.times") + (F.col("r.rank") <= F.col("s.room")).cast("long"), F.lit(0).cast("long"))
    return joined.select("r.*", "p.source_size", "p.target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """`docs` with each row as often as the mix takes it; its columns and their values are untouched."""
    # Rows alike in id, source and size may stand for each other: they are numbered on both sides.
    names = [unused(docs, n) for n in ("mix_id", "mix_source", "mix_size", "mix_nth")]
    times, copy = unused(docs, "mix_times"), unused(docs, "mix_copy")
    nth = F.row_number().over(Window.partitionBy(*names[:3]).orderBy(F.lit(1)))
    left = docs.withColumns(dict(zip(names, (F.col("doc_id"), F.col("source").cast("string"), _size())))).withColumn(names[3], nth)
    taken = _planned(_rows(docs, seed), weights, most).where("copies > 0")
    right = taken.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "source", "size"), names)), "copies").withColumn(names[3], nth)
    same = reduce(lambda a, b: a & b, (F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names))
    joined = left.alias("l").join(right.alias("r"), same).select("l.*", F.col("r.copies").alias(times))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
