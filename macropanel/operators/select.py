"""Choosing features: false discovery rate, correlation, variance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CORRELATION_CUT
from ..functions.association import association_p
from ..session import cut_lineage
from .columns import matrix, with_stats
from .longform import attach

ORDER = ("table_pos", "pos", "fpos", "feature")
BLOCK = 2048  # features that are compared with as many others in one task
PIVOTS = 64
STEP = 4  # features that a round is done with, to those of the round before
SAMPLE = 1024


def column_order(df: DataFrame) -> Column:
    """Place of a feature among the columns of the panel, as one comparable value."""
    return F.struct(*[c for c in ORDER if c in df.columns])


def p_values(columns: DataFrame) -> DataFrame:
    """Add `p`, the p-value of each feature against `ys`; NULL for a constant feature."""
    p = association_p("xs", "ys")
    return columns.withColumn("p", F.when(~F.isnan(p), p))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m. Beyond 1000 the sum's own expansion is used, which differs from it by less
    than 1e-12: the order in which doubles are added matters more."""
    summed = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    limit = F.log(m) + 0.57721566490153286 + 1 / (2 * m) - 1 / (12 * m * m)
    return F.when(m <= 1000, summed).otherwise(limit)


def select_by_fdr(tested: DataFrame, keys: Sequence[str] = (), *, fdr_level: float = 0.05) -> DataFrame:
    """Benjamini-Yekutieli step-up over all features of an entity; rows with a NULL `p` take no part.

    The rank of a p-value is the number of p-values up to it. It is found without sorting
    all of them in one task: equal values are counted first, the values are spread over
    slots of [0, 1], and only the slot totals (a fixed number) are cumulated in one place.
    """
    keys = list(keys)
    low = F.when(F.col("p") > 0, F.greatest(F.floor(-F.log("p") * 16), F.lit(0))).otherwise(F.lit(12_000))
    slot = F.struct(F.floor(F.col("p") * 1024).alias("a"), (-low).alias("b"))
    counts = tested.filter("p is not null").groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", slot)
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy(*keys, "slot").agg(F.sum("n").alias("n"))
        .withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("m", F.sum("n").over(Window.partitionBy(*keys)))
        .drop("n")
    )
    inside = Window.partitionBy(*keys, "slot").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("upto", F.sum("n").over(inside))
        .join(totals, [*keys, "slot"])
        .withColumn("k", F.col("below") + F.col("upto"))
    )
    passing = F.col("p") <= F.col("k") / F.col("m") * F.lit(fdr_level) / harmonic(F.col("m"))
    cut = ranked.filter(passing).groupBy(*keys).agg(F.max("p").alias("__cut"))
    return attach(tested, cut, keys).filter("p <= __cut").drop("__cut")


def drop_correlated(
    columns: DataFrame,
    keys: Sequence[str] = (),
    *,
    cut: float = CORRELATION_CUT,
    blocks: int | None = None,
) -> DataFrame:
    """Drop a feature when an earlier one has |Pearson r| above `cut` with it, dropped or not.

    Entities of at most `BLOCK` features are compared in one task each. Larger ones are compared in rounds: all
    features that no earlier round found meet the first ones in order, then a stretch several times as long. Who
    was found is not looked for again, so what is sent only grows with the square of the features that stay.
    In a round both sides are cut into blocks of like features, and only block pairs that can hold a close pair
    meet (`block_pairs`); a task gives back only the features it found to be too close to an earlier one, never
    a list of pairs. A constant feature correlates with nothing and stays.
    """
    entity = list(keys) or ["__all"]
    base = cut_lineage(columns if keys else columns.withColumn("__all", F.lit(0)))
    names = [c for c in ORDER if c in columns.columns]
    schema = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in [*entity, "feature"])

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*names, "row"], kind="stable").reset_index(drop=True)
        # A feature that is on both sides has one place in the order.
        place = (pdf["row"] != pdf["row"].shift()).cumsum().to_numpy()
        a, b = np.flatnonzero(~pdf["late"]), np.flatnonzero(pdf["late"])
        if not len(a) or not len(b):
            return pdf.loc[[], [*entity, "feature"]]
        z = matrix(pdf["z"])
        near = (np.abs(z[a] @ z[b].T) > cut) & (place[a][:, None] < place[b][None, :])
        return pdf.loc[b[near.any(axis=0)], [*entity, "feature"]]

    scaled = _unit_vectors(base, entity, names).withColumn("row", F.monotonically_increasing_id())
    sides = F.explode(F.array(F.lit(False), F.lit(True)))
    largest = base.groupBy(*entity).count().agg(F.max("count")).first()[0] or 0
    if blocks is None and largest <= BLOCK:
        near = scaled.withColumn("late", sides).groupBy(*entity).applyInPandas(close, schema)
    else:
        ends = []
        while (end := BLOCK * STEP ** len(ends)) < largest:
            ends.append(end)
        placed = _staged(_placed(scaled, entity, blocks), entity, names, ends)
        near = None
        for stage in range(len(ends) + 1):
            early, late = placed.filter(F.col("stage") == stage), placed.filter(F.col("stage") >= stage)
            if near is not None:
                late = late.join(near, [*entity, "feature"], "left_anti")
            sent = _met(_blocked(early, entity, blocks), _blocked(late, entity, blocks), entity, names, cut)
            found = cut_lineage(sent.groupBy(*entity, "left", "right").applyInPandas(close, schema).distinct())
            near = found if near is None else near.unionByName(found)
    return base.join(near, [*entity, "feature"], "left_anti").select(columns.columns)


def _met(early: DataFrame, late: DataFrame, entity: Sequence[str], names: Sequence[str], cut: float) -> DataFrame:
    """Features of both sides, once for each pair of blocks that can hold a partner of theirs."""
    pairs = cut_lineage(block_pairs(early, entity, cut, late).filter("near").drop("near"))
    reach = _reach(cut)
    fits = F.forall(
        F.arrays_zip("angles", "lo", "hi"), lambda p: (p["angles"] >= p["lo"] - reach) & (p["angles"] <= p["hi"] + reach)
    )

    def side(rows: DataFrame, this: str, other: str) -> DataFrame:
        to = pairs.select(*entity, "left", "right", F.col(this).alias("block"), F.col(f"lo_{other}").alias("lo"), F.col(f"hi_{other}").alias("hi"))
        sent = rows.join(to, [*entity, "block"]).filter(fits).withColumn("late", F.lit(this == "right"))
        return sent.select(*entity, *names, "row", "z", "late", "left", "right")

    return side(early, "left", "right").unionByName(side(late, "right", "left"))


def _staged(placed: DataFrame, entity: Sequence[str], names: Sequence[str], ends: Sequence[int]) -> DataFrame:
    """`placed` with a `stage`: how many of `ends` a feature's place in the order of its entity is behind.

    Places are estimated from about `SAMPLE` features of an entity, drawn by hash; who is in an earlier stage is
    earlier in any case.
    """
    if not ends:
        return placed.withColumn("stage", F.lit(0))
    order = F.struct(*[x.alias(f"o{i}_{k}") for i, c in enumerate(names) for k, x in enumerate((F.col(c).isNull(), F.col(c)))])
    sizes = placed.groupBy(*entity).agg(F.count(F.lit(1)).alias("n"))
    drawn = _with(placed, sizes, entity).filter(F.pmod(F.xxhash64("feature", F.lit(2)), F.ceil(F.col("n") / SAMPLE)) == 0)
    some = cut_lineage(drawn.groupBy(*entity, "n").agg(F.array_sort(F.collect_list(order)).alias("some")))
    at = lambda end: F.get("some", F.floor(F.lit(end) * F.size("some") / F.col("n")).cast("int"))
    behind = [F.when((F.lit(end) < F.col("n")) & (at(end) <= order), 1).otherwise(0) for end in ends]
    return _with(placed, some, entity, "left").withColumn("stage", sum(behind[1:], behind[0])).drop("n", "some")


def _unit_vectors(base: DataFrame, entity: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Features as vectors of mean 0 and length 1, whose products are correlations; none for constants."""
    return with_stats(base).filter("__s > 0").select(
        *entity, *names, F.transform("__d", lambda d: d / F.sqrt(F.col("__s"))).alias("z")
    )


def _reach(cut: float) -> float:
    """The largest angle between two lines whose |r| is above `cut`, and a little for rounding."""
    return math.acos(min(1.0, max(0.0, cut))) + 1e-6


def _with(rows: DataFrame, each: DataFrame, entity: Sequence[str], how: str = "inner") -> DataFrame:
    """`rows` with what `each` has for their entity. Of a panel without keys that is one row, which goes to the rows, so
    that they do not meet in one task."""
    return rows.join(F.broadcast(each) if list(entity) == ["__all"] else each, list(entity), how)


def _wanted(blocks: int | None) -> Column:
    return (F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / BLOCK)) if blocks is None else F.lit(blocks)).cast("int")


def _placed(scaled: DataFrame, entity: Sequence[str], blocks: int | None) -> DataFrame:
    """`scaled` with the `angles` to some of its features, the pivots: at most `PIVOTS`, chosen by hash."""
    name = F.xxhash64("feature")
    slots = scaled.groupBy(*entity).agg(_wanted(blocks).alias("slots"))
    pivots = (
        _with(scaled, slots, entity).groupBy(*entity, F.pmod(name, F.col("slots")).alias("slot"))
        .agg(F.min_by("z", F.struct(name, "feature")).alias("z"))
        .groupBy(*entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "z"))), lambda p: p["z"]).alias("pivots"))
    )
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    # Angles between lines, not vectors: the sign of a correlation does not count.
    angles = F.transform("pivots", lambda p: F.acos(F.least(F.lit(1.0), F.abs(product(F.col("z"), p)))))
    return cut_lineage(_with(scaled, pivots, entity).withColumn("angles", angles).drop("pivots"))


def _blocked(rows: DataFrame, entity: Sequence[str], blocks: int | None) -> DataFrame:
    """`rows` with a `block` of like features, and with `angles` if they have none yet.

    A feature belongs to its nearest pivot, of as many pivots as these rows fill blocks; a pivot with many
    features is cut into blocks of about `BLOCK` by hash.
    """
    placed = rows if "angles" in rows.columns else _placed(rows, entity, blocks)
    slots = placed.groupBy(*entity).agg(_wanted(blocks).alias("slots"))
    own = F.slice("angles", F.lit(1), F.col("slots"))
    placed = cut_lineage(_with(placed, slots, entity).withColumn("cell", F.array_position(own, F.array_min(own)).cast("int")).drop("slots"))
    parts = placed.groupBy(*entity, "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("feature", F.lit(1)), F.col("parts"))
    return placed.join(parts, [*entity, "cell"]).withColumn("block", (F.col("cell") * (1 << 32) + part).cast("long")).drop("cell", "parts")


def block_pairs(blocked: DataFrame, entity: Sequence[str], cut: float, others: DataFrame | None = None) -> DataFrame:
    """All pairs of blocks `left >= right` of an entity, or all of its `left` ones in `blocked` and `right` ones in
    `others`, with the ranges of their angles, and whether they are `near`.

    Angles between lines obey the triangle inequality. So two features with |r| above `cut`, that is, an angle
    below acos(`cut`), have angles to each pivot that differ by no more; blocks whose ranges lie further
    apart for one of the pivots hold no such pair.
    """

    def one(rows: DataFrame, side: str) -> DataFrame:
        at = rows.select(*entity, "block", F.posexplode("angles").alias("pivot", "angle"))
        ranges = (
            at.groupBy(*entity, "block", "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
            .groupBy(*entity, "block").agg(F.array_sort(F.collect_list(F.struct("pivot", "lo", "hi"))).alias("r"))
        )
        return ranges.select(*entity, F.col("block").alias(side), F.col("r.lo").alias(f"lo_{side}"), F.col("r.hi").alias(f"hi_{side}"))

    reach = _reach(cut)
    meet = F.forall(
        F.arrays_zip("lo_left", "hi_left", "lo_right", "hi_right"),
        lambda p: (p["lo_left"] <= p["hi_right"] + reach) & (p["lo_right"] <= p["hi_left"] + reach),
    )
    pairs = one(blocked, "left").join(one(blocked if others is None else others, "right"), list(entity))
    return (pairs.filter("left >= right") if others is None else pairs).withColumn("near", meet)


def top_variance(
    columns: DataFrame, keys: Sequence[str] = (), *, max_feature_ratio: float = 0.6, parts: int = 64
) -> DataFrame:
    """Keep the `int(n * ratio)` features of largest sample variance (n dates), all if there are
    no more than that. Adds `rank`: panel order if all stay, else descending variance.

    Every part of the features hands on its own best ones, so the final ranking sees at most
    `parts * k` rows of an entity, whatever the number of features.
    """
    keys = list(keys)
    stats = with_stats(columns).withColumn("variance", F.col("__s") / F.nullif(F.size("xs") - 1, F.lit(0)))
    stats = stats.withColumn("__o", column_order(columns)).drop("__m", "__d", "__s")
    size = columns.groupBy(*keys).agg(F.max(F.size("xs")).alias("n"), F.count(F.lit(1)).alias("features"))
    size = size.withColumn("k", F.floor(F.col("n") * max_feature_ratio))
    by_variance = [F.col("variance").desc_nulls_last(), F.col("__o")]
    local = Window.partitionBy(*keys, "__part").orderBy(*by_variance)
    final = Window.partitionBy(*keys).orderBy(*by_variance)
    in_order = Window.partitionBy(*keys).orderBy("__o")
    kept = (
        attach(stats, size, keys)
        .withColumn("__part", F.pmod(F.xxhash64("feature"), F.lit(parts)))
        .withColumn("__l", F.row_number().over(local))
        .filter(F.col("__l") <= F.greatest("k", F.lit(1)))
        .withColumn("__g", F.row_number().over(final))
        .filter((F.col("features") <= F.col("k")) | (F.col("__g") <= F.col("k")))
        .withColumn("rank", F.when(F.col("features") <= F.col("k"), F.row_number().over(in_order)).otherwise(F.col("__g")))
    )
    return kept.drop("__part", "__l", "__g", "__o")
