"""Principal components of standardised feature columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..config import DATE
from ..session import cut_lineage
from .columns import MISALIGNED, standardise
from .longform import attach


class Components(NamedTuple):
    scores: DataFrame     # (keys, date, component, score, y)
    explained: DataFrame  # (keys, component, ratio, cumulative)


HELD = 4_000_000  # numbers of the partial sums that a task keeps
BATCH = 4096  # features whose loadings are found together


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _by_entity(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Array]]:
    """The entities of a batch, and the arrays of each."""
    if not keys:
        yield (), batch.column("xs")
        return
    rows: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
        rows.setdefault(key, []).append(at)
    for key, at in rows.items():
        yield key, batch.column("xs").take(pa.array(at))


def _rows(arrays: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    sizes = pc.list_value_length(arrays)
    if pc.min(sizes) != pc.max(sizes):
        raise ValueError(MISALIGNED)
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)


def gram(columns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`(keys, i, j, v)`, i <= j: the date-by-date inner products of all features.

    There are far fewer dates than features, so the small matrix over dates is used in place
    of the covariance over features: its size depends on the calendar alone. A task adds up the
    products of the batches that it sees and sends one partial matrix an entity; no feature
    moves, and no group of features meets in one place.
    """
    keys = list(keys)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for key, g in held.items():
                i, j = np.triu_indices(len(g))
                own = [pa.array([k] * len(i), t) for k, t in zip(key, kinds)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], names=[*keys, "i", "j", "v"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for key, arrays in _by_entity(batch, keys):
                z = _rows(arrays)
                before = held.get(key)
                if before is not None and len(before) != z.shape[1]:
                    raise ValueError(MISALIGNED)
                held[key] = z.T @ z if before is None else before + z.T @ z
            if sum(g.size for g in held.values()) > HELD:
                yield from sent()
                held.clear()
        yield from sent()

    parts = columns.select(*keys, "xs").mapInArrow(partial, _types(columns, keys) + "i int, j int, v double")
    return parts.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _signs(scaled: DataFrame, parts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`(keys, component, __lead)`: the largest loading of each component (of equal ones that of the last feature).

    Features are dealt to batches and each batch is multiplied with the axes of its entity at once.
    """
    keys = list(keys)
    batches = F.ceil(F.col("p") / BATCH)
    features = attach(scaled.select(*keys, "feature", "xs"), sizes, keys).withColumn("__batch", F.pmod(F.xxhash64("feature"), batches)).drop("p")
    axes = attach(parts.select(*keys, "component", "u", "s"), sizes, keys)
    axes = axes.select(*keys, "component", "u", "s", F.explode(F.sequence(F.lit(0).cast("long"), batches - 1)).alias("__batch"))

    def lead(own: pa.Table, axis: pa.Table) -> pa.Table:
        names, s = np.array(own["feature"].to_pylist(), object), axis["s"].to_numpy()
        found = []
        if own.num_rows and axis.num_rows:
            loadings = _rows(own["xs"].combine_chunks()) @ _rows(axis["u"].combine_chunks()).T
            for c in np.flatnonzero(s > 0):
                value = loadings[:, c] / s[c]
                size = np.abs(value).max()
                at = max(np.flatnonzero(np.abs(value) == size), key=lambda i: names[i])
                found.append((axis["component"][int(c)].as_py(), size, names[at], value[at]))
        given = [pa.array([axis[k][0].as_py()] * len(found), axis.schema.field(k).type) for k in keys]
        component, size, name, value = zip(*found) if found else ([], [], [], [])
        return pa.table([*given, pa.array(component, pa.int32()), pa.array(size, pa.float64()), pa.array(name, pa.string()), pa.array(value, pa.float64())], names=[*keys, "component", "size", "feature", "loading"])

    by = [*keys, "__batch"]
    leads = features.groupBy(*by).cogroup(axes.groupBy(*by)).applyInArrow(lead, _types(scaled, keys) + "component int, size double, feature string, loading double")
    return leads.groupBy(*keys, "component").agg(F.max_by("loading", F.struct("size", "feature")).alias("__lead"))


def pca(columns: DataFrame, keys: Sequence[str] = (), *, variance: float = 0.95, max_ratio: float = 0.8) -> Components:
    """Scores of the first components of standardised features with one date axis per entity.

    The number of components is the smallest whose shares of variance exceed `variance`, at
    most `max(int(max_ratio * n), 2)`. A component's sign is such that its largest loading
    is positive.
    """
    keys = list(keys)
    scaled = standardise(columns)
    sizes = scaled.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    sized = attach(gram(scaled, keys), sizes, keys)

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        g = np.zeros((n, n))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        g[i, j] = g[j, i] = pdf["v"].to_numpy()
        values, vectors = np.linalg.eigh(g)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        usable = min(n, int(pdf["p"].iloc[0]))
        ratio = values / values.sum() if values.sum() else np.zeros(n)
        cumulative = np.cumsum(ratio)
        enough = int(np.searchsorted(cumulative[:usable], variance, side="right")) + 1
        k = min(max(int(n * max_ratio), 2), enough, usable)
        out = pd.DataFrame({
            "component": np.arange(1, k + 1), "ratio": ratio[:k], "cumulative": cumulative[:k],
            "u": list(vectors[:, :k].T), "s": np.sqrt(values[:k]),
        })
        for e in keys:
            out[e] = pdf[e].iloc[0]
        return out

    # The matrix of one entity: its size depends on the number of dates only.
    schema = _types(scaled, keys) + "component int, ratio double, cumulative double, u array<double>, s double"
    parts = cut_lineage(sized.groupBy(*keys).applyInPandas(decompose, schema))
    signs = _signs(scaled, parts, sizes, keys)
    axis = scaled.groupBy(*keys).agg(F.first("dates").alias("dates"), F.first("ys").alias("ys"))
    sign = F.when(F.col("__lead") < 0, -1.0).otherwise(1.0)
    scores = (
        attach(parts.join(signs, [*keys, "component"]), axis, keys)
        .select(*keys, "component", "s", sign.alias("sign"), F.explode(F.arrays_zip("dates", "ys", "u")).alias("p"))
        .select(
            *keys, F.col("p.dates").alias(DATE), "component",
            (F.col("p.u") * F.col("s") * F.col("sign")).alias("score"), F.col("p.ys").alias("y"),
        )
    )
    return Components(scores, parts.select(*keys, "component", "ratio", "cumulative"))


def scores_wide(components: Components, keys: Sequence[str] = (), count: int | None = None) -> DataFrame:
    """`(keys, date, PCA_1..PCA_k, y)`; without `count` the number of components is read first."""
    if count is None:
        count = components.explained.agg(F.max("component")).first()[0] or 0
    cells = [
        F.max(F.when(F.col("component") == i, F.col("score"))).alias(f"PCA_{i}") for i in range(1, count + 1)
    ]
    return components.scores.groupBy(*keys, DATE).agg(*cells, F.max("y").alias("y"))
