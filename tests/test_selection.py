import itertools
import math

import numpy as np
import pytest
from helpers import day
from macropanel.functions.association import association, association_rows, concordance, kendall, two_sample_ks
from macropanel.operators import columns, reduce, select
from pyspark.sql import functions as F

DATES = [day(f"2024-{m:02d}-28") for m in range(1, 13)]
SCHEMA = "feature string, pos int, dates array<date>, xs array<double>, ys array<double>"


def packed(spark, features, y=None, key=None):
    rows = [
        (name, i, DATES[:len(x)], [None if v is None else float(v) for v in x], [float(v) for v in (y or range(len(x)))])
        for i, (name, x) in enumerate(features.items())
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("k", F.lit(key)) if key else df


def names(df):
    return {r["feature"] for r in df.select("feature").collect()}


def test_concordance_counts_pairs():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, 300).astype(float), rng.integers(0, 9, 300).astype(float)
    pairs = itertools.combinations(range(300), 2)
    assert concordance(x, y) == sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in pairs)


def test_kendall_known_values():
    tau, p = kendall(np.array([12.0, 2, 1, 12, 2]), np.array([1.0, 4, 7, 1, 0]))
    assert tau == pytest.approx(-0.47140452079103173)
    assert p == pytest.approx(0.2827454599327748)
    assert math.isnan(kendall(np.ones(5), np.arange(5.0))[1])


def exact_ks(a, b):
    """Share of all splits of the pooled ranks whose statistic is at least the observed one."""
    n, m = len(a), len(b)

    def stat(first):
        i = j = best = 0
        for r in range(n + m):
            i, j = (i + 1, j) if r in first else (i, j + 1)
            best = max(best, abs(i * m - j * n))
        return best

    order = np.argsort(np.concatenate([a, b]))
    observed = stat({r for r, o in enumerate(order) if o < n})
    splits = list(itertools.combinations(range(n + m), n))
    return sum(stat(set(s)) >= observed for s in splits) / len(splits)


@pytest.mark.parametrize("seed, n, m", [(1, 3, 4), (2, 5, 5), (3, 2, 7), (4, 6, 4)])
def test_two_sample_is_exact(seed, n, m):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(1, 1, m)
    assert two_sample_ks(a, b) == pytest.approx(exact_ks(a, b))


def test_two_sample_is_exact_at_any_size():
    """Against the path counts in whole numbers, beyond the size at which others switch to a limit law."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=100), rng.normal(0.2, 1, 101)
    every = np.concatenate([a, b])
    gaps = np.searchsorted(np.sort(a), every, side="right") * 101 - np.searchsorted(np.sort(b), every, side="right") * 100
    reach = int(np.abs(gaps).max())
    paths = [0] * 102
    for i in range(101):
        for j in range(102):
            if abs(i * 101 - j * 100) >= reach:
                paths[j] = 0
            elif i or j:
                paths[j] = (paths[j] if i else 0) + (paths[j - 1] if j else 0)
            else:
                paths[0] = 1
    assert two_sample_ks(a, b) == pytest.approx(1 - paths[101] / math.comb(201, 100), rel=1e-9)


def test_concordance_with_ties():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 17, 64, 65):
        x, y = rng.integers(0, 6, n).astype(float), rng.integers(0, 5, n).astype(float)
        pairs = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
        assert concordance(x, y) == pairs


def test_association_by_kind(spark):
    y = np.arange(8.0)
    assert math.isnan(association(np.ones(8), y))
    assert association(np.array([0, 0, 0, 0, 1, 1, 1, 1.0]), y) == pytest.approx(2 / 70)
    tested = select.p_values(packed(spark, {"const": [1] * 8, "up": range(8), "flag": [0, 0, 0, 0, 1, 1, 1, 1]}))
    got = {r["feature"]: r["p"] for r in tested.collect()}
    assert got["const"] is None
    assert got["flag"] == pytest.approx(2 / 70)
    assert got["up"] == pytest.approx(kendall(y, y)[1])


def by_numpy(ps, level):
    kept = np.array(sorted(p for p in ps if p is not None))
    m = len(kept)
    limit = level * np.arange(1, m + 1) / (m * (1 / np.arange(1, m + 1)).sum())
    passing = np.flatnonzero(kept <= limit)
    return kept[passing.max()] if len(passing) else -1.0


@pytest.mark.parametrize("level", [0.01, 0.05, 0.3, 0.9])
def test_false_discovery_filter(spark, level):
    rng = np.random.default_rng(7)
    ps = [0.0, 1.0, None, *(float(p) for p in rng.random(3000) ** 4), *[0.002] * 50, 1e-300, 5e-324]
    df = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(ps)], "feature string, p double")
    cut = by_numpy(ps, level)
    want = {f"f{i}" for i, p in enumerate(ps) if p is not None and p <= cut}
    assert names(select.select_by_fdr(df, fdr_level=level)) == want


def test_false_discovery_filter_grows_with_the_level(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(f"f{i}", float(p)) for i, p in enumerate(rng.random(300) ** 6)], "feature string, p double")
    kept = [names(select.select_by_fdr(df, fdr_level=level)) for level in (0.01, 0.1, 0.5)]
    assert kept[0] <= kept[1] <= kept[2]
    assert names(select.select_by_fdr(df.withColumn("p", F.lit(1.0)), fdr_level=0.05)) == set()


def test_harmonic_numbers(spark):
    for m in (1, 2, 1000, 1001, 50_000):
        got = spark.range(1).select(select.harmonic(F.lit(m).cast("long"))).first()[0]
        assert got == pytest.approx((1 / np.arange(1, m + 1)).sum(), rel=1e-12)


@pytest.mark.parametrize("blocks", [None, 1, 2, 5])
def test_correlation_filter_is_not_greedy(spark, blocks):
    rng = np.random.default_rng(2)
    a, e = rng.normal(size=12), rng.normal(size=12)
    features = {"x1": a, "x2": a + 0.5 * e, "x3": a + 1.4 * e, "x4": -a, "flat": np.ones(12), "x5": rng.normal(size=12)}
    m = np.array([features[k] for k in features])
    with np.errstate(all="ignore"):
        r = np.abs(np.corrcoef(m))
    want = {k for j, k in enumerate(features) if not any(r[i, j] > 0.85 for i in range(j))}
    assert r[1, 2] > 0.85 > r[0, 2] and "x3" not in want  # dropped because of x2, which is itself dropped
    assert names(select.drop_correlated(packed(spark, features), blocks=blocks)) == want


def test_variance_ties_keep_the_first_column(spark):
    base = np.array([1.0, -1, 1, -1, 1, -1, 1, -1, 1, -1])
    cols = packed(spark, {"a": base, "b": 2 * base, "c": 2 * base, "d": 2 * base})
    top = select.top_variance(cols, max_feature_ratio=0.2, parts=3)
    assert [(r["feature"], r["rank"]) for r in top.orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    everything = select.top_variance(cols, max_feature_ratio=0.4)
    assert [r["feature"] for r in everything.orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_impute(spark):
    inf = float("inf")
    cols = packed(spark, {"a": [1, None, 3, inf, -inf, 10], "none": [None, inf, -inf, None, None, None], "nan": [float("nan"), 2, 4, 4, 4, 4]})
    got = {r["feature"]: r["xs"] for r in columns.impute(cols).collect()}
    assert got == {"a": [1, 3, 3, 10, 1, 10], "none": [0] * 6, "nan": [4, 2, 4, 4, 4, 4]}


def test_standardise(spark):
    x = np.array([1.0, 2, 4, 8])
    got = {r["feature"]: r["xs"] for r in columns.standardise(packed(spark, {"x": x, "flat": [3, 3, 3, 3]})).collect()}
    np.testing.assert_allclose(got["x"], (x - x.mean()) / x.std())
    assert got["flat"] == [0, 0, 0, 0]


def pca_by_svd(m, variance=0.95, ratio=0.8):
    z = (m - m.mean(axis=0)) / m.std(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    shares = s ** 2 / (s ** 2).sum()
    k = min(max(int(len(m) * ratio), 2), int(np.searchsorted(np.cumsum(shares), variance, side="right")) + 1, len(s))
    signs = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    return u[:, :k] * s[:k] * signs, shares[:k]


@pytest.mark.parametrize("p, keyed", [(5, False), (40, False), (30, True)])
def test_pca_matches_svd(spark, p, keyed):
    m = np.random.default_rng(p).normal(size=(12, p)) @ np.diag(np.linspace(3, 0.1, p))
    m[:, 1] += 2 * m[:, 0]
    cols = packed(spark, {f"f{j:02d}": m[:, j] for j in range(p)}, key="a" if keyed else None)
    if keyed:
        other = packed(spark, {f"f{j}": np.random.default_rng(j).normal(size=12) for j in range(3)}, key="b")
        cols = cols.unionByName(other)
    out = reduce.pca(cols, ["k"] if keyed else [])
    want, shares = pca_by_svd(m)
    explained, wide = out.explained, reduce.scores_wide(out, ["k"] if keyed else [])
    if keyed:
        explained, wide = explained.filter("k = 'a'"), wide.filter("k = 'a'")
    got = np.array([[r[f"PCA_{i + 1}"] for i in range(want.shape[1])] for r in wide.orderBy("date").collect()], float)
    np.testing.assert_allclose(got, want, atol=1e-8)
    np.testing.assert_allclose([r["ratio"] for r in explained.orderBy("component").collect()], shares)


def test_misaligned_features_are_refused(spark):
    cols = packed(spark, {"a": [1, 2, 3], "b": [1, 2, 4, 5]})
    with pytest.raises(Exception, match="share their dates"):
        select.drop_correlated(cols).collect()


def test_rows_with_one_target_get_the_p_values_of_each_alone():
    rng = np.random.default_rng(12)
    for n in (2, 3, 7, 40, 65):
        for y in (rng.integers(0, 4, n).astype(float), rng.normal(size=n), np.zeros(n)):
            x = np.concatenate([rng.integers(0, k, (20, n)).astype(float) for k in (1, 2, 3, 9)] + [rng.normal(size=(20, n)), y[None, :], -y[None, :]])
            want = [association(a, y) for a in x]
            np.testing.assert_allclose(association_rows(x, y), want, rtol=1e-12)


def test_gram_is_summed_over_tasks_and_entities(spark, monkeypatch):
    monkeypatch.setattr(reduce, "HELD", 20)
    rng = np.random.default_rng(3)
    values = {(k, f): rng.normal(size=5) for k in "abc" for f in range(40)}
    rows = [(k, f"f{f}", v.tolist()) for (k, f), v in values.items()]
    df = spark.createDataFrame(rows, "k string, feature string, xs array<double>").repartition(6)
    for r in reduce.gram(df, ["k"]).collect():
        assert r.v == pytest.approx(sum(values[r.k, f][r.i] * values[r.k, f][r.j] for f in range(40)))
    assert reduce.gram(df.limit(0)).count() == 0


def test_signs_do_not_depend_on_the_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cols = packed(spark, {f"f{j:02d}": rng.normal(size=9) for j in range(25)})
    want = sorted(map(tuple, reduce.pca(cols).scores.collect()))
    monkeypatch.setattr(reduce, "BATCH", 4)
    got = sorted(map(tuple, reduce.pca(cols).scores.collect()))
    np.testing.assert_allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


def test_correlation_filter_skips_blocks_that_are_too_far_apart(spark, monkeypatch):
    """Noisy copies of a few shapes: most pairs of blocks cannot hold a close pair, and none is lost."""
    monkeypatch.setattr(select, "BLOCK", 20)
    rng = np.random.default_rng(11)
    shapes = rng.normal(size=(12, 40))
    m = np.concatenate([sign * s + 0.25 * rng.normal(size=(25, 40)) for s in shapes for sign in (1, -1)])
    order = rng.permutation(len(m))
    features = {f"f{i:04d}": m[at] for i, at in enumerate(order)}
    r = np.abs(np.corrcoef(np.array(list(features.values()))))
    want = {k for j, k in enumerate(features) if not (r[:j, j] > 0.85).any()}
    cols = packed(spark, features)
    assert 12 <= len(want) < len(features)
    assert names(select.drop_correlated(cols)) == want
    scaled = select._unit_vectors(cols.withColumn("e", F.lit(0)), ["e"], [c for c in select.ORDER if c in cols.columns])
    pairs = select.block_pairs(select._blocked(scaled, ["e"], None), ["e"], 0.85)
    total, near = pairs.count(), pairs.filter("near").count()
    assert total > 300 and near < total / 3


def test_found_features_are_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(select, "BLOCK", 20)
    rng = np.random.default_rng(13)
    shapes = rng.normal(size=(30, 8))
    m = np.concatenate([shapes, *(s + 0.02 * rng.normal(size=(20, 8)) for s in shapes)])
    features = {f"f{i:04d}": m[at] for i, at in enumerate(rng.permutation(len(m)))}
    r = np.abs(np.corrcoef(np.array(list(features.values()))))
    want = {k for j, k in enumerate(features) if not (r[:j, j] > 0.6).any()}
    sent, kind = spark.sparkContext.accumulator(0), type(spark.range(0).groupBy("id"))

    def counted(self, run, schema, of=kind.applyInPandas):
        def marked(pdf):
            sent.add(len(pdf))
            return run(pdf)

        return of(self, marked, schema)

    monkeypatch.setattr(kind, "applyInPandas", counted)
    assert names(select.drop_correlated(packed(spark, features), cut=0.6)) == want and len(want) < 20
    assert len(m) < sent.value < 8 * len(m)


@pytest.mark.parametrize("cut", [0.0, 0.3, 0.999, 1.0])
def test_block_ranges_lose_no_close_pair(spark, monkeypatch, cut):
    monkeypatch.setattr(select, "BLOCK", 7)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(30, 5))
    features = {f"f{i:03d}": x for i, x in enumerate(np.concatenate([base, 3 * base + 1, -base + 1e-3 * rng.normal(size=base.shape)]))}
    z = np.array([(x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).sum()) for x in features.values()])
    r = np.abs(z @ z.T)
    got = names(select.drop_correlated(packed(spark, features), cut=cut))
    for j, k in enumerate(features):
        if not np.any(np.abs(r[:j, j] - cut) < 1e-9):  # a tie with the cut is a matter of rounding
            assert (k in got) == (not (r[:j, j] > cut).any())
