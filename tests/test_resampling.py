"""Ranks by ranges of values, and resampled statistics against plain computations with the same draws."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clustering as C
from cohortlens.operators import kernels as K
from cohortlens.operators import rank as R
from cohortlens.operators import resampling as Q
from cohortlens.operators import scorers as T

RNG = np.random.default_rng(3)
ROWS = [(g, i, float(x), float(y)) for g, n in (("a", 41), ("b", 6), (None, 12)) for i, (x, y) in enumerate(zip(RNG.integers(0, 9, n), RNG.normal(size=n).round(1), strict=True))]
ROWS += [("a", 90, None, 1.0), ("a", 91, 2.0, float("nan")), ("c", 0, 1.0, 2.0), ("c", 1, 1.0, 3.0), ("d", 0, None, 1.0)]
SCHEMA = "g string, row long, x double, y double"


@pytest.fixture(scope="module")
def pairs(spark):
    return C.stored(spark.createDataFrame(ROWS, SCHEMA))


def frames():
    out = {}
    for g in ("a", "b", None, "c"):
        out[g] = pd.DataFrame([r for r in ROWS if r[0] == g], columns=["g", "row", "x", "y"]).dropna(subset=["x", "y"]).reset_index(drop=True)
    return out


@pytest.mark.parametrize("rows", [1, 7, 1000])
@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_by_ranges_equal_windows(pairs, rows, by):
    got = {(r["g"], r["row"]): r["rank"] for r in R.with_ranks(pairs, by, "x", rows=rows).collect()}
    want = {(r["g"], r["row"]): r["rank"] for r in pairs.withColumn("rank", R.avg_rank(by, "x")).collect()}
    assert got == want and len(got) == len(ROWS)


def test_no_window_holds_all_rows_of_one_unit(pairs):
    many = pairs.sparkSession.range(5000).select((F.col("id") % 1000).alias("v"))
    cut = R.ranged(many, [], "v", rows=500)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 800
    got = {r["v"]: r["rank"] for r in R.value_ranks(cut, [], "v").collect()}
    assert got == {v: 5 * v + 3.0 for v in range(1000)}


def test_auc_and_ladder_without_a_unit(spark):
    rows = [(float(s), int(y)) for s, y in zip(RNG.integers(0, 20, 200), RNG.integers(0, 2, 200), strict=True)] + [(None, 1)]
    out = T.auc(spark.createDataFrame(rows, "s double, y int"), [], "s", F.col("y") == 1).first()
    held = [r for r in rows if r[0] is not None]
    ranks = pd.Series([s for s, _ in held]).rank().to_numpy()
    y = np.array([v for _, v in held])
    u = ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2
    assert out["auc"] == pytest.approx(u / (y.sum() * (1 - y).sum())) and out["n1"] == y.sum()


def test_draws_are_those_of_clustering(spark):
    df = spark.createDataFrame([(i,) for i in (-3, 0, 1, 7, 2**31, 2**40 + 5)], "row long")
    for start, step in ((0, 0), (3, 2), (1999, 0)):
        got = [r["u"] for r in df.select("row", Q.draw_column(F.col("row"), F.lit(start), step, 49).alias("u")).collect()]
        assert got == C.draw(np.array([r["row"] for r in df.collect()]), start, step, 49).tolist()


def weighted(v, w):
    return np.array([w[v < x].sum() + (w[v == x].sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("rows", [5, 10**6])
def test_bootstrap_equals_rows_repeated(pairs, rows):
    """Weights as repeated rows, ranked by pandas."""
    out = {r["g"]: r for r in Q.bootstrap_spearman(pairs, ["g"], "row", draws=60, range_rows=rows).collect()}
    assert set(out) == {"a", "b", None, "c"}
    for g, df in frames().items():
        rho = []
        for r in range(61):
            w = np.ones(len(df), int) if r == 0 else np.array([sum(u >= e for e in Q.poisson_steps()) for u in C.draw(df["row"].to_numpy(), r, 0, 49)])
            again = df.loc[np.repeat(df.index, w)]
            a, b = again["x"].rank(), again["y"].rank()
            rho.append(np.corrcoef(a, b)[0, 1] if a.nunique() > 1 and b.nunique() > 1 else np.nan)
            assert np.allclose(weighted(df["x"].to_numpy(), w)[w > 0], again["x"].rank().groupby(level=0).first())
        got = out[g]
        assert got["n"] == len(df)
        if g == "c":  # x is constant
            assert got["spearman"] is None and got["ci_lo"] is None
            continue
        assert got["spearman"] == pytest.approx(rho[0])
        assert (got["ci_lo"], got["ci_hi"]) == pytest.approx(tuple(np.nanquantile(rho[1:], [0.025, 0.975])))


def test_weights_are_poisson():
    u = C.draw(np.arange(200_000), 1, 0, 49)
    w = np.searchsorted(Q.poisson_steps(), u, side="right")
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def test_shuffles_are_bijections_and_spread_evenly():
    for n in (1, 2, 3, 7, 40):
        to = Q.shuffled(np.arange(n), np.full(n, n), *Q.keys_of(300, 49))
        assert all(sorted(x) == list(range(n)) for x in to)
    counts = np.array([np.bincount(c, minlength=7) for c in Q.shuffled(np.arange(7), np.full(7, 7), *Q.keys_of(7000, 49)).T])
    assert np.abs(counts - 1000).max() < 150
    orders = {tuple(x) for x in Q.shuffled(np.arange(4), np.full(4, 4), *Q.keys_of(2000, 49))}
    assert len(orders) == 24


@pytest.mark.parametrize("rows", [5, 10**6])
def test_permutations_equal_a_plain_count(pairs, rows):
    out = {r["g"]: r for r in Q.permutation_spearman(pairs, ["g"], "row", draws=80, range_rows=rows).collect()}
    assert set(out) == {"a", "b", None, "c"}
    for g, df in frames().items():
        df = df.sort_values("row")
        a, b, n = df["x"].rank().to_numpy(), df["y"].rank().to_numpy(), len(df)
        to = Q.shuffled(np.arange(n), np.full(n, n), *Q.keys_of(80, 49))
        null, centre = np.sort(b)[to] @ a, n * ((n + 1) / 2) ** 2
        assert out[g]["perm_p"] == pytest.approx((np.sum(np.abs(null - centre) >= abs(a @ b - centre)) + 1) / 81)
    assert out["c"]["perm_p"] == 1 and out["c"]["spearman"] is None


def test_permutation_p_is_near_the_exact_one(spark):
    x, y = np.arange(6.0), np.array([0.0, 2, 1, 3, 5, 4])
    exact = np.mean([abs(np.corrcoef(x, p)[0, 1]) >= abs(np.corrcoef(x, y)[0, 1]) - 1e-12 for p in itertools.permutations(y)])
    df = spark.createDataFrame([("u", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], SCHEMA)
    assert Q.permutation_spearman(df, ["g"], "row", draws=4000).first()["perm_p"] == pytest.approx(exact, abs=0.01)


def test_null_rand_equals_the_kernel(spark):
    rows = [(g, i, int(v)) for g, n in (("a", 40), (None, 9)) for i, v in enumerate(RNG.integers(0, 3, n))]
    out = Q.null_rand(spark.createDataFrame(rows, "g string, sample long, label int"), ["g"], draws=30, range_rows=8).collect()
    assert len(out) == 60
    for g in ("a", None):
        label = np.array([v for k, _, v in rows if k == g])
        to = Q.shuffled(np.arange(len(label)), np.full(len(label), len(label)), *Q.keys_of(30, 49))
        got = [r["ari"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["_draw"])]
        assert got == pytest.approx([K.ari(label, np.sort(label)[t]) for t in to])


def test_null_rand_makes_no_row_for_a_row_and_draw(spark, monkeypatch):
    """Some draws of a slice of a unit are counted where they are made."""
    monkeypatch.setattr(Q, "drawn", None)
    monkeypatch.setattr(Q, "SLICE", 16)
    rows = [(i, "xyz"[int(v)] if v < 3 else None) for i, v in enumerate(RNG.integers(0, 4, 70))]
    out = Q.null_rand(spark.createDataFrame(rows, "sample long, label string"), [], draws=230).collect()
    label = np.array(["xyz".find(v) if v else -1 for _, v in rows])
    to = Q.shuffled(np.arange(70), np.full(70, 70), *Q.keys_of(230, 49))
    assert [r["ari"] for r in sorted(out, key=lambda r: r["_draw"])] == pytest.approx([K.ari(label, np.sort(label)[t]) for t in to])


def test_nothing_gives_nothing(pairs):
    none = pairs.where("false")
    assert Q.bootstrap_spearman(none, ["g"], "row", draws=3).count() == 0
    assert Q.permutation_spearman(none, ["g"], "row", draws=3).count() == 0
    assert R.with_ranks(none, ["g"], "x").count() == 0
    assert Q.null_rand(none.select("g", F.col("row").alias("sample"), F.lit(1).alias("label")), ["g"], draws=3).count() == 0
