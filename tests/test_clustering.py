"""k-means of many units at once, and transfers built on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clustering as C
from cohortlens.operators import kernels as K
from cohortlens.operators import learners as L
from cohortlens.plans import experiment as B
from cohortlens.plans import fixtures as X

POINTS = "unit string, sample long, features array<double>"


def groups(seed, n, d, k, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(k, d)) * 3
    return centre[rng.integers(k, size=n)] + rng.normal(size=(n, d)) * spread


def frame(spark, units):
    return spark.createDataFrame([(u, i, x.tolist()) for u, xs in units.items() for i, x in enumerate(xs)], POINTS)


def models(df):
    return {(r["unit"], r["k"]): (r["cost"], np.array(r["centroids"])) for r in df.collect()}


def test_costs_are_those_of_the_kernel(spark, sf_dir):
    points = C.standard_points(X.blocks(spark, sf_dir), ["cohort"]).withColumnRenamed("cohort", "unit")
    got, held = models(C.fit(points, ["unit"], (3, 5))), points.toPandas()
    for u in ("A", "B"):
        x = np.array(held[held["unit"] == u]["features"].tolist())
        for k in (3, 5):
            _, c = K.kmeans(x, k, starts=20)
            want = K.distances2(x, c).min(axis=1).sum()
            assert got[u, k][0] <= 1.01 * want
            assert np.isclose(got[u, k][0], K.distances2(x, got[u, k][1]).min(axis=1).sum())


def test_planted_groups_are_found_in_every_unit(spark):
    units = {f"u{i}": groups(i, 150 + 40 * i, 6, 4) for i in range(5)}
    points = frame(spark, units)
    whole = models(C.fit(points, ["unit"], (2, 4), starts=6))
    assert set(whole) == {(u, k) for u in units for k in (2, 4)}
    for u, x in units.items():
        _, c = K.kmeans(x, 4, starts=20)
        assert np.isclose(whole[u, 4][0], K.distances2(x, c).min(axis=1).sum(), rtol=1e-6)
    # a pass that carries one unit at a time, and other partitions, change nothing
    for other in (C.fit(points, ["unit"], (2, 4), starts=6, model_bytes=1), C.fit(points.repartition(7), ["unit"], (2, 4), starts=6)):
        again = models(other)
        assert all(np.isclose(again[m][0], whole[m][0], rtol=1e-9) and np.allclose(again[m][1], whole[m][1]) for m in whole)


def test_no_group_holds_a_unit(spark, sf_dir, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a unit was grouped")

    monkeypatch.setattr(L, "grouped", refuse)
    out = L.transfer(X.blocks(spark, sf_dir), ["domain"], "cohort", "kmeans", steps=3)
    assert out.count() == 3
    points = C.standard_points(X.blocks(spark, sf_dir), ["domain", "cohort"])
    assert "FlatMapGroups" not in points._jdf.queryExecution().executedPlan().toString()


def test_few_and_equal_points(spark):
    units = {"one": np.ones((1, 2)), "same": np.ones((9, 2)), "two": np.array([[0.0, 0.0]] * 4 + [[1.0, 0.0]] * 3)}
    got = models(C.fit(frame(spark, units), ["unit"], (3,), starts=2))
    assert {u: len(c) for (u, _), (_, c) in got.items()} == {"one": 1, "same": 1, "two": 2}
    assert all(abs(cost) < 1e-9 for cost, _ in got.values())
    assert C.fit(frame(spark, {}), ["unit"], (3,)).collect() == []


def test_labels_are_of_the_nearest_centroid(spark):
    x = groups(3, 80, 4, 3)
    points = frame(spark, {"u": x})
    fitted = C.fit(points, ["unit"], (3,), starts=4)
    (_, c), rows = models(fitted)["u", 3], C.assigned(points, fitted, ["unit"]).collect()
    assert [r["label"] for r in sorted(rows, key=lambda r: r["sample"])] == K.distances2(x, c).argmin(axis=1).tolist()


def test_draws_are_spread_evenly():
    u = np.stack([C.draw(np.arange(20_000), s, t, 49) for s in range(3) for t in range(3)])
    assert abs(u.mean() - 0.5) < 0.01 and u.min() >= 0 and u.max() < 1
    assert np.abs(np.corrcoef(u) - np.eye(len(u))).max() < 0.05


def test_points_need_every_layer_and_hold_no_gap(spark):
    rows = [("u", 1, "a", [1.0, 5.0]), ("u", 1, "b", [2.0]), ("u", 2, "a", [3.0, 5.0]), ("u", 2, "b", [float("nan")]), ("u", 3, "a", [8.0, 5.0]), ("u", 4, "a", [None, 5.0]), ("u", 4, "b", [6.0]), ("u", 4, "b", [7.0])]
    got = {r["sample"]: r["features"] for r in C.standard_points(spark.createDataFrame(rows, "unit string, sample long, layer string, features array<double>"), ["unit"]).collect()}
    # samples 1, 2 and 4: the flat feature is 0, the missing values too; the smaller of the repeated rows counts
    assert got == {1: pytest.approx([-1.0, 0.0, -1.0]), 2: pytest.approx([1.0, 0.0, 0.0]), 4: pytest.approx([0.0, 0.0, 1.0])}


# ---------- transfers


def two_sides(spark, units):
    rows = [(u, side, i, layer, part.tolist()) for u, sides in units.items() for side, x in sides.items() for i, v in enumerate(x) for layer, part in (("first", v[:3]), ("second", v[3:]))]
    return spark.createDataFrame(rows, "domain string, cohort string, sample long, layer string, features array<double>")


def test_transfer_of_the_same_structure_and_of_none(spark):
    rng = np.random.default_rng(1)
    same = groups(2, 240, 6, 3)
    blocks = two_sides(spark, {"same": {"A": same[:120], "B": same[120:]}, "noise": {"A": rng.normal(size=(60, 6)), "B": rng.normal(size=(70, 6))}, "alone": {"A": same[:40]}})
    got = {(r["domain"], r["method"], r["k"]): r for r in L.transfers(blocks, ["domain"], "cohort", ["kmeans", "pca"], (3,), starts=5, steps=20).collect()}
    assert len(got) == 6
    assert got["same", "kmeans", 3]["ari"] == got["same", "pca", 3]["ari"] == 1.0
    assert abs(got["noise", "kmeans", 3]["ari"]) < 0.5 and got["noise", "kmeans", 3]["n_b"] == 70
    for m in ("kmeans", "pca"):
        r = got["alone", m, 3]
        assert r["ari"] is None and r["err"] == "needs two sides, has 1" and r["n_a"] == 0
    mine = {r["k"]: r["ari"] for r in L.transfer(blocks.where("domain = 'same'"), ["domain"], "cohort", "pca", (2, 3), reference="self", starts=5).collect()}
    assert mine[3] == 1.0


def test_a_failing_method_is_a_record(spark, monkeypatch):
    same = groups(2, 60, 6, 3)

    monkeypatch.setitem(L.METHODS, "broken", lambda xs: 1 / 0)
    blocks = two_sides(spark, {"d": {"A": same[:30], "B": same[30:]}})
    got = {r["method"]: r for r in L.transfers(blocks, ["domain"], "cohort", ["kmeans", "broken"], (2,), starts=2, steps=4).collect()}
    assert got["broken"]["err"] == "division by zero" and got["broken"]["ari"] is None
    assert got["kmeans"]["err"] is None and got["kmeans"]["ari"] is not None


def test_the_grid_skips_small_units_with_a_record(spark):
    same = groups(4, 90, 6, 2)
    blocks = two_sides(spark, {"d": {"A": same[:40], "B": same[40:80], "C": same[80:]}})
    got = B.benchmark(blocks, "cohort", ["kmeans"], (2,), least_samples=20, least_features=2)
    err = {(r["pair"], r["subset"]): r["err"] for r in got.collect()}
    assert {p for (p, _), e in err.items() if e is None} == {"AxB"} and len(err) == 9
    assert {e for e in err.values() if e} == {"fewer complete samples on a side than 20"}
    few = B.benchmark(blocks.where(F.col("cohort") != "C"), "cohort", ["kmeans"], (2,), least_features=50)
    assert {r["err"] for r in few.collect()} == {"fewer features in a layer than 50"}
