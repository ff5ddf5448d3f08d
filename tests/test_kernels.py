"""Kernels and distributions: identities, known values, recovery of planted structure."""

import math

import numpy as np
import pandas as pd
import pytest

from cohortlens.functions import distributions as D
from cohortlens.operators import kernels as K
from cohortlens.operators import learners as L


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(0)
    truth = np.repeat(np.arange(3), 30)
    layers = [rng.normal(size=(90, 20)) + 3 * np.eye(3)[truth] @ rng.normal(size=(3, 20)) for _ in range(2)]
    return truth, [K.standardised(x) for x in layers]


@pytest.mark.parametrize("method", sorted(set(L.METHODS) - {"snf", "snf_scaled"}))
def test_methods_find_planted_clusters(planted, method):
    truth, layers = planted
    found = L.METHODS[method](layers)
    label, _ = K.kmeans(K.standardised(found[:, :2] if method == "spectral" else found), 3)
    assert K.ari(label, truth) > 0.8


def test_fusion(planted):
    truth, layers = planted
    label, _ = K.kmeans(K.spectral(K.fused(layers), 2), 3)
    assert K.ari(label, truth) > 0.8
    np.testing.assert_allclose(K.fused(layers[:1]), K.knn_affinity(layers[0]))
    plain, scaled = (K.spectral(K.fused(layers), 3, scaled=s) for s in (False, True))
    sizes = np.linalg.norm(scaled, axis=0) / np.linalg.norm(plain, axis=0)  # the roots of the eigenvalues: at most 1, falling
    np.testing.assert_allclose(scaled, plain * sizes)
    assert 1 >= sizes[0] >= sizes[1] >= sizes[2] > 0


def test_weighted_and_plain_components_agree_after_scaling(planted):
    a, b = (K.standardised(K.layer_components(planted[1], weighted=w)) for w in (False, True))
    np.testing.assert_allclose(a, b, atol=1e-8)


def test_ari_properties():
    rng = np.random.default_rng(1)
    x, y = rng.integers(3, size=50), rng.integers(4, size=50)
    assert K.ari(x, x) == 1 and K.ari(np.zeros(5), np.zeros(5)) == 1 and K.ari(np.zeros(5), np.arange(5)) == 0
    assert math.isclose(K.ari(x, y), K.ari(y, (x + 1) % 3))


def test_auc_and_its_complement():
    rng = np.random.default_rng(2)
    s, y = rng.integers(5, size=60).astype(float), rng.integers(2, size=60)
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(K.auc(s, y), wins) and math.isclose(K.auc(-s, y), 1 - wins)


def test_linear_models_separate():
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1], 40)
    x = rng.normal(size=(80, 10)) + 2.5 * y[:, None] * (np.arange(10) < 2)
    for fit in (K.logistic, K.linear_svm):
        assert K.auc(K.out_of_fold(x, y, fit), y) > 0.95


def test_average_linkage_and_pca():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    label = K.average_linkage(np.abs(x - x.T), 3)
    assert label[0] == label[1] != label[2] == label[3] != label[4]
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 6)), rng.normal(size=(6, 30))
    for m in (a, b):
        scores, v, share = K.pca(m, 3)
        centred = m - m.mean(axis=0)
        np.testing.assert_allclose(np.abs(centred @ v), np.abs(scores), atol=1e-8)
        assert (np.diff(share) <= 1e-12).all()


def whole_matrix_linkage(d, k):
    """Every merge looks for the least distance in the whole matrix."""
    n = len(d)
    d, size, member = d.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    for _ in range(n - min(k, n)):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


@pytest.mark.parametrize("seed", range(6))
def test_linkage_looks_at_few_rows(seed, monkeypatch):
    """The merges are those of the whole matrix, ties included, without a search of it for each."""
    rng = np.random.default_rng(seed)
    d = rng.integers(1, 5, size=(60, 60)).astype(float) if seed % 2 else rng.random((60, 60))
    d = np.triu(d, 1) + np.triu(d, 1).T
    want, searched, plain = [whole_matrix_linkage(d, k) for k in (1, 4, 60)], [], np.argmin
    monkeypatch.setattr(np, "argmin", lambda a, *args, **kw: (searched.append(a.size), plain(a, *args, **kw))[1])
    assert all((K.average_linkage(d, k) == w).all() for k, w in zip((1, 4, 60), want, strict=True))
    assert all(size < 60 * 60 for size in searched)


def test_fusion_is_the_dense_recurrence_without_dense_factors(planted):
    xs = [*planted[1], planted[1][0][:, :5]]
    local = [K.knn_affinity(x, 10) for x in xs]
    np.testing.assert_allclose(K.times(K.levels(local[0]), xs[1], 7), local[0] @ xs[1], atol=1e-12)
    now = list(local)
    for _ in range(20):
        nxt = [s @ (sum(p for j, p in enumerate(now) if j != i) / 2) @ s.T for i, s in enumerate(local)]
        now = [(p + p.T) / 2 + np.eye(len(p)) * 1e-3 for p in nxt]
        now = [p / p.sum(axis=1, keepdims=True) for p in now]
    np.testing.assert_allclose(K.fused(xs), sum(now) / 3, atol=1e-12)


def test_harmonised_mixes_batches():
    rng = np.random.default_rng(5)
    batch = np.tile([0, 1], 60)
    x = rng.normal(size=(120, 12)) + 2.0 * batch[:, None]
    z = K.harmonised(x, batch, k=5)
    assert np.abs(z[batch == 0].mean(axis=0) - z[batch == 1].mean(axis=0)).max() < 0.3 * np.abs(K.pca(K.standardised(x), 5)[0][batch == 0].mean(axis=0)).max()


def test_distributions_known_values():
    np.testing.assert_allclose(D.normal_ppf(np.array([0.975, 0.5])), [1.959963984540054, 0], atol=1e-9)
    assert math.isclose(D.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(D.t_ppf(0.95, 21), 1.720742902811878, rel_tol=1e-7)
    assert math.isnan(D.t_two_sided(float("nan"), 3))


def test_errors_become_records(spark):
    rows = [("D", "A", i, "first", [float(i), 1.0]) for i in range(6)]
    out = L.transfer(spark.createDataFrame(rows, "domain string, cohort string, sample long, layer string, features array<double>"), ["domain"], "cohort", "kmeans").collect()
    assert len(out) == 3 and all(r["err"] and r["ari"] is None or math.isnan(r["ari"]) for r in out)


def test_power_and_bias():
    curve = pd.DataFrame(L.power_curve(0.15, (0.05,), (10, 50, 200)), columns=["d", "n", "p"])
    assert curve.p.is_monotonic_increasing
    bias = dict(L.selection_bias((2, 8)))
    assert abs(bias[2] - 0.5642) < 0.02 and abs(bias[8] - 1.4236) < 0.02


def test_kmeans_of_parts_is_kmeans_of_each_part():
    rng = np.random.default_rng(3)
    for n, d, apart in ((60, 5, 0), (300, 8, 3), (5, 2, 0)):
        x = rng.normal(size=(n, d)) + apart * rng.integers(3, size=n)[:, None]
        if n == 5:  # fewer distinct rows than clusters
            x[:] = x[0]
            x[1] += 1
        parts = [rng.permutation(n)[: n // 2] if i % 2 else rng.integers(n, size=n) for i in range(6)]
        for p, got, seed in zip(parts, K.kmeans_of_parts(x, parts, 3, list(range(6)), 3, rows=64), range(6), strict=True):
            want = K.kmeans(x[p], 3, seed, starts=3)[1]
            assert np.allclose(sorted(map(tuple, got.round(7))), sorted(map(tuple, want.round(7))), atol=1e-6)
