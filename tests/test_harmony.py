"""Correction of a large unit in passes over blocks against the kernel on the whole unit."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import harmony as H
from cohortlens.operators import kernels as K
from cohortlens.operators import learners as L


def test_a_large_unit_is_no_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) + 3 * rng.integers(3, size=(300, 1)) * np.array([1, 0, 2, 0, 1, 0])
    batch = rng.integers(2, size=300)
    x[batch == 1] += 1.5
    x[7, 2], x[:, 5] = np.nan, 4.0
    rows = [("big", i, [None if np.isnan(v) else float(v) for v in r], int(b)) for i, (r, b) in enumerate(zip(x, batch))]
    rows += [("small", i, r, b) for _, i, r, b in rows[:40]]
    df = spark.createDataFrame(rows, "unit string, sample long, features array<double>, batch int").repartition(5)
    grouped, calls = L.grouped, []
    monkeypatch.setattr(L, "SAMPLES", 100)
    monkeypatch.setattr(L, "grouped", lambda b, *a: calls.append(sorted(r[0] for r in b.select("unit").distinct().collect())) or grouped(b, *a))
    got = L.harmony(df, ["unit"], "batch").collect()
    assert calls == [["small"]]
    for unit, n in (("big", 300), ("small", 40)):
        y = np.array([r["features"] for r in sorted((r for r in got if r["unit"] == unit), key=lambda r: r["sample"])])
        # the sign of a component of no variance is that of rounding
        assert np.allclose(y, K.harmonised(x[:n], batch[:n], k=50), atol=2e-6)


def test_the_median_is_exact(spark):
    x = np.random.default_rng(6).normal(size=(5000, 3))
    blocks = H._packed(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "sample long, features array<double>, b int"), "b", {0: 0})
    for c in (x[:5], x[:4]):
        assert np.isclose(H._median(blocks, 3, c, len(x)), np.median(K.distances2(x, c)), rtol=1e-12)
    assert H._median(blocks.where(F.lit(True)), 3, np.zeros((1, 3)), len(x)) > 0
