"""Steps whose work must not gather in one task or grow faster than the input."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import kernels as K
from cohortlens.operators import learners as L
from cohortlens.operators import matrix as M
from cohortlens.operators import relational as J
from cohortlens.operators import scorers as T
from cohortlens.sources import matrix as FM


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(c, int(s), layer, rng.normal(s % 3, 1, 4).tolist()) for c in "AB" for s in range(40) for layer in ("one", "two")]
    return spark.createDataFrame(rows, "cohort string, sample long, layer string, features array<double>")


@pytest.mark.parametrize("kind", ["split", "bootstrap"])
def test_draws_are_shared_out(blocks, kind):
    """Groups of two draws and all draws in one group agree with the kernel over the whole unit."""
    held = {n: sorted(map(tuple, L.resampled_ari(blocks, ["cohort"], 3, kind, 7, together=n).collect())) for n in (2, 7)}
    assert held[2] == held[7] and [r[:2] for r in held[2]] == [("A", 7), ("B", 7)]
    own = blocks.where("cohort = 'A'").toPandas()
    x, values = np.hstack(L.layers_of(own)[1]), []
    for r in range(7):
        rng = np.random.default_rng([49, r])
        order = rng.permutation(len(x)) if kind == "split" else None
        parts = (order[:20], order[20:]) if kind == "split" else tuple(rng.integers(len(x), size=len(x)) for _ in range(2))
        fits = [K.kmeans(x[p], 3, 49 + 1000 * i, starts=3)[1] for i, p in enumerate(parts)]
        values.append(K.ari(*(K.distances2(x, c).argmin(axis=1) for c in fits)))
    assert held[2][0][2:] == pytest.approx((np.mean(values), np.std(values), *np.quantile(values, [0.95, 0.99])), abs=6e-5)


def test_parts_of_a_unit_lie_in_several_tasks(blocks):
    at = L.shared_out(blocks, ["cohort"], "_part", 12).select("cohort", "_part", F.spark_partition_id().alias("task")).distinct()
    assert at.count() == 24 and at.select("task").distinct().count() >= 12


def test_a_sample_is_sent_a_bounded_number_of_times(spark):
    """Every two blocks meet once, in at most ``most`` blocks a unit; small vectors make no more."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(i), rng.normal(size=3).tolist()) for i in range(200)], "sample long, features array<double>")

    def work(i, x, j, y, first):
        own = i[:, None] < j[None, :] if first["p"] == first["q"] else np.ones((len(i), len(j)), dtype=bool)
        return {"rows": np.array([len(i)]), "pairs": np.array([own.sum()])}

    for most in (3, 7):
        met = M.two_blocks(df, [], work, "rows long, pairs long", "features", "sample", most=most, least_rows=10).collect()
        assert len(met) <= most * (most + 1) / 2 and sum(r["pairs"] for r in met) == 200 * 199 / 2


def test_neighbours_and_median_with_copies_and_long_vectors(spark):
    """Copies lie at 0 from each other, ties go by id, and a vector far from the origin loses no digits."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(30, 9))] * 3) + np.r_[1e5, np.zeros(8)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "sample long, features array<double>")
    d = M.between(x, x)
    want = {i: [int(j) for j in np.lexsort((np.arange(90), d[i])) if j != i][:6] for i in range(90)}
    got = {}
    for r in M.nearest_samples(df, 6).orderBy("i", "place").collect():
        assert r["distance"] == d[r["i"], r["j"]]
        got.setdefault(r["i"], []).append(r["j"])
    assert got == want
    for bins in (8, 4096):
        assert M.median_distance(df, bins=bins).first()["sigma"] == pytest.approx(np.median(d[d > 0]), abs=1e-8)


def test_samples_with_the_same_labels_are_one_row(spark, monkeypatch):
    """Counts of all pairs, from as many rows as there are different rows of labels; equal to a count pair by pair."""
    rng = np.random.default_rng(8)
    kinds = np.where(rng.random((9, 6)) < 0.3, np.nan, rng.integers(3, size=(9, 6)))
    x = kinds[rng.integers(9, size=60)]
    rows = [(r, s, int(x[s, r])) for s in range(60) for r in range(6) if not np.isnan(x[s, r])]
    met = []
    real = T.two_blocks
    monkeypatch.setattr(T, "two_blocks", lambda blocks, *a, **k: met.append(blocks.count()) or real(blocks, *a, **k))
    got = T.pac(spark.createDataFrame(rows, "replicate int, sample int, label int")).first()
    c = [np.nanmean(np.where(np.isnan(x[i]) | np.isnan(x[j]), np.nan, x[i] == x[j])) for i in range(60) for j in range(i) if (~np.isnan(x[i]) & ~np.isnan(x[j])).any()]
    c = np.array(c)
    assert met[0] <= 9 and got["n_pairs"] == len(c)
    assert [got[n] for n in ("pac", "strong", "weak", "median_consensus")] == pytest.approx([((c > 0.1) & (c < 0.9)).mean(), (c > 0.9).mean(), (c < 0.1).mean(), np.median(c)])


def test_lines_of_a_gzipped_matrix_are_dealt_to_tasks(spark, tmp_path):
    """One task reads the file; its cells are made in others."""
    lines = ["ID\t" + "\t".join(f"s{i}" for i in range(30))] + [f"g{f}\t" + "\t".join(str(f * 100 + i) for i in range(30)) for f in range(40)]
    (tmp_path / "m.txt.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    out = FM.read_matrix(spark, str(tmp_path / "m.txt.gz"))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["feature"], r["sample"]): r["value"] for r in out.collect()} == {(f"g{f}", f"s{i}"): f * 100 + i for f in range(40) for i in range(30)}


@pytest.mark.parametrize("odd", [None, "gap", "group"])
def test_correlations_of_groups_equal_all_pairs(spark, monkeypatch, odd):
    """Sums of unit vectors give what all pairs give, a flat sample included; only gaps and missing groups need the pairs."""
    rng = np.random.default_rng(9)
    rows = [(int(s), int(s) % 3, ([2.0] * 6 if s == 4 else rng.normal(s % 3, 1, 6).tolist())) for s in range(25)]
    if odd == "gap":
        rows[7][2][3] = None
    if odd == "group":
        rows[7] = (7, None, rows[7][2])
    df = spark.createDataFrame(rows, "sample long, grp long, features array<double>")
    made, real = [], M.correlation_network
    monkeypatch.setattr(M, "correlation_network", lambda *a, **k: made.append(1) or real(*a, **k))
    got = {(r["group_a"], r["group_b"]): r for r in M.group_correlations(df, "grp").collect()}
    assert bool(made) == bool(odd)
    want = {}
    for i, (_, g, x) in enumerate(rows):
        for _, h, y in rows[:i]:
            pair = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
            r = np.corrcoef(*np.array(pair).T)[0, 1] if len({tuple(x), (2.0,) * 6, tuple(y)}) == 3 else None
            key = (g if h is None else h, None) if None in (g, h) else (min(g, h), max(g, h))
            want.setdefault(key, []).append(r)
    assert set(got) == set(want)
    for key, rs in want.items():
        known = [r for r in rs if r is not None]
        assert (got[key]["n_pairs"], got[key]["n"]) == (len(rs), len(known)) and got[key]["total"] == pytest.approx(sum(known))


def test_pairs_of_boxes_are_not_shuffled(spark):
    """Nothing follows the join of cells, and every pair comes once, whichever cells two boxes share."""
    rng = np.random.default_rng(4)
    at, size = rng.integers(-30, 30, (80, 2)), rng.integers(1, 15, (80, 2))
    rows = [(i, "s", *map(int, (*p, *(p + q)))) for i, (p, q) in enumerate(zip(at, size, strict=True))]
    out = J.boxes_overlap(spark.createDataFrame(rows, "id int, sheet string, x0 int, y0 int, x1 int, y1 int"), ["sheet"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [sheet" not in plan and "Distinct" not in plan
    want = {}
    for i, (p, q) in enumerate(zip(at, at + size, strict=True)):
        for j in range(i):
            side = np.minimum(q, at[j] + size[j]) - np.maximum(p, at[j])
            share = side.prod() / min(size[i].prod(), size[j].prod()) if (side > 0).all() else 0
            if share > 0.12:
                want[j, i] = share
    got = [(r["a_id"], r["b_id"], r["share"]) for r in out.collect()]
    assert len(got) == len(want) and {g[:2]: g[2] for g in got} == pytest.approx(want)


@pytest.mark.parametrize("around", [0.01, -0.4])
def test_neighbours_and_median_in_common_passes(spark, around):
    """Equal to the separate passes with several blocks, copies and a bracket that misses the middle."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 4))
    x[100:160] = x[0]
    df = spark.createDataFrame([("u" if i < 1400 else "v", i, v.tolist()) for i, v in enumerate(x)], "unit string, sample long, features array<double>").cache()
    near, sigma = M.near_and_median(df, 6, ["unit"], around=around)
    want = {(r["unit"], r["i"], r["place"]): (r["j"], r["distance"]) for r in M.nearest_samples(df, 6, ["unit"]).collect()}
    assert {(r["unit"], r["i"], r["place"]): (r["j"], r["distance"]) for r in near.collect()} == want
    got = {r["unit"]: r["sigma"] for r in sigma.collect()}
    for unit, own in (("u", x[:1400]), ("v", x[1400:])):
        d = np.round(np.sqrt(((own[:, None] - own[None]) ** 2).sum(axis=2)), 9)
        assert got[unit] == pytest.approx(np.median(d[d > 0]), abs=1e-8)


def test_boxes_of_the_same_corners_are_compared_once(spark):
    """Copies of boxes are a class: the join of cells has a row for two classes, the result for two boxes."""
    corners = [(0, 0, 4, 4), (1, 1, 5, 5), (20, 20, 24, 24)]
    rows = [(i, "s", *corners[i % 3]) for i in range(30)]
    boxes = spark.createDataFrame(rows, "id int, sheet string, x0 int, y0 int, x1 int, y1 int")
    for together in (512, 4):
        out = J.boxes_overlap(boxes, ["sheet"], places=4, together=together)
        got = {(r["a_id"], r["b_id"]): r["share"] for r in out.collect()}
        want = {(i, j): 1.0 if i % 3 == j % 3 else 0.5625 for i in range(30) for j in range(i + 1, 30) if i % 3 == j % 3 or {i % 3, j % 3} == {0, 1}}
        assert out.count() == len(got) and got == want
    assert "Generate explode(a_ids" in out._jdf.queryExecution().optimizedPlan().toString()
