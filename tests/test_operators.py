"""Relational, rank, matrix and scoring operators on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import matrix as M
from cohortlens.operators import rank as R
from cohortlens.operators import relational as J
from cohortlens.operators import scorers as T
from cohortlens.plans import experiment as B


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (S.clean_id, ' "ab" ', "ab"),
        (S.first_of, "a;b", "a"),
        (S.sample_barcode, "TCGA-AB-1234-01A", "TCGA-AB-1234"),
        (S.sample_barcode, " x1 ", "x1"),
        (S.case_id, " c3l-001-a", "C3L-001"),
        (S.subset_key, "z+x + a", "a+x+z"),
        (S.pair_key, " dis × ind ", "disxind"),
        (S.id_kind, "ENSG0001", "ensembl"),
        (S.id_kind, "cg00000029", "cpg"),
        (S.id_kind, "?", "other"),
        (S.plain_number, "−1.500", "-1.5"),
        (S.number, "nan", None),
        (S.number, "x", None),
        (S.number, "1e2", 100.0),
        (lambda t: S.decoded(t, {"a": "b"}), "a", "b"),
        (lambda t: S.decoded(t, {"a": "b"}), "z", "z"),
        (lambda t: S.domain_token(t, "CPTAC"), "x CPTAC y", "A"),
    ],
)
def test_scalar_functions(spark, column, text, want):
    assert one(spark, column(F.col("t")), t=text) == want


def test_null_safe_flags_and_degeneracy(spark):
    df = spark.createDataFrame([(1, "+"), (2, None), (3, "")], "i int, f string")
    assert {r["i"] for r in J.keep_unflagged(df, "f").collect()} == {2, 3}
    r = spark.createDataFrame([(0.5, None), (0.4, 0), (0.3, 1), (None, 0)], "ari double, degen int")
    assert J.not_degenerate(r, True).count() == 1 and J.not_degenerate(r, False).count() == 2


def test_relational_division_and_difference(spark):
    p = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "g string, s int")
    assert [r["s"] for r in J.in_all(p, "s", "g").collect()] == [1]
    out = J.only_on_one_side(p.where("g = 'a'"), p.where("g = 'b'"), ["s"]).collect()
    assert [(r["s"], r["side"]) for r in out] == [(2, "left")]


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("u", 1.0), ("u", 1.0), ("u", 3.0), ("u", None)], "g string, v double")
    got = sorted((r["v"] is None, r["r"]) for r in df.withColumn("r", R.avg_rank(["g"], "v")).select("v", "r").collect() if r["v"] is not None)
    assert [x for _, x in got] == [1.5, 1.5, 3.0]
    assert df.withColumn("r", R.avg_rank(["g"], "v")).where("v is null").first()["r"] is None


def test_quartiles_close_on_the_right(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double")
    assert sorted((r["v"], r["quartile"]) for r in R.quartile(df, "v").collect()) == [(float(i), (i + 1) // 2) for i in range(1, 9)]


def test_quantile_normalised_samples_share_values(spark):
    df = spark.createDataFrame([("c", "l", f, s, float((f * 7 + s * 3) % 11)) for f in range(6) for s in range(4)], "cohort string, layer string, feature int, sample int, value double")
    per = {}
    for r in R.quantile_normalise(df).collect():
        per.setdefault(r["sample"], []).append(round(r["normalised"], 9))
    assert len({tuple(sorted(v)) for v in per.values()}) == 1


def test_within_batch_z_removes_the_batch(spark):
    df = spark.createDataFrame([(0, s, s % 2, float(s * (1 + 10 * (s % 2)))) for s in range(20)], "feature int, sample int, batch int, value double")
    z = M.zscore(df, ["feature", "batch"])
    d = J.group_delta(z, ["feature"], F.col("batch") == 1, "z").first()["delta"]
    assert abs(d) < 1e-9
    flat = M.zscore(df.withColumn("value", F.lit(3.0)), ["feature"]).agg(F.max(F.abs("z"))).first()[0]
    assert flat == 0


def test_shift_cancels_under_z(spark):
    df = spark.createDataFrame([(f, s, float(f * s % 7)) for f in range(3) for s in range(10)], "feature int, sample int, value double")
    a, b = (sorted((r["feature"], r["sample"], round(r["z"], 9)) for r in M.zscore(x, ["feature"]).collect()) for x in (df, df.withColumn("value", F.col("value") * 2 + 5)))
    assert a == b


def test_adjusted_rand_edges(spark):
    same = spark.createDataFrame([(1, 1)] * 4, "a int, b int")
    assert T.adjusted_rand(same, "a", "b").first()["ari"] == 1
    other = spark.createDataFrame([(1, i) for i in range(4)], "a int, b int")
    assert T.adjusted_rand(other, "a", "b").first()["ari"] == 0
    assert T.adjusted_rand(other, "a", "b").first()["degen_labels"] == 1


def test_required_n_falls_with_the_square(spark):
    df = spark.createDataFrame([(0.2,)], "sd double")
    n = [T.required_n(df, "sd", F.lit(x)).first()["required_n"] for x in (0.05, 0.1)]
    assert n[0] == pytest.approx(4 * n[1], abs=4)


def test_projection_leaves_nothing_along_the_direction(spark):
    cells = spark.createDataFrame([(s, f, float((s * 5 + f * 3) % 7)) for s in range(5) for f in range(4)], "sample int, feature int, value double")
    loading = spark.createDataFrame([(f, float(f + 1)) for f in range(6)], "feature int, loading double")
    out = M.remove_direction(cells, loading).join(loading, "feature").groupBy("sample").agg(F.sum(F.col("value") * F.col("loading")).alias("s"))
    assert all(abs(r["s"]) < 1e-9 for r in out.collect())


def test_gates_without_data_are_undecidable(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert B.gates({"g": ("x", none, 1.0)}).first()["verdict"] == "UNDECIDABLE"


def test_subsets_are_the_nonempty_powerset():
    assert B.subsets(["b", "a", "c"]) == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]


def test_empty_frames_do_not_crash(spark):
    cells = spark.createDataFrame([], "cohort string, layer string, feature int, sample int, value double")
    assert T.spearman(J.aligned_pairs(J.profile(cells)), ["layer"]).count() == 0
    assert R.top_mad(cells, 3).count() == 0 and M.zscore(cells, ["feature"]).count() == 0
    assert J.leave_one_out(cells).count() == 0


def test_frozen_documents():
    from cohortlens.operators import verify

    assert verify.frozen("a plan, draft", [("draft", "frozen"), ("plan", "PLAN")], ["frozen"]) == "a PLAN, frozen"
    with pytest.raises(ValueError, match="nothing to replace"):
        verify.frozen("a", [("b", "c")])
    with pytest.raises(ValueError, match="missing"):
        verify.frozen("a b", [("b", "c")], ["b"])


def test_tables_are_written(spark, sf_dir, tmp_path):
    from cohortlens.plans import catalogue, experiment, tables

    q = catalogue.queries()
    made = {"T3": q["table_3"](spark, sf_dir), "T1b": q["table_1b"](spark, sf_dir)}
    pairs = spark.createDataFrame([("c", float(i), float(i * i % 7), float(i % 4) / 4, 0.5) for i in range(40)], "comparison string, x double, y double, pac double, ari double")
    made |= {"T5b": tables.pac_bins(pairs, (0.25, 0.5)), "T7a": tables.platform_ladder(pairs), "T7b": tables.effect_bins(pairs), "T7c": tables.levels({"all": pairs}), "T6": tables.batch_testbed({"raw": pairs.groupBy().count(), "fixed": pairs.groupBy().count()})}
    made["T8"] = tables.gates({"g": ("at least 1", pairs.groupBy().count(), 1.0)})
    tables.write_tables(made, str(tmp_path))
    for name, df in made.items():
        back = spark.read.option("header", True).csv(f"{tmp_path}/{name}")
        assert back.columns == df.columns and back.count() == df.count() > 0
    assert experiment.subsets(["b", "a"]) == [("a",), ("b",), ("a", "b")]


def test_one_large_unit_equals_numpy(spark):
    import numpy as np

    from cohortlens.operators import distributed as D

    x = np.random.default_rng(3).normal(size=(300, 6)) * [5, 3, 1, 1, 1, 1] + 2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample long, features array<double>").repartition(5)
    mean, w, var = D.principal_components(df, 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(var, values[::-1][:2]) and np.allclose(np.abs(w.T @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-6)
    got = {r["sample"]: r["scores"] for r in D.projected(df, mean, w).collect()}
    assert np.allclose([got[i] for i in range(300)], (x - mean) @ w)
    c = x[:3].copy()
    for _ in range(4):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[label == i].mean(axis=0) for i in range(3)])
    assert np.allclose(D.lloyd(df, x[:3], 4), c)
    assert D.principal_components(df.where("false"), 2)[1].shape == (0, 2) and np.array_equal(D.lloyd(df.where("false"), c, 2), c)


def test_correlations_by_blocks_and_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 12)) + 15
    x[rng.random(x.shape) < 0.15] = np.nan
    cells = [(i, j, float(x[i, j])) for i in range(40) for j in range(12) if x[i, j] == x[i, j]]
    out = M.correlation_network(spark.createDataFrame(cells, "sample long, feature long, value double"), by=[], size=5, chunk=7).collect()
    assert len(out) == 66
    for r in out:
        a, b = x[:, r["feature_a"]], x[:, r["feature_b"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        assert r["feature_a"] < r["feature_b"] and r["n"] == ok.sum() and abs(r["r"] - np.corrcoef(a[ok], b[ok])[0, 1]) < 1e-9


def test_neighbours_and_median_by_blocks(spark):
    import numpy as np

    x = np.random.default_rng(7).integers(0, 4, size=(60, 3)).astype(float)  # many ties and repeated rows
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample long, features array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    M_size = M.block_pairs.__defaults__
    M.block_pairs.__defaults__ = (17, *M_size[1:])
    try:
        near = {(r["i"], r["place"]): r["j"] for r in M.nearest_samples(df, 4).collect()}
        sigma = M.median_distance(df, bins=50).first()["sigma"]
    finally:
        M.block_pairs.__defaults__ = M_size
    off = ~np.eye(60, dtype=bool)
    assert sigma == pytest.approx(np.median(d[off & (d > 0)]))
    for i in range(60):
        order = sorted((d[i, j], j) for j in range(60) if j != i)[:4]
        assert [near[i, k + 1] for k in range(4)] == [j for _, j in order]
