"""The jobs: their SQL, growing input, runs that break off, odd rows, and the command line."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import matrix as M
from cohortlens.operators import rank as R
from jobs import common, harmonise_cohorts, identifier_ledger, registry
from test_catalogue import rows_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in os.listdir(sf_dir):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) > 10 and a == b


# ---------- the incremental job


def ledger_settings(base, **more):
    return identifier_ledger.Settings(input=f"{base}/in", output=f"{base}/out", checkpoint=f"{base}/checkpoint", **more)


def land(docs, base, name):
    """One more file in the input folder."""
    docs.coalesce(1).write.parquet(f"{base}/land-{name}")
    os.makedirs(f"{base}/in", exist_ok=True)
    for f in os.listdir(f"{base}/land-{name}"):
        if f.endswith(".parquet"):
            os.rename(f"{base}/land-{name}/{f}", f"{base}/in/{name}.parquet")


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_ledger_of_growing_input(spark, docs, tmp_path):
    whole, grown = tmp_path / "whole", tmp_path / "grown"
    land(docs, whole, "all")
    identifier_ledger.run(spark, ledger_settings(whole))
    want = rows(identifier_ledger.output(spark, ledger_settings(whole)))
    s = ledger_settings(grown, files_per_batch=1)
    land(docs.where("doc_id % 3 = 0"), grown, "a")
    land(docs.where("doc_id % 3 = 1"), grown, "b")
    first = identifier_ledger.run(spark, s)
    assert first["read"] == docs.where("doc_id % 3 < 2").count()
    early = rows(identifier_ledger.output(spark, s))
    assert identifier_ledger.run(spark, s)["read"] == 0 and rows(identifier_ledger.output(spark, s)) == early
    land(docs.where("doc_id % 3 = 2"), grown, "c")
    second = identifier_ledger.run(spark, s)
    assert second["read"] == docs.where("doc_id % 3 = 2").count() and second["ledger"] < len(want)
    assert rows(identifier_ledger.output(spark, s)) == want
    assert sum("=" in f for f in os.listdir(f"{s.output}/parts")) == 3  # a part for each epoch


def test_ledger_repeats_an_epoch_that_broke_off(spark, docs, tmp_path):
    s = ledger_settings(tmp_path)
    land(docs.where("doc_id % 2 = 0"), tmp_path, "a")
    identifier_ledger.run(spark, s)
    land(docs.where("doc_id % 2 = 1"), tmp_path, "b")
    identifier_ledger.run(spark, s)
    want = rows(identifier_ledger.output(spark, s))
    last = max(int(f) for f in os.listdir(f"{s.checkpoint}/commits") if f.isdigit())
    # as if the run had died after the tables were written and before the epoch was committed
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(f"{s.checkpoint}/commits/{f}"):
            os.remove(f"{s.checkpoint}/commits/{f}")
    assert identifier_ledger.run(spark, s)["read"] == docs.where("doc_id % 2 = 1").count()
    assert rows(identifier_ledger.output(spark, s)) == want


def test_ledger_breaks_off_in_the_middle(spark, docs, tmp_path, monkeypatch):
    s = ledger_settings(tmp_path)
    land(docs.where("doc_id % 2 = 0"), tmp_path, "a")
    identifier_ledger.run(spark, s)
    land(docs.where("doc_id % 2 = 1"), tmp_path, "b")
    whole = identifier_ledger.part_of

    def fails(held):
        raise RuntimeError("lost between the ledger and its part")

    monkeypatch.setattr(identifier_ledger, "part_of", fails)
    with pytest.raises(Exception, match="lost between"):
        identifier_ledger.run(spark, s)
    monkeypatch.setattr(identifier_ledger, "part_of", whole)
    identifier_ledger.run(spark, s)
    alone = ledger_settings(tmp_path / "alone")
    land(docs, tmp_path / "alone", "all")
    identifier_ledger.run(spark, alone)
    assert rows(identifier_ledger.output(spark, s)) == rows(identifier_ledger.output(spark, alone))


def test_ledger_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, source string, kind string, epoch long"
    land(spark.createDataFrame([(1, "TP53 ENSG0000123 cg0012345 hsa-mir-21 MIMAT001 12 a/b TP53", "x", "?", 9), (2, None, None, None, None), (3, "", "x", "", 0), (None, "lost", "x", "", 0), (4, "zz", "y", "", 0), (4, "aa", "y", "", 0), (5, "w " * 50_000, "y", "", 0)], schema), tmp_path, "a")
    s = ledger_settings(tmp_path)
    identifier_ledger.run(spark, s)
    land(spark.createDataFrame([(1, "another version", "x", "", 0), (6, "new", "z", "", 0)], schema), tmp_path, "b")
    assert identifier_ledger.run(spark, s)["ledger"] == 1
    got = {(r["doc_id"], r["kind"]): (r["n_tokens"], r["n_distinct"], r["example"]) for r in identifier_ledger.output(spark, s).where("level = 'document'").collect()}
    assert got == {
        (1, "symbol"): (2, 1, "TP53"), (1, "ensembl"): (1, 1, "ENSG0000123"), (1, "cpg"): (1, 1, "cg0012345"), (1, "mirna"): (1, 1, "hsa-mir-21"), (1, "mimat"): (1, 1, "MIMAT001"), (1, "entrez"): (1, 1, "12"), (1, "other"): (1, 1, "a/b"),
        (2, "none"): (0, 0, None), (3, "none"): (0, 0, None), (4, "symbol"): (1, 1, "aa"), (5, "symbol"): (50_000, 1, "w"), (6, "symbol"): (1, 1, "new"),
    }
    empty = ledger_settings(tmp_path / "empty")
    land(spark.createDataFrame([], schema), tmp_path / "empty", "none")
    assert identifier_ledger.run(spark, empty) == {"read": 0, "ledger": 0, "census": 0}


def test_ledger_reads_texts_without_a_shuffle(spark, docs, tmp_path):
    plan = identifier_ledger.entries(docs, ledger_settings(tmp_path))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert plan.count("Exchange hashpartitioning") == 1 and below.count("regexp_extract_all") == 1


# ---------- the cohorts


def test_cohorts_can_be_replaced_one_by_one(spark, sf_dir, tmp_path):
    base = dict(input=f"{sf_dir}/lineitem.parquet", **registry.CELLS, completeness=0.05, most_variable=40)
    whole, one = harmonise_cohorts.Settings(output=f"{tmp_path}/whole", **base), harmonise_cohorts.Settings(output=f"{tmp_path}/one", **base)
    harmonise_cohorts.run(spark, whole)
    for cohorts in (["R"], ["A", "N"], ["N"]):
        harmonise_cohorts.run(spark, harmonise_cohorts.Settings(output=f"{tmp_path}/one", cohorts=cohorts, **base))
    assert rows(harmonise_cohorts.output(spark, one)) == rows(harmonise_cohorts.output(spark, whole))
    assert {f for f in os.listdir(f"{tmp_path}/one/cells") if "=" in f} == {"cohort=A", "cohort=N", "cohort=R"}


def test_cohorts_odd_rows(spark, tmp_path):
    cells = [("a", "l", f, s, float(2 + f * s % 7)) for f in range(4) for s in range(6)] + [("b", "l", f, s, float(1 + f + s)) for f in range(4) for s in range(6)]
    odd = [("a", "l", 0, 0, None), ("a", "l", 1, 1, -5.0), ("a", "l", 9, 1, 0.0), ("a", None, 0, 0, 1.0), (None, "l", 0, 0, 1.0), ("a", "l", 2, 2, float("nan")), ("b", "m", 0, 0, 3.0)]
    spark.createDataFrame(cells + odd, "cohort string, layer string, feature long, sample long, value double").write.parquet(f"{tmp_path}/in")
    s = harmonise_cohorts.Settings(input=f"{tmp_path}/in", output=f"{tmp_path}/out")
    counts = harmonise_cohorts.run(spark, s)
    assert harmonise_cohorts.run(spark, s) == counts
    got = harmonise_cohorts.output(spark, s)
    assert got.where("part = 'scaled' and (value is null or isnan(value))").count() == 0
    # a negative mean and NaN have no logarithm: those cells are missing
    assert spark.read.parquet(f"{tmp_path}/out/cells").where("cohort = 'a'").count() == 22
    assert {(r["cohort"], r["sample"]) for r in got.where("part = 'concordance'").collect()} == {("a", "b")}
    none = harmonise_cohorts.Settings(input=f"{tmp_path}/in", output=f"{tmp_path}/none", cohorts=["?"])
    with pytest.raises(ValueError, match="no measurement"):
        harmonise_cohorts.run(spark, none)


# ---------- settings and the command line


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"input": "a", "output": "b", "checkpoint": "c"}))
    s = common.read_settings(spark, identifier_ledger.Settings, f"file://{tmp_path}/s.json", {"output": "d", "text": None})
    assert (s.input, s.output, s.text) == ("a", "d", "text")
    with pytest.raises(ValueError, match="unknown settings: inputs"):
        common.read_settings(spark, identifier_ledger.Settings, None, {"inputs": "a"})
    for name, kind in (("identifier_ledger", identifier_ledger.Settings), ("harmonise_cohorts", harmonise_cohorts.Settings)):
        common.read_settings(spark, kind, f"{ROOT}/jobs/{name}.json", {})


def test_command_line(spark, sf_dir, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"input": f"{sf_dir}/{{documents.parquet}}", "output": "?", "checkpoint": f"{tmp_path}/c"}))
    done = subprocess.run([sys.executable, "-m", "jobs.identifier_ledger", "--config", f"{tmp_path}/s.json", "--output", f"{tmp_path}/out"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "new documents" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/ledger").agg(F.countDistinct("doc_id")).first()[0] == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


# ---------- what grows with the measurements


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_averaged_once_behind_one_shuffle(spark, sf_dir):
    s = harmonise_cohorts.Settings(input="", output="", **registry.CELLS)
    plan = planned(harmonise_cohorts.measured(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), s))
    # no sums of parts are kept, sent and merged
    assert plan.count("Exchange") == 1 and "avg(" not in plan[plan.index("Exchange") :]


def test_scaled_cells_and_profiles_come_from_the_stored_moments(spark, sf_dir, tmp_path):
    s = harmonise_cohorts.Settings(input=f"{sf_dir}/lineitem.parquet", output=f"{tmp_path}/out", **registry.CELLS, completeness=0.05, most_variable=40)
    harmonise_cohorts.run(spark, s)
    cells, features, scaled = (spark.read.parquet(f"{s.output}/{t}") for t in ("cells", "coverage", "scaled"))
    by = ["cohort", "layer", "feature"]
    assert features.count() == cells.select(*by).distinct().count()
    new = M.zscore_by(cells, features, by)
    assert "Window" not in planned(new) and "Exchange hashpartitioning" not in planned(new)
    apart = M.zscore(cells, by).withColumnRenamed("z", "wanted").join(new.select(*by, "sample", "z"), [*by, "sample"], "full")
    assert apart.count() == cells.count() and apart.where("z is null or wanted is null or abs(z - wanted) > 1e-9").count() == 0
    assert scaled.count() > 10 and scaled.join(new, [*by, "sample"], "left_anti").count() == 0
    flat = spark.createDataFrame([("a", "l", 1, s, 0.1) for s in range(3)], "cohort string, layer string, feature int, sample int, value double")
    assert {abs(round(r["z"], 12)) for r in M.zscore_by(flat, M.moments(flat, by), by).collect()} == {0.0}


def test_median_deviations_take_one_shuffle(spark):
    values = {1: [1.0, None, 4.0], 2: [None], 3: [float("inf"), 1.0, 2.0], 4: [5.0], 5: [1.0, 2.0, 4.0, 9.0, 9.0, 7.5]}
    cells = spark.createDataFrame([("a", "l", f, v) for f, held in values.items() for v in held], "cohort string, layer string, feature int, value double")
    found = R.mad(cells)
    assert {r["feature"]: r["mad"] for r in found.collect()} == {1: 1.5, 2: None, 3: 1.0, 4: 0.0, 5: 3.25}
    assert planned(R.mad(cells)).count("Exchange") == 1
