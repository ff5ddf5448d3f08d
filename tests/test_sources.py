"""Readers and writers: tolerant matrices, maps, records, configuration; streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import matrix, records
from cohortlens.streaming import cells as stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    text = '# comment\n\nid\tS1\tS2\t"S3"\ng1\t1\t2\t\n"g1"\t3\tx\t\n?bad\t1\t1\t1\ng2\t5\n g3 \t-1.5\tnan\t\n'
    with gzip.open(d / "m.cct.gz", "wt") as f:
        f.write(text)
    (d / "probes.tsv").write_text("probe\tgenes\np1\tA,B\np2\t.\np3\t\np4\tC\n")
    (d / "groups.tsv").write_text("Protein IDs\tGene names\tReverse\tPotential contaminant\tOnly identified by site\tUnique peptides\tLFQ intensity a1\tLFQ intensity b1\nP1;P2\tG1;G2\t\t\t\t3\t10\t0\nP3\tG3\t+\t\t\t5\t1\t1\nP4\t\t\t\t\t5\t1\t1\nP5\tG5\t\t\t\t1\t7\t8\nP6\tG6\n")
    return d


def test_matrix_reading(spark, folder):
    got = {(r["feature"], r["sample"]): r["value"] for r in matrix.read_matrix(spark, str(folder / "m.cct.gz")).collect()}
    assert got == {("g1", "S1"): 2.0, ("g1", "S2"): 2.0, ("g3", "S1"): -1.5, ("g3", "S2"): None}  # S3 has no value
    head = matrix.headers(spark, str(folder / "m.cct.gz")).first()
    assert head["names"] == ["id", "S1", "S2", "S3"] and head["width"] == 4
    white = spark.createDataFrame([("S2",)], "s string")
    assert {r["sample"] for r in matrix.read_matrix(spark, str(folder / "m.cct.gz"), keep_samples=white).collect()} == {"S2"}
    assert [r["feature"] for r in matrix.feature_ids(spark, str(folder / "m.cct.gz")).collect()] == ["g1", "g1", "?bad", "g2", "g3"]
    assert matrix.head_lines(spark, str(folder / "m.cct.gz"), 2).count() == 2
    cells = matrix.read_matrix(spark, str(folder / "m.cct.gz"))
    assert matrix.sampled_cells(cells, 1, 1).count() == 1


def test_maps_and_groups(spark, folder):
    assert sorted((r["probe"], r["gene"], r["place"]) for r in matrix.probe_map(spark, str(folder / "probes.tsv")).where("probe <> 'probe'").collect()) == [("p1", "A", 0), ("p1", "B", 1), ("p4", "C", 0)]
    got = sorted((r["protein"], r["gene"], r["sample"], r["value"]) for r in matrix.protein_groups(spark, str(folder / "groups.tsv"), least_peptides=2).collect())
    assert got == [("P1", "G1", "a1", 10.0), ("P1", "G1", "b1", None)]
    hinted = matrix.clinical(spark, str(folder / "groups.tsv"), ["peptide"])
    assert {r["column"] for r in hinted.collect()} == {"Unique peptides"}


def test_records_round_trip(spark, tmp_path):
    src = tmp_path / "r.json"
    src.write_text('[{"domain":"A","subset":"x+y","pair":"p","method":"m","ari":{"3":0.5,"4":0.25},"degen":{"3":0,"4":1},"balance":{"3":[0.2,0.5,0.3]},"nA":3,"nB":4,"nfeat":9},{"domain":"A","subset":"x","pair":"p","method":"m","err":"failed"}]')
    flat = records.read_records(spark, str(src))
    got = {(r["subset"], r["k"]): (r["ari"], r["degen"], r["max_fraction"], r["err"]) for r in flat.collect()}
    assert got == {("x+y", 3): (0.5, 0, 0.5, None), ("x+y", 4): (0.25, 1, None, None), ("x", None): (None, None, None, "failed")}
    records.write_records(flat, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert again.count() == 2


def test_append_units_replaces_own_partition(spark, tmp_path):
    path = str(tmp_path / "units")
    for rows in ([("a", 1), ("b", 1)], [("b", 2)]):
        records.append_units(spark.createDataFrame(rows, "method string, v int"), path)
    assert sorted((r["method"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_tables_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double")
    records.write_csv(df, str(tmp_path / "csv"), gzip=True)
    assert records.read_csv(spark, str(tmp_path / "csv"), "a int, b double").count() == 2
    assert records.read_csv(spark, str(tmp_path / "none"), "a int").count() == 0
    assert records.markdown(df) == "| a | b |\n| --- | --- |\n| 1 | 0.5 |\n| 2 | NA |"
    assert records.markdown(df, 1).endswith("| 1 | 0.5 |\n(only the first 1 rows are shown)") and records.markdown(df, 2) == records.markdown(df)
    assert records.list_files(spark, str(tmp_path), r"\.csv\.gz$").count() >= 1
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x01\x00\x00\x00\x00\x20rest")
    (tmp_path / "img" / "b.eps").write_bytes(b"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 10 20 310 220\n\xff")
    (tmp_path / "img" / "c.txt").write_bytes(b"x")
    got = {r["path"][-5:]: (r["kind"], r["width"], r["height"]) for r in records.image_headers(spark, str(tmp_path / "img")).collect()}
    assert got == {"a.png": ("png", 256, 32), "b.eps": ("eps", 300, 200), "c.txt": ("other", None, None)}
    (tmp_path / "t.txt").write_bytes(b"a\xffb")
    assert records.documents(spark, str(tmp_path / "t.txt")).first()["text"] == "a�b"


def test_lossy_clinical_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_bytes("id\tPurity é\tage\ns1\t0.5\t40\n".encode("latin-1") + b"s2\t\xff0.7\t50\n")
    rows = matrix.clinical(spark, str(tmp_path / "c.tsv"), ["purity"]).collect()
    assert sorted((r["column"], r["text"]) for r in rows) == [("Purity \ufffd", "0.5"), ("Purity \ufffd", "\ufffd0.7")]


def test_configuration():
    tree = {"root": "/x", "a": {"p": "${root}/d", "n": "${m}", "e": "${env:HOME_X:-${root}/e}"}, "m": 3, "list": ["${a.p}"]}
    assert records.resolve(tree, env={}) == {"root": "/x", "a": {"p": "/x/d", "n": 3, "e": "/x/e"}, "m": 3, "list": ["/x/d"]}
    with pytest.raises(ValueError):
        records.resolve({"a": "${b}", "b": "${a}"}, env={})
    with pytest.raises(KeyError, match="NOT_SET"):
        records.resolve({"a": "${env:NOT_SET}"}, env={})
    with pytest.raises(KeyError, match="nowhere"):
        records.resolve({"a": "${nowhere}"}, env={})
    nested = {"paths": {"work": "/w", "deep": {"cache": "${work}/c", "logs": "${cache}/l", "other": "${gone:-none}"}}, "deep": {"work": "/no"}}
    assert records.resolve(nested, env={})["paths"]["deep"] == {"cache": "/w/c", "logs": "/w/c/l", "other": "none"}
    assert records.overridden({"s": {"n": 1, "f": True}}, {"CL_S__N": "5", "CL_S__F": "no"}, "CL") == {"s": {"n": 5, "f": False}}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = tmp_path / "in"
    events.repartition(3).write.parquet(str(folder))
    live = stream.windowed_profile(stream.table_stream(spark, str(folder), events.schema), "ts", ["event_type"], "value", late="60 days")
    q = live.writeStream.outputMode("complete").format("memory").queryName("profile_stream").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 day").start.alias("s"), "event_type").count()
    assert spark.table("profile_stream").count() == want.count()
    cells = events.select(F.lit("c").alias("cohort"), F.lit("l").alias("layer"), F.col("event_type").alias("feature"), "value")
    cells.write.parquet(str(tmp_path / "cells"))
    q = stream.mergeable_profiles(stream.table_stream(spark, str(tmp_path / "cells"), cells.schema), str(tmp_path / "parts"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {r["feature"]: round(r["value"], 6) for r in stream.merged(spark, str(tmp_path / "parts")).collect()}
    assert got == {r["feature"]: round(r["v"], 6) for r in cells.groupBy("feature").agg(F.avg("value").alias("v")).collect()}
