"""Spreadsheet and array files, verification operators."""

import io
import zipfile

import numpy as np

from cohortlens.operators import verify as V
from cohortlens.sources import files

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Group</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>0.5</v></c></row><row r="3"><c r="C3"><v>2</v></c></row></sheetData></worksheet>'
STRINGS = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Case_id</t></si><si><r><t>c</t></r><r><t>1</t></r></si></sst>'


def test_spreadsheets(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/sharedStrings.xml", STRINGS)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    got = sorted((r["row"], r["column"], r["text"]) for r in files.read_sheets(spark, str(tmp_path / "a.xlsx")).collect())
    assert got == [(1, "Case_id", "c1"), (1, "Group", "0.5"), (2, "Group", "2")]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.array([1.0, 2.0]))
    np.savez(tmp_path / "m.npz", a=np.arange(4).reshape(2, 2))
    assert sorted(r["value"] for r in files.read_arrays(spark, str(tmp_path / "v.npy")).collect()) == [1, 2]
    assert {(r["array"], r["i"], r["j"]): r["value"] for r in files.read_arrays(spark, str(tmp_path / "m.npz")).collect()} == {("a", 0, 0): 0, ("a", 0, 1): 1, ("a", 1, 0): 2, ("a", 1, 1): 3}


def test_tracing(spark):
    texts = spark.createDataFrame([(1, "rho = −0.50 and 12"), (2, None)], "k int, t string")
    numbers = V.numbers_in(texts, "k", "t")
    assert sorted(r["num"] for r in numbers.collect()) == ["-0.5", "12"]
    expected = spark.createDataFrame([("12",), ("-0.5",), ("7",)], "num string")
    assert [r["num"] for r in V.missing_values(expected, numbers).collect()] == ["7"]
    refs = spark.createDataFrame([("1",), ("4",)], "ref string")
    assert sorted(r["ref"] for r in V.numbering_gaps(refs).collect()) == [2, 3]
    keys = spark.createDataFrame([("domain B, four layers",), ("A",), ("none",)], "key string")
    names = spark.createDataFrame([("A",), ("domain b",)], "name string")
    assert {r["key"]: r["name"] for r in V.fuzzy_key(keys, names).collect()} == {"domain B, four layers": "domain b", "A": "A", "none": None}
    claims = spark.createDataFrame([("c1", "t", "k1", 0.5), ("c2", "t", "k2", 0.5), ("c3", "t", "k3", 0.5)], "claim string, artefact string, key string, value double")
    evidence = spark.createDataFrame([("t", "k1", 0.50001), ("t", "k2", 0.7)], "artefact string, key string, value double")
    assert {r["claim"]: r["verdict"] for r in V.ledger(claims, evidence).collect()} == {"c1": "agrees", "c2": "differs", "c3": "no evidence"}


def test_nested_numbers(spark):
    rows = [(1, "[1,2,3]"), (2, '{"a": [ 4 , -5.5], "b": {"c": 6e1}, "d": "7", "e": 2e9}'), (3, None), (4, ""), (5, "[8, 8]")]
    got = V.nested_numbers(spark.createDataFrame(rows, "k int, j string"), "k", "j", 1e9)
    assert sorted((r["k"], r["x"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, -5.5), (2, 4), (2, 60), (5, 8), (5, 8)]
