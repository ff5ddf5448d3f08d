"""Spreadsheet and array files, read as distributed binary files and decoded by Arrow-batched functions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Texts of one sheet of an XLSX file, row by row; cells that are not there are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in root.findall("m:si", _NS)]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", _NS):
            out: list[str | None] = []
            for cell in row.findall("m:c", _NS):
                letters = re.match("[A-Z]+", cell.get("r", "")) or re.match("", "")
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at = at - 1 if at else len(out)
                out += [None] * (at - len(out))
                value, inline = cell.find("m:v", _NS), cell.find("m:is", _NS)
                text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else value.text if value is not None else None
                out.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
            rows.append(out)
    return rows


def read_sheets(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """XLSX files, long: path, row, column (by the first row's names), text."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                rows = sheet_rows(content, sheet)
                names = rows[0] if rows else []
                found = [(path_, i, names[j], v) for i, r in enumerate(rows[1:], 1) for j, v in enumerate(r) if j < len(names) and names[j] and v is not None]
                yield pd.DataFrame(found, columns=["path", "row", "column", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, row long, column string, text string")


def write_arrays(cells: DataFrame, folder: str) -> DataFrame:
    """One NPY file for each array of (array, i, j, value); gaps are NaN. Returns the files: array, path, rows, columns.

    An array is made in one task, as its file is one; the frame returned is the
    action's result, so the files are written once it is evaluated.
    """
    uri = folder if "://" in folder else f"file://{folder}"

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name = str(pdf["array"].iloc[0])
        a = np.full((int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1), np.nan)
        a[pdf["i"], pdf["j"]] = pdf["value"].astype(float)
        held = io.BytesIO()
        np.save(held, a, allow_pickle=False)
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}.npy") as out:
            out.write(held.getvalue())
        return pd.DataFrame([{"array": name, "path": f"{uri}/{name}.npy", "rows": a.shape[0], "columns": a.shape[1]}])

    return cells.groupBy("array").applyInPandas(encode, "array string, path string, rows long, columns long")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """NPY and NPZ files of numbers, long: path, array, i, j, value (j is 0 for vectors; NaN is NULL)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {k: held[k] for k in held.files} if hasattr(held, "files") else {"": held}
                for name, a in arrays.items():
                    a = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
                    i, j = np.indices(a.shape)
                    yield pd.DataFrame({"path": path_, "array": name, "i": i.ravel(), "j": j.ravel(), "value": a.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, array string, i long, j long, value double")
