"""Records, artefacts, tables and configuration: readers and writers."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "domain string, subset string, pair string, method string, ari map<string,double>, degen map<string,int>, balance map<string,array<double>>, nA int, nB int, nfeat int, err string"


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON records with maps keyed by K as text, flat: one row for each K; records with an error keep one row.

    Files hold one array of records, or with ``lines`` one record a line, as ``write_records`` makes them.
    """
    r = spark.read.schema(RECORD).option("multiLine", not lines).json(path)
    flat = r.select("domain", "subset", "pair", "method", "nA", "nB", "nfeat", "err", F.explode_outer(F.map_keys("ari")).alias("k"), "ari", "degen", "balance")
    return flat.select("domain", "subset", "pair", "method", "nA", "nB", "nfeat", "err", F.col("k").cast("int").alias("k"), *[F.element_at(c, F.col("k")).alias(c) for c in ("ari", "degen")], F.element_at("balance", F.col("k")).alias("balance"), F.array_max(F.element_at("balance", F.col("k"))).alias("max_fraction"))


def write_records(flat: DataFrame, path: str) -> None:
    """The flat form back to one JSON record for each unit and method."""
    keys = ["domain", "subset", "pair", "method", "nA", "nB", "nfeat", "err"]
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct(F.col("k").cast("string").alias("k"), F.col(c).alias("v"))))))
    flat.groupBy(*keys).agg(*[entry(c).alias(c) for c in ("ari", "degen", "balance") if c in flat.columns]).write.mode("overwrite").json(path)


def append_units(df: DataFrame, path: str, by: tuple[str, ...] = ("method",)) -> None:
    """Incremental results: finished units replace their own partition only, so a restart goes on where it stopped."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a known schema; a path that does not exist gives an empty table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def markdown(df: DataFrame, limit: int | None = None) -> str:
    """A report table; NULL and NaN as NA, floats in short form.

    All rows come to the driver, or the first ``limit`` and a line that says that there are more.
    """

    def text(v: Any) -> str:
        if v is None or isinstance(v, float) and v != v:
            return "NA"
        return f"{v:g}" if isinstance(v, float) else str(v)

    rows = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    held = df.collect() if limit is None else df.limit(limit + 1).collect()
    more = [f"(only the first {limit} rows are shown)"] if limit is not None and len(held) > limit else []
    return "\n".join(rows + ["| " + " | ".join(map(text, r)) + " |" for r in held[:limit]] + more)


def list_files(spark: SparkSession, folder: str, pattern: str, top: int | None = None) -> DataFrame:
    """Files under a folder whose path fits a pattern, the largest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), "modificationTime")
    out = f.where(F.col("path").rlike(pattern)).orderBy(F.desc("bytes"), "path")
    return out.limit(top) if top else out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, bytes that are not UTF-8 replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """Kind and size of image files by their first bytes: PNG width and height, EPS bounding box."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.substring("content", 1, 4096).alias("c"))
    number = lambda at: F.conv(F.hex(F.substring("c", at, 4)), 16, 10).cast("long")
    is_png = F.hex(F.substring("c", 1, 8)) == "89504E470D0A1A0A"
    text = F.make_valid_utf8(F.col("c").cast("string"))
    is_eps = text.startswith("%!PS")
    box = F.regexp_extract_all(F.regexp_extract(text, r"%%BoundingBox:([^\r\n]*)", 1), F.lit(r"-?[0-9]+"), 0)
    side = lambda i: F.get(box, F.lit(i + 2)).cast("long") - F.get(box, F.lit(i)).cast("long")
    return f.select("path", "bytes", F.when(is_png, "png").when(is_eps, "eps").otherwise("other").alias("kind"), *[F.when(is_png, number(17 + 4 * i)).when(is_eps, side(i)).alias(n) for i, n in enumerate(("width", "height"))])


_NAME = re.compile(r"\$\{(env:)?([A-Za-z0-9_.]+)(?::-((?:[^{}]|\{[^{}]*\})*))?\}")


def resolve(config: Mapping[str, Any], env: Mapping[str, str] | None = None, depth: int = 12) -> dict:
    """A configuration tree with ``${a.b}`` and ``${env:X:-default}`` replaced.

    Values may name each other up to ``depth`` times; a longer chain is a cycle.
    A whole-value reference keeps the type of what it names. A name is a path from
    the root, or else a key that stands in the tree, the nearest to the root first.
    A name or variable that is nowhere and has no default is an error.
    """
    env = os.environ if env is None else env

    def find(path: str) -> Any:
        at: Any = config
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                break
            at = at[part]
        else:
            return at
        level: list[Any] = [config]
        while level:
            for held in level:
                if isinstance(held, Mapping) and path in held:
                    return held[path]
            level = [v for held in level if isinstance(held, Mapping) for v in held.values()]
        raise KeyError(f"nothing is named {path}")

    def one(value: Any, left: int) -> Any:
        if isinstance(value, Mapping):
            return {k: one(v, left) for k, v in value.items()}
        if isinstance(value, list):
            return [one(v, left) for v in value]
        if not isinstance(value, str) or "${" not in value:
            return value
        if left == 0:
            raise ValueError(f"references go in a circle: {value}")

        def named(m: re.Match) -> Any:
            if m[1]:
                if m[2] not in env and m[3] is None:
                    raise KeyError(f"the environment has no {m[2]}, and there is no default")
                return env.get(m[2], m[3])
            try:
                return find(m[2])
            except KeyError:
                if m[3] is None:
                    raise
                return m[3]

        if (m := _NAME.fullmatch(value)) is not None:
            return one(named(m), left - 1)
        return one(_NAME.sub(lambda m: str(named(m)), value), left - 1)

    return one(dict(config), depth)


def overridden(config: dict, env: Mapping[str, str], prefix: str) -> dict:
    """Settings replaced by environment variables ``PREFIX_SECTION__KEY``, in the type of what they replace."""
    out = json.loads(json.dumps(config))
    for name, text in env.items():
        if not name.startswith(prefix + "_"):
            continue
        at, (*path, last) = out, name[len(prefix) + 1 :].lower().split("__")
        for part in path:
            at = at.setdefault(part, {})
        old = at.get(last)
        at[last] = text.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text) if isinstance(old, (int, float)) else text
    return out


