"""Matrix files to cells and back.

A matrix file is wide (one column for each sample, 10^4 to 10^5 of them), so it
is read as lines of text, split once, and turned into long cells; columns are
never Spark columns. Gzip and plain text read alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S


#: Tasks that share the long lines of a matrix file, which one task reads if it is gzipped.
SHARED = 64


def raw_lines(spark: SparkSession, path: str, lossy: bool = False) -> DataFrame:
    """Lines of text files with their file; comment and blank lines left out.

    ``lossy`` replaces bytes that are not UTF-8.
    """
    line = F.make_valid_utf8("value") if lossy else F.col("value")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), line.alias("line"), F.monotonically_increasing_id().alias("_at"))
    return lines.where(~F.col("line").startswith("#") & (F.trim("line") != ""))


def headers(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The header of each file: file, names (array), width."""
    first = raw_lines(spark, path).groupBy("file").agg(F.min_by("line", "_at").alias("line"))
    names = F.transform(F.split("line", sep), S.clean_id)
    return first.select("file", names.alias("names"), F.size(names).alias("width"))


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", id_pattern: str = S.ANY_ID, keep_samples: DataFrame | None = None, keep_features: DataFrame | None = None, barcode: bool = False, drop_ragged: bool = True, first_rows: int | None = None, sampled: int | None = None, seed: int = 49) -> DataFrame:
    """Cells (file, feature, sample, value) of matrix files.

    The first column is the feature id whatever its header; identifiers lose
    blanks and quotes and must fit ``id_pattern``; what is no number is NULL;
    rows whose width differs from the header's are dropped (``drop_ragged``) or
    cut; duplicate features and samples are averaged; with ``barcode`` samples
    are reduced to patients; ``keep_samples`` and ``keep_features`` (one column
    each) are whitelists; ``first_rows`` reads so many rows of each file, and
    ``sampled`` a seeded choice of so many of its columns. Rows and columns are
    chosen before a line is turned into cells.
    """
    lines, head = raw_lines(spark, path), headers(spark, path, sep)
    first = lines.groupBy("file").agg(F.min("_at").alias("_first"))
    body = lines.join(first, "file").where("_at <> _first")
    if first_rows is not None:
        body = body.withColumn("_row", F.row_number().over(Window.partitionBy("file").orderBy("_at"))).where(F.col("_row") <= first_rows).drop("_row")
    if sampled is not None:
        places = F.sequence(F.lit(1), F.col("width") - 1)
        drawn = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(seed), F.get("names", i)).alias("h"), i.alias("i"))))
        head = head.withColumn("chosen", F.transform(F.slice(drawn, 1, sampled), lambda x: x["i"]))
    # a few lines hold all cells: they are dealt to tasks before they are split, by number, as their bytes tell little
    cells = body.join(head, "file").repartition(SHARED).withColumn("v", F.split("line", sep))
    if drop_ragged:
        cells = cells.where(F.size("v") == F.col("width"))
    cells = cells.withColumn("feature", S.clean_id(F.get("v", F.lit(0)))).where(F.col("feature").rlike(id_pattern))
    if keep_features is not None:
        cells = cells.join(keep_features.select(F.col(keep_features.columns[0]).alias("feature")).distinct(), "feature", "left_semi")
    if sampled is not None:
        pick = lambda c: F.concat(F.slice(c, 1, 1), F.transform("chosen", lambda i: F.get(F.col(c), i)))
        cells = cells.withColumn("names", pick("names")).withColumn("v", pick("v"))
    cells = cells.select("file", "feature", F.posexplode(F.arrays_zip(F.slice("names", 2, 1 << 30).alias("n"), F.slice("v", 2, 1 << 30).alias("x"))).alias("i", "c"))
    sample = S.sample_barcode(F.col("c.n")) if barcode else F.col("c.n")
    cells = cells.where(F.col("c.n").isNotNull()).select("file", "feature", sample.alias("sample"), S.number(F.col("c.x")).alias("value"))
    if keep_samples is not None:
        cells = cells.join(keep_samples.select(F.col(keep_samples.columns[0]).alias("sample")).distinct(), "sample", "left_semi")
    out = cells.groupBy("file", "feature", "sample").agg(F.avg("value").alias("value"))
    # samples without a single value are dropped
    return out.withColumn("_n", F.count("value").over(Window.partitionBy("file", "sample"))).where("_n > 0").drop("_n")


def head_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of each file."""
    w = Window.partitionBy("file").orderBy("_at")
    return raw_lines(spark, path).withColumn("row", F.row_number().over(w)).where(F.col("row") <= n).drop("_at")


def feature_ids(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The id column of each file, as written, in order."""
    lines = raw_lines(spark, path)
    first = lines.groupBy("file").agg(F.min("_at").alias("_first"))
    body = lines.join(first, "file").where("_at <> _first")
    return body.select("file", S.clean_id(F.split_part("line", F.lit(sep), F.lit(1))).alias("feature"), "_at").orderBy("file", "_at").drop("_at")


def sampled_cells(cells: DataFrame, features: int, samples: int, seed: int = 49) -> DataFrame:
    """Cells of the first features and of a seeded choice of samples of each file."""
    f = cells.select("file", "feature").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("feature"))).where(F.col("_r") <= features)
    s = cells.select("file", "sample").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64(F.lit(seed), "sample"), "sample"))).where(F.col("_r") <= samples)
    return cells.join(f.drop("_r"), ["file", "feature"], "left_semi").join(s.drop("_r"), ["file", "sample"], "left_semi")


def probe_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(probe, gene, place): one row for each gene of a probe; '' and '.' are no genes."""
    parts = F.split("line", sep)
    rows = raw_lines(spark, path).select(S.clean_id(F.get(parts, F.lit(0))).alias("probe"), F.posexplode(F.split(F.get(parts, F.lit(1)), ",")).alias("place", "gene"))
    return rows.withColumn("gene", F.trim("gene")).where(~F.col("gene").isin("", ".")).select("probe", "gene", "place")


def probe_means(cells: DataFrame, probes: DataFrame, first_only: bool = False, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Cells of genes from cells of probes: the mean over the probes of a gene, missing values left out."""
    names = probes.where("place = 0") if first_only else probes
    return cells.join(names.select(F.col("probe").alias("feature"), "gene"), "feature").groupBy("gene", *by).agg(F.avg("value").alias("value"))


def protein_means(cells: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Cells of genes from cells of proteins: the mean over the proteins of a gene."""
    return cells.groupBy("gene", *by).agg(F.avg("value").alias("value"))


def dense_features(cells: DataFrame, share: float = 0.6, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """Cells of the features with at least the integer part of ``share`` times the samples as values."""
    least = cells.agg(F.floor(F.lit(share) * F.countDistinct(sample)).alias("_least"))
    held = cells.groupBy(feature).agg(F.count(value).alias("_n")).crossJoin(F.broadcast(least)).where("_n >= _least")  # one row
    return cells.join(held.select(feature), feature, "left_semi")


def protein_groups(spark: SparkSession, path: str, prefix: str = "LFQ intensity ", least_peptides: int = 0, sep: str = "\t") -> DataFrame:
    """Cells (protein, gene, sample, value) of a protein-groups table.

    Groups flagged '+' as reverse, contaminant or identified by site go (a
    missing flag is none), so do groups without a gene, truncated rows and rows
    with too few unique peptides; intensities of 0 or below are missing.
    """
    cells_ = read_rows(spark, path, sep)
    get = lambda name: F.element_at("row", F.lit(name))
    for flag in ("Reverse", "Potential contaminant", "Only identified by site"):
        cells_ = cells_.where(~get(flag).eqNullSafe(F.lit("+")))
    gene = F.trim(S.first_of(get("Gene names")))
    peptides = F.coalesce(get("Unique peptides").try_cast("int"), F.lit(0))
    kept = cells_.where((gene != "") & (peptides >= least_peptides)).select(S.first_of(get("Protein IDs")).alias("protein"), gene.alias("gene"), F.explode("row").alias("name", "x"))
    value = S.number(F.col("x"))
    return kept.where(F.col("name").startswith(prefix)).select("protein", "gene", F.regexp_replace("name", f"^{prefix}", "").alias("sample"), F.when(value > 0, value).alias("value"))


def read_rows(spark: SparkSession, path: str, sep: str = "\t", lossy: bool = False) -> DataFrame:
    """Rows of wide text tables as maps from column name to text; rows of another width go."""
    lines, head = raw_lines(spark, path, lossy), headers(spark, path, sep)
    first = lines.groupBy("file").agg(F.min("_at").alias("_first"))
    body = lines.join(first, "file").where("_at <> _first").join(head, "file").withColumn("v", F.split("line", sep, -1))
    return body.where(F.size("v") == F.col("width")).select("file", F.map_from_arrays("names", "v").alias("row"))


def clinical(spark: SparkSession, path: str, hints: Sequence[str], sep: str = "\t", lossy: bool = True) -> DataFrame:
    """Columns of clinical tables whose names hold one of the hints, long: file, row id, column, text."""
    rows = read_rows(spark, path, sep, lossy).withColumn("row_id", F.monotonically_increasing_id())
    one = rows.select("file", "row_id", F.explode("row").alias("column", "text"))
    return one.where(F.lower("column").rlike("|".join(h.lower() for h in hints)))
