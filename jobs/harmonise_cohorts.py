"""Measurements of several cohorts brought onto one scale, with the evidence that they may be compared.

From a table of measurements, whose columns or expressions name cohort, layer,
feature, sample and value, the job writes

- ``cells``: repeated measurements averaged, on the log2 scale; partitioned by
  cohort and layer;
- ``coverage`` and ``variability``: the samples that have each feature, with mean and
  deviation, and the median absolute deviation of the features that all cohorts cover and its place;
- ``scaled``: the features that are among the most variable of every cohort,
  standardised within each cohort; partitioned by cohort and layer;
- ``quality``: size, quantiles and value domain of each cohort and layer;
- ``concordance``: for each layer and pair of cohorts the rank correlation of the
  mean profiles over the features kept, and its band; partitioned by layer.

``cohorts`` limits a run to some cohorts: their partitions of ``cells`` are
replaced, the others stay, and what compares cohorts is made anew from all that
are there. A rerun gives the same tables.

    python -m jobs.harmonise_cohorts --config jobs/harmonise_cohorts.json
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import matrix as M
from cohortlens.operators import rank as R
from cohortlens.operators import relational as J
from cohortlens.operators import scorers as T
from jobs.common import log, main, replace_partitions, stored


@dataclass(frozen=True)
class Settings:
    """``input``: a table in Parquet; the five names below are SQL expressions over it."""

    input: str
    output: str
    cohort: str = "cohort"
    layer: str = "layer"
    feature: str = "feature"
    sample: str = "sample"
    value: str = "value"
    cohorts: list[str] = field(default_factory=list)
    #: Share of a cohort's samples that must have a feature, and how many of the most variable features count.
    completeness: float = 0.5
    most_variable: int = 1000


def measured(table: DataFrame, s: Settings) -> DataFrame:
    """cohort, layer, feature, sample, value: means of repeated measurements on the log2 scale; what has no logarithm is missing."""
    named = table.select(*[F.expr(getattr(s, c)).alias(c) for c in ("cohort", "layer", "feature", "sample", "value")])
    named = named.where(F.col("cohort").isNotNull() & F.col("layer").isNotNull() & F.col("feature").isNotNull() & F.col("sample").isNotNull())
    if s.cohorts:
        named = named.where(F.col("cohort").cast("string").isin(*s.cohorts))
    # dealt out before they are averaged: most cells are measured once or a few times, so that means of parts
    # would save little and be merged again; and the samples that ``coverage`` counts each stand in one place
    dealt = named.repartition("cohort", "layer", "sample")
    cells = J.dedup_mean(dealt, ["cohort", "layer", "feature", "sample"]).withColumn("value", F.col("value").cast("double"))
    return cells.withColumn("value", S.finite(F.log2("value"))).where("value is not null")


def coverage(cells: DataFrame) -> DataFrame:
    """For each feature of a cohort and layer the samples that have it, those there are, and mean and deviation of its values."""
    size = cells.groupBy("cohort", "layer").agg(F.countDistinct("sample").alias("n_samples"))
    return M.moments(cells, ["cohort", "layer", "feature"]).join(size, ["cohort", "layer"])


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Write the harmonised cohorts and the evidence about them."""
    at = {name: f"{s.output.rstrip('/')}/{name}" for name in ("cells", "coverage", "variability", "scaled", "quality", "concordance")}
    source = spark.read.parquet(s.input)
    log.info("read %d rows of %s", source.count(), s.input)
    replace_partitions(measured(source, s), at["cells"], "cohort", "layer")
    if (cells := stored(spark, at["cells"])) is None:
        raise ValueError(f"no measurement in {s.input}")
    coverage(cells).write.mode("overwrite").parquet(at["coverage"])
    features = spark.read.parquet(at["coverage"])
    covered = J.in_all(features.where(F.col("n") >= s.completeness * F.col("n_samples")), "feature", "cohort", ["layer"])
    R.top_mad(cells.join(covered, ["layer", "feature"], "left_semi"), s.most_variable).write.mode("overwrite").parquet(at["variability"])
    kept = features.join(J.in_all(spark.read.parquet(at["variability"]), "feature", "cohort", ["layer"]), ["layer", "feature"], "left_semi")
    scaled = M.zscore_by(cells, kept, ["cohort", "layer", "feature"]).select("cohort", "layer", "feature", "sample", "z")
    scaled.write.partitionBy("cohort", "layer").mode("overwrite").parquet(at["scaled"])
    p = J.numeric_profile(cells, ["cohort", "layer"])
    p.withColumn("domain", S.value_domain(F.col("q05"), F.col("q95"), F.col("low"), F.col("high"))).write.mode("overwrite").parquet(at["quality"])
    # the profiles of features kept; the places kept are those of the published tables
    profile = kept.select("cohort", "layer", "feature", F.round("mean", 6).alias("value"))
    pairs = T.spearman(J.aligned_pairs(profile), ["layer", "cohort_a", "cohort_b"]).withColumn("band", T.band(F.col("spearman")))
    pairs.write.partitionBy("layer").mode("overwrite").parquet(at["concordance"])
    # a partitioned table without a row has no file: there may be no pair of cohorts, or no feature that all have
    written = {name: 0 if (held := stored(spark, path)) is None else held.count() for name, path in at.items()}
    for name, n in written.items():
        log.info("wrote %d rows of %s", n, at[name])
    return written


def output(spark: SparkSession, s: Settings) -> DataFrame:
    """The tables under each other, numbers rounded to 4 places."""
    base = s.output.rstrip("/")
    r4 = lambda c: F.round(c, 4).alias("value")
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    text = lambda c, name: F.col(c).cast("string").alias(name)
    keys = lambda c: [text(c, "cohort"), text("layer", "layer")]
    columns = {
        "scaled": [*keys("cohort"), text("feature", "feature"), text("sample", "sample"), F.lit(1).cast("long").alias("n"), r4("z"), *none(("verdict", "string"))],
        "quality": [*keys("cohort"), *none(("feature", "string"), ("sample", "string")), F.col("n_cells").alias("n"), r4("q50"), F.col("domain").alias("verdict")],
        "concordance": [*keys("cohort_a"), *none(("feature", "string")), text("cohort_b", "sample"), "n", r4("spearman"), F.col("band").alias("verdict")],
    }
    held = {name: df for name in columns if (df := stored(spark, f"{base}/{name}")) is not None}
    return J.union_tagged({name: df.select(*columns[name]) for name, df in held.items()}, "part")


if __name__ == "__main__":
    main("harmonise_cohorts", Settings, run)
