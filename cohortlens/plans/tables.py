"""The published tables as frames, made from cells, presence and evaluation records, and written as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import rank as R
from cohortlens.operators import relational as J
from cohortlens.operators import scorers as T
from cohortlens.plans import experiment as B
from cohortlens.sources.records import write_csv


def numeric_domains(cells: DataFrame) -> DataFrame:
    """T1a: size, quantiles and numeric kind of each layer of a cohort."""
    sizes = cells.groupBy("cohort", "layer").agg(F.countDistinct("feature").alias("n_features"))
    p = J.numeric_profile(cells, ["cohort", "layer"]).join(sizes, ["cohort", "layer"])
    return p.select("cohort", "layer", "n_features", S.value_domain(F.col("q05"), F.col("q95"), F.col("low"), F.col("high")).alias("domain"), "pct_finite", "q05", "q50", "q95")


def availability(presence: DataFrame, domain: Column, most: int = 4) -> DataFrame:
    """T1b: samples of each cohort with at least 1, 2, ... layers."""
    wide = J.layer_availability(presence).groupBy("cohort").pivot("n_layers", list(range(1, most + 1))).agg(F.max("n_samples"))
    return wide.select(domain.alias("domain"), "cohort", *[F.coalesce(str(i), F.lit(0)).alias(f"n_samples_all_{i}_layers") for i in range(1, most + 1)])


def concordance(pairs: DataFrame) -> DataFrame:
    """T2: rank correlation of the profiles of each two cohorts in a layer, with its p."""
    out = T.correlation_p(T.spearman(pairs, ["layer", "cohort_a", "cohort_b"]))
    return out.select("layer", F.concat_ws("-", "cohort_a", "cohort_b").alias("cohort_pair"), F.col("n").alias("n_genes"), "spearman", "p")


def method_ranking(records: DataFrame, domain_a: str, domain_b: str) -> DataFrame:
    """T3: mean score of each method by domain and overall, with mean largest cluster and degeneracy."""
    mean = lambda d: F.avg(F.when(F.col("domain") == d, F.col("ari")))
    return records.groupBy("method").agg(mean(domain_a).alias("domain_A_ARI"), mean(domain_b).alias("domain_B_ARI"), F.avg("ari").alias("overall_ARI"), F.avg("max_fraction").alias("max_cluster_fraction"), F.avg("degen").alias("degeneracy_rate"), F.count("*").alias("n_records"))


def package_ranking(records: DataFrame, implementations: dict[str, str]) -> DataFrame:
    """T4: mean score of each method, and what implements it."""
    return records.groupBy("method").agg(F.avg("ari").alias("mean_ARI"), F.count("*").alias("n_records")).withColumn("implementation", S.decoded(F.col("method"), implementations))


def stability(records: DataFrame, domain_a: str, domain_b: str) -> DataFrame:
    """T5a: mean PAC of each method by domain and overall, strong share and median consensus."""
    mean = lambda d: F.avg(F.when(F.col("domain") == d, F.col("pac")))
    return records.groupBy("method").agg(mean(domain_a).alias("PAC_A"), mean(domain_b).alias("PAC_B"), F.avg("pac").alias("PAC_overall"), F.avg("strong").alias("strong_consensus"), F.avg("median_consensus").alias("median_consensus"), F.count("*").alias("n_records"))


def pac_bins(pairs: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """T5b: mean transfer score by bins of PAC."""
    out = B.binned(pairs, "pac", edges, "ari")
    return out.select("bin", *[c for c in out.columns if c != "bin"])


def batch_testbed(arms: dict[str, DataFrame]) -> DataFrame:
    """T6: the metrics (one row each) of every correction arm."""
    return J.union_tagged(arms, "arm")


def platform_ladder(pairs: DataFrame) -> DataFrame:
    """T7a: agreement of two platforms for each comparison."""
    out = T.platform_ladder(pairs, ["comparison"])
    return out.withColumnRenamed("n", "n_genes")


def effect_bins(pairs: DataFrame, effect: str = "x") -> DataFrame:
    """T7b: agreement by quartile of the absolute effect."""
    binned = R.quartile(pairs.withColumn("_size", F.abs(F.col(effect))), "_size").drop("_size")
    out = T.platform_ladder(binned, ["quartile"])
    return out.select(F.col("quartile").alias("effect_size_bin"), F.col("n").alias("n_genes"), "spearman", "sign_concordance")


def levels(parts: dict[str, DataFrame]) -> DataFrame:
    """T7c: rank correlation (of columns x and y) at each level of comparison."""
    return T.spearman(J.union_tagged(parts, "level").select("level", "x", "y"), ["level"]).select("level", "n", "spearman")


def gates(criteria: dict[str, tuple[str, DataFrame, float]]) -> DataFrame:
    """T8: verdicts computed from data."""
    return B.gates(criteria).withColumnRenamed("threshold", "frozen_threshold")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV in its own folder below ``folder``."""
    for name, df in tables.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}")
