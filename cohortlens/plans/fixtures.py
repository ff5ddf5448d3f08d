"""Views of the test tables in the engine's data model, for Spark and as SQL.

Money is averaged as DECIMAL and taken to the log2 scale of the matrices the
engine is for; both engines then agree to the places kept, and no derived value
lies on a rounding boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import table


def _price() -> F.Column:
    return F.log2(F.avg(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort, layer, feature, sample, value: duplicates averaged."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("cohort"), F.col("l_linestatus").alias("layer"), (F.col("l_partkey") % 50).alias("feature"), F.col("l_suppkey").alias("sample")).agg(_price().alias("value"))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which samples have which of four layers."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_returnflag").alias("cohort"), F.concat(F.lit("q"), F.quarter("l_shipdate").cast("string")).alias("layer"), F.col("l_partkey").alias("sample")).distinct()


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2 x 2 design of batch and condition with missing values."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("feature"), F.col("l_suppkey").alias("sample")).agg(_price().alias("v"))
    gap = (F.col("feature") * 7 + F.col("sample")) % 11 == 0
    return t.select("feature", "sample", (F.col("sample") % 2).alias("batch"), (F.floor(F.col("sample") / 2) % 2).alias("cond"), F.when(~gap, F.col("v")).alias("value"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark-like records: domain, pair, method, subset, score and degeneracy."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.col("p_size") % 3
    return t.groupBy(F.col("l_linestatus").alias("domain"), F.col("l_returnflag").alias("pair"), F.col("p_type").alias("method"), (kind + 1).alias("nlay"), F.when(kind == 0, "x").when(kind == 1, "y+x").otherwise("z+x+y").alias("subset")).agg(
        F.round(F.avg(F.col("l_discount") * 10), 4).alias("ari"), F.when(F.min("l_linenumber") + F.max("l_partkey") % 9 == 1, 1).otherwise(0).alias("degen"), F.count("*").alias("n")
    )


def boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap labels with absent samples."""
    both = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("replicate"))
    return both.where((F.col("sample") * (2 * F.col("replicate") + 3) + F.col("replicate")) % 5 != 0).select("replicate", "sample", ((F.col("label") + (F.col("sample") * F.col("replicate")) % 2) % 4).alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a vector of doubles, batch, condition and cohort."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), (F.col("label") % 2).alias("batch"), (F.floor(F.col("label") / 2) % 2).cast("int").alias("cond"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("cohort"), "label")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as two layers of 32 features."""
    v = vectors(spark, sf_dir).withColumn("domain", F.lit("D"))
    halves = F.explode(F.array(F.struct(F.lit("first").alias("layer"), F.slice("features", 1, 32).alias("features")), F.struct(F.lit("second").alias("layer"), F.slice("features", 33, 32).alias("features"))))
    return v.select("domain", "cohort", "sample", "batch", "cond", halves.alias("h")).select("domain", "cohort", "sample", "batch", "cond", "h.layer", "h.features")


SQL = {
    "cells": """SELECT l_returnflag AS cohort, l_linestatus AS layer, l_partkey % 50 AS feature, l_suppkey AS sample,
  log2(CAST(avg(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)) AS value FROM lineitem GROUP BY ALL""",
    "presence": """SELECT DISTINCT l_returnflag AS cohort, concat('q', CAST(quarter(l_shipdate) AS VARCHAR)) AS layer, l_partkey AS sample FROM lineitem""",
    "design": """SELECT l_partkey % 50 AS feature, l_suppkey AS sample, l_suppkey % 2 AS batch, CAST(floor(l_suppkey / 2) AS BIGINT) % 2 AS cond,
  CASE WHEN (l_partkey % 50 * 7 + l_suppkey) % 11 = 0 THEN NULL ELSE log2(CAST(avg(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)) END AS value
  FROM lineitem GROUP BY l_partkey % 50, l_suppkey""",
    "records": """SELECT l_linestatus AS domain, l_returnflag AS pair, p_type AS method, p_size % 3 + 1 AS nlay,
  CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y+x' ELSE 'z+x+y' END AS subset, round(avg(l_discount * 10), 4) AS ari,
  CASE WHEN min(l_linenumber) + max(l_partkey) % 9 = 1 THEN 1 ELSE 0 END AS degen, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linestatus, l_returnflag, p_type, p_size % 3""",
    "boot": """SELECT r AS replicate, vec_id AS sample, (label + (vec_id * r) % 2) % 4 AS label
  FROM embeddings CROSS JOIN (SELECT unnest(range(0, 12)) AS r) b WHERE (vec_id * (2 * r + 3) + r) % 5 <> 0""",
    "emb": """SELECT vec_id AS sample, label, label % 2 AS batch, CAST(floor(label / 2) AS BIGINT) % 2 AS cond,
  CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS cohort, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""",
    "profile": "SELECT cohort, layer, feature, round(avg(value), 6) AS value FROM cells GROUP BY ALL",
    "pairs": """SELECT a.layer, a.feature, a.cohort AS cohort_a, b.cohort AS cohort_b, a.value AS x, b.value AS y
  FROM profile a JOIN profile b USING (layer, feature) WHERE a.cohort < b.cohort""",
    "ranked": """SELECT *, rank() OVER (PARTITION BY layer, cohort_a, cohort_b ORDER BY x) + (count(*) OVER (PARTITION BY layer, cohort_a, cohort_b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY layer, cohort_a, cohort_b ORDER BY y) + (count(*) OVER (PARTITION BY layer, cohort_a, cohort_b, y) - 1) / 2.0 AS ry FROM pairs""",
    "delta": """SELECT feature, batch, avg(CASE WHEN cond = 1 THEN value END) AS mean_case, avg(CASE WHEN cond <> 1 THEN value END) AS mean_control,
  avg(CASE WHEN cond = 1 THEN value END) - avg(CASE WHEN cond <> 1 THEN value END) AS delta FROM design GROUP BY feature, batch""",
    "deltas": "SELECT a.feature, round(a.delta, 6) AS x, round(b.delta, 6) AS y FROM delta a JOIN delta b USING (feature) WHERE a.batch = 0 AND b.batch = 1",
    "mads": """SELECT cohort, layer, feature, median(abs(value - m)) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY cohort, layer, feature) AS m FROM cells) GROUP BY ALL""",
    "dist": """SELECT i, j, sqrt(sum((x - y) * (x - y))) AS distance FROM (SELECT a.sample AS i, b.sample AS j, a.v AS x, b.v AS y FROM emb a JOIN emb b USING (pos) WHERE a.sample <> b.sample) GROUP BY i, j""",
    "purity": "SELECT s_suppkey AS sample, s_acctbal AS purity FROM supplier",
    "assoc": "SELECT layer, feature, count(*) AS n, corr(value, purity) AS r, regr_slope(value, purity) AS slope FROM cells JOIN purity USING (sample) GROUP BY layer, feature",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views in front; ``body`` may go on with views of its own."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + (body if body.lstrip().startswith(",") else "\n" + body)
