"""The jobs as queries: each runs twice into one new folder, and what then stands there is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans.fixtures import with_views
from cohortlens.session import make_importable, scratch
from jobs import harmonise_cohorts, identifier_ledger


def job1_identifier_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(make_importable(spark), "job1")
    # a pattern, as a file stream takes no path of a single file
    s = identifier_ledger.Settings(input=f"{sf_dir}/{{documents.parquet}}", output=f"{base}/out", checkpoint=f"{base}/checkpoint")
    for _ in range(2):
        identifier_ledger.run(spark, s)
    return identifier_ledger.output(spark, s)


#: How the measurements of the test tables name a cohort's cells.
CELLS = {"cohort": "l_returnflag", "layer": "l_linestatus", "feature": "l_partkey % 50", "sample": "l_suppkey", "value": "cast(l_extendedprice as decimal(18,2))"}


def job2_harmonise_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = harmonise_cohorts.Settings(input=f"{sf_dir}/lineitem.parquet", output=scratch(make_importable(spark), "job2"), **CELLS, completeness=0.05, most_variable=40)
    for _ in range(2):
        harmonise_cohorts.run(spark, s)
    return harmonise_cohorts.output(spark, s)


JOB1_SQL = r"""
WITH tokens AS (
  SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._@/\-][A-Za-z0-9]+)*')) AS t FROM documents),
tagged AS (
  SELECT doc_id, source, t, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 'entrez' WHEN regexp_matches(t, '^ENSG[0-9]+') THEN 'ensembl' WHEN regexp_matches(t, '^cg[0-9]{6,}$') THEN 'cpg'
    WHEN regexp_matches(t, '^(hsa-)?(mir|let)-') THEN 'mirna' WHEN regexp_matches(t, '^MIMAT[0-9]+$') THEN 'mimat' WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9\-\._@]*$') THEN 'symbol' ELSE 'other' END AS kind FROM tokens),
ledger AS (
  SELECT doc_id, source, kind, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct, min(t) AS example FROM tagged GROUP BY ALL
  UNION ALL SELECT doc_id, source, 'none', 0, 0, NULL FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM tokens))
SELECT 'document' AS level, doc_id, source, kind, 1 AS n_docs, n_tokens, n_distinct, example FROM ledger
UNION ALL SELECT 'source', NULL, source, kind, count(*), CAST(sum(n_tokens) AS BIGINT), NULL, min(example) FROM ledger GROUP BY source, kind
"""

JOB2_SQL = with_views(
    """, sizes AS (SELECT cohort, layer, count(DISTINCT sample) AS n_samples FROM cells GROUP BY ALL),
wide AS (SELECT layer, feature, cohort FROM cells JOIN sizes USING (cohort, layer) GROUP BY layer, feature, cohort, n_samples HAVING count(*) >= 0.05 * n_samples),
per_layer AS (SELECT layer, count(DISTINCT cohort) AS wanted FROM wide GROUP BY layer),
complete AS (SELECT layer, feature FROM wide JOIN per_layer USING (layer) GROUP BY layer, feature, wanted HAVING count(DISTINCT cohort) = wanted),
own AS (SELECT * FROM cells SEMI JOIN complete USING (layer, feature)),
spread AS (SELECT cohort, layer, feature, median(abs(value - m)) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY cohort, layer, feature) AS m FROM own) GROUP BY ALL),
variable AS (SELECT cohort, layer, feature FROM (SELECT *, row_number() OVER (PARTITION BY cohort, layer ORDER BY mad DESC, feature) AS place FROM spread WHERE mad > 0) WHERE place <= 40),
sides AS (SELECT layer, count(DISTINCT cohort) AS wanted FROM variable GROUP BY layer),
chosen AS (SELECT layer, feature FROM variable JOIN sides USING (layer) GROUP BY layer, feature, wanted HAVING count(*) = wanted),
kept AS (SELECT * FROM own SEMI JOIN chosen USING (layer, feature)),
z AS (SELECT cohort, layer, feature, sample, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-9 THEN stddev_pop(value) OVER w ELSE 1 END AS z FROM kept WINDOW w AS (PARTITION BY cohort, layer, feature)),
q AS (SELECT cohort, layer, count(*) AS n, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95, min(value) AS low, max(value) AS high FROM cells GROUP BY ALL),
means AS (SELECT cohort, layer, feature, round(avg(value), 6) AS value FROM kept GROUP BY ALL),
sided AS (SELECT a.layer, a.cohort AS cohort_a, b.cohort AS cohort_b, a.value AS x, b.value AS y FROM means a JOIN means b USING (layer, feature) WHERE a.cohort < b.cohort),
placed AS (SELECT *, rank() OVER (PARTITION BY layer, cohort_a, cohort_b ORDER BY x) + (count(*) OVER (PARTITION BY layer, cohort_a, cohort_b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY layer, cohort_a, cohort_b ORDER BY y) + (count(*) OVER (PARTITION BY layer, cohort_a, cohort_b, y) - 1) / 2.0 AS ry FROM sided),
rho AS (SELECT layer, cohort_a, cohort_b, count(*) AS n, corr(rx, ry) AS r FROM placed GROUP BY ALL)
SELECT 'scaled' AS part, cohort, layer, CAST(feature AS VARCHAR) AS feature, CAST(sample AS VARCHAR) AS sample, 1 AS n, round(z, 4) AS value, NULL AS verdict FROM z
UNION ALL SELECT 'quality', cohort, layer, NULL, NULL, n, round(q50, 4), CASE WHEN low >= 0 AND high <= 1 THEN 'unit interval' WHEN low >= -2 AND high <= 2 THEN 'discrete levels' WHEN q05 < 0 AND abs(q95) <= 20 THEN 'log ratio' WHEN low >= 0 AND high <= 25 THEN 'log count' WHEN low >= 0 THEN 'positive' ELSE 'other' END FROM q
UNION ALL SELECT 'concordance', cohort_a, layer, NULL, cohort_b, n, round(r, 4), CASE WHEN r > 0.8 THEN 'high' WHEN r > 0.5 THEN 'moderate' ELSE 'low' END FROM rho""",
    "cells",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_identifier_ledger": job1_identifier_ledger, "job2_harmonise_cohorts": job2_harmonise_cohorts}


def oracle_sql() -> dict[str, str]:
    return {"job1_identifier_ledger": JOB1_SQL, "job2_harmonise_cohorts": JOB2_SQL}
