"""Registered queries of guards, keys, corrections and p-values, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import distributed as D
from cohortlens.operators import learners as L
from cohortlens.operators import matrix as M
from cohortlens.operators import rank as R
from cohortlens.operators import relational as J
from cohortlens.operators import scorers as T
from cohortlens.operators import verify as V
from cohortlens.plans import fixtures as X
from cohortlens.plans.catalogue import _LOADING, _PAIRED, BY, _pairs, _purity, _seed_centroids, query, r4, r6
from cohortlens.plans import tables as P
from cohortlens.session import table
from cohortlens.sources import matrix as FM


def simpson(f: str, end: str, n: int = 2000) -> str:
    """SQL of the integral of ``f`` (of x) from 0 to ``end`` by Simpson's rule."""
    return f"(SELECT sum(CASE WHEN i IN (0, {n}) THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * {f}) FROM (SELECT i, {end} * i / {n}.0::DOUBLE AS x FROM (SELECT unnest(range({n + 1})) AS i))) * {end} / {3 * n}.0::DOUBLE"


def t_tails(t: str, df: str) -> str:
    """SQL of Student's two-sided p."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) / sqrt(pi()) * {simpson(f'pow(cos(x), {df} - 1)', angle)})"


# ---------- numbers, keys, filters


_TEXTS = """WITH t AS (SELECT l_linestatus, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'x7' WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 3 THEN '-1.5' WHEN 4 THEN 'inf' END AS a FROM lineitem),
n AS (SELECT l_linestatus, CASE WHEN NOT isnan(TRY_CAST(a AS DOUBLE)) THEN TRY_CAST(a AS DOUBLE) END AS v FROM t)"""


@query(_TEXTS + """ SELECT l_linestatus, count(*) AS n, count(v) AS n_parsed, count(*) FILTER (isfinite(v)) AS n_finite, count(*) FILTER (v > 0) AS n_positive, sum(CASE WHEN isfinite(v) THEN v ELSE 0 END) AS total FROM n GROUP BY l_linestatus""")
def number_coercion(spark, d):
    k = F.col("l_orderkey") % 6
    a = F.when(k == 0, "NaN").when(k == 1, "x7").when(k == 2, F.col("l_quantity").cast("int").cast("string")).when(k == 3, "-1.5").when(k == 4, "inf")
    t = table(spark, d, "lineitem").select("l_linestatus", S.number(a).alias("v"))
    kept = F.coalesce(S.finite(F.col("v")), F.lit(0.0))
    return t.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count("v").alias("n_parsed"), F.count(S.finite(F.col("v"))).alias("n_finite"), F.count_if(F.col("v") > 0).alias("n_positive"), F.sum(kept).alias("total"))


@query("SELECT feature, round(avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END), 4) AS least_share FROM design GROUP BY feature HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) > 0.9", "design")
def strict_completeness(spark, d):
    return J.complete_features(X.design(spark, d), 0.9, by=(), strict=True).select("feature", r4("least_share"))


@query("SELECT feature, count(value) AS n FROM design GROUP BY feature HAVING count(value) >= (SELECT CAST(floor(0.905::DOUBLE * count(DISTINCT sample)) AS BIGINT) FROM design)", "design")
def dense_features(spark, d):
    return FM.dense_features(X.design(spark, d), 0.905).groupBy("feature").agg(F.count("value").alias("n"))


@query("""SELECT kind, n FROM (SELECT CASE WHEN p_size % 4 > 0 THEN p_brand END AS kind, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, kind NULLS LAST LIMIT 7""")
def value_counts(spark, d):
    t = table(spark, d, "part").select(F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("kind"))
    return J.value_counts(t, "kind", 7).withColumnRenamed("count", "n")


@query("""SELECT DISTINCT subset, CASE subset WHEN 'x' THEN 'x' WHEN 'y+x' THEN 'x+y' ELSE 'x+y+z' END AS subset_key, nlay AS n_layers, concat(pair, 'x', domain) AS pair_key,
  CASE WHEN domain = 'F' THEN 'A' ELSE 'B' END AS side, CASE pair WHEN 'A' THEN 'first' WHEN 'N' THEN 'second' ELSE pair END AS name FROM records""", "records")
def record_keys(spark, d):
    c = F.col
    out = X.records(spark, d).select("subset", S.subset_key(c("subset")).alias("subset_key"), S.layer_count(c("subset")).cast("long").alias("n_layers"), S.pair_key(F.concat(c("pair"), F.lit(" × "), c("domain"), F.lit(" "))).alias("pair_key"), S.domain_token(c("domain"), "F").alias("side"), S.decoded(c("pair"), {"A": "first", "N": "second"}).alias("name"))
    return out.distinct()


@query(r"""SELECT c_custkey, regexp_replace(regexp_replace(translate(printed, '−', '-'), '0+$', ''), '\.$', '') AS number, contains(regexp_replace(concat(c_name, ' ', c_mktsegment), '\s+', '', 'g'), '0B') AS holds
  FROM (SELECT *, replace(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '-', '−') AS printed FROM customer)""")
def printed_numbers(spark, d):
    printed = F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("-"), F.lit("−"))
    return table(spark, d, "customer").select("c_custkey", S.plain_number(printed).alias("number"), S.flattened(F.concat_ws(" ", "c_name", "c_mktsegment")).contains("0B").alias("holds"))


@query("""SELECT grp, count(*) AS n, count(DISTINCT c) AS n_cases FROM (SELECT o_orderkey, regexp_replace(upper(trim(lower(concat(' c', CAST(o_custkey AS VARCHAR), '-A ')))), '-[A-Z]$', '') AS c FROM orders)
  JOIN (SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS c, c_mktsegment AS grp FROM customer WHERE c_custkey % 3 <> 0) USING (c) GROUP BY grp""")
def case_groups(spark, d):
    o = table(spark, d, "orders").select(S.case_id(F.lower(F.concat(F.lit(" c"), F.col("o_custkey").cast("string"), F.lit("-A ")))).alias("case_id"))
    g = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("case_id"), F.col("c_mktsegment").alias("grp"))
    return J.lookup(o, g, "case_id", "grp").where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"))


@query("SELECT cohort, layer, count(*) AS n_cells FROM cells GROUP BY ALL HAVING count(DISTINCT feature) >= 50 AND count(DISTINCT sample) >= 8", "cells")
def unit_guards(spark, d):
    return J.guarded(X.cells(spark, d), ["cohort", "layer"], {"feature": 50, "sample": 8}).groupBy("cohort", "layer").agg(F.count("*").alias("n_cells"))


@query(""", b AS (SELECT 'many' AS unit, * FROM boot UNION ALL SELECT 'few', * FROM boot WHERE replicate < 3 UNION ALL SELECT 'small', * FROM boot WHERE sample < 10),
ok AS (SELECT unit FROM b GROUP BY unit HAVING count(DISTINCT replicate) >= 4),
c AS (SELECT x.unit, x.sample AS i, y.sample AS j, avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0.0 END) AS c FROM b x JOIN b y ON x.unit = y.unit AND x.replicate = y.replicate JOIN ok ON ok.unit = x.unit WHERE x.sample < y.sample GROUP BY ALL)
SELECT unit, count(*) AS n_pairs, round(avg(CASE WHEN c > 0.1 AND c < 0.9 THEN 1.0 ELSE 0.0 END), 4) AS pac FROM c GROUP BY unit HAVING count(*) >= 100""", "boot")
def pac_guards(spark, d):
    b = X.boot(spark, d)
    units = [b.withColumn("unit", F.lit("many")), b.where("replicate < 3").withColumn("unit", F.lit("few")), b.where("sample < 10").withColumn("unit", F.lit("small"))]
    return T.pac(units[0].unionByName(units[1]).unionByName(units[2]), by=["unit"]).select("unit", "n_pairs", r4("pac"))


@query(""", top AS (SELECT cohort, layer, feature FROM (SELECT *, row_number() OVER (PARTITION BY cohort, layer ORDER BY mad DESC, feature) AS place FROM mads WHERE mad > 0) WHERE place <= 12),
common AS (SELECT layer, feature FROM (SELECT layer, feature, count(DISTINCT cohort) AS held FROM top GROUP BY ALL) JOIN (SELECT layer, count(DISTINCT cohort) AS wanted FROM top GROUP BY layer) USING (layer) WHERE held = wanted),
every AS (SELECT layer, feature FROM (SELECT layer, feature, count(DISTINCT cohort) AS held FROM cells GROUP BY ALL) JOIN (SELECT layer, count(DISTINCT cohort) AS wanted FROM cells GROUP BY layer) USING (layer) WHERE held = wanted),
few AS (SELECT l.layer, count(b.feature) < 10 AS few FROM (SELECT DISTINCT layer FROM cells) l LEFT JOIN common b USING (layer) GROUP BY l.layer)
SELECT layer, feature, 0 AS fallback FROM common JOIN few USING (layer) WHERE NOT few UNION ALL
SELECT layer, feature, 1 FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY feature) AS r FROM every) JOIN few USING (layer) WHERE few AND r <= 12""", "cells", "mads")
def mad_shared_fallback(spark, d):
    return R.shared_top_mad(X.cells(spark, d), 12, least=10)


@query("SELECT feature, sample, round(coalesce(value, median(value) OVER (PARTITION BY feature)), 4) AS imputed FROM design", "design")
def column_median_impute(spark, d):
    return M.cell_median_impute(X.design(spark, d), by=("feature",)).select("feature", "sample", r4("imputed"))


@query("SELECT sample, pos - 1 AS feature, round((v - avg(v) OVER (PARTITION BY pos)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY pos) > 1e-9 THEN stddev_pop(v) OVER (PARTITION BY pos) ELSE 1 END, 4) AS z FROM emb", "emb")
def standard_scaler(spark, d):
    v = X.vectors(spark, d).select("sample", F.posexplode("features").alias("feature", "value"))
    return M.zscore(v, ["feature"]).select("sample", F.col("feature").cast("long").alias("feature"), r4("z"))


# ---------- corrections


_COMBAT = """, h AS (SELECT feature, batch, sample, CAST(cond AS DOUBLE) AS c, value AS v FROM design WHERE value IS NOT NULL),
o AS (SELECT feature, batch, count(*) AS n, avg(v) AS mv, avg(c) AS mc, covar_pop(v, c) AS cvc, var_pop(c) AS vc, var_pop(v) AS vv FROM h GROUP BY ALL),
s AS (SELECT feature, CASE WHEN sum(n * vc) > 1e-9 THEN sum(n * cvc) / sum(n * vc) ELSE 0 END AS b FROM o GROUP BY feature),
f AS (SELECT feature, sum(n * (mv - b * mc)) / sum(n) AS grand, sqrt(sum(n * (vv - 2 * b * cvc + b * b * vc)) / sum(n)) AS sd FROM o JOIN s USING (feature) GROUP BY feature),
l AS (SELECT feature, batch, n, b, grand, sd, (mv - b * mc - grand) / sd AS g, (vv - 2 * b * cvc + b * b * vc) / (sd * sd) * n / (n - 1) AS d FROM o JOIN s USING (feature) JOIN f USING (feature)),
p AS (SELECT batch, avg(g) AS g0, var_samp(g) AS t2, avg(d) AS m, var_samp(d) AS s2 FROM l GROUP BY batch),
q AS (SELECT l.*, g0, t2, (2 * s2 + m * m) / s2 AS pa, (m * s2 + m * m * m) / s2 AS pb FROM l JOIN p USING (batch)),
it AS (SELECT feature, batch, n, g, d, g0, t2, pa, pb, g AS gs, d AS ds, 0 AS k FROM q UNION ALL
  SELECT feature, batch, n, g, d, g0, t2, pa, pb, ng, (((n - 1) * d + n * (g - ng) * (g - ng)) / 2 + pb) / (n / 2.0::DOUBLE + pa - 1), k + 1 FROM (SELECT *, (n * t2 * g + ds * g0) / (n * t2 + ds) AS ng FROM it WHERE k < 30)),
star AS (SELECT feature, batch, gs, ds FROM it WHERE k = 30)
SELECT design.feature, design.sample, round(((value - grand - b * cond) / sd - gs) / sqrt(ds) * sd + grand + b * cond, 4) AS adjusted FROM design JOIN l USING (feature, batch) JOIN star USING (feature, batch)"""


@query(_COMBAT, "design")
def combat_covariate(spark, d):
    return M.combat(X.design(spark, d), covariate="cond").select("feature", "sample", r4("adjusted"))


@query(""", w1 AS (SELECT pos, CASE WHEN pos % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS l FROM (SELECT DISTINCT pos FROM emb)), w2 AS (SELECT pos, CASE WHEN pos % 3 = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS l FROM (SELECT DISTINCT pos FROM emb WHERE pos > 5)),
u1 AS (SELECT pos, l / sqrt((SELECT sum(l * l) FROM w1)) AS l FROM w1), s1 AS (SELECT sample, sum(v * l) AS s FROM emb JOIN u1 USING (pos) GROUP BY sample), e1 AS (SELECT sample, pos, v - s * l AS v FROM emb JOIN u1 USING (pos) JOIN s1 USING (sample)),
u2 AS (SELECT pos, l / sqrt((SELECT sum(l * l) FROM w2)) AS l FROM w2), s2 AS (SELECT sample, sum(v * l) AS s FROM e1 JOIN u2 USING (pos) GROUP BY sample), e2 AS (SELECT sample, pos, v - s * l AS v FROM e1 JOIN u2 USING (pos) JOIN s2 USING (sample))
SELECT sample, pos - 1 AS feature, round((v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos), 4) AS z FROM e2""", "emb")
def directions_removed(spark, d):
    v = X.vectors(spark, d).select("sample", F.posexplode("features").alias("feature", "value"))
    f = v.select("feature").distinct()
    first = f.select("feature", F.when(F.col("feature") % 2 == 0, 1.0).otherwise(-0.5).alias("loading"))
    second = f.where("feature >= 5").select("feature", F.when(F.col("feature") % 3 == 0, 1.0).otherwise(0.25).alias("loading"))
    return M.remove_directions(v, [first, second]).select("sample", F.col("feature").cast("long").alias("feature"), r4("z"))


@query(""", r AS (SELECT cohort, layer, feature, sample, value - (purity - (SELECT avg(purity) FROM purity)) * slope AS x FROM cells JOIN purity USING (sample) JOIN assoc USING (layer, feature))
SELECT cohort, layer, feature, sample, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 1e-9 THEN stddev_pop(x) OVER w ELSE 1 END, 4) AS z FROM r WINDOW w AS (PARTITION BY cohort, layer, feature)""", "cells", "purity", "assoc")
def residual_zscore(spark, d):
    c, p = X.cells(spark, d), _purity(spark, d)
    out = M.residualise(c, p, M.covariate_association(c, p))
    return M.zscore(out, ["cohort", "layer", "feature"], "residual").select("cohort", "layer", "feature", "sample", r4("z"))


@query("SELECT sample % 5 AS unit, count(DISTINCT sample) AS n_samples, 'no sample has purity' AS err FROM cells WHERE sample % 5 = 3 GROUP BY 1", "cells")
def residual_errors(spark, d):
    c = X.cells(spark, d).withColumn("unit", F.col("sample") % 5)
    return M.not_residualised(c, _purity(spark, d).where("sample % 5 <> 3"), ["unit"]).select("unit", "n_samples", "err")


@query("SELECT layer, feature, round(r, 6) AS r, row_number() OVER (PARTITION BY layer ORDER BY abs(r) DESC, feature) AS place FROM assoc", "cells", "purity", "assoc")
def effect_rank(spark, d):
    a = M.covariate_association(X.cells(spark, d), _purity(spark, d))
    return R.effect_rank(a, "r", ["layer"], "feature").select("layer", "feature", r6("r"), F.col("place").cast("long").alias("place"))


# ---------- summaries and p-values


@query(", s AS (SELECT domain, stddev_samp(ari) AS sd FROM records GROUP BY domain, pair, method HAVING stddev_samp(ari) IS NOT NULL) SELECT domain, count(*) AS n_units, round(median(sd), 6) AS median_sd FROM s GROUP BY domain", "records")
def spread_over_layers(spark, d):
    s = T.spread_over(X.records(spark, d), ["domain", "pair", "method"], "nlay")
    return s.groupBy("domain").agg(F.count("*").alias("n_units"), r6(F.median("sd"), "median_sd"))


@query(""", n AS (SELECT replicate, label, count(*) AS n FROM boot GROUP BY ALL), b AS (SELECT replicate, max(n) / sum(n) AS most FROM n GROUP BY replicate)
SELECT round(avg(most), 6) AS mean_most, round(avg(CASE WHEN replicate % 2 = 0 THEN most END), 6) AS mean_even, round(avg(CASE WHEN replicate % 2 = 1 THEN most END), 6) AS mean_odd, round(avg(CASE WHEN most > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS degenerate FROM b""", "boot")
def balance_means(spark, d):
    b = T.cluster_balance(X.boot(spark, d), "label", ["replicate"], 0.3)
    even, most = F.col("replicate") % 2 == 0, F.col("max_fraction")
    return b.agg(r6(F.avg(most), "mean_most"), r6(F.avg(F.when(even, most)), "mean_even"), r6(F.avg(F.when(~even, most)), "mean_odd"), r6(F.avg("degen_balance"), "degenerate"))


@query(""", c AS (SELECT sample AS label, pos, v FROM emb WHERE sample < 4), s AS (SELECT e.sample, c.label, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM emb e JOIN c USING (pos) GROUP BY ALL),
n AS (SELECT cohort, label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, label) AS rn FROM s) JOIN (SELECT DISTINCT sample, cohort FROM emb) USING (sample) WHERE rn = 1 GROUP BY ALL)
SELECT cohort, count(*) AS n_clusters, round(max(n) / sum(n), 4) AS max_fraction, CASE WHEN max(n) / sum(n) > 0.8 THEN 1 ELSE 0 END AS degenerate FROM n GROUP BY cohort""", "emb")
def cross_cohort_degeneracy(spark, d):
    v = X.vectors(spark, d)
    given = T.nearest_centroid(v, _seed_centroids(spark, d)).join(v.select("sample", "cohort"), "sample")
    return T.cluster_balance(given, "label", ["cohort"], 0.8).select("cohort", "n_clusters", r4("max_fraction"), F.col("degen_balance").alias("degenerate"))


@query(""", s AS (SELECT domain, stddev_samp(ari) AS sd FROM records GROUP BY domain, method, subset HAVING stddev_samp(ari) IS NOT NULL)
SELECT domain, count(*) AS n_units, CAST(ceil(pow(2.8::DOUBLE * median(sd) / 0.05::DOUBLE, 2)) AS BIGINT) AS required_n, round(2.8::DOUBLE * median(sd) / sqrt(count(*)), 6) AS least_visible FROM s GROUP BY domain""", "records")
def least_visible_difference(spark, d):
    floor = T.noise_floor(X.records(spark, d), ["method", "subset"], ["domain"])
    return T.required_n(floor, "median_sd", F.lit(0.05), n=F.col("n_units")).select("domain", "n_units", "required_n", r6("least_visible"))


@query(", s AS (SELECT layer, cohort_a, cohort_b, count(*) AS n, corr(rx, ry) AS rho FROM ranked GROUP BY ALL), t AS (SELECT *, rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS t FROM s) SELECT layer, cohort_a, cohort_b, n, round(rho, 4) AS spearman, round(" + t_tails("t", "(n - 2)") + ", 6) AS p FROM t", "cells", "profile", "pairs", "ranked")
def correlation_p_values(spark, d):
    return T.correlation_p(T.spearman(_pairs(spark, d), BY)).select(*BY, "n", r4("spearman"), r6("p"))


@query(_PAIRED + ", g AS (SELECT method, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM p GROUP BY method) SELECT method, n, round(t, 6) AS t, round(" + t_tails("t", "(n - 1)") + ", 6) AS p FROM g", "records")
def paired_p_values(spark, d):
    return T.paired_p(T.paired_vs_baseline(X.records(spark, d), ["domain", "pair", "subset"], "ECONOMY")).select("method", "n", r6("t"), r6("p"))


_U = """WITH r AS (SELECT event_type, user_id % 2 AS y, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS r FROM events WHERE value IS NOT NULL),
s AS (SELECT event_type, sum(y) AS n1, sum(1 - y) AS n0, sum(r * y) AS s FROM r GROUP BY event_type), u AS (SELECT *, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s),
z AS (SELECT *, greatest(abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5::DOUBLE, 0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0::DOUBLE) AS z FROM u)
"""


@query(_U + "SELECT event_type, u, round(u / (n1 * n0), 4) AS auc, round(greatest(0, 1 - 2 / sqrt(2 * pi()) * " + simpson("exp(-x * x / 2)", "z") + "), 4) AS p FROM z")
def mann_whitney(spark, d):
    out = T.mann_whitney_p(T.auc(table(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 2 == 1))
    return out.select("event_type", "u", r4("auc"), r4("p"))


# ---------- blocks, texts and tables


@query(""", h AS (SELECT * FROM cells WHERE cohort = 'N' AND substring(CAST(sample AS VARCHAR), 1, 1) IN ('1', '2', '3')),
k AS (SELECT sample FROM h GROUP BY sample HAVING count(DISTINCT layer) = (SELECT count(DISTINCT layer) FROM h)),
g AS (SELECT f.layer, f.feature, k.sample, h.value AS v FROM (SELECT DISTINCT layer, feature FROM h WHERE sample IN (SELECT sample FROM k)) f CROSS JOIN k LEFT JOIN h USING (layer, feature, sample)),
z AS (SELECT layer, feature, sample, coalesce((v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-9 THEN stddev_pop(v) OVER w ELSE 1 END, 0) AS z FROM g WINDOW w AS (PARTITION BY layer, feature))
SELECT 'N' AS cohort, layer, sample, row_number() OVER (PARTITION BY layer, sample ORDER BY feature) - 1 AS place, round(z, 4) AS z FROM z""", "cells")
def cohort_blocks(spark, d):
    wanted = spark.createDataFrame([("1x",), ("2",), ("3-A",)], "id string")
    blocks = J.cohort_blocks(X.cells(spark, d).where("cohort = 'N'"), wanted, prefix=1, least_samples=2)
    return blocks.select("cohort", "layer", "sample", F.posexplode("features").alias("place", "z")).select("cohort", "layer", "sample", F.col("place").cast("long").alias("place"), r4("z"))


@query("""SELECT item_id, len(t) AS n_chars, 1 + CASE WHEN contains(text, 'the') THEN 0 ELSE 1 END AS n_missing FROM (SELECT item_id, text, replace(replace(text, 'the', 'THE'), 'no such anchor', 'x') AS t FROM benchmark WHERE text IS NOT NULL)""")
def plan_edits(spark, d):
    t = table(spark, d, "benchmark").where("text is not null")
    out = V.edited(t, "text", [("the", "THE"), ("no such anchor", "x")])
    return out.select("item_id", F.char_length("edited").cast("long").alias("n_chars"), F.size("missing").cast("long").alias("n_missing"))


@query(r"""SELECT kind, token, count(*) AS n FROM (SELECT 'code' AS kind, concat('run ', CAST(doc_id % 3 AS VARCHAR)) AS token FROM documents UNION ALL SELECT 'figure', concat('Fig. ', CAST(doc_id % 4 AS VARCHAR)) FROM documents
  UNION ALL SELECT 'figure', 'Table S2' FROM documents UNION ALL SELECT 'citation', CAST(doc_id % 5 AS VARCHAR) FROM documents UNION ALL SELECT 'citation', '7' FROM documents
  UNION ALL SELECT 'figure', unnest(regexp_extract_all(text, '(?:Figure|Fig\.|Table) S?[0-9]+[a-z]?')) FROM documents) GROUP BY ALL""")
def text_tokens(spark, d):
    k = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nSee Fig. "), k(4), F.lit(" and Table S2 ["), k(5), F.lit(", 7].\n```sh\nrun "), k(3), F.lit("\n```\n"))
    t = table(spark, d, "documents").select(text.alias("t"))
    parts = [t.select(F.lit(kind).alias("kind"), F.explode(f(F.col("t"))).alias("token")) for kind, f in (("code", S.fenced_code), ("figure", S.figure_references), ("citation", S.citation_numbers))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "token").agg(F.count("*").alias("n"))


@query(r"SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[A-Za-z][A-Za-z0-9\-\._@]*$') GROUP BY w")
def symbol_filter(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return words.where(F.col("w").rlike(S.SYMBOL_ID)).groupBy("w").agg(F.count("*").alias("n"))


@query()
def purity_components(spark, d):
    v = X.vectors(spark, d).withColumn("unit", F.lit("all")).withColumn("purity", F.col("label") * 0.1 + F.col("features")[0])
    return L.ranked_components(v, ["unit"], "purity")


@query("""SELECT cohort, layer, count(DISTINCT feature) AS n_features, CASE WHEN min(value) >= 0 AND max(value) <= 1 THEN 'unit interval' WHEN min(value) >= -2 AND max(value) <= 2 THEN 'discrete levels' WHEN quantile_cont(value, 0.05) < 0 AND abs(quantile_cont(value, 0.95)) <= 20 THEN 'log ratio'
  WHEN min(value) >= 0 AND max(value) <= 25 THEN 'log count' WHEN min(value) >= 0 THEN 'positive' ELSE 'other' END AS domain, round(100 * avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END), 4) AS pct_finite, round(quantile_cont(value, 0.05), 4) AS q05, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.95), 4) AS q95 FROM cells GROUP BY cohort, layer""", "cells")
def table_1a(spark, d):
    return P.numeric_domains(X.cells(spark, d)).select("cohort", "layer", "n_features", "domain", *[r4(c) for c in ("pct_finite", "q05", "q50", "q95")])


@query("SELECT CASE WHEN cohort = 'A' THEN 'A' ELSE 'B' END AS domain, cohort, " + ", ".join(f"count(*) FILTER (held >= {i}) AS n_samples_all_{i}_layers" for i in (1, 2, 3, 4)) + " FROM (SELECT cohort, sample, count(DISTINCT layer) AS held FROM presence GROUP BY ALL) GROUP BY cohort", "presence")
def table_1b(spark, d):
    return P.availability(X.presence(spark, d), F.when(F.col("cohort") == "A", "A").otherwise("B"))


@query(", s AS (SELECT layer, concat(cohort_a, '-', cohort_b) AS cohort_pair, count(*) AS n_genes, corr(rx, ry) AS rho FROM ranked GROUP BY ALL), t AS (SELECT *, rho * sqrt((n_genes - 2) / greatest(1 - rho * rho, 1e-300)) AS t FROM s) SELECT layer, cohort_pair, n_genes, round(rho, 4) AS spearman, round(" + t_tails("t", "(n_genes - 2)") + ", 6) AS p FROM t", "cells", "profile", "pairs", "ranked")
def table_2(spark, d):
    return P.concordance(_pairs(spark, d)).select("layer", "cohort_pair", "n_genes", r4("spearman"), r6("p"))


_R = ", r AS (SELECT *, (n % 50 + 10) / 100.0::DOUBLE AS x FROM records)"


def _scored(spark, d):
    return X.records(spark, d).withColumn("x", (F.col("n") % 50 + 10) / 100)


@query(_R + """ SELECT method, round(avg(CASE WHEN domain = 'F' THEN ari END), 6) AS "domain_A_ARI", round(avg(CASE WHEN domain = 'O' THEN ari END), 6) AS "domain_B_ARI", round(avg(ari), 6) AS "overall_ARI", round(avg(x), 6) AS max_cluster_fraction, round(avg(degen), 6) AS degeneracy_rate, count(*) AS n_records FROM r GROUP BY method""", "records")
def table_3(spark, d):
    out = P.method_ranking(_scored(spark, d).withColumnRenamed("x", "max_fraction"), "F", "O")
    return out.select("method", *[r6(c) for c in ("domain_A_ARI", "domain_B_ARI", "overall_ARI", "max_cluster_fraction", "degeneracy_rate")], "n_records")


@query("""SELECT method, round(avg(ari), 6) AS "mean_ARI", count(*) AS n_records, CASE WHEN method LIKE 'ECONOMY%' THEN 'economy kernel' ELSE method END AS implementation FROM records GROUP BY method""", "records")
def table_4(spark, d):
    names = {r["method"]: "economy kernel" for r in X.records(spark, d).where("method like 'ECONOMY%'").select("method").distinct().collect()}  # a few methods
    return P.package_ranking(X.records(spark, d), names).select("method", r6("mean_ARI"), "n_records", "implementation")


@query(_R + """ SELECT method, round(avg(CASE WHEN domain = 'F' THEN x END), 6) AS "PAC_A", round(avg(CASE WHEN domain = 'O' THEN x END), 6) AS "PAC_B", round(avg(x), 6) AS "PAC_overall", round(avg(1 - x), 6) AS strong_consensus, round(avg(x / 2), 6) AS median_consensus, count(*) AS n_records FROM r GROUP BY method""", "records")
def table_5a(spark, d):
    out = P.stability(_scored(spark, d).withColumnRenamed("x", "pac").withColumn("strong", 1 - F.col("pac")).withColumn("median_consensus", F.col("pac") / 2), "F", "O")
    return out.select("method", *[r6(c) for c in ("PAC_A", "PAC_B", "PAC_overall", "strong_consensus", "median_consensus")], "n_records")


# ---------- one large unit


@query(_LOADING, "emb")
def distributed_component(spark, d):
    _, loadings, _ = D.principal_components(X.vectors(spark, d), 1)
    return spark.createDataFrame([("all", i, float(x)) for i, x in enumerate(loadings[:, 0])], "unit string, feature long, loading double").withColumn("loading", F.round("loading", 4))


_LLOYD = ", c0 AS (SELECT sample AS label, pos, v FROM emb WHERE sample < 4)" + "".join(
    f""", d{i} AS (SELECT e.sample, c.label, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM emb e JOIN c{i} c USING (pos) GROUP BY ALL), l{i} AS (SELECT sample, label FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, label) AS rn FROM d{i}) WHERE rn = 1),
c{i + 1} AS (SELECT c.label, c.pos, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT l.label, e.pos, avg(e.v) AS v FROM emb e JOIN l{i} l ON l.sample = e.sample GROUP BY l.label, e.pos) m ON m.label = c.label AND m.pos = c.pos)"""
    for i in range(3)
)


@query(_LLOYD + " SELECT label, pos - 1 AS feature, round(v, 4) AS centroid FROM c3", "emb")
def distributed_lloyd(spark, d):
    v = X.vectors(spark, d)
    first = np.array([r["features"] for r in v.where("sample < 4").orderBy("sample").collect()])  # four rows
    c = D.lloyd(v, first, 3)
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(c.shape[1])], "label long, feature long, centroid double").withColumn("centroid", F.round("centroid", 4))
