"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import learners as L
from cohortlens.operators import matrix as M
from cohortlens.operators import rank as R
from cohortlens.operators import relational as J
from cohortlens.operators import scorers as T
from cohortlens.operators import verify as V
from cohortlens.plans import experiment as B
from cohortlens.plans import fixtures as X
from cohortlens.session import table

_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(body: str | None = None, *views: str):
    """Register a query, with its SQL after the named views."""

    def keep(f: Callable) -> Callable:
        _FOUND[f.__name__] = (f, None if body is None else X.with_views(body, *views) if views else body)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None}


def r4(c, name: str | None = None):
    """Rounded to 4 places under its own or a given name."""
    return F.round(F.col(c) if isinstance(c, str) else c, 4).alias(name or c)


def r6(c, name: str | None = None):
    """Rounded to 6 places: means of numbers of 4 places often end in a 5 at the fifth."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def _profile(spark, d):
    return J.profile(X.cells(spark, d)).withColumn("value", F.round("value", 6))


def _pairs(spark, d):
    return J.aligned_pairs(_profile(spark, d))


def _delta(spark, d):
    return J.group_delta(X.design(spark, d), ["feature", "batch"], F.col("cond") == 1)


def _deltas(spark, d):
    t = _delta(spark, d).select("feature", "batch", F.round("delta", 6).alias("delta"))
    return t.where("batch = 0").select("feature", F.col("delta").alias("x")).join(t.where("batch = 1").select("feature", F.col("delta").alias("y")), "feature")


BY = ["layer", "cohort_a", "cohort_b"]

# ---------- profiles, joins, counts


@query("""SELECT layer, cohort_a, cohort_b, count(*) AS n_features, round(corr(rx, ry), 4) AS spearman,
  CASE WHEN corr(rx, ry) > 0.8 THEN 'high' WHEN corr(rx, ry) > 0.5 THEN 'moderate' ELSE 'low' END AS band FROM ranked GROUP BY ALL""", "cells", "profile", "pairs", "ranked")
def profile_concordance(spark, d):
    out = T.spearman(_pairs(spark, d), BY)
    return out.select(*BY, F.col("n").alias("n_features"), r4("spearman"), T.band(F.col("spearman")).alias("band"))


@query("SELECT cohort, layer, feature, sample, round(value, 4) AS value FROM cells", "cells")
def dedup_mean_cells(spark, d):
    return X.cells(spark, d).select("cohort", "layer", "feature", "sample", r4("value"))


@query("""SELECT cohort, n_layers, count(*) AS n_samples FROM (SELECT cohort, sample, count(DISTINCT layer) AS held FROM presence GROUP BY ALL)
  JOIN (SELECT unnest(range(1, 5)) AS n_layers) ON n_layers <= held GROUP BY ALL""", "presence")
def layer_availability(spark, d):
    return J.layer_availability(X.presence(spark, d)).select("cohort", F.col("n_layers").cast("long").alias("n_layers"), "n_samples")


@query("""SELECT cohort, count(*) FILTER (held >= 1) AS l1, count(*) FILTER (held >= 2) AS l2, count(*) FILTER (held >= 3) AS l3, count(*) FILTER (held >= 4) AS l4
  FROM (SELECT cohort, sample, count(DISTINCT layer) AS held FROM presence GROUP BY ALL) GROUP BY cohort""", "presence")
def availability_pivot(spark, d):
    wide = J.layer_availability(X.presence(spark, d)).groupBy("cohort").pivot("n_layers", [1, 2, 3, 4]).agg(F.max("n_samples"))
    return wide.select("cohort", *[F.coalesce(str(i), F.lit(0)).alias(f"l{i}") for i in (1, 2, 3, 4)])


@query(""", every AS (SELECT DISTINCT cohort, layer FROM presence), held AS (SELECT cohort, sample, count(*) AS k FROM presence GROUP BY ALL),
lacking AS (SELECT h.cohort, e.layer, h.sample FROM held h JOIN every e USING (cohort) ANTI JOIN presence p ON p.cohort = h.cohort AND p.layer = e.layer AND p.sample = h.sample WHERE h.k = (SELECT count(*) FROM every x WHERE x.cohort = h.cohort) - 1),
n AS (SELECT cohort, count(*) FILTER (k = (SELECT count(*) FROM every x WHERE x.cohort = held.cohort)) AS n_all FROM held GROUP BY cohort),
g AS (SELECT cohort, layer, count(*) AS gain FROM lacking GROUP BY ALL)
SELECT e.cohort, e.layer AS left_out, n_all, n_all + coalesce(gain, 0) AS n_without, coalesce(gain, 0) AS gain FROM every e JOIN n USING (cohort) LEFT JOIN g USING (cohort, layer)""", "presence")
def leave_one_layer_out(spark, d):
    return J.leave_one_out(X.presence(spark, d))


@query("""SELECT layer, sample FROM (SELECT layer, sample, count(DISTINCT cohort) AS held FROM presence GROUP BY ALL) JOIN (SELECT layer, count(DISTINCT cohort) AS wanted FROM presence GROUP BY layer) USING (layer) WHERE held = wanted""", "presence")
def shared_features_nway(spark, d):
    return J.in_all(X.presence(spark, d), "sample", "cohort", ["layer"])


@query("""SELECT cohort, sample FROM (SELECT cohort, sample, count(DISTINCT layer) AS held FROM presence GROUP BY ALL) JOIN (SELECT cohort, count(DISTINCT layer) AS wanted FROM presence GROUP BY cohort) USING (cohort) WHERE held = wanted""", "presence")
def complete_samples(spark, d):
    return J.in_all(X.presence(spark, d), "sample", "layer", ["cohort"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' AS side FROM b WHERE k NOT IN (SELECT k FROM a)""")
def set_difference_both_ways(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    return J.only_on_one_side(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["k"])


@query("""SELECT side, method, count(*) AS n, round(avg(ari), 6) AS mean_ari FROM (SELECT 'first' AS side, method, ari FROM records WHERE domain = 'F' UNION ALL SELECT 'second', method, ari FROM records WHERE domain = 'O') GROUP BY ALL""", "records")
def union_tagged_ranking(spark, d):
    r = X.records(spark, d)
    both = J.union_tagged({"first": r.where("domain = 'F'"), "second": r.where("domain = 'O'")})
    return both.groupBy("side", "method").agg(F.count("*").alias("n"), r6(F.avg("ari"), "mean_ari")).orderBy("side", F.desc("mean_ari"), "method")


@query("SELECT domain, pair, method, subset, ari FROM (SELECT *, row_number() OVER (PARTITION BY domain, pair, method ORDER BY nlay DESC) AS rn FROM records) WHERE rn = 1", "records")
def last_wins_dedup(spark, d):
    return J.ordered_first(X.records(spark, d), ["domain", "pair", "method"], [F.desc("nlay")]).select("domain", "pair", "method", "subset", "ari")


@query("SELECT domain, pair, method, subset, ari FROM (SELECT *, row_number() OVER (PARTITION BY domain, pair, method ORDER BY nlay) AS rn FROM records) WHERE rn = 1", "records")
def first_wins_dedup(spark, d):
    return J.ordered_first(X.records(spark, d), ["domain", "pair", "method"], [F.asc("nlay")]).select("domain", "pair", "method", "subset", "ari")


@query("""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_surplus, round(sum(n - 1) / sum(n), 4) AS surplus_rate FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def duplicate_audit(spark, d):
    return J.duplicate_audit(table(spark, d, "lineitem"), "l_orderkey").withColumn("surplus_rate", F.round("surplus_rate", 4))


@query(r"""SELECT kind, count(*) AS n, min(w) AS example FROM (SELECT w, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'entrez' WHEN regexp_matches(w, '^ENSG[0-9]+') THEN 'ensembl'
  WHEN regexp_matches(w, '^cg[0-9]{6,}$') THEN 'cpg' WHEN regexp_matches(w, '^(hsa-)?(mir|let)-') THEN 'mirna' WHEN regexp_matches(w, '^MIMAT[0-9]+$') THEN 'mimat'
  WHEN regexp_matches(w, '^[A-Za-z][A-Za-z0-9\-\._@]*$') THEN 'symbol' ELSE 'other' END AS kind
  FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '') GROUP BY kind""")
def identifier_census(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return J.census(words, S.id_kind(F.col("w")), "w")


@query(r"""SELECT c_custkey, CASE WHEN regexp_extract(long_id, '(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})', 1) <> '' THEN regexp_extract(long_id, '(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})', 1) ELSE trim(long_id) END AS sample
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat('TCGA-', lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), '-01A') END AS long_id FROM customer)""")
def barcode_normalise(spark, d):
    t = table(spark, d, "customer")
    made = F.concat(F.lit("TCGA-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("-01A"))
    return t.select("c_custkey", S.sample_barcode(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(made)).alias("sample"))


@query("SELECT family, count(*) AS n FROM (SELECT regexp_extract(p_name, '^[A-Za-z]+', 0) AS family FROM part) GROUP BY family")
def family_parse(spark, d):
    return table(spark, d, "part").groupBy(S.family(F.col("p_name")).alias("family")).agg(F.count("*").alias("n"))


@query("""SELECT cohort, layer, n_cells, round(pct_finite, 4) AS pct_finite, round(q05, 4) AS q05, round(q50, 4) AS q50, round(q95, 4) AS q95, round(low, 4) AS low, round(high, 4) AS high, round(mean, 4) AS mean,
  CASE WHEN low >= 0 AND high <= 1 THEN 'unit interval' WHEN low >= -2 AND high <= 2 THEN 'discrete levels' WHEN q05 < 0 AND abs(q95) <= 20 THEN 'log ratio' WHEN low >= 0 AND high <= 25 THEN 'log count' WHEN low >= 0 THEN 'positive' ELSE 'other' END AS domain
  FROM (SELECT cohort, layer, count(*) AS n_cells, 100 * avg(CASE WHEN value IS NULL THEN 0 ELSE 1 END) AS pct_finite, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95, min(value) AS low, max(value) AS high, avg(value) AS mean FROM cells GROUP BY ALL)""", "cells")
def numeric_domain_profile(spark, d):
    p = J.numeric_profile(X.cells(spark, d), ["cohort", "layer"])
    return p.select("cohort", "layer", "n_cells", *[r4(c) for c in ("pct_finite", "q05", "q50", "q95", "low", "high", "mean")], S.value_domain(F.col("q05"), F.col("q95"), F.col("low"), F.col("high")).alias("domain"))


@query("SELECT o_orderkey, flag FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '+' WHEN o_orderkey % 3 = 1 THEN '' END AS flag FROM orders) WHERE flag IS DISTINCT FROM '+'")
def flag_filter_null_safe(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "+").when(F.col("o_orderkey") % 3 == 1, "").alias("flag"))
    return J.keep_unflagged(t, "flag")


@query("SELECT feature, round(min(share), 4) AS least_share FROM (SELECT feature, batch, cond, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM design GROUP BY ALL) GROUP BY feature HAVING min(share) >= 0.85", "design")
def cell_completeness_filter(spark, d):
    return J.complete_features(X.design(spark, d), 0.85).select("feature", r4("least_share"))


@query("SELECT feature, sample, batch, cond, round(coalesce(value, median(value) OVER (PARTITION BY feature, batch, cond)), 4) AS imputed FROM design", "design")
def cell_median_impute(spark, d):
    return M.cell_median_impute(X.design(spark, d)).select("feature", "sample", "batch", "cond", r4("imputed"))


@query(""", pooled AS (SELECT layer, cohort_a, cohort_b, unnest([x, y]) AS v FROM pairs), edges AS (SELECT layer, cohort_a, cohort_b, quantile_cont(v, 0.05) AS low, quantile_cont(v, 0.95) AS high FROM pooled GROUP BY ALL),
kept AS (SELECT p.* FROM pairs p JOIN edges USING (layer, cohort_a, cohort_b) WHERE x BETWEEN low AND high AND y BETWEEN low AND high),
r AS (SELECT *, rank() OVER (PARTITION BY layer, cohort_a, cohort_b ORDER BY x) + (count(*) OVER (PARTITION BY layer, cohort_a, cohort_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY layer, cohort_a, cohort_b ORDER BY y) + (count(*) OVER (PARTITION BY layer, cohort_a, cohort_b, y) - 1) / 2.0 AS ry FROM kept)
SELECT layer, cohort_a, cohort_b, count(*) AS n, round(corr(rx, ry), 4) AS spearman FROM r GROUP BY ALL""", "cells", "profile", "pairs")
def trimmed_concordance(spark, d):
    return T.spearman(J.trimmed(_pairs(spark, d), 0.05, by=BY), BY).select(*BY, "n", r4("spearman"))


@query("SELECT feature, batch, round(mean_case, 4) AS mean_case, round(mean_control, 4) AS mean_control, round(delta, 4) AS delta FROM delta", "design", "delta")
def delta_profile(spark, d):
    return _delta(spark, d).select("feature", "batch", r4("mean_case"), r4("mean_control"), r4("delta"))


@query(""", r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, x, y FROM deltas)
SELECT 'batches' AS contrast, count(*) AS n, round(corr(rx, ry), 4) AS spearman, round(corr(x, y), 4) AS pearson, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 4) AS sign_concordance, round(regr_slope(y, x), 4) AS slope FROM r""", "design", "delta", "deltas")
def delta_concordance(spark, d):
    out = T.platform_ladder(_deltas(spark, d).withColumn("contrast", F.lit("batches")), ["contrast"])
    return out.select("contrast", "n", *[r4(c) for c in ("spearman", "pearson", "sign_concordance", "slope")])


@query("""SELECT c_custkey, n_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def group_lookup_join(spark, d):
    c = J.lookup(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "nation"), "n_nationkey", "n_name")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return J.lookup(c.where("n_name is not null"), o, "c_custkey", "n_orders", F.lit(0)).select("c_custkey", "n_name", F.col("n_orders").cast("long").alias("n_orders"))


@query("SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS k FROM part) JOIN (SELECT s_suppkey, concat(lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), 'xx') AS m FROM supplier) ON substring(k, 1, 4) = substring(m, 1, 4)")
def prefix_join(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("k"))
    b = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit("xx")).alias("m"))
    return J.prefix_join(a, b, "k", "m", 4).select("p_partkey", "s_suppkey")


@query("SELECT p_partkey, split_part(concat(p_brand, ';', p_type), ';', 1) AS first_name, len(string_split(concat(p_brand, ';', p_type), ';')) AS n_names FROM part")
def map_explode_first(spark, d):
    genes = F.concat(F.col("p_brand"), F.lit(";"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", S.first_of(genes).alias("first_name"), F.size(F.split(genes, ";")).cast("long").alias("n_names"))


@query("SELECT gene, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM (SELECT coalesce(p_brand, '') AS gene, l_extendedprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size >= 10) WHERE gene <> '' GROUP BY gene")
def left_map_repair(spark, d):
    p = table(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    out = J.lookup(table(spark, d, "lineitem"), p, "l_partkey", "gene", F.lit("")).where("gene <> ''")
    return out.groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total_value"))


@query("""SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.method, b.method) AS method, coalesce(a.subset, b.subset) AS subset, a.ari AS x, b.ari AS y FROM (SELECT * FROM records WHERE domain = 'F' AND pair <> 'A') a
  FULL JOIN (SELECT * FROM records WHERE domain = 'O' AND pair <> 'R') b ON a.pair = b.pair AND a.method = b.method AND a.subset = b.subset""", "records")
def full_outer_paired(spark, d):
    r = X.records(spark, d)
    return J.full_outer_paired(r.where("domain = 'F' AND pair <> 'A'"), r.where("domain = 'O' AND pair <> 'R'"), ["pair", "method", "subset"], "ari")


@query("""SELECT 'events' AS candidate, count(*) AS n_shared FROM (SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) UNION ALL
  SELECT 'orders', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) UNION ALL
  SELECT 'suppliers', count(*) FROM (SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer))""")
def key_probe(spark, d):
    sets = {"events": table(spark, d, "events").select("user_id"), "orders": table(spark, d, "orders").select("o_custkey"), "suppliers": table(spark, d, "supplier").select("s_suppkey")}
    return J.key_overlaps(sets, table(spark, d, "customer").select("c_custkey"))


@query("""SELECT a.method AS method_a, b.method AS method_b, count(*) AS n, round(max(abs(a.ari - b.ari)), 6) AS max_gap, round(avg(abs(a.ari - b.ari)), 6) AS mean_gap, max(abs(a.ari - b.ari)) < 1e-9 AS identical
  FROM records a JOIN records b USING (domain, pair, subset) WHERE a.method < b.method GROUP BY ALL""", "records")
def method_pair_differences(spark, d):
    return J.method_differences(X.records(spark, d), ["domain", "pair", "subset"]).select("method_a", "method_b", "n", r6("max_gap"), r6("mean_gap"), "identical")


# ---------- scalings


def _z(by, sd):
    return f"SELECT {{cols}}, round(coalesce((value - avg(value) OVER w) / CASE WHEN {sd}(value) OVER w > 1e-9 THEN {sd}(value) OVER w ELSE 1 END, 0), 4) AS z FROM {{t}} WINDOW w AS (PARTITION BY {by})"


@query(_z("cohort, layer, feature", "stddev_pop").format(cols="cohort, layer, feature, sample", t="cells"), "cells")
def zscore_pop(spark, d):
    return M.zscore(X.cells(spark, d), ["cohort", "layer", "feature"]).select("cohort", "layer", "feature", "sample", r4("z"))


@query(_z("feature", "stddev_samp").format(cols="feature, sample", t="design"), "design")
def zscore_sample(spark, d):
    return M.zscore(X.design(spark, d), ["feature"], sample_sd=True).select("feature", "sample", r4("z"))


@query(_z("feature, batch", "stddev_samp").format(cols="feature, sample, batch", t="design"), "design")
def zscore_within_batch(spark, d):
    return M.zscore(X.design(spark, d), ["feature", "batch"], sample_sd=True).select("feature", "sample", "batch", r4("z"))


@query("SELECT cohort, layer, feature, sample, round(value - median(value) OVER (PARTITION BY cohort, layer, sample), 4) AS centred FROM cells", "cells")
def median_centre(spark, d):
    return M.median_centre(X.cells(spark, d)).select("cohort", "layer", "feature", "sample", r4("centred"))


@query("SELECT cohort, layer, feature, round(mad, 4) AS mad, place FROM (SELECT *, row_number() OVER (PARTITION BY cohort, layer ORDER BY mad DESC, feature) AS place FROM mads WHERE mad > 0) WHERE place <= 20", "cells", "mads")
def mad_topk(spark, d):
    return R.top_mad(X.cells(spark, d), 20).select("cohort", "layer", "feature", r4("mad"), F.col("place").cast("long").alias("place"))


@query(""", top AS (SELECT cohort, layer, feature FROM (SELECT *, row_number() OVER (PARTITION BY cohort, layer ORDER BY mad DESC, feature) AS place FROM mads WHERE mad > 0) WHERE place <= 30)
SELECT layer, feature FROM (SELECT layer, feature, count(DISTINCT cohort) AS held FROM top GROUP BY ALL) JOIN (SELECT layer, count(DISTINCT cohort) AS wanted FROM top GROUP BY layer) USING (layer) WHERE held = wanted""", "cells", "mads")
def mad_topk_shared(spark, d):
    return J.in_all(R.top_mad(X.cells(spark, d), 30), "feature", "cohort", ["layer"])


@query("SELECT cohort, layer, feature, sample, rank() OVER (PARTITION BY cohort, layer, sample ORDER BY v) + (count(*) OVER (PARTITION BY cohort, layer, sample, v) - 1) / 2.0 AS avg_rank FROM (SELECT *, round(value, 1) AS v FROM cells)", "cells")
def avg_rank(spark, d):
    t = X.cells(spark, d).withColumn("v", F.round(F.col("value"), 1))
    return t.select("cohort", "layer", "feature", "sample", R.avg_rank(["cohort", "layer", "sample"], "v").alias("avg_rank"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY cohort, layer, sample ORDER BY value, feature) AS r FROM cells) SELECT cohort, layer, feature, sample, round(avg(value) OVER (PARTITION BY cohort, layer, r), 4) AS normalised FROM r", "cells")
def quantile_normalise(spark, d):
    return R.quantile_normalise(X.cells(spark, d)).select("cohort", "layer", "feature", "sample", r4("normalised"))


@query(""", held AS (SELECT *, count(*) OVER (PARTITION BY batch, sample) AS n, row_number() OVER (PARTITION BY batch, sample ORDER BY value, feature) AS r FROM design WHERE value IS NOT NULL),
grid AS (SELECT k, k / 100.0::DOUBLE AS q FROM (SELECT unnest(range(0, 101)) AS k)),
srt AS (SELECT batch, sample, n, r, value FROM held WHERE n >= 3),
pts AS (SELECT h.batch, h.sample, g.k, lo.value + (hi.value - lo.value) * ((h.n - 1) * g.q - floor((h.n - 1) * g.q)) AS v
  FROM (SELECT DISTINCT batch, sample, n FROM srt) h CROSS JOIN grid g
  JOIN srt lo ON lo.batch = h.batch AND lo.sample = h.sample AND lo.r = floor((h.n - 1) * g.q) + 1
  JOIN srt hi ON hi.batch = h.batch AND hi.sample = h.sample AND hi.r = least(floor((h.n - 1) * g.q) + 2, h.n)),
ref AS (SELECT batch, k, avg(v) AS v FROM pts GROUP BY ALL),
place AS (SELECT *, CASE WHEN n > 1 THEN (r - 1) * 100.0::DOUBLE / (n - 1) ELSE 0 END AS p FROM held)
SELECT s.batch, s.feature, s.sample, round(CASE WHEN n < 3 THEN value ELSE a.v + (b.v - a.v) * (p - a.k) END, 2) AS normalised
FROM place s LEFT JOIN ref a ON a.batch = s.batch AND a.k = least(floor(p), 99) LEFT JOIN ref b ON b.batch = s.batch AND b.k = a.k + 1""", "design")
def quantile_normalise_gaps(spark, d):
    out = R.quantile_normalise_gaps(X.design(spark, d), by=["batch"])
    return out.select("batch", "feature", "sample", F.round("normalised", 2).alias("normalised"))


@query(""", g AS (SELECT x, exp(-x * x / 2) / sqrt(2 * pi()) AS f, 0.5::DOUBLE + sum(exp(-x * x / 2) / sqrt(2 * pi()) + exp(-(x - 1e-4) * (x - 1e-4) / 2) / sqrt(2 * pi())) OVER (ORDER BY x) * 5e-5 AS c FROM (SELECT (i + 1) * 1e-4::DOUBLE AS x FROM (SELECT unnest(range(50000)) AS i)) UNION ALL SELECT 0, 1 / sqrt(2 * pi()), 0.5),
p AS (SELECT cohort, layer, feature, sample, (row_number() OVER (PARTITION BY cohort, layer, sample ORDER BY value, feature) - 0.5::DOUBLE) / count(value) OVER (PARTITION BY cohort, layer, sample) AS p FROM cells)
SELECT cohort, layer, feature, sample, round(CASE WHEN p < 0.5 THEN -1 ELSE 1 END * (x + (greatest(p, 1 - p) - c) / f), 4) AS normal_score FROM p ASOF JOIN g ON greatest(p.p, 1 - p.p) >= g.c""", "cells")
def rank_to_int(spark, d):
    return R.rank_to_normal(X.cells(spark, d), ["cohort", "layer", "sample"], "value", "feature").select("cohort", "layer", "feature", "sample", r4("normal_score"))


@query("""SELECT feature, sample, round((value - avg(value) OVER b) / CASE WHEN stddev_pop(value) OVER b > 1e-9 THEN stddev_pop(value) OVER b ELSE 1 END * stddev_pop(value) OVER f, 4) AS adjusted FROM design
  WINDOW b AS (PARTITION BY feature, batch), f AS (PARTITION BY feature)""", "design")
def combat_location_scale(spark, d):
    return M.location_scale(X.design(spark, d)).select("feature", "sample", r4("adjusted"))


@query("SELECT feature, sample, round(value - avg(value) OVER b + avg(value) OVER f, 4) AS adjusted FROM design WINDOW b AS (PARTITION BY feature, batch), f AS (PARTITION BY feature)", "design")
def combat_mean_only(spark, d):
    return M.location_scale(X.design(spark, d), scale=False).select("feature", "sample", r4("adjusted"))


@query(""", s AS (SELECT feature, sample, batch, value, avg(value) OVER (PARTITION BY feature) AS mean, CASE WHEN stddev_pop(value) OVER (PARTITION BY feature) > 1e-9 THEN stddev_pop(value) OVER (PARTITION BY feature) ELSE 1 END AS sd FROM design),
l AS (SELECT feature, batch, avg((value - mean) / sd) AS g, coalesce(var_samp((value - mean) / sd), 0) AS d2, count(value) AS n FROM s GROUP BY ALL),
p AS (SELECT batch, avg(g) AS g0, coalesce(var_samp(g), 0) AS t2 FROM l GROUP BY batch),
e AS (SELECT feature, batch, CASE WHEN n * t2 + d2 > 0 THEN (n * t2 * g + d2 * g0) / (n * t2 + d2) ELSE g END AS star FROM l JOIN p USING (batch))
SELECT feature, sample, round(((value - mean) / sd - star) * sd + mean, 4) AS adjusted FROM s JOIN e USING (feature, batch)""", "design")
def combat_empirical_bayes(spark, d):
    return M.eb_location_scale(X.design(spark, d)).select("feature", "sample", r4("adjusted"))


@query(""", c AS (SELECT feature, cond, avg(CASE WHEN batch = 0 THEN value END) AS m0, avg(CASE WHEN batch = 1 THEN value END) AS m1, count(CASE WHEN batch = 0 THEN value END) AS n0, count(CASE WHEN batch = 1 THEN value END) AS n1 FROM design GROUP BY ALL),
e AS (SELECT feature, sum(n0 * n1 / (n0 + n1) * (m1 - m0)) / sum(n0 * n1 / (n0 + n1)) AS effect FROM c WHERE n0 > 0 AND n1 > 0 GROUP BY feature)
SELECT feature, sample, round(value - coalesce(effect, 0) * (batch - 0.5::DOUBLE), 4) AS adjusted FROM design LEFT JOIN e USING (feature)""", "design")
def remove_batch_effect(spark, d):
    return M.remove_batch_effect(X.design(spark, d)).select("feature", "sample", r4("adjusted"))


# ---------- vectors


@query(""", m AS (SELECT pos, avg(CASE WHEN batch = 1 THEN v END) - avg(CASE WHEN batch = 0 THEN v END) AS w FROM emb GROUP BY pos),
s AS (SELECT sample, batch, round(sum(v * w), 9) AS score FROM emb JOIN m USING (pos) GROUP BY ALL),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
u AS (SELECT sum(CASE WHEN batch = 1 THEN r ELSE 0 END) - sum(batch) * (sum(batch) + 1) / 2.0 AS u, sum(batch) AS n1, sum(1 - batch) AS n0 FROM r)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(u / (n1 * n0), 4) AS auc, round(greatest(u / (n1 * n0), 1 - u / (n1 * n0)), 4) AS auc_fixed FROM u""", "emb")
def centroid_auc(spark, d):
    v = X.vectors(spark, d).select("sample", "batch", F.posexplode("features").alias("pos", "v"))
    w = J.group_delta(v, ["pos"], F.col("batch") == 1, "v").select("pos", F.col("delta").alias("w"))
    score = v.join(w, "pos").groupBy("sample", "batch").agg(F.round(F.sum(F.col("v") * F.col("w")), 9).alias("score"))
    return T.auc(score, [], "score", F.col("batch") == 1).select("n1", "n0", r4("auc"), r4("auc_fixed"))


@query(""", r AS (SELECT event_type, CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM e),
u AS (SELECT event_type, sum(r * y) - sum(y) * (sum(y) + 1) / 2.0 AS u, sum(y) AS n1, sum(1 - y) AS n0 FROM r GROUP BY event_type)
SELECT event_type, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, u, round(u / (n1 * n0), 4) AS auc, round(greatest(u / (n1 * n0), 1 - u / (n1 * n0)), 4) AS auc_fixed FROM u""".replace(", r AS", "WITH e AS (SELECT * FROM events WHERE value IS NOT NULL), r AS", 1))
def auc_rank_sum(spark, d):
    out = T.auc(table(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 2 == 1)
    return out.select("event_type", "n1", "n0", "u", r4("auc"), r4("auc_fixed"))


def _near(spark, d, k):
    return M.nearest_samples(X.vectors(spark, d).select("sample", "features"), k)


@query(""", near AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(distance, 9), j) AS place FROM dist) WHERE place <= 10), g AS (SELECT DISTINCT sample, batch FROM emb)
SELECT count(*) AS n, round(avg(other), 4) AS mixing FROM (SELECT i, avg(CASE WHEN a.batch <> b.batch THEN 1.0 ELSE 0.0 END) AS other FROM near JOIN g a ON a.sample = i JOIN g b ON b.sample = j GROUP BY i)""", "emb", "dist")
def knn_mixing(spark, d):
    return T.knn_mixing(_near(spark, d, 10), X.vectors(spark, d).select("sample", F.col("batch").alias("grp"))).select("n", r4("mixing"))


@query(""", s AS (SELECT median(round(distance, 9)) AS sigma FROM dist WHERE round(distance, 9) > 0),
near AS (SELECT * FROM (SELECT i, j, round(distance, 9) AS distance, row_number() OVER (PARTITION BY i ORDER BY round(distance, 9), j) AS place FROM dist) WHERE place <= 9),
k AS (SELECT i, j, exp(-(distance * distance) / (2 * sigma * sigma)) AS v FROM near CROSS JOIN s UNION ALL SELECT DISTINCT sample, sample, 1.0 FROM emb),
b AS (SELECT i, j, sum(v) / 2 AS v FROM (SELECT i, j, v FROM k UNION ALL SELECT j, i, v FROM k) GROUP BY i, j)
SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 4) AS affinity FROM b""", "emb", "dist")
def knn_affinity(spark, d):
    return M.knn_affinity(X.vectors(spark, d).select("sample", "features"), 10).select("i", "j", r4("affinity"))


@query(""", c AS (SELECT a.sample AS i, b.sample AS j, corr(a.v, b.v) AS r, any_value(a.batch) = any_value(b.batch) AS same FROM emb a JOIN emb b USING (pos) WHERE a.sample < b.sample GROUP BY a.sample, b.sample)
SELECT round(avg(CASE WHEN same THEN r END), 4) AS within, round(avg(CASE WHEN NOT same THEN r END), 4) AS "between", round(avg(CASE WHEN same THEN r END) - avg(CASE WHEN NOT same THEN r END), 4) AS gap FROM c""", "emb")
def correlation_gap(spark, d):
    sums = M.group_correlations(X.vectors(spark, d).select("sample", "batch", "features"), "batch")
    return T.correlation_gap_of_groups(sums).select(r4("within"), r4("between"), r4("gap"))


@query(""", v AS (SELECT feature, value, batch FROM design WHERE value IS NOT NULL), n AS (SELECT feature, value, sum(batch) AS a, sum(1 - batch) AS b FROM v GROUP BY ALL),
g AS (SELECT feature, abs(sum(a) OVER u / sum(a) OVER t - sum(b) OVER u / sum(b) OVER t) AS gap FROM n WINDOW u AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY feature))
SELECT count(*) AS n_features, round(median(ks), 4) AS ks_median FROM (SELECT feature, max(gap) AS ks FROM g GROUP BY feature)""", "design")
def ks_median(spark, d):
    ks = T.ks_statistic(X.design(spark, d), ["feature"], "value", F.col("batch") == 1)
    return ks.agg(F.count("*").alias("n_features"), r4(F.median("ks"), "ks_median"))


def _seed_centroids(spark, d):
    v = X.vectors(spark, d)
    return v.where("sample < 4").select(F.col("sample").alias("label"), F.col("features").alias("centroid"))


@query(""", c AS (SELECT sample AS label, pos, v FROM emb WHERE sample < 4), s AS (SELECT e.sample, c.label, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM emb e JOIN c USING (pos) GROUP BY ALL)
SELECT sample, label, round(sqrt(d2), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, label) AS rn FROM s) WHERE rn = 1""", "emb")
def nearest_centroid(spark, d):
    return T.nearest_centroid(X.vectors(spark, d), _seed_centroids(spark, d)).select("sample", "label", r4("distance"))


@query("""WITH t AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS ab, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM t GROUP BY quality)) AS a,
  (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM t GROUP BY toxic)) AS b, (SELECT sum(n) FROM t) AS n)
SELECT CAST(n AS BIGINT) AS n, round((ab - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0)), 4) AS ari FROM s""")
def adjusted_rand(spark, d):
    return T.adjusted_rand(table(spark, d, "labels"), "quality", "toxic").select("n", r4("ari"))


@query("SELECT count(*) AS n_clusters, round(max(n) / sum(n), 4) AS max_fraction, CASE WHEN max(n) / sum(n) > 0.7 THEN 1 ELSE 0 END AS degen_balance FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def cluster_balance(spark, d):
    return T.cluster_balance(table(spark, d, "embeddings"), "label").select("n_clusters", r4("max_fraction"), "degen_balance")


@query(""", a AS (SELECT sample, pos, v FROM emb WHERE cohort = 'A'), b AS (SELECT sample, pos, v FROM emb WHERE cohort = 'B'), c0 AS (SELECT sample AS label, pos, v FROM emb WHERE sample < 4),
d AS (SELECT a.sample, c0.label, sum((a.v - c0.v) * (a.v - c0.v)) AS d2 FROM a JOIN c0 USING (pos) GROUP BY ALL), l AS (SELECT sample, label FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, label) AS rn FROM d) WHERE rn = 1),
c1 AS (SELECT label, pos, avg(v) AS v FROM a JOIN l USING (sample) GROUP BY ALL), e AS (SELECT b.sample, c1.label, sum((b.v - c1.v) * (b.v - c1.v)) AS d2 FROM b JOIN c1 USING (pos) GROUP BY ALL),
g AS (SELECT sample, label AS x FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, label) AS rn FROM e) WHERE rn = 1),
y AS (SELECT DISTINCT sample, label AS y FROM emb), t AS (SELECT x, y, count(*) AS n FROM g JOIN y USING (sample) GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS ab, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM t GROUP BY x)) AS a, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM t GROUP BY y)) AS b, (SELECT sum(n) FROM t) AS n)
SELECT CAST(n AS BIGINT) AS n, round((ab - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0)), 4) AS ari FROM s""", "emb")
def transfer_ari_one_lloyd_step(spark, d):
    v = X.vectors(spark, d)
    first = T.nearest_centroid(v.where("cohort = 'A'"), _seed_centroids(spark, d)).select("sample", "label")
    moved = v.select("sample", F.posexplode("features").alias("pos", "v")).join(first, "sample").groupBy("label", "pos").agg(F.avg("v").alias("v"))
    centroids = moved.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centroid"))
    given = T.nearest_centroid(v.where("cohort = 'B'"), centroids).select("sample", F.col("label").alias("x"))
    return T.adjusted_rand(given.join(v.select("sample", F.col("label").alias("y")), "sample"), "x", "y").select("n", r4("ari"))


@query(""", c AS (SELECT a.sample AS i, b.sample AS j, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS c FROM boot a JOIN boot b USING (replicate) WHERE a.sample < b.sample GROUP BY ALL)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN c > 0.1 AND c < 0.9 THEN 1.0 ELSE 0.0 END), 4) AS pac, round(avg(CASE WHEN c > 0.9 THEN 1.0 ELSE 0.0 END), 4) AS strong, round(avg(CASE WHEN c < 0.1 THEN 1.0 ELSE 0.0 END), 4) AS weak, round(median(c), 4) AS median_consensus FROM c""", "boot")
def pac_from_labels(spark, d):
    return T.pac(X.boot(spark, d)).select("n_pairs", *[r4(c) for c in ("pac", "strong", "weak", "median_consensus")])


@query(""", e AS (SELECT quantile_cont(abs(x), 0.25) AS e1, quantile_cont(abs(x), 0.5) AS e2, quantile_cont(abs(x), 0.75) AS e3 FROM deltas),
q AS (SELECT *, CASE WHEN abs(x) <= e1 THEN 1 WHEN abs(x) <= e2 THEN 2 WHEN abs(x) <= e3 THEN 3 ELSE 4 END AS quartile FROM deltas CROSS JOIN e),
r AS (SELECT *, rank() OVER (PARTITION BY quartile ORDER BY x) + (count(*) OVER (PARTITION BY quartile, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY quartile ORDER BY y) + (count(*) OVER (PARTITION BY quartile, y) - 1) / 2.0 AS ry FROM q)
SELECT quartile, count(*) AS n, round(corr(rx, ry), 4) AS spearman, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 4) AS sign_concordance FROM r GROUP BY quartile""", "design", "delta", "deltas")
def effect_quartile_concordance(spark, d):
    t = R.quartile(_deltas(spark, d).withColumn("size", F.abs("x")), "size")
    return T.platform_ladder(t, ["quartile"]).select("quartile", "n", r4("spearman"), r4("sign_concordance"))


@query("""SELECT layer, cohort_a, cohort_b, count(*) AS n, round(corr(rx, ry), 4) AS spearman, round(corr(x, y), 4) AS pearson, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 4) AS sign_concordance, round(regr_slope(y, x), 4) AS slope FROM ranked GROUP BY ALL""", "cells", "profile", "pairs", "ranked")
def platform_ladder(spark, d):
    return T.platform_ladder(_pairs(spark, d), BY).select(*BY, "n", *[r4(c) for c in ("spearman", "pearson", "sign_concordance", "slope")])


@query(""", c AS (SELECT a.cohort, a.layer, a.feature AS feature_a, b.feature AS feature_b, corr(a.value, b.value) AS r, count(*) AS n FROM cells a JOIN cells b USING (cohort, layer, sample) WHERE a.feature < b.feature GROUP BY ALL)
SELECT cohort, layer, feature_a, feature_b, n, round(r, 4) AS r FROM c""", "cells")
def pair_network_correlation(spark, d):
    return M.correlation_network(X.cells(spark, d)).select("cohort", "layer", "feature_a", "feature_b", "n", r4("r"))


# ---------- records and gates


_PAIRED = """, b AS (SELECT domain, pair, subset, ari AS base FROM records WHERE method = 'ECONOMY'), p AS (SELECT r.method, r.ari, r.ari - base AS d, base FROM records r JOIN b USING (domain, pair, subset) WHERE r.method <> 'ECONOMY')"""


@query(_PAIRED + """ SELECT method, count(*) AS n, round(avg(ari), 6) AS mean_arm, round(avg(d), 6) AS mean_delta, round(avg(d) / avg(base), 6) AS rel_vs_base, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t,
  round(avg(d) - 1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)), 6) AS ci_lo, round(avg(d) + 1.96::DOUBLE * stddev_samp(d) / sqrt(count(*)), 6) AS ci_hi, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM p GROUP BY method""", "records")
def paired_vs_baseline(spark, d):
    out = T.paired_vs_baseline(X.records(spark, d), ["domain", "pair", "subset"], "ECONOMY")
    return out.select("method", "n", *[r6(c) for c in ("mean_arm", "mean_delta", "rel_vs_base", "t", "ci_lo", "ci_hi", "win_rate")])


_FLOOR = ", s AS (SELECT domain, method, subset, stddev_samp(ari) AS sd FROM records GROUP BY ALL), f AS (SELECT domain, count(*) AS n_units, median(sd) AS median_sd, avg(sd) AS mean_sd FROM s WHERE sd IS NOT NULL GROUP BY domain)"


@query(_FLOOR + " SELECT domain, n_units, round(median_sd, 6) AS median_sd, round(mean_sd, 6) AS mean_sd FROM f", "records")
def noise_floor_sd(spark, d):
    return T.noise_floor(X.records(spark, d), ["method", "subset"], ["domain"]).select("domain", "n_units", r6("median_sd"), r6("mean_sd"))


@query(_FLOOR + " SELECT domain, CAST(ceil(pow(2.8::DOUBLE * median_sd / 0.05::DOUBLE, 2)) AS BIGINT) AS required_n FROM f", "records")
def required_n(spark, d):
    return T.required_n(T.noise_floor(X.records(spark, d), ["method", "subset"], ["domain"]), "median_sd", F.lit(0.05)).select("domain", "required_n")


_CHAMP = ", w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, subset, pair ORDER BY ari DESC, method) AS rn FROM records) WHERE rn = 1)"


@query(_CHAMP + " SELECT domain, subset, count(*) AS n_pairs, count(DISTINCT method) AS n_unique_winner, string_agg(DISTINCT method, '|' ORDER BY method) AS winners, count(DISTINCT method) = 1 AS consistent FROM w GROUP BY ALL", "records")
def champion_flip(spark, d):
    return T.champion_flip(X.records(spark, d), ["domain", "subset"])


@query(_CHAMP + " SELECT domain, subset, method, wins, CAST(sum(wins) OVER (PARTITION BY domain, subset) AS BIGINT) AS n_pairs, wins / sum(wins) OVER (PARTITION BY domain, subset) >= 2.0 / 3 - 1e-12 AND sum(wins) OVER (PARTITION BY domain, subset) >= 2 AS replicable FROM (SELECT domain, subset, method, count(*) AS wins FROM w GROUP BY ALL)", "records")
def replicability(spark, d):
    return T.replicability(X.records(spark, d), ["domain", "subset"])


@query(""", w AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY m DESC, method) AS place FROM (SELECT domain, method, avg(ari) AS m FROM records GROUP BY ALL)),
c AS (SELECT a.domain, a.method AS champion, b.method AS challenger FROM w a JOIN w b USING (domain) WHERE a.place = 1 AND b.place = 2),
g AS (SELECT c.domain, champion, challenger, x.ari - y.ari AS gap FROM c JOIN records x ON x.domain = c.domain AND x.method = champion JOIN records y ON y.domain = c.domain AND y.method = challenger AND y.pair = x.pair AND y.subset = x.subset)
SELECT domain, champion, challenger, count(*) AS n, round(avg(gap), 6) AS mean_gap, round(stddev_samp(gap), 6) AS sd_gap, round(avg(gap) / (stddev_samp(gap) / sqrt(count(*))), 6) AS t FROM g GROUP BY ALL""", "records")
def challenger_sd(spark, d):
    return B.challengers(X.records(spark, d), ["domain"], ["pair", "subset"]).select("domain", "champion", "challenger", "n", r6("mean_gap"), r6("sd_gap"), r6("t"))


@query(""", b AS (SELECT domain, pair, method, subset, CASE WHEN nlay = 3 THEN ari + 0.0000005 WHEN nlay = 2 AND method = 'PROMO' THEN ari + 0.1 ELSE ari END AS ari FROM records), g AS (SELECT abs(a.ari - b.ari) AS gap FROM records a JOIN b USING (domain, pair, method, subset))
SELECT count(*) AS n_shared, count(*) FILTER (gap <= 1e-6) AS n_near, count(*) FILTER (gap <= 1e-9) AS n_same, round(max(gap), 6) AS max_gap FROM g""", "records")
def reproduction_check(spark, d):
    r = X.records(spark, d)
    other = r.withColumn("ari", F.when(F.col("nlay") == 3, F.col("ari") + 0.0000005).when((F.col("nlay") == 2) & (F.col("method") == "PROMO"), F.col("ari") + 0.1).otherwise(F.col("ari")))
    return T.reproduction(r, other, ["domain", "pair", "method", "subset"]).select("n_shared", "n_near", "n_same", r6("max_gap"))


@query(""", b AS (SELECT domain, pair, subset, ari AS base FROM records WHERE method = 'ECONOMY') SELECT subset AS layer, method AS strategy, round(avg(ari), 6) AS mean_ari, round(max(abs(ari - base)), 6) AS max_gap,
  count(*) FILTER (ari - base > 0.01) AS better, count(*) FILTER (ari - base < -0.01) AS worse, count(*) FILTER (abs(ari - base) <= 0.01) AS same FROM records JOIN b USING (domain, pair, subset) WHERE method <> 'ECONOMY' GROUP BY ALL""", "records")
def alignment_aggregate(spark, d):
    out = B.alignment_summary(X.records(spark, d), ["domain", "pair", "subset"], "ECONOMY", ["subset", "method"])
    return out.select(F.col("subset").alias("layer"), F.col("method").alias("strategy"), r6("mean_ari"), r6("max_gap"), "better", "worse", "same")


@query("SELECT CASE WHEN pac < 0.3 THEN 'a' WHEN pac < 0.45 THEN 'b' WHEN pac < 0.6 THEN 'c' ELSE 'd' END AS bin, count(*) AS n_pairs, round(avg(ari), 6) AS mean_ari FROM (SELECT ari, (n % 100) / 100.0::DOUBLE AS pac FROM records) GROUP BY bin", "records")
def pac_bins(spark, d):
    return B.binned(X.records(spark, d).withColumn("pac", F.col("n") % 100 / 100), "pac", (0.3, 0.45, 0.6), "ari").select("bin", "n_pairs", r6("mean_ari"))


@query(""", s AS (SELECT pair AS cohort, method, avg((n % 100) / 100.0::DOUBLE) AS pac FROM records GROUP BY ALL), c AS (SELECT a.domain, a.method, a.subset, a.pair AS cohort_a, b.pair AS cohort_b, (a.ari + b.ari) / 2 AS ari FROM records a JOIN records b USING (domain, method, subset) WHERE a.pair < b.pair)
SELECT domain, count(*) AS n, round(corr(ari, (x.pac + y.pac) / 2), 6) AS r FROM c JOIN s x ON x.cohort = cohort_a AND x.method = c.method JOIN s y ON y.cohort = cohort_b AND y.method = c.method GROUP BY domain""", "records")
def pac_cross(spark, d):
    r = X.records(spark, d)
    stability = r.groupBy(F.col("pair").alias("cohort"), "method").agg(F.avg(F.col("n") % 100 / 100).alias("pac"))
    a, b = (r.select("domain", "method", "subset", F.col("pair").alias(f"cohort_{s}"), F.col("ari").alias(f"ari_{s}")) for s in ("a", "b"))
    pairs = a.join(b, ["domain", "method", "subset"]).where("cohort_a < cohort_b").withColumn("ari", (F.col("ari_a") + F.col("ari_b")) / 2)
    return B.pac_against_ari(pairs, stability).select("domain", "n", r6("r"))


@query(""", m AS (SELECT a.method, a.ari AS x, b.ari AS y FROM records a JOIN records b USING (pair, method, subset) WHERE a.domain = 'F' AND b.domain = 'O'),
r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY x) + (count(*) OVER (PARTITION BY method, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method ORDER BY y) + (count(*) OVER (PARTITION BY method, y) - 1) / 2.0 AS ry FROM m)
SELECT method, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(median(abs(x - y)), 6) AS median_gap FROM r GROUP BY method""", "records")
def toolchain_agreement(spark, d):
    r = X.records(spark, d)
    both = J.full_outer_paired(r.where("domain = 'F'"), r.where("domain = 'O'"), ["pair", "method", "subset"], "ari").where("x is not null and y is not null")
    return B.agreement(both, ["method"]).select("method", "n", *[r6(c) for c in ("spearman", "mean_x", "mean_y", "median_gap")])


@query(""", m AS (SELECT nlay, avg(ari) AS mean_ari, count(*) AS n FROM records WHERE method = 'STANDARD' GROUP BY nlay) SELECT CAST(nlay AS BIGINT) AS nlay, n, round(mean_ari, 6) AS mean_ari, round(mean_ari - lag(mean_ari) OVER (ORDER BY nlay), 6) AS step FROM m""", "records")
def layer_curve(spark, d):
    return B.layer_curve(X.records(spark, d), "STANDARD").select(F.col("nlay").cast("long").alias("nlay"), "n", r6("mean_ari"), r6("step"))


@query(""", m AS (SELECT domain, nlay, array_to_string(list_sort(string_split(subset, '+')), '+') AS subset, method, avg(ari) AS mean_ari, count(*) AS n FROM records GROUP BY ALL)
SELECT domain, CAST(nlay AS BIGINT) AS nlay, subset, method, n, round(mean_ari, 6) AS mean_ari FROM (SELECT *, row_number() OVER (PARTITION BY domain, nlay ORDER BY mean_ari DESC, subset, method) AS rn FROM m) WHERE rn = 1""", "records")
def best_subset_per_layer_count(spark, d):
    r = X.records(spark, d).withColumn("subset", S.subset_key(F.col("subset")))
    return B.best_per_layer_count(r).select("domain", F.col("nlay").cast("long").alias("nlay"), "subset", "method", "n", r6("mean_ari"))


@query("SELECT method, sum(n) AS n, round(avg(CASE WHEN domain = 'F' THEN ari END), 6) AS mean_f, round(avg(CASE WHEN domain = 'O' THEN ari END), 6) AS mean_o, round(avg(ari), 6) AS mean_all, round(avg(degen), 6) AS degeneracy FROM (SELECT domain, method, ari, degen, 1 AS n FROM records WHERE ari IS NOT NULL) GROUP BY method".replace("sum(n)", "count(*)"), "records")
def method_ranking(spark, d):
    return B.method_ranking(X.records(spark, d), "F", "O").select("method", "n", r6("mean_a", "mean_f"), r6("mean_b", "mean_o"), r6("mean_all"), r6("degeneracy"))


@query("SELECT domain, count(*) AS n, count(*) FILTER (coalesce(dg, 1) = 0) AS kept_strict, count(*) FILTER (coalesce(dg, 0) = 0) AS kept_lenient FROM (SELECT domain, ari, CASE WHEN nlay = 2 THEN NULL ELSE degen END AS dg FROM records) GROUP BY domain", "records")
def degeneracy_filters(spark, d):
    r = X.records(spark, d).withColumn("degen", F.when(F.col("nlay") != 2, F.col("degen")))
    strict, lenient = (J.not_degenerate(r, missing).groupBy("domain").agg(F.count("*").alias(n)) for missing, n in ((True, "kept_strict"), (False, "kept_lenient")))
    out = r.groupBy("domain").agg(F.count("*").alias("n")).join(strict, "domain", "left").join(lenient, "domain", "left")
    return out.select("domain", "n", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept_strict", "kept_lenient")])


@query(""", g AS (SELECT 'layers' AS gate, 'mean rank correlation >= 0.4 in every layer' AS criterion, min(rho) AS observed, 0.4::DOUBLE AS threshold FROM (SELECT layer, avg(rho) AS rho FROM (SELECT layer, cohort_a, cohort_b, corr(rx, ry) AS rho FROM ranked GROUP BY ALL) GROUP BY layer)
UNION ALL SELECT 'samples', 'at least 50 complete samples', CAST(count(*) AS DOUBLE), 50.0 FROM (SELECT cohort, sample FROM cells GROUP BY ALL HAVING count(DISTINCT layer) = 2))
SELECT gate, criterion, threshold, round(observed, 6) AS observed, CASE WHEN observed >= threshold THEN 'PASS' ELSE 'NOT PASSED' END AS verdict FROM g""", "cells", "profile", "pairs", "ranked")
def decision_gates(spark, d):
    rho = T.spearman(_pairs(spark, d), BY).groupBy("layer").agg(F.avg("spearman").alias("rho")).agg(F.min("rho").alias("v"))
    c = X.cells(spark, d)
    n = c.groupBy("cohort", "sample").agg(F.countDistinct("layer").alias("k")).where("k = 2").agg(F.count("*").cast("double").alias("v"))
    return B.gates({"layers": ("mean rank correlation >= 0.4 in every layer", rho, 0.4), "samples": ("at least 50 complete samples", n, 50.0)}).withColumn("observed", F.round("observed", 6))


# ---------- purity


def _purity(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("purity"))


@query("SELECT layer, feature, n, round(r, 4) AS r, round(slope, 4) AS slope FROM assoc", "cells", "purity", "assoc")
def purity_gene_assoc(spark, d):
    return M.covariate_association(X.cells(spark, d), _purity(spark, d)).select("layer", "feature", "n", r4("r"), r4("slope"))


@query("SELECT layer, count(*) AS n_features, round(avg(CASE WHEN abs(r) > 0.05 THEN 1.0 ELSE 0.0 END), 4) AS frac_associated, round(avg(r * r), 4) AS mean_r2, round(max(abs(r)), 4) AS max_abs_r FROM assoc GROUP BY layer", "cells", "purity", "assoc")
def purity_confounding(spark, d):
    a = M.covariate_association(X.cells(spark, d), _purity(spark, d))
    return B.confounding(a, 0.05).select("layer", "n_features", r4("frac_associated"), r4("mean_r2"), r4("max_abs_r"))


@query("SELECT cohort, layer, feature, sample, round(CASE WHEN abs(r) >= 0.04 THEN 0 ELSE value END, 4) AS masked FROM cells LEFT JOIN assoc USING (layer, feature)", "cells", "purity", "assoc")
def purity_mask(spark, d):
    c = X.cells(spark, d)
    return M.mask_associated(c, M.covariate_association(c, _purity(spark, d)), 0.04).select("cohort", "layer", "feature", "sample", r4("masked"))


@query("SELECT cohort, layer, feature, sample, round(value - (purity - (SELECT avg(purity) FROM purity)) * slope, 4) AS residual FROM cells JOIN purity USING (sample) JOIN assoc USING (layer, feature)", "cells", "purity", "assoc")
def purity_residualise(spark, d):
    c, p = X.cells(spark, d), _purity(spark, d)
    return M.residualise(c, p, M.covariate_association(c, p)).select("cohort", "layer", "feature", "sample", r4("residual"))


@query(""", w AS (SELECT pos, CASE WHEN pos % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS l FROM (SELECT DISTINCT pos FROM emb)), u AS (SELECT pos, l / sqrt((SELECT sum(l * l) FROM w)) AS l FROM w),
s AS (SELECT sample, sum(v * l) AS s FROM emb JOIN u USING (pos) GROUP BY sample) SELECT sample, pos - 1 AS feature, round(v - s * l, 4) AS value FROM emb JOIN u USING (pos) JOIN s USING (sample)""", "emb")
def purity_pc_removal(spark, d):
    v = X.vectors(spark, d).select("sample", F.posexplode("features").alias("feature", "value"))
    w = v.select("feature").distinct().select("feature", F.when(F.col("feature") % 2 == 0, 1.0).otherwise(-0.5).alias("loading"))
    return M.remove_direction(v, w).select("sample", F.col("feature").cast("long").alias("feature"), r4("value"))


# ---------- text and verification


@query(r"""SELECT num, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?')) AS num FROM documents) GROUP BY num""")
def number_extraction(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(S.NUMBER), 0)).alias("num")).groupBy("num").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, doi FROM (SELECT page_id, unnest(regexp_extract_all(concat(html, ' ', url, ' 10.1234/abc.', CAST(page_id AS VARCHAR)), '10\.[0-9]{4,9}/[A-Za-z0-9._;()/:\-]+')) AS doi FROM pages)""")
def doi_extraction(spark, d):
    text = F.concat(F.coalesce("html", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")), F.lit(" 10.1234/abc."), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(text, F.lit(S.DOI), 0)).alias("doi"))


@query("""WITH used AS (SELECT doc_id, unnest(regexp_extract_all(body, '\\[([0-9]+)\\]', 1)) AS ref FROM (SELECT doc_id, concat(text, ' see [', CAST(doc_id % 70 AS VARCHAR), '] and [', CAST(doc_id % 50 AS VARCHAR), ']') AS body FROM documents)),
known AS (SELECT CAST(item_id AS VARCHAR) AS ref FROM benchmark)
SELECT ref, count(*) AS n_cited, ref IN (SELECT ref FROM known) AS defined FROM used GROUP BY ref""")
def citation_map(spark, d):
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" see ["), (F.col("doc_id") % 70).cast("string"), F.lit("] and ["), (F.col("doc_id") % 50).cast("string"), F.lit("]"))
    used = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(body, F.lit(r"\[([0-9]+)\]"), 1)).alias("ref"))
    known = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("ref"), F.lit(True).alias("defined"))
    return J.lookup(used.groupBy("ref").agg(F.count("*").alias("n_cited")), known, "ref", "defined", F.lit(False)).select("ref", "n_cited", "defined")


@query("SELECT n_nationkey, replace(replace(replace(n_name, 'A', 'α'), 'B', 'β'), 'α', 'a') AS name, regexp_replace(concat(n_name, ' x', chr(9), 'y'), '\\s+', '', 'g') AS flat FROM nation")
def symbol_substitution(spark, d):
    t = table(spark, d, "nation")
    return t.select("n_nationkey", S.substituted(F.col("n_name"), [("A", "α"), ("B", "β"), ("α", "a")]).alias("name"), S.flattened(F.concat(F.col("n_name"), F.lit(" x\ty"))).alias("flat"))


@query("SELECT event_type, count(*) AS n, count(v) AS n_known FROM (SELECT event_type, json_extract_string(props, '$.' || (json_keys(props))[1]) AS v FROM events) GROUP BY event_type")
def json_map_access(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_type", m.alias("m")).select("event_type", F.element_at("m", F.map_keys("m")[0]).alias("v")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("n_known"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (user_id % 4 = 0) AS n_events, round(median(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) / 365.25::DOUBLE), 4) AS median_years,
  round(avg(CASE WHEN date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) / 365.25::DOUBLE < 3 THEN 1.0 ELSE 0.0 END), 4) AS frac_under_3y FROM events GROUP BY event_type""")
def survival_summary(spark, d):
    t = table(spark, d, "events").withColumn("days", F.datediff(F.to_date("ts"), F.to_date(F.lit("2020-01-01"))))
    return B.survival_summary(t, ["event_type"], "days", F.col("user_id") % 4 == 0).select("event_type", "n", "n_events", r4("median_years"), r4("frac_under_3y"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size % 5 AS sheet, p_partkey % 97 AS x0, p_partkey % 89 AS y0, p_partkey % 97 + 5 + p_size % 7 AS x1, p_partkey % 89 + 4 + p_size % 6 AS y1 FROM part)
SELECT sheet, a_id, b_id, round(share, 4) AS share FROM (SELECT a.sheet, a.id AS a_id, b.id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 1.0::DOUBLE / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS share
FROM b a JOIN b ON a.sheet = b.sheet AND a.id < b.id WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) WHERE share > 0.12""")
def box_overlap(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    boxes = p.select(k.alias("id"), (F.col("p_size") % 5).alias("sheet"), (k % 97).alias("x0"), (k % 89).alias("y0"), (k % 97 + 5 + F.col("p_size") % 7).alias("x1"), (k % 89 + 4 + F.col("p_size") % 6).alias("y1"))
    return J.boxes_overlap(boxes, ["sheet"], places=4)


@query("""SELECT domain, pair, method, subset, round(ari + CASE WHEN nlay = 2 THEN 0.01 ELSE 0 END, 4) AS printed, CASE WHEN domain = 'F' OR pair <> 'A' THEN round(CASE WHEN nlay = 2 THEN 0.01 ELSE 0 END, 4) END AS gap, nlay <> 2 AND (domain = 'F' OR pair <> 'A') AS traced FROM records""", "records")
def table_cell_check(spark, d):
    r = X.records(spark, d)
    printed = r.withColumn("ari", F.round(F.col("ari") + F.when(F.col("nlay") == 2, 0.01).otherwise(0.0), 4))
    return B.cell_check(printed, r.where("domain = 'F' or pair <> 'A'"), ["domain", "pair", "method", "subset"], "ari").select("domain", "pair", "method", "subset", "printed", r4("gap"), "traced")


@query("SELECT DISTINCT num FROM (SELECT unnest(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')) AS num FROM benchmark UNION ALL SELECT CAST(item_id AS VARCHAR) FROM benchmark) WHERE num NOT IN (SELECT unnest(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?')) FROM documents)")
def expected_values_missing(spark, d):
    b = table(spark, d, "benchmark")
    expected = b.select(F.explode(F.regexp_extract_all("text", F.lit(S.NUMBER), 0)).alias("num")).unionByName(b.select(F.col("item_id").cast("string").alias("num"))).distinct()
    return expected.join(number_extraction(spark, d).select("num"), "num", "left_anti")


@query(""", a AS (SELECT method AS artefact, ari AS value FROM records WHERE domain = 'F') SELECT r.pair, r.method, r.subset, r.ari AS value, count(DISTINCT a.artefact) AS n_artefacts, count(a.artefact) > 0 AS traced
  FROM records r LEFT JOIN a ON round(a.value, 4) = round(r.ari, 4) WHERE r.domain = 'O' GROUP BY r.pair, r.method, r.subset, r.ari""", "records")
def value_provenance(spark, d):
    r = X.records(spark, d)
    out = V.provenance(r.where("domain = 'O'").select("pair", "method", "subset", F.col("ari").alias("value")), r.where("domain = 'F'").select(F.col("method").alias("artefact"), F.col("ari").alias("value")))
    return out.select("pair", "method", "subset", "value", "n_artefacts", "traced")


_CITED = "SELECT unnest(regexp_extract_all(text, '(?:^|[^0-9])([0-9]{1,3})(?:[^0-9]|$)', 1)) AS ref FROM documents"


def _cited(spark, d):
    """Numbers of up to three digits that stand alone in the texts."""
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?:^|[^0-9])([0-9]{1,3})(?:[^0-9]|$)"), 1)).alias("ref"))


@query(f"""WITH c AS (SELECT DISTINCT ref FROM ({_CITED})), d AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS ref FROM benchmark)
SELECT ref, 'not defined' AS problem FROM c WHERE ref NOT IN (SELECT ref FROM d) UNION ALL SELECT ref, 'not cited' FROM d WHERE ref NOT IN (SELECT ref FROM c)""")
def cross_references(spark, d):
    return V.cross_references(_cited(spark, d), table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("ref"))).select("ref", "problem")


@query(f"WITH u AS (SELECT DISTINCT CAST(ref AS INTEGER) AS ref FROM ({_CITED})) SELECT CAST(r AS INTEGER) AS ref FROM (SELECT unnest(range(1, CAST((SELECT max(ref) FROM u) AS BIGINT) + 1)) AS r) WHERE r NOT IN (SELECT ref FROM u)")
def reference_numbering(spark, d):
    return V.numbering_gaps(_cited(spark, d).select(F.col("ref").cast("int").alias("ref")))


@query("""SELECT p_name AS key, CASE WHEN count(*) FILTER (hit) = 1 THEN min(CASE WHEN hit THEN name END) END AS name FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part), LATERAL (SELECT list_contains(string_split(lower(p_name), ' '), name) AS hit) GROUP BY p_name""")
def fuzzy_domain_key(spark, d):
    p = table(spark, d, "part").select("p_name").distinct()
    return V.fuzzy_key(p.select(F.col("p_name").alias("key")), p.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name")).distinct())


@query(""", h AS (SELECT sample, list(DISTINCT layer) AS l FROM presence WHERE cohort = 'A' GROUP BY sample)
SELECT 1 AS step, 'q1' AS layer, count(*) AS n_samples FROM h WHERE list_has_all(l, ['q1']) UNION ALL SELECT 2, 'q2', count(*) FROM h WHERE list_has_all(l, ['q1', 'q2']) UNION ALL SELECT 4, 'q3', count(*) FROM h WHERE list_has_all(l, ['q1', 'q2', 'q3'])""", "presence")
def core_set_sizes(spark, d):
    p = X.presence(spark, d).where("cohort = 'A'").select("sample", "layer")
    return V.core_set(p, ["q1", "q2", "q9", "q3"])


@query(""", c AS (SELECT a.sample AS i, b.sample AS j, corr(a.v, b.v) AS r, any_value(a.label) AS la, any_value(b.label) AS lb FROM emb a JOIN emb b USING (pos) WHERE a.sample < b.sample GROUP BY a.sample, b.sample)
SELECT least(la, lb) AS family_a, greatest(la, lb) AS family_b, count(*) AS n_pairs, round(avg(r), 4) AS mean_r FROM c GROUP BY ALL""", "emb")
def family_spectra_correlation(spark, d):
    sums = M.group_correlations(X.vectors(spark, d).select("sample", "label", "features"), "label")
    both = sums.groupBy(F.col("group_a").alias("family_a"), F.coalesce("group_b", "group_a").alias("family_b"))
    return both.agg(F.sum("n_pairs").alias("n_pairs"), r4(F.sum("total") / F.sum("n"), "mean_r"))


@query(""", e AS (SELECT domain AS artefact, concat(pair, method, subset) AS key, ari AS value FROM records WHERE nlay < 3), c AS (SELECT domain AS artefact, concat(pair, method, subset) AS key, CASE WHEN method = 'PROMO' THEN ari + 0.5 ELSE ari END AS value FROM records)
SELECT artefact, key, CASE WHEN e.value IS NULL THEN 'no evidence' WHEN abs(c.value - e.value) <= 1e-4 THEN 'agrees' ELSE 'differs' END AS verdict FROM c LEFT JOIN e USING (artefact, key)""", "records")
def evidence_ledger(spark, d):
    r = X.records(spark, d).withColumn("key", F.concat("pair", "method", "subset")).withColumn("artefact", F.col("domain"))
    claims = r.select("artefact", "key", F.when(F.col("method") == "PROMO", F.col("ari") + 0.5).otherwise(F.col("ari")).alias("value"))
    return V.ledger(claims, r.where("nlay < 3").select("artefact", "key", F.col("ari").alias("value"))).select("artefact", "key", "verdict")


# RE2 has no look-ahead: each comma is doubled, so that a number and the next one have a separator each
@query(r"""SELECT event_id, CAST(unnest(regexp_extract_all(replace(concat('{"at":[', event_id, ',', user_id, ', -2.5],"p":', props, '}'), ',', ',,'), '[:\[,]\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*[,\]}]', 1)) AS DOUBLE) AS x FROM events""")
def nested_numbers(spark, d):
    made = F.concat(F.lit('{"at":['), F.col("event_id").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit(', -2.5],"p":'), F.coalesce("props", F.lit("")), F.lit("}"))
    return V.nested_numbers(table(spark, d, "events").select("event_id", made.alias("nested")), "event_id", "nested", 1e9)


@query("SELECT cohort, sample, count(*) AS n_features, round(sum(v * pos), 4) AS checksum FROM emb GROUP BY ALL", "emb")
def concatenated_blocks(spark, d):
    whole = M.concatenated(X.blocks(spark, d), ["cohort"])
    total = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return whole.select("cohort", "sample", F.size("features").cast("long").alias("n_features"), r4(total, "checksum"))


# ---------- learned: rows only


def _unit(spark, d):
    return X.blocks(spark, d), ["cohort"]


def _features(method):
    def run(spark, d):
        blocks, unit = _unit(spark, d)
        return L.features(blocks, unit, method)

    return run


for _name, _method in {"pca_features": "pca", "nmf_features": "nmf", "snf_features": "snf", "mcca_lite": "mcca_lite", "mofa_lite": "mofa_lite", "mfa": "mfa", "intnmf": "intnmf", "block_pls": "block_pls", "icluster": "icluster", "mofa": "mofa"}.items():
    _FOUND[_name] = (_features(_method), None)


@query()
def fusion_linkage(spark, d):
    return L.linkage_clusters(X.blocks(spark, d), ["cohort"], 4, "fusion")


@query()
def benchmark_grid(spark, d):
    return B.benchmark(X.blocks(spark, d), "cohort", sorted(L.METHODS), (3, 4, 5), least_features=32)


@query()
def stability_pac(spark, d):
    labels = L.bootstrap_labels(X.blocks(spark, d), ["cohort"], "kmeans", 4)
    return T.pac(labels, by=["cohort"]).select("cohort", "n_pairs", *[r4(c) for c in ("pac", "strong", "weak", "median_consensus")])


def _one(spark, d):
    return X.vectors(spark, d).withColumn("unit", F.lit("all"))


@query()
def cv_logistic_auc(spark, d):
    return L.cross_validated_auc(_one(spark, d), ["unit"], "batch")


@query()
def svm_auc(spark, d):
    return L.cross_validated_auc(_one(spark, d), ["unit"], "batch", "svm")


@query()
def cross_batch_accuracy(spark, d):
    return L.cross_batch_accuracy(_one(spark, d), ["unit"], "batch", "cond")


@query()
def pc_sweep(spark, d):
    return L.component_sweep(_one(spark, d), ["unit"], "batch").where("kind = 'dropped'")


@query()
def pc_association(spark, d):
    return L.component_sweep(_one(spark, d), ["unit"], "cond").where("kind = 'single'")


@query()
def harmony_embedding(spark, d):
    return L.harmony(_one(spark, d), ["unit"], "batch")


_LOADING = """, m AS (SELECT sample, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM emb), c AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS c FROM m a JOIN m b USING (sample) GROUP BY ALL),
r AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)),
w AS (SELECT 0 AS k, m FROM r UNION ALL SELECT k + 1, list_transform(u, lambda a: list_transform(a, lambda x: x / sqrt(list_sum(list_transform(u, lambda q: list_dot_product(q, q))))))
  FROM (SELECT k, list_transform(m, lambda a: list_transform(m, lambda q: list_dot_product(a, q))) AS u FROM w WHERE k < 24)),
l AS (SELECT v FROM (SELECT unnest(m) AS v FROM w WHERE k = 24) ORDER BY list_dot_product(v, v) DESC LIMIT 1)
SELECT 'all' AS unit, unnest(range(len(v))) AS feature, round(unnest(v) / sqrt(list_dot_product(v, v)) * CASE WHEN list_sum(v) >= 0 THEN 1 ELSE -1 END, 4) AS loading FROM l"""


@query(_LOADING, "emb")
def first_component_loading(spark, d):
    return L.first_loading(_one(spark, d), ["unit"]).withColumn("loading", F.round("loading", 4))


@query()
def split_half(spark, d):
    return L.resampled_ari(X.blocks(spark, d), ["cohort"], 3, "split", 200)


@query()
def bootstrap_ceiling(spark, d):
    return L.resampled_ari(X.blocks(spark, d), ["cohort"], 3, "bootstrap", 200)


@query()
def power_curve(spark, d):
    return spark.createDataFrame(L.power_curve(0.15, (0.02, 0.05, 0.1), (10, 22, 50, 100)), "delta double, n int, power double")


@query(""", k AS (SELECT pair, nlay, count(DISTINCT method) AS k FROM records GROUP BY ALL), g AS (SELECT x, exp(-x * x / 2) / sqrt(2 * pi()) AS f, sum(exp(-x * x / 2) / sqrt(2 * pi())) OVER (ORDER BY x) * 1e-3 - exp(-x * x / 2) / sqrt(2 * pi()) * 5e-4 AS c FROM (SELECT -9 + i * 1e-3::DOUBLE AS x FROM (SELECT unnest(range(18001)) AS i))),
e AS (SELECT k, sum(x * k * f * pow(c, k - 1)) * 1e-3 AS m FROM (SELECT DISTINCT k FROM k) CROSS JOIN g GROUP BY k) SELECT pair, CAST(nlay AS BIGINT) AS nlay, k, round(m, 4) AS expected_max FROM k JOIN e USING (k)""", "records")
def selection_bias(spark, d):
    k = X.records(spark, d).groupBy("pair", F.col("nlay").cast("long").alias("nlay")).agg(F.countDistinct("method").alias("k"))
    known = L.selection_bias(tuple(r["k"] for r in k.select("k").distinct().collect()))  # a few numbers of methods
    return k.join(spark.createDataFrame(known, "k long, expected_max double"), "k").select("pair", "nlay", "k", r4("expected_max"))


@query(""", e AS (SELECT * FROM events) SELECT w AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT time_bucket(INTERVAL 1 day, ts) AS w, event_type, value FROM e) GROUP BY ALL""".replace(", e AS", "WITH e AS", 1))
def daily_event_profile(spark, d):
    t = table(spark, d, "events")
    return t.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")




from cohortlens.plans import catalogue_files, catalogue_learners, catalogue_more  # noqa: E402, F401  (register their queries)
