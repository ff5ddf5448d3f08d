"""Statistics and scores. All but p-values stay in the JVM and have exact SQL counterparts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.distributions import normal_p_two_sided, t_p_two_sided, t_ppf
from cohortlens.operators.matrix import squared_distance, strips, two_blocks
from cohortlens.operators.rank import avg_rank, matched, ranged, value_ranks, with_ranks

#: Lower bounds of the concordance bands.
HIGH, MODERATE = 0.8, 0.5


def band(rho: Column) -> Column:
    return F.when(rho > HIGH, "high").when(rho > MODERATE, "moderate").otherwise("low")


def spearman(pairs: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rank correlation with average ranks, and its two-sided p."""
    ranked = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_rx", avg_rank(by, x)).withColumn("_ry", avg_rank(by, y))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def correlation_p(df: DataFrame, rho: str = "spearman", n: str = "n") -> DataFrame:
    """Two-sided p of a correlation by Student's t with n - 2 degrees."""
    r, k = F.col(rho), F.col(n)
    t = r * F.sqrt((k - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return df.withColumn("p", t_p_two_sided(t, (k - 2).cast("double")))


def platform_ladder(pairs: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Spearman, Pearson, sign concordance and slope of y on x in one table."""
    ranked = with_ranks(with_ranks(pairs, by, x, "_rx"), by, y, "_ry")
    same = (F.signum(x) == F.signum(y)).cast("int")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman"), F.corr(x, y).alias("pearson"), F.avg(same).alias("sign_concordance"), F.regr_slope(y, x).alias("slope"))


def auc(df: DataFrame, by: Sequence[str], score: str, label: Column) -> DataFrame:
    """Area under the ROC curve by the rank sum, also with the sign fixed, and Mann-Whitney's U."""
    held = ranged(df.where(F.col(score).isNotNull()).withColumn("_y", label.cast("int")), by, score)
    ranked = value_ranks(held, by, score, "_r", "_range", None, F.sum("_y").alias("_n1"), F.sum(1 - F.col("_y")).alias("_n0"))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_n1")).alias("_s"), F.sum("_n1").alias("n1"), F.sum("_n0").alias("n0"))
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2
    out = sums.withColumn("u", u).withColumn("auc", F.col("u") / (F.col("n1") * F.col("n0")))
    return out.withColumn("auc_fixed", F.greatest(F.col("auc"), 1 - F.col("auc"))).drop("_s")


def mann_whitney_p(df: DataFrame) -> DataFrame:
    """Two-sided p of U (columns u, n1, n0), normal approximation with continuity correction."""
    mean, sd = F.col("n1") * F.col("n0") / 2, F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12)
    z = F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)) / sd
    return df.withColumn("p", normal_p_two_sided(z))


def adjusted_rand(labels: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labellings; equal trivial partitions give 1, other zero denominators 0."""
    return rand_of_counts(labels.groupBy(*by, a, b).agg(F.count("*").alias("n")), a, b, by)


def rand_of_counts(table: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``adjusted_rand`` from the counts n of the pairs of labels."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = table.groupBy(*by).agg(F.sum(two("n")).alias("s_ab"), F.sum("n").alias("n"), F.count("*").alias("k_ab"))
    sides = [table.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(two("m")).alias(f"s_{s}"), F.count("*").alias(f"k_{s}")) for c, s in ((a, "a"), (b, "b"))]
    for s in sides:
        cells = matched(cells, s, list(by)) if by else cells.crossJoin(F.broadcast(s))  # one row each
    expected = F.col("s_a") * F.col("s_b") / F.greatest(two("n"), F.lit(1.0))
    most = (F.col("s_a") + F.col("s_b")) / 2
    same = (F.col("k_ab") == F.col("k_a")) & (F.col("k_ab") == F.col("k_b"))
    score = F.when(most - expected == 0, F.when(same, 1.0).otherwise(0.0)).otherwise((F.col("s_ab") - expected) / F.when(most - expected == 0, F.lit(None)).otherwise(most - expected))
    return cells.withColumn("ari", score).withColumn("degen_labels", ((F.col("k_a") < 2) | (F.col("k_b") < 2)).cast("int")).select(*by, "n", "ari", "degen_labels")


def cluster_balance(labels: DataFrame, label: str, by: Sequence[str] = (), limit: float = 0.7) -> DataFrame:
    """Clusters, share of the largest, and whether it exceeds the limit."""
    out = labels.groupBy(*by, label).count().groupBy(*by).agg(F.count("*").alias("n_clusters"), (F.max("count") / F.sum("count")).alias("max_fraction"))
    return out.withColumn("degen_balance", (F.col("max_fraction") > limit).cast("int"))


def nearest_centroid(samples: DataFrame, centroids: DataFrame, vector: str = "features", sample: str = "sample") -> DataFrame:
    """Each sample's closest centroid (label, centroid), ties to the smaller label; k centroids, k small."""
    both = samples.select(sample, vector).crossJoin(F.broadcast(centroids.select("label", "centroid"))).withColumn("_d", squared_distance(F.col(vector), F.col("centroid")))
    return both.groupBy(sample).agg(F.min(F.struct("_d", "label")).alias("_b")).select(sample, F.col("_b.label").alias("label"), F.sqrt("_b._d").alias("distance"))


def pac(labels: DataFrame, replicate: str = "replicate", sample: str = "sample", label: str = "label", low: float = 0.1, high: float = 0.9, by: Sequence[str] = (), least_replicates: int = 4, least_pairs: int = 100) -> DataFrame:
    """Proportion of ambiguous pairs: consensus strictly between the bounds, over replicates that drew both samples.

    Units with fewer replicates or pairs than the least have no row.
    """
    if by:
        enough = labels.groupBy(*by).agg(F.countDistinct(replicate).alias("_r")).where(F.col("_r") >= least_replicates)
        labels = labels.join(enough.select(*by), list(by), "left_semi")
    else:
        enough = labels.agg(F.countDistinct(replicate).alias("_r")).where(F.col("_r") >= least_replicates)
        labels = labels.join(F.broadcast(enough.select()), how="left_semi")  # one row or none
    # a pair matters by how often it was drawn and how often it agreed; samples with the same labels in every
    # replicate are one row with their number, and blocks of such rows count the combinations
    reps = labels.groupBy(*by).agg(F.array_sort(F.collect_set(replicate)).alias("_reps"))
    held = labels.groupBy(*by, sample).agg(F.map_from_entries(F.collect_list(F.struct(replicate, label))).alias("_m"))
    held = held.join(reps, list(by)) if by else held.crossJoin(F.broadcast(reps))  # one row
    codes = F.transform("_reps", lambda r: F.coalesce(F.element_at("_m", r).cast("double"), F.lit(float("nan"))))
    alike = held.select(*by, sample, codes.alias("_v")).groupBy(*by, "_v").agg(F.min(sample).alias(sample), F.count("*").cast("double").alias("_n"))
    counts = two_blocks(alike.select(*by, sample, F.concat("_v", F.array("_n")).alias("_v")), by, _agreements, "same long, drawn long, n long", "_v", sample)
    shares = counts.where("drawn > 0").groupBy(*by, (F.col("same") / F.col("drawn")).alias("c")).agg(F.sum("n").alias("n"))
    upto, total = F.sum("n").over(Window.partitionBy(*by).orderBy("c")), F.sum("n").over(Window.partitionBy(*by))
    shares = shares.withColumn("_upto", upto).withColumn("_total", total)
    c, n = F.col("c"), F.col("n")
    middle = F.array(*[F.min(F.when(F.col("_upto") >= F.floor((F.col("_total") + k) / 2), c)) for k in (1, 2)])
    share = lambda condition: F.sum(F.when(condition, n).otherwise(0)) / F.sum(n)
    out = shares.groupBy(*by).agg(F.sum(n).alias("n_pairs"), share((c > low) & (c < high)).alias("pac"), share(c > high).alias("strong"), share(c < low).alias("weak"), middle.alias("_middle"))
    return out.where(F.col("n_pairs") >= least_pairs).withColumn("median_consensus", (F.col("_middle")[0] + F.col("_middle")[1]) / 2).drop("_middle")


def _agreements(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, first: dict) -> dict:
    """How many pairs of samples agree in so many replicates and were both drawn in so many. The last of a row's numbers is how many samples it stands for."""
    (x, m), (y, w), base = (x[:, :-1], x[:, -1]), (y[:, :-1], y[:, -1]), x.shape[1]
    known = [np.unique(np.r_[a, b][~np.isnan(np.r_[a, b])]) for a, b in zip(x.T, y.T, strict=True)]
    one = lambda z: np.hstack([z[:, [r]] == v for r, v in enumerate(known)]).astype(np.float32)
    # the product of two rows is (agreements) * base + (both drawn), exact in single precision up to 4,000 replicates
    kind = np.float32 if base < 4000 else np.float64
    left, right = np.c_[one(x).astype(kind) * base, ~np.isnan(x)].astype(kind), np.c_[one(y), ~np.isnan(y)].astype(kind)
    total = np.zeros(base * base)
    for part in strips(len(x), len(y)):
        code, n = (left[part] @ right.T).astype(np.int64), m[part][:, None] * w[None, :]
        if first["p"] == first["q"]:
            before, own = i[part][:, None] < j[None, :], i[part][:, None] == j[None, :]
            n = np.where(own, n - m[part][:, None], 2 * n * before) / 2  # samples alike are pairs, too
        total += np.bincount(code.ravel(), n.ravel(), base * base)
    found = np.flatnonzero(total)
    return {"same": found // base, "drawn": found % base, "n": total[found].astype(np.int64)}


def ks_statistic(df: DataFrame, by: Sequence[str], value: str, group: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each feature."""
    held = df.where(F.col(value).isNotNull()).withColumn("_g", group.cast("int"))
    at = held.groupBy(*by, value).agg(F.sum("_g").alias("a"), F.sum(1 - F.col("_g")).alias("b"))
    up, all_ = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    gap = F.abs(F.sum("a").over(up) / F.sum("a").over(all_) - F.sum("b").over(up) / F.sum("b").over(all_))
    return at.withColumn("_gap", gap).groupBy(*by).agg(F.max("_gap").alias("ks"))


def knn_mixing(neighbours: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean share of neighbours (i, j) that come from another group (sample, grp)."""
    left = groups.select(F.col("sample").alias("i"), F.col("grp").alias("gi"))
    right = groups.select(F.col("sample").alias("j"), F.col("grp").alias("gj"))
    other = neighbours.join(left, "i").join(right, "j").groupBy(*by, "i").agg(F.avg((F.col("gi") != F.col("gj")).cast("int")).alias("other"))
    return other.groupBy(*by).agg(F.count("*").alias("n"), F.avg("other").alias("mixing"))


def correlation_gap(pairs: DataFrame, same: Column, r: str = "r") -> DataFrame:
    """Mean correlation within groups, between groups, and their difference."""
    out = pairs.agg(F.avg(F.when(same, F.col(r))).alias("within"), F.avg(F.when(~same, F.col(r))).alias("between"))
    return out.withColumn("gap", F.col("within") - F.col("between"))


def correlation_gap_of_groups(sums: DataFrame) -> DataFrame:
    """``correlation_gap`` from the sums of ``matrix.group_correlations``; pairs without a known group count on neither side."""
    same = F.col("group_a") == F.col("group_b")
    mean = lambda c: F.sum(F.when(c, F.col("total"))) / F.sum(F.when(c, F.col("n")))
    return sums.agg(mean(same).alias("within"), mean(~same).alias("between")).withColumn("gap", F.col("within") - F.col("between"))


def paired_vs_baseline(records: DataFrame, keys: Sequence[str], baseline: str, arm: str = "method", score: str = "ari") -> DataFrame:
    """Each arm against the baseline on shared records: difference, gain, t, interval and win rate."""
    base = records.where(F.col(arm) == baseline).select(*keys, F.col(score).alias("_base"))
    d = F.col(score) - F.col("_base")
    both = records.where(F.col(arm) != baseline).join(base, list(keys)).where(F.col(score).isNotNull() & F.col("_base").isNotNull())
    out = both.groupBy(arm).agg(F.count("*").alias("n"), F.avg(score).alias("mean_arm"), F.avg(d).alias("mean_delta"), (F.avg(d) / F.avg("_base")).alias("rel_vs_base"), F.stddev_samp(d).alias("_sd"), F.avg((d > 0).cast("int")).alias("win_rate"))
    se = F.col("_sd") / F.sqrt("n")
    return out.withColumn("t", F.col("mean_delta") / se).withColumn("ci_lo", F.col("mean_delta") - 1.96 * se).withColumn("ci_hi", F.col("mean_delta") + 1.96 * se).drop("_sd")


def paired_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", t_p_two_sided("t", (F.col("n") - 1).cast("double")))


def noise_floor(records: DataFrame, unit: Sequence[str], by: Sequence[str], score: str = "ari") -> DataFrame:
    """Sample sd of the score inside each unit; by group the median and mean of those sds."""
    sds = records.groupBy(*by, *unit).agg(F.stddev_samp(score).alias("sd"), F.count("*").alias("n"))
    return sds.where("sd is not null").groupBy(*by).agg(F.count("*").alias("n_units"), F.median("sd").alias("median_sd"), F.avg("sd").alias("mean_sd"))


def required_n(df: DataFrame, sd: str, delta: Column, z: float = 2.8, n: Column | None = None) -> DataFrame:
    """Records needed to see ``delta`` at z standard errors, and the least difference visible with ``n`` at hand."""
    out = df.withColumn("required_n", F.ceil((F.lit(z) * F.col(sd) / delta) ** 2).cast("long"))
    return out.withColumn("least_visible", F.lit(z) * F.col(sd) / F.sqrt(n)) if n is not None else out


def spread_over(records: DataFrame, unit: Sequence[str], over: str, score: str = "ari") -> DataFrame:
    """Sample sd of the score over the values of one column (K, say), for each unit that has two of them."""
    return records.groupBy(*unit).agg(F.stddev_samp(score).alias("sd"), F.countDistinct(over).alias("n")).where("sd is not null")


def champions(records: DataFrame, keys: Sequence[str], method: str = "method", score: str = "ari") -> DataFrame:
    """The best method of each record, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), method)
    return records.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def champion_flip(records: DataFrame, unit: Sequence[str], pair: str = "pair", method: str = "method", score: str = "ari") -> DataFrame:
    """Over the pairs of each unit: pairs, distinct winners, whether all agree, the winners."""
    won = champions(records, [*unit, pair], method, score)
    return won.groupBy(*unit).agg(F.count("*").alias("n_pairs"), F.countDistinct(method).alias("n_unique_winner"), F.array_join(F.array_sort(F.collect_set(method)), "|").alias("winners")).withColumn("consistent", F.col("n_unique_winner") == 1)


def replicability(records: DataFrame, unit: Sequence[str], pair: str = "pair", method: str = "method", score: str = "ari", share: float = 2 / 3, least: int = 2) -> DataFrame:
    """Methods that win at least a share of the pairs of a unit, out of enough pairs."""
    won = champions(records, [*unit, pair], method, score)
    n = F.sum("wins").over(Window.partitionBy(*unit))
    return won.groupBy(*unit, method).agg(F.count("*").alias("wins")).withColumn("n_pairs", n).withColumn("replicable", (F.col("wins") / F.col("n_pairs") >= share) & (F.col("n_pairs") >= least))


def reproduction(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str = "ari", near: float = 1e-6, same: float = 1e-9) -> DataFrame:
    """Shared records, records within tolerance and equal, and the largest difference."""
    both = a.select(*keys, F.col(score).alias("x")).join(b.select(*keys, F.col(score).alias("y")), list(keys))
    gap = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count("*").alias("n_shared"), F.sum((gap <= near).cast("int")).alias("n_near"), F.sum((gap <= same).cast("int")).alias("n_same"), F.max(gap).alias("max_gap"))


def power_needed(sd: float, delta: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Paired records for a one-sided t test, from the quantiles of Student's distribution."""
    n = 3
    while n < 100_000 and delta * n**0.5 / sd < t_ppf(1 - alpha, n - 1) + t_ppf(power, n - 1):
        n += 1
    return n
