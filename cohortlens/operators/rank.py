"""Rank and window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.distributions import normal_quantile


def avg_rank(by: Sequence[str], value: str) -> Column:
    """Rank from 1, ties with the mean of their ranks; NULL has none."""
    ordered = Window.partitionBy(*by, F.col(value).isNull()).orderBy(value)
    tied = Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(ordered) + (F.count(value).over(tied) - 1) / 2)


def ordinal_rank(by: Sequence[str], value: str, tie: str) -> Column:
    """Rank from 1, ties in the order of ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))


#: Rows of one range of values: what a window of one task holds.
ROWS_PER_RANGE = 1_000_000


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, in which nulls are equal; the keys are those of the left."""
    other = right.select(*[F.col(k).alias(f"_of_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_of_{k}" for k in keys])


def ranged(df: DataFrame, by: Sequence[str], value: str, out: str = "_range", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``out``: the range of values that a row falls into, numbered in their order within a unit; null without a value.

    There are as many as the largest unit needs for ``rows`` rows in each, cut at
    approximate quantiles; equal values share a range. The cuts are a written
    table, so that all that is made from them agrees; results do not depend on them.
    """
    from cohortlens.operators.clustering import stored

    held = df.where(F.col(value).isNotNull())
    most = held.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    n = -(-most // rows)
    if n <= 1:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), 0))
    cuts = stored(held.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / n) for i in range(1, n)]), max(10_000, 10 * n))).alias("_cuts")))
    cut = matched(df, cuts, list(by), "left") if by else df.crossJoin(F.broadcast(cuts))  # one row
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return cut.withColumn(out, F.when(F.col(value).isNotNull(), below)).drop("_cuts")


def value_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", ranges: str = "_range", weight: Column | None = None, *also: Column) -> DataFrame:
    """Each distinct value of a unit with its rank from 1 (ties, and rows of whole weights, have the mean of theirs).

    Columns: unit, range, value, ``_n`` (rows or weight), ``also`` (other aggregates of the value's rows), rank. Rows are
    counted before anything is ordered; a window holds one range of distinct values, another the totals of a unit's ranges.
    """
    w = F.lit(1) if weight is None else weight
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, ranges, value).agg(F.sum(w).cast("long").alias("_n"), *also)
    before = Window.partitionBy(*by).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, ranges).agg(F.sum("_n").alias("_t")).withColumn("_t", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    up_to = Window.partitionBy(*by, ranges).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = matched(counts.withColumn("_to", F.sum("_n").over(up_to)), totals, [*by, ranges])
    return placed.withColumn(out, F.col("_t") + F.col("_to") - (F.col("_n") - 1) / 2).drop("_t", "_to")


def with_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``avg_rank`` for units of any size: no task orders more than a range of a unit's values."""
    cut = ranged(df, by, value, "_range", rows)
    return matched(cut, value_ranks(cut, by, value, out).drop("_n"), [*by, "_range", value], "left").drop("_range")


def rank_to_normal(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """Each value replaced by the normal quantile of (rank - 0.5) / n."""
    n = F.count(value).over(Window.partitionBy(*by))
    return df.withColumn("_p", (ordinal_rank(by, value, tie) - 0.5) / n).withColumn("normal_score", normal_quantile("_p")).drop("_p")


def quantile_normalise(cells: DataFrame, by: Sequence[str] = ("cohort", "layer"), sample: str = "sample", feature: str = "feature", value: str = "value") -> DataFrame:
    """Complete data: the r-th smallest value of a sample becomes the mean r-th smallest of all samples."""
    ranked = cells.where(F.col(value).isNotNull()).withColumn("r", ordinal_rank([*by, sample], value, feature))
    mean = F.avg(value).over(Window.partitionBy(*by, "r"))
    return ranked.withColumn("normalised", mean).drop("r")


def quantile_normalise_gaps(cells: DataFrame, by: Sequence[str] = ("cohort", "layer"), sample: str = "sample", feature: str = "feature", value: str = "value", points: int = 101, least: int = 3) -> DataFrame:
    """With missing values: each sample is read at the same relative positions, and the reference is
    the mean over samples at each position; values go to the reference at their own position, with
    linear interpolation between positions. Samples with fewer than ``least`` values stay as they are.
    """
    held = cells.where(F.col(value).isNotNull())
    unit = [*by, sample]
    n = F.count("*").over(Window.partitionBy(*unit))
    ranked = held.withColumn("n", n).withColumn("r", ordinal_rank(unit, value, feature))
    grid = [k / (points - 1) for k in range(points)]
    curves = ranked.where(F.col("n") >= least).groupBy(*unit).agg(F.percentile(value, F.array(*map(F.lit, grid))).alias("q"))
    reference = curves.select(*by, F.posexplode("q").alias("k", "v")).groupBy(*by, "k").agg(F.avg("v").alias("v")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("ref"))
    place = (F.col("r") - 1) / (F.col("n") - 1) * (points - 1)
    low = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    a, b = F.col("ref")[low], F.col("ref")[low + 1]
    out = ranked.join(reference, list(by), "left")
    return out.withColumn("normalised", F.when(F.col("n") < least, F.col(value)).otherwise(a + (b - a) * (place - low))).drop("ref", "n", "r")


def mad(cells: DataFrame, by: Sequence[str] = ("cohort", "layer", "feature"), value: str = "value") -> DataFrame:
    """Median absolute deviation from the median, for each group.

    Values come together by group once, as an array that is sorted, and again by the
    distance from its middle: no counts of distinct values are built, sent and merged.
    """

    def middle(x: Column) -> Column:
        n = F.size(x)
        return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2

    dealt = cells.select(*by, F.col(value).cast("double").alias("_v")).repartition(*by)
    held = dealt.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_all")).withColumn("_m", middle(F.col("_all")))
    apart = held.select(*by, F.sort_array(F.transform("_all", lambda x: F.abs(x - F.col("_m")))).alias("_apart"))
    return apart.select(*by, middle(F.col("_apart")).alias("mad"))


def top_mad(cells: DataFrame, n: int, by: Sequence[str] = ("cohort", "layer"), feature: str = "feature", value: str = "value") -> DataFrame:
    """The n features of largest MAD above 0 in each matrix, ties by feature."""
    order = Window.partitionBy(*by).orderBy(F.desc("mad"), F.asc(feature))
    return mad(cells, [*by, feature], value).where("mad > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def effect_rank(df: DataFrame, effect: str, by: Sequence[str], tie: str) -> DataFrame:
    """Place of each row by the size of an effect, the largest first, ties in the order of ``tie``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(effect))), tie)))


def shared_top_mad(cells: DataFrame, n: int, side: str = "cohort", by: Sequence[str] = ("layer",), feature: str = "feature", value: str = "value", least: int = 50) -> DataFrame:
    """Features among the n of largest MAD on every side; where fewer than ``least`` are, the first n that every side has."""
    from cohortlens.operators.relational import in_all

    both = in_all(top_mad(cells, n, [side, *by], feature, value), feature, side, by)
    counts = cells.select(*by).distinct().join(both.groupBy(*by).agg(F.count("*").alias("_n")), list(by), "left").select(*by, (F.coalesce("_n", F.lit(0)) < least).alias("_few"))
    first = in_all(cells, feature, side, by).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(feature))).where(F.col("_r") <= n).drop("_r")
    chosen = lambda df, few: df.join(counts.where(F.col("_few") == few).select(*by), list(by), "left_semi")
    return chosen(both, False).withColumn("fallback", F.lit(0)).unionByName(chosen(first, True).withColumn("fallback", F.lit(1)))


def quartile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartile 1 to 4 by interpolated edges, closed on the right, the lowest value in the first."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e"))
    out = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))  # one row
    v = F.col(value)
    return out.withColumn("quartile", F.when(v <= F.col("_e")[0], 1).when(v <= F.col("_e")[1], 2).when(v <= F.col("_e")[2], 3).otherwise(4)).drop("_e")
