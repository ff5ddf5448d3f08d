"""Learners over units of blocks: the kernels run as grouped Arrow functions, one group for each unit.

``blocks`` has one row for each sample and layer: unit columns, ``sample``,
``layer``, ``features`` (array of doubles, in one order for a layer).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import clustering as C
from cohortlens.operators import harmony as H
from cohortlens.operators import kernels as K
from cohortlens.operators import linkage as G
from cohortlens.operators import scorers as T

#: Feature constructors: layers of a unit to a samples x columns array.
METHODS: dict[str, Callable[[list[np.ndarray]], np.ndarray]] = {
    "kmeans": lambda xs: np.hstack(xs),
    "pca": lambda xs: K.pca(np.hstack(xs), 10)[0],
    "nmf": lambda xs: K.nmf(np.hstack(xs), 10)[0],
    "spectral": lambda xs: K.spectral(K.knn_affinity(np.hstack(xs)), 8),
    "coassociation": K.coassociation,
    "snf": lambda xs: K.spectral(K.fused(xs if len(xs[0]) >= 15 else xs[:1]), 8),
    "snf_scaled": lambda xs: K.spectral(K.fused(xs if len(xs[0]) >= 15 else xs[:1]), 8, scaled=True),
    "mcca_lite": lambda xs: K.layer_components(xs, 5),
    "mofa_lite": lambda xs: K.layer_components(xs, 5, weighted=True),
    "mfa": K.multiple_factors,
    "intnmf": lambda xs: K.shared_nmf(xs, 5),
    "block_pls": K.block_components,
    "icluster": K.factor_analysis,
    "mofa": lambda xs: K.factor_analysis([x[:, np.argsort(-np.median(np.abs(x - np.median(x, axis=0)), axis=0), kind="stable")[:400]] for x in xs], 4),
}


def layers_of(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Samples that have every layer, in order, and their standardised layers."""
    names = sorted(pdf["layer"].unique())
    held = [pdf[pdf["layer"] == n].set_index("sample")["features"] for n in names]
    samples = sorted(set.intersection(*(set(h.index) for h in held)))
    return np.array(samples), [K.standardised(np.array(h.loc[samples].tolist(), dtype=float)) for h in held]


def grouped(blocks: DataFrame, unit: Sequence[str], run: Callable[[tuple, pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """``run`` on every unit; its columns follow the unit's."""
    keys = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in unit)

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(key, pdf)
        for i, c in enumerate(unit):
            out.insert(i, c, key[i])
        return out

    return blocks.groupBy(*unit).applyInPandas(kernel, f"{keys}, {columns}")


def shared_out(blocks: DataFrame, unit: Sequence[str], part: str, parts: int) -> DataFrame:
    """Every row once for each part of its unit's work, the parts spread over tasks of their own however few bytes they are."""
    return blocks.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(4 * parts, *unit, part)


def apart(blocks: DataFrame, unit: Sequence[str], tasks: int = 64) -> DataFrame:
    """Units of few bytes and long work stay on tasks of their own, which adaptive execution would put together."""
    return blocks.repartition(tasks, *unit)


#: Samples of a unit up to which a group fuses and links its network; larger units go through blocks.
LINKED = 6_000


def by_size(blocks: DataFrame, unit: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of units of at most so many samples, and those of the others (none: no such unit)."""
    names = list(unit)
    # samples of the layer with the most: a row for each unit
    large = blocks.groupBy(*names, "layer").agg(F.count("*").alias("_n")).groupBy(*names).agg(F.max("_n").alias("_n")).where(F.col("_n") > most).drop("_n")
    large = large.sparkSession.createDataFrame(large.collect(), large.schema)
    if large.isEmpty():
        return blocks, None
    same = reduce(Column.__and__, [blocks[c].eqNullSafe(large[c]) for c in names])
    large = F.broadcast(large)
    return blocks.join(large, same, "left_anti"), blocks.join(large, same, "left_semi")


def features(blocks: DataFrame, unit: Sequence[str], method: str) -> DataFrame:
    """The feature constructor of a method on every unit: sample and its columns, rounded to 6 places."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        samples, xs = layers_of(pdf)
        f = METHODS[method](xs)
        return pd.DataFrame({"sample": samples, "features": np.round(f, 6).tolist()})

    return grouped(apart(blocks, unit), unit, run, "sample long, features array<double>")


def clusters(blocks: DataFrame, unit: Sequence[str], method: str, k: int, seed: int = 49) -> DataFrame:
    """Cluster labels of every unit under a method."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        samples, xs = layers_of(pdf)
        label, _ = K.kmeans(K.standardised(METHODS[method](xs)), k, seed)
        return pd.DataFrame({"sample": samples, "label": label.astype(int)})

    return grouped(blocks, unit, run, "sample long, label int")


def linkage_clusters(blocks: DataFrame, unit: Sequence[str], k: int, kind: str = "coassociation") -> DataFrame:
    """Average linkage on a consensus: co-association of layer clusterings, or the fused network.

    Networks of more than ``LINKED`` samples are fused by blocks and linked in rounds.
    """
    blocks, large = by_size(blocks, unit, LINKED) if kind == "fusion" else (blocks, None)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        samples, xs = layers_of(pdf)
        if kind == "coassociation":
            member = K.coassociation(xs)
            near = member @ member.T / max(float(member.sum(axis=1).max()), 1.0)
        else:
            near = K.fused(xs)
            near = near / max(float(near.max()), 1e-12)
        return pd.DataFrame({"sample": samples, "label": K.average_linkage(1 - (near + near.T) / 2, k).astype(int)})

    out = grouped(apart(blocks, unit), unit, run, "sample long, label int")
    if large is None:
        return out
    return out.unionByName(G.average_linkage(C.stored(G.fusion_distances(large, unit)), unit, k, far=1.0))


def joint_features(blocks: DataFrame, unit: Sequence[str], side: str, method: str) -> DataFrame:
    """Features of a method made for both sides of a unit together, standardised on each side: side, sample, features, err.

    A unit that fails is one row with its message and no features.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            sides = sorted(pdf[side].unique())
            if len(sides) != 2:
                raise ValueError(f"needs two sides, has {len(sides)}")
            held = [layers_of(pdf[pdf[side] == s]) for s in sides]
            joint = METHODS[method]([np.vstack(p) for p in zip(*(xs for _, xs in held), strict=True)])
            cut = len(held[0][0])
            parts = [pd.DataFrame({side: s, "sample": samples, "features": K.standardised(f).tolist(), "err": None}) for s, (samples, _), f in zip(sides, held, (joint[:cut], joint[cut:]), strict=True)]
            return pd.concat(parts)
        except Exception as e:  # a failed unit is a record, not the end of the benchmark
            return pd.DataFrame([{side: None, "sample": None, "features": None, "err": str(e)[:70]}])

    return grouped(blocks, unit, run, f"{side} {blocks.schema[side].dataType.simpleString()}, sample long, features array<double>, err string")


def transfers(blocks: DataFrame, unit: Sequence[str], side: str, methods: Sequence[str], ks: tuple[int, ...] = (3, 4, 5), seed: int = 49, reference: str = "fixed", starts: int = 20, steps: int = 50, least_samples: int = 1, least_features: int = 1) -> DataFrame:
    """Centroids learned on the first side assign the second; ARI with a reference partition of the second.

    ``reference``: ``fixed`` clusters the standardised data, once whatever the
    methods; ``self`` clusters each method's own features. All models (unit,
    method, side, k, start) are fitted together, and no task holds a unit but where
    a method's features are made (``kmeans`` has none). A unit without two sides,
    with fewer complete samples on a side or features in a layer than the least, or
    whose features fail, is a record with a message; nothing of it is fitted.
    """
    own, tagged = list(unit), [*unit, "method"]
    plain = C.standard_points(blocks, [*own, side])
    plain = C.stored(plain)
    held = plain.groupBy(*own, side).agg(F.count("*").alias("_n")).groupBy(*own).agg(F.min("_n").alias("_n"), F.count("*").alias("_sides"))
    sides = blocks.groupBy(*own).agg(F.array_sort(F.collect_set(side)).alias("_s"), F.min(F.size("features")).alias("_f")).join(held, own, "left")
    few = F.when(F.size("_s") != 2, F.concat(F.lit("needs two sides, has "), F.size("_s").cast("string")))
    few = few.when(F.coalesce("_sides", F.lit(0)) < 2, "a side has no complete sample").when(F.col("_n") < least_samples, F.concat(F.lit("fewer complete samples on a side than "), F.lit(str(least_samples))))
    sides = C.stored(sides.withColumn("_few", few.when(F.col("_f") < least_features, F.concat(F.lit("fewer features in a layer than "), F.lit(str(least_features))))))
    fair = sides.where("_few is null")
    blocks = blocks.join(fair.select(*own), own, "left_semi")
    made = [joint_features(blocks, unit, side, m).withColumn("method", F.lit(m)) for m in methods if m != "kmeans"]
    made = C.stored(reduce(DataFrame.unionByName, made)) if made else None
    points = [plain.withColumn("method", F.lit("kmeans"))] if "kmeans" in methods else []
    points += [made.where("err is null").drop("err")] if made is not None else []
    points = reduce(DataFrame.unionByName, points)
    of = lambda rows, i: rows.join(fair.select(*own, F.col("_s")[i].alias(side)), [*own, side], "left_semi")
    first, second = of(points, 0), of(points, 1)
    # one fit for all: the reference partitions are models of their own, of no method where they are the same for all
    base = of(plain.withColumn("method", F.lit("")), 1) if reference == "fixed" else second
    on = own if reference == "fixed" else tagged
    role = lambda rows, r: rows.select(*tagged, F.lit(r).alias("_role"), "sample", "features")
    fitted = C.fit(role(first, "first").unionByName(role(base, "reference")), [*tagged, "_role"], ks, starts, seed, steps)
    given = C.stored(C.assigned(second, fitted.where("_role = 'first'"), tagged).select(*tagged, "k", "sample", F.col("label").alias("given")))
    wanted = C.assigned(base, fitted.where("_role = 'reference'"), on).select(*on, "k", "sample", F.col("label").alias("wanted"))
    both = given.join(wanted, [*on, "k", "sample"])
    score = T.adjusted_rand(both, "given", "wanted", [*tagged, "k"]).select(*tagged, "k", F.round("ari", 4).alias("ari"))
    balance = T.cluster_balance(given, "given", [*tagged, "k"]).select(*tagged, "k", (F.col("n_clusters") < 2).cast("int").alias("degen_labels"), F.round("max_fraction", 4).alias("max_fraction"))
    count = lambda rows, name: rows.groupBy(*tagged).agg(F.count("*").cast("int").alias(name))
    grid = sides.select(*own, F.explode(F.array(*map(F.lit, methods))).alias("method"), "_few").select(*tagged, F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"), "_few")
    for part, keys in ((score, [*tagged, "k"]), (balance, [*tagged, "k"]), (count(first, "n_a"), tagged), (count(second, "n_b"), tagged)):
        grid = grid.join(part, keys, "left")
    grid = grid.withColumn("_err", F.lit(None).cast("string")) if made is None else grid.join(made.where("err is not null").select(*tagged, F.col("err").alias("_err")), tagged, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.select(*tagged, "k", "ari", "degen_labels", "max_fraction", zero("n_a"), zero("n_b"), F.coalesce("_few", "_err").alias("err"))


def transfer(blocks: DataFrame, unit: Sequence[str], side: str, method: str, ks: tuple[int, ...] = (3, 4, 5), seed: int = 49, reference: str = "fixed", starts: int = 20, steps: int = 50) -> DataFrame:
    """``transfers`` of one method."""
    return transfers(blocks, unit, side, [method], ks, seed, reference, starts, steps).drop("method")


def bootstrap_labels(blocks: DataFrame, unit: Sequence[str], method: str, k: int, replicates: int = 12, seed: int = 49) -> DataFrame:
    """Labels of bootstrap draws without repeats; draws with fewer than 3 k samples are left out. A replicate of a unit is a group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        samples, xs = layers_of(pdf)
        none, r = pd.DataFrame({"sample": [], "label": []}), key[-1]
        at = np.unique(np.random.default_rng([seed, r]).integers(len(samples), size=len(samples)))
        if len(at) < 3 * k:
            return none
        label, _ = K.kmeans(K.standardised(METHODS[method]([x[at] for x in xs])), k, seed + r, starts=5)
        return pd.DataFrame({"sample": samples[at], "label": label.astype(int)}) if len(np.unique(label)) > 1 else none

    return grouped(shared_out(blocks, unit, "replicate", replicates), [*unit, "replicate"], run, "sample long, label int")


def cross_validated_auc(blocks: DataFrame, unit: Sequence[str], target: str, model: str = "logistic") -> DataFrame:
    """Out-of-fold AUC of a binary target from the features of each unit."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x, y = K.standardised(np.array(pdf["features"].tolist(), dtype=float)), pdf[target].to_numpy()
        score = K.out_of_fold(x, y, K.logistic if model == "logistic" else K.linear_svm)
        v = K.auc(score, y)
        return pd.DataFrame([{"n": len(y), "auc": round(v, 4), "auc_fixed": round(max(v, 1 - v), 4)}])

    return grouped(blocks, unit, run, "n int, auc double, auc_fixed double")


def cross_batch_accuracy(blocks: DataFrame, unit: Sequence[str], batch: str, target: str) -> DataFrame:
    """Accuracy on one batch of a model fitted on the other, both ways and their mean."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x, y, b = K.standardised(np.array(pdf["features"].tolist(), dtype=float)), pdf[target].to_numpy(), pdf[batch].to_numpy()
        out = []
        for train, test in ((0, 1), (1, 0)):
            w = K.logistic(x[b == train], y[b == train])
            out.append(float((((x[b == test] @ w[:-1] + w[-1]) > 0) == (y[b == test] > 0)).mean()))
        return pd.DataFrame([{"acc_01": round(out[0], 4), "acc_10": round(out[1], 4), "acc_mean": round(sum(out) / 2, 4)}])

    return grouped(blocks, unit, run, "acc_01 double, acc_10 double, acc_mean double")


def component_sweep(blocks: DataFrame, unit: Sequence[str], target: str, drops: tuple[int, ...] = (0, 1, 2, 5, 10), keep: int = 30) -> DataFrame:
    """AUC of a target from component scores after the first few are dropped, and of each of the first components."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        y = pdf[target].to_numpy()
        scores = K.pca(K.standardised(np.array(pdf["features"].tolist(), dtype=float)), keep)[0]
        rows = [{"kind": "dropped", "k": d, "auc_fixed": K.auc(K.out_of_fold(scores[:, d:], y, K.logistic), y)} for d in drops if d < scores.shape[1]]
        rows += [{"kind": "single", "k": i + 1, "auc_fixed": K.auc(scores[:, i], y)} for i in range(min(5, scores.shape[1]))]
        out = pd.DataFrame(rows)
        out["auc_fixed"] = np.maximum(out["auc_fixed"], 1 - out["auc_fixed"]).round(4)
        return out

    return grouped(blocks, unit, run, "kind string, k int, auc_fixed double")


def ranked_components(blocks: DataFrame, unit: Sequence[str], covariate: str, keep: int = 20) -> DataFrame:
    """Principal components ranked by the size of their correlation with a covariate, the largest first."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[covariate]).sort_values("sample")
        scores, y = K.pca(K.standardised(np.array(pdf["features"].tolist(), dtype=float)), keep)[0], pdf[covariate].to_numpy(dtype=float)
        r = np.array([np.corrcoef(s, y)[0, 1] for s in scores.T])
        order = np.argsort(-np.abs(r), kind="stable")
        return pd.DataFrame({"place": np.arange(1, len(r) + 1), "component": order + 1, "r": np.round(r[order], 4)})

    return grouped(blocks, unit, run, "place int, component int, r double")


#: Samples of a unit that one group corrects; larger units go through blocks of samples.
SAMPLES = 20_000


def harmony(blocks: DataFrame, unit: Sequence[str], batch: str) -> DataFrame:
    """Batch-corrected components of each unit: a group for each, and for large units passes over blocks of samples."""
    sizes = blocks.groupBy(*unit).agg(F.count("*").alias("_n"), F.max(F.size("features")).alias("_d"))
    large = sizes.where((F.col("_n") > SAMPLES) & (F.col("_n") >= F.col("_d"))).collect()
    apart, rest = [], blocks
    for r in large:
        own = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(r[c])) for c in unit])
        out = H.corrected(blocks.where(own), batch, k=50)
        apart.append(out.select(*[F.lit(r[c]).cast(blocks.schema[c].dataType).alias(c) for c in unit], "sample", "features"))
        rest = rest.where(~own)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        z = K.harmonised(np.array(pdf["features"].tolist(), dtype=float), pdf[batch].to_numpy(), k=50)
        return pd.DataFrame({"sample": pdf["sample"].to_numpy(), "features": np.round(z, 6).tolist()})

    return reduce(DataFrame.unionByName, apart, grouped(rest, unit, run, "sample long, features array<double>"))


def first_loading(blocks: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Loadings of the first component of each unit, sign fixed by their sum."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("sample")["features"].tolist(), dtype=float)
        v = K.pca(x, 1)[1][:, 0]
        return pd.DataFrame({"feature": np.arange(len(v)), "loading": v * (1 if v.sum() >= 0 else -1)})

    return grouped(blocks, unit, run, "feature long, loading double")


def resampled_ari(blocks: DataFrame, unit: Sequence[str], k: int, kind: str, draws: int = 50, seed: int = 49, together: int = 8) -> DataFrame:
    """Distributions of ARI: ``split`` (halves assign each other's samples) and ``bootstrap`` (two resamples
    compared on all rows); ``resampling.null_rand`` has random partitions.

    Some draws of a unit (``together``) are a group, whose models are fitted in common passes over the rows; a group is
    sent the unit's samples.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, xs = layers_of(pdf)
        x = np.hstack(xs)
        parts = []
        for r in range(key[-1] * together, min((key[-1] + 1) * together, draws)):
            rng = np.random.default_rng([seed, r])
            if kind == "split":
                order = rng.permutation(len(x))
                parts += order[: len(x) // 2], order[len(x) // 2 :]
            else:
                parts += [rng.integers(len(x), size=len(x)) for _ in range(2)]
        fits = K.kmeans_of_parts(x, parts, k, [seed + 1000 * (i % 2) for i in range(len(parts))], starts=3)
        labels = [K.distances2(x, c).argmin(axis=1) for c in fits]
        values = [K.ari(a, b) for a, b in zip(labels[::2], labels[1::2], strict=True)]
        return pd.DataFrame({"ari": values})

    values = grouped(shared_out(blocks, unit, "_draws", -(-draws // together)), [*unit, "_draws"], run, "ari double")
    q = F.percentile("ari", F.array(F.lit(0.95), F.lit(0.99)))
    out = values.groupBy(*unit).agg(F.count("*").cast("int").alias("draws"), F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("sd"), q.alias("_q"))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return out.select(*unit, "draws", r4("mean", "mean"), r4("sd", "sd"), r4(F.col("_q")[0], "q95"), r4(F.col("_q")[1], "q99"))


def power_curve(sd: float, deltas: tuple[float, ...], ns: tuple[int, ...], draws: int = 4000, seed: int = 49) -> list[tuple[float, int, float]]:
    """Share of simulated one-sided paired t tests that find each difference at each size."""
    from cohortlens.functions.distributions import t_ppf

    out = []
    for n in ns:
        rng, limit = np.random.default_rng([seed, n]), t_ppf(0.95, n - 1)
        noise = rng.normal(0, sd, size=(draws, n))
        mean, se = noise.mean(axis=1), noise.std(axis=1, ddof=1) / np.sqrt(n)
        out += [(d, n, round(float(((mean + d) / se > limit).mean()), 4)) for d in deltas]
    return out


def selection_bias(ks: tuple[int, ...]) -> list[tuple[int, float]]:
    """Expected largest of k standard normal values, by quadrature: what the best of k equal methods gains by chance."""
    x = np.linspace(-9, 9, 36_001)
    f = np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    c = np.r_[0.0, np.cumsum((f[1:] + f[:-1]) / 2) * (x[1] - x[0])]
    return [(k, float(np.sum(x * k * f * c ** (k - 1)) * (x[1] - x[0]))) for k in ks]
