"""k-means of many units at once: parallel oversampled seeding, then Lloyd sums for every model in one pass.

``points`` has one row for each sample: unit columns, ``sample`` (a whole number)
and ``features``. A model is a unit, a number of clusters and a start. All models
of as many units as fit in ``MODEL_BYTES`` are fitted together: every pass maps
over the points once, wherever they lie, and each task sends back sums whose size
depends on the models alone. No task or group holds a unit.

Seeding (k-means||): each start draws one point, then ``ROUNDS`` times every point
with a chance of ``OVERSAMPLE`` x (largest k) x its share of the squared distances;
the points drawn are weighted by the points nearest to them, and k of them are
chosen, the heaviest first and then those of the largest weighted distance to
the ones chosen. Draws are a hash of sample, start and round, so that a fit does
not depend on partitions and other engines can repeat it. Where a unit has fewer
distinct points than k, it has fewer clusters. Missing or non-finite features are
an error of the caller: ``standard_points`` turns them into 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.kernels import distances2
from cohortlens.operators.matrix import FLAT
from cohortlens.session import scratch

#: Centroids and candidates that one pass may carry.
MODEL_BYTES = 32 << 20
ROUNDS, OVERSAMPLE = 4, 2
_M32 = np.uint64(0xFFFFFFFF)


def draw(sample: np.ndarray, start: int, step: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each sample: a 32-bit mix of sample, start, round and seed."""
    with np.errstate(over="ignore"):
        x = (sample.astype(np.int64).astype(np.uint64) * np.uint64(2654435761) + np.uint64(start * 40503 + step * 9973 + seed * 65599)) & _M32
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x = ((x ^ (x >> np.uint64(shift))) * np.uint64(by)) & _M32
        x ^= x >> np.uint64(16)
    return x.astype(np.float64) / 2**32


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: written into the shared folder and read again."""
    path = scratch(df.sparkSession, "clustering")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def standard_points(blocks: DataFrame, unit: Sequence[str]) -> DataFrame:
    """unit, sample, features: every layer of a unit standardised, of the samples that have all of its layers, side by side in the order of layers.

    Missing values and flat features become 0; of rows that repeat (unit, layer, sample) the smallest counts.
    """
    rows = blocks.groupBy(*unit, "layer", "sample").agg(F.min("features").alias("features"))
    layers = rows.groupBy(*unit).agg(F.countDistinct("layer").alias("_layers"))
    whole = rows.groupBy(*unit, "sample").agg(F.count("*").alias("_held")).join(layers, list(unit)).where("_held = _layers").select(*unit, "sample")
    rows = rows.join(whole, [*unit, "sample"], "left_semi")
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    moments = rows.select(*unit, "layer", F.posexplode("features").alias("pos", "x")).groupBy(*unit, "layer", "pos").agg(F.avg(finite).alias("m"), F.stddev_pop(finite).alias("s"))
    scale = moments.groupBy(*unit, "layer").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("m", F.lit(0.0)).alias("m"), F.when(F.col("s") > FLAT, F.col("s")).otherwise(1.0).alias("s")))).alias("_scale"))

    def z(x, p):
        v = (x - p["m"]) / p["s"]
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    scaled = rows.join(scale, [*unit, "layer"]).select(*unit, "layer", "sample", F.zip_with("features", "_scale", z).alias("z"))
    side_by_side = F.transform(F.array_sort(F.collect_list(F.struct("layer", "z"))), lambda s: s["z"])
    return scaled.groupBy(*unit, "sample").agg(F.flatten(side_by_side).alias("features"))


def add_up(points: DataFrame, first: int, last: int, work: Callable[[int, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """``work`` gives (part, array) for the rows of one unit at hand; the arrays of a unit and part are added up over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            u, sample = b["u"].to_numpy(), b["sample"].to_numpy()
            x, width = b["features"], np.diff(b["features"].offsets.to_numpy())
            flat, at = x.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(width)]
            for unit in np.unique(u):
                own = np.flatnonzero(u == unit)
                rows = np.stack([flat[at[i] : at[i + 1]] for i in own])
                for part, add in work(int(unit), sample[own], rows):
                    total[unit, part] = total[unit, part] + add if (unit, part) in total else add
        for (unit, part), t in total.items():
            held = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), unit, np.int32)), pa.array(np.full(len(held), part, np.int32)), pa.array(held.astype(np.int64)), pa.array(t[held])], names=["u", "part", "i", "x"])

    rows = points.where(F.col("u").between(first, last)).mapInArrow(run, "u int, part int, i long, x double").groupBy("u", "part", "i").agg(F.sum("x").alias("x")).toArrow()
    out: dict[tuple[int, int], np.ndarray] = {}
    u, part, i, x = (rows[c].to_numpy() for c in ("u", "part", "i", "x"))
    order = np.lexsort((i, part, u))
    edges = np.flatnonzero(np.r_[True, (np.diff(u[order]) != 0) | (np.diff(part[order]) != 0), True]) if len(u) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        t = np.zeros(int(i[own].max()) + 1)
        t[i[own]] = x[own]
        out[int(u[own[0]]), int(part[own[0]])] = t
    return out


def _drawn(points: DataFrame, first: int, last: int, chosen: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """Points that ``chosen`` picks for each start, by unit and start, in the order of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b["u"].to_numpy()
            for unit in np.unique(u):
                own = np.flatnonzero(u == unit)
                rows = b.take(pa.array(own))
                picked = chosen(int(unit), rows["sample"].to_numpy(), np.stack(rows["features"].to_pylist()))
                for start, at in enumerate(picked):
                    if len(at):
                        some = rows.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([some["u"], pa.array(np.full(len(at), start, np.int32)), some["sample"], some["features"]], names=["u", "start", "sample", "features"])

    rows = points.where(F.col("u").between(first, last)).mapInArrow(run, "u int, start int, sample long, features array<double>").orderBy("u", "start", "sample").collect()
    out: dict[tuple[int, int], list] = {}
    for r in rows:
        out.setdefault((r["u"], r["start"]), []).append(r["features"])
    return {k: np.array(v) for k, v in out.items()}


def _firsts(points: DataFrame, first: int, last: int, starts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """The first candidate of each unit and start: the point of the smallest draw (ties: the smaller sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, sample = b["u"].to_numpy(), b["sample"].to_numpy()
            for unit in np.unique(u):
                own = np.flatnonzero(u == unit)
                for start in range(starts):
                    drawn = draw(sample[own], start, 0, seed)
                    i = own[np.lexsort((sample[own], drawn))[0]]
                    yield pa.RecordBatch.from_arrays([b["u"].slice(i, 1), pa.array([start], pa.int32()), pa.array([drawn.min()]), b["sample"].slice(i, 1), b["features"].slice(i, 1)], names=["u", "start", "d", "sample", "features"])

    least = points.where(F.col("u").between(first, last)).mapInArrow(run, "u int, start int, d double, sample long, features array<double>")
    rows = least.groupBy("u", "start").agg(F.min_by("features", F.struct("d", "sample")).alias("features")).collect()
    return {(r["u"], r["start"]): np.array([r["features"]]) for r in rows}


def _candidates(points: DataFrame, first: int, last: int, most: int, starts: int, seed: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each unit and start the oversampled points and the number of points nearest to each."""
    held = _firsts(points, first, last, starts, seed)
    for step in range(1, ROUNDS + 1):
        def total(unit: int, sample: np.ndarray, x: np.ndarray, held=held) -> Iterator[tuple[int, np.ndarray]]:
            yield 0, np.array([distances2(x, held[unit, s]).min(axis=1).sum() for s in range(starts)])

        cost = add_up(points, first, last, total)

        def chosen(unit: int, sample: np.ndarray, x: np.ndarray, held=held, cost=cost, step=step) -> list[np.ndarray]:
            out = []
            for s in range(starts):
                t = cost.get((unit, 0), np.empty(0))
                all_of = t[s] if s < len(t) else 0.0
                far = distances2(x, held[unit, s]).min(axis=1)
                out.append(np.flatnonzero(draw(sample, s, step, seed) * all_of < OVERSAMPLE * most * far) if all_of > FLAT else np.empty(0, np.int64))
            return out

        for key, x in _drawn(points, first, last, chosen).items():
            held[key] = np.vstack([held[key], x])

    def nearest(unit: int, sample: np.ndarray, x: np.ndarray, held=held) -> Iterator[tuple[int, np.ndarray]]:
        for s in range(starts):
            yield s, np.bincount(distances2(x, held[unit, s]).argmin(axis=1), minlength=len(held[unit, s])).astype(float)

    weights = add_up(points, first, last, nearest)
    return {k: (x, np.pad(weights[k], (0, len(x) - len(weights[k])))) for k, x in held.items()}


def chosen_of(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the weighted candidates: the heaviest, then each time the largest weight times squared distance to those chosen."""
    at = [int(weight.argmax())]
    while len(at) < k:
        gain = weight * distances2(x, x[at]).min(axis=1)
        if gain.max() <= FLAT:
            break
        at.append(int(gain.argmax()))
    return x[at]


def fit(points: DataFrame, unit: Sequence[str], ks: Sequence[int], starts: int = 20, seed: int = 49, steps: int = 50, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """unit, k, cost, centroids: for each unit and k the start of the least sum of squared distances (ties: the first)."""
    spark = points.sparkSession
    sizes = points.groupBy(*unit).agg(F.max(F.size("features")).alias("_d")).orderBy(*unit).collect()
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in unit)
    schema = f"{kinds}, k int, cost double, centroids array<array<double>>"
    if not sizes:
        return spark.createDataFrame([], schema)
    named = [tuple(r[c] for c in unit) for r in sizes]
    numbers = spark.createDataFrame([(*key, i) for i, key in enumerate(named)], f"{kinds}, u int")
    numbered = stored(points.join(numbers, list(unit)).select("u", F.col("sample").cast("long").alias("sample"), "features"))
    each = [8 * r["_d"] * starts * max(sum(ks), ROUNDS * OVERSAMPLE * max(ks)) for r in sizes]
    out, a = scratch(spark, "models"), 0
    while a < len(sizes):
        b = a + 1
        while b < len(sizes) and sum(each[a : b + 1]) <= model_bytes:
            b += 1
        rows = [(*named[u], k, cost, c.tolist()) for (u, k), (cost, c) in _fit_units(numbered, a, b - 1, ks, starts, seed, steps).items()]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(out)
        a = b
    return spark.read.parquet(out)


def _fit_units(points: DataFrame, first: int, last: int, ks: Sequence[int], starts: int, seed: int, steps: int) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    seeds = _candidates(points, first, last, max(ks), starts, seed)
    models = {(u, j * starts + s): chosen_of(x, w, k) for (u, s), (x, w) in seeds.items() for j, k in enumerate(ks)}
    moving = set(models)
    for step in range(steps + 1):
        def sums(unit: int, sample: np.ndarray, x: np.ndarray, models=models, moving=frozenset(moving), costs=step == steps) -> Iterator[tuple[int, np.ndarray]]:
            for m in range(len(ks) * starts):
                if (unit, m) not in moving and not costs:
                    continue
                c = models[unit, m]
                gap = distances2(x, c)
                one = np.eye(len(c))[gap.argmin(axis=1)]
                # the cost of the last centroids, then for each cluster its count and sums
                yield m, np.r_[gap.min(axis=1).sum(), np.c_[one.sum(axis=0), one.T @ x].ravel()]

        if not moving and step < steps:
            continue
        added = add_up(points, first, last, sums)
        if step == steps:
            break
        moved = set()
        for key in moving:
            c = models[key]
            t = np.zeros(len(c) * (c.shape[1] + 1))
            t[: len(added[key]) - 1] = added[key][1:]
            t = t.reshape(len(c), -1)
            new = np.where(t[:, :1] > 0, t[:, 1:] / np.maximum(t[:, :1], 1), c)
            if not np.allclose(new, c, rtol=1e-9, atol=1e-12):
                moved.add(key)
            models[key] = new
        moving = moved
    best: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    for (u, m), c in sorted(models.items(), key=lambda x: x[0]):
        k, cost = ks[m // starts], float(added[u, m][0]) if (u, m) in added else 0.0
        if (u, k) not in best or cost < best[u, k][0] - 1e-9:
            best[u, k] = cost, c
    return best


def assigned(points: DataFrame, models: DataFrame, on: Sequence[str]) -> DataFrame:
    """``points`` with k and ``label``: the nearest centroid (ties: the smaller) of every model that shares the columns ``on``."""
    def gap(x, c):
        return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    both = points.join(models.select(*on, "k", "centroids"), list(on))
    near = F.transform("centroids", lambda c: gap(F.col("features"), c))
    return both.withColumn("_gaps", near).withColumn("label", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps", "centroids")
