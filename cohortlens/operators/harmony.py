"""Batch-corrected components of one large unit: ``kernels.harmonised`` in passes over blocks of samples.

The samples, in order, lie in blocks of a few thousand rows. A pass maps over the
blocks and sends back sums whose size depends on features, clusters and batches
alone; they are added in the order of the blocks. Draws are those of the kernel:
a draw falls into a block by the sums of the blocks, and then on a row of it. The
median is exact: bins around the middle are cut finer until few distances are left.
Results equal the kernel's but for the order in which sums are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.clustering import stored
from cohortlens.operators.kernels import distances2

#: Samples of a block; bins of a pass for the median, and distances that end them.
ROWS, BINS, FEW = 2048, 4096, 4096
_BLOCK = "part int, at int, sample binary, batch binary, x binary, most double"


def _row(part: int, at: int, sample: bytes, batch: bytes, x: np.ndarray, most: float = 0.0) -> pa.RecordBatch:
    ints = [pa.array([v], pa.int32()) for v in (part, at)]
    return pa.RecordBatch.from_arrays([*ints, *[pa.array([v], pa.binary()) for v in (sample, batch, np.ascontiguousarray(x).tobytes())], pa.array([most])], names=["part", "at", "sample", "batch", "x", "most"])


def _packed(rows: DataFrame, batch: str, codes: dict) -> DataFrame:
    """Blocks of samples in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                t = b.slice(start, ROWS)
                own = np.array([codes.get(v, -1) for v in t["b"].to_pylist()], np.int32)
                yield _row(part, at, t["sample"].to_numpy().astype(np.int64).tobytes(), own.tobytes(), np.array(t["features"].to_pylist(), dtype=np.float64))
                at += 1

    return stored(rows.select(F.col("sample").cast("long").alias("sample"), F.col(batch).alias("b"), "features").orderBy("sample").mapInArrow(run, _BLOCK))


def _mapped(blocks: DataFrame, width: int, work: Callable[[tuple, np.ndarray, np.ndarray], np.ndarray | None]) -> list[tuple[tuple, np.ndarray]]:
    """(block, array) in the order of blocks: ``work`` on (block, rows, batch codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                key = r["part"], r["at"]
                v = work(key, np.frombuffer(r["x"], np.float64).reshape(-1, width), np.frombuffer(r["batch"], np.int32))
                if v is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.asarray(v, np.float64).tobytes()], pa.binary())], names=["part", "at", "v"])

    rows = blocks.select("part", "at", "batch", "x").mapInArrow(run, "part int, at int, v binary").collect()
    return sorted([((r["part"], r["at"]), np.frombuffer(r["v"], np.float64)) for r in rows], key=lambda r: r[0])


def _sum(blocks: DataFrame, width: int, work: Callable) -> np.ndarray:
    return np.sum([v for _, v in _mapped(blocks, width, work)], axis=0)


def _changed(blocks: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]]) -> DataFrame:
    """The blocks with new rows, and the number that ``work`` gives with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, most = work(np.frombuffer(r["x"], np.float64).reshape(-1, width), np.frombuffer(r["batch"], np.int32))
                yield _row(r["part"], r["at"], r["sample"], r["batch"], x, most)

    return stored(blocks.mapInArrow(run, _BLOCK))


def _components(blocks: DataFrame, d: int, n: int, k: int) -> tuple[DataFrame, int]:
    """``pca`` of the ``standardised`` rows."""
    held = _sum(blocks, d, lambda _, x, b: np.r_[(~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0)]).reshape(2, d)
    with np.errstate(all="ignore"):
        mean = held[1] / held[0]
        sd = np.sqrt(_sum(blocks, d, lambda _, x, b: np.nansum((x - mean) ** 2, axis=0)) / held[0])
    sd = np.where(np.isfinite(mean) & np.isfinite(sd) & (sd > 1e-9), sd, 1.0)
    z = lambda x: np.nan_to_num((x - mean) / sd, nan=0.0, posinf=0.0, neginf=0.0)
    middle = _sum(blocks, d, lambda _, x, b: z(x).sum(axis=0)) / n
    values, v = np.linalg.eigh(_sum(blocks, d, lambda _, x, b: ((z(x) - middle).T @ (z(x) - middle)).ravel()).reshape(d, d))
    k = min(k, d, max(1, n - 1))
    v = v[:, ::-1][:, :k]

    def largest(_: tuple, x: np.ndarray, b: np.ndarray) -> np.ndarray:
        scores = (z(x) - middle) @ v
        return scores[np.abs(scores).argmax(axis=0), np.arange(k)]

    ends = np.array([s for _, s in _mapped(blocks, d, largest)])
    sign = np.sign(ends[np.abs(ends).argmax(axis=0), np.arange(k)])
    sign[sign == 0] = 1
    return _changed(blocks, d, lambda x, b: (((z(x) - middle) @ v) * sign, 0.0)), k


def _rows_at(blocks: DataFrame, width: int, keys: list[tuple], places: Callable[[int, np.ndarray], int]) -> list[np.ndarray]:
    """For each start the row of its block that ``places`` (start, rows) tells."""
    wanted: dict[tuple, list[int]] = {}
    for s, key in enumerate(keys):
        wanted.setdefault(key, []).append(s)
    found = {}
    for _, v in _mapped(blocks, width, lambda key, x, b: np.concatenate([np.r_[s, x[places(s, x)]] for s in wanted[key]]) if key in wanted else None):
        found |= {int(r[0]): r[1:] for r in v.reshape(-1, width + 1)}
    return [found[s] for s in range(len(keys))]


def _kmeans(blocks: DataFrame, width: int, sizes: dict[tuple, int], k: int, seed: int, starts: int, steps: int = 100) -> np.ndarray:
    """The centroids of ``kernels.kmeans``, those of its starts in the same passes."""
    keys, n = list(sizes), sum(sizes.values())
    before = dict(zip(keys, np.cumsum([0, *sizes.values()])[:-1].tolist(), strict=True))
    some = [v.reshape(-1, width) for _, v in _mapped(blocks, width, lambda _, x, b: np.unique(x, axis=0)[:k].ravel())]
    k = min(k, len(np.unique(np.vstack(some), axis=0)))
    rng, first, draws = np.random.default_rng(seed), [], []
    for _ in range(starts):
        first.append(int(rng.integers(n)))
        draws.append([rng.random() for _ in range(k - 1)])
    edges = np.cumsum(list(sizes.values()))
    own = [keys[int(np.searchsorted(edges, i, side="right"))] for i in first]
    local = [i - before[key] for i, key in zip(first, own, strict=True)]
    c = [x[None, :] for x in _rows_at(blocks, width, own, lambda s, x: local[s])]
    for j in range(k - 1):
        held = _mapped(blocks, width, lambda _, x, b, c=tuple(c): np.array([distances2(x, m).min(axis=1).sum() for m in c]))
        upto = np.cumsum([v for _, v in held], axis=0)
        own, rest = [], []
        for s in range(starts):
            target = draws[s][j] * upto[-1, s]
            at = min(int(np.searchsorted(upto[:, s], target, side="right")), len(held) - 1)
            own.append(held[at][0])
            rest.append(target - (upto[at - 1, s] if at else 0.0))

        def place(s: int, x: np.ndarray, c=tuple(c), rest=tuple(rest)) -> int:
            return min(int(np.searchsorted(distances2(x, c[s]).min(axis=1).cumsum(), rest[s], side="right")), len(x) - 1)

        c = [np.vstack([m, x]) for m, x in zip(c, _rows_at(blocks, width, own, place), strict=True)]
    moving = list(range(starts))
    for _ in range(steps):
        def sums(_: tuple, x: np.ndarray, b: np.ndarray, c=tuple(c), moving=tuple(moving)) -> np.ndarray:
            ones = (np.eye(k)[distances2(x, c[s]).argmin(axis=1)] for s in moving)
            return np.concatenate([np.c_[one.sum(axis=0), one.T @ x].ravel() for one in ones])

        total = _sum(blocks, width, sums).reshape(len(moving), k, width + 1)
        still = []
        for s, t in zip(moving, total, strict=True):
            new = np.where(t[:, :1] > 0, t[:, 1:] / np.maximum(t[:, :1], 1), c[s])
            if not np.allclose(new, c[s]):
                c[s] = new
                still.append(s)
        if not (moving := still):
            break

    def ends(key: tuple, x: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = []
        for m in c:
            d = distances2(x, m)
            label, seen = np.unique(d.argmin(axis=1), return_index=True)
            first = np.full(k, np.inf)
            first[label] = seen + before[key]
            out.append(np.r_[d.min(axis=1).sum(), first])
        return np.array(out)

    held = np.array([v.reshape(starts, k + 1) for _, v in _mapped(blocks, width, ends)])
    best, cost = 0, held[:, :, 0].sum(axis=0)
    for s in range(1, starts):
        best = s if cost[s] < cost[best] - 1e-12 else best
    seen = held[:, best, 1:].min(axis=0)
    order = np.argsort(seen)
    return c[best][order[np.isfinite(seen[order])]]


def _median(blocks: DataFrame, width: int, c: np.ndarray, n: int) -> float:
    """The median of all distances to the centroids."""
    total = n * len(c)
    places = (total - 1) // 2, total // 2
    top = max(v[0] for _, v in _mapped(blocks, width, lambda _, x, b: np.array([distances2(x, c).max()])))
    cuts: list[tuple[float, float, int, int]] = []
    low, step, below = 0.0, top / BINS, 0

    def within(x: np.ndarray) -> np.ndarray:
        d = distances2(x, c).ravel()
        for a, w, first, last in cuts:
            at = np.clip((d - a) / w, 0, BINS - 1).astype(np.int64)
            d = d[(at >= first) & (at <= last)]
        return d

    left = total
    while left > FEW and step > 1e-14 * top and len(cuts) < 5:
        n_bin = _sum(blocks, width, lambda _, x, b: np.bincount(np.clip((within(x) - low) / step, 0, BINS - 1).astype(np.int64), minlength=BINS))
        upto = below + np.cumsum(n_bin)
        first, last = (int(np.searchsorted(upto, p, side="right")) for p in places)
        below = int(upto[first] - n_bin[first])
        left = int(n_bin[first : last + 1].sum())
        cuts = [*cuts, (low, step, first, last)]
        low, step = low + first * step, (last + 1 - first) * step / BINS
    values: dict[float, int] = {}
    for _, v in _mapped(blocks, width, lambda _, x, b: np.stack(np.unique(within(x), return_counts=True))):
        for value, m in v.reshape(2, -1).T:
            values[value] = values.get(value, 0) + int(m)
    order = np.array(sorted(values))
    upto = below + np.cumsum([values[v] for v in order])
    return float(np.mean([order[np.searchsorted(upto, p, side="right")] for p in places]))


def corrected(rows: DataFrame, batch: str, k: int = 50, clusters: int = 5, steps: int = 10, seed: int = 49) -> DataFrame:
    """sample, features: ``kernels.harmonised`` of the rows, rounded to 6 places."""
    names = sorted(r[0] for r in rows.select(batch).distinct().collect() if r[0] is not None)
    blocks = _packed(rows, batch, {b: i for i, b in enumerate(names)})
    d = rows.select(F.size("features")).first()[0]
    sizes = {key: int(v[0]) for key, v in _mapped(blocks, d, lambda _, x, b: np.array([len(x)]))}
    n = sum(sizes.values())
    z, width = _components(blocks, d, n, k)
    z = z.persist()  # read by some hundred passes
    for _ in range(steps):
        c = _kmeans(z, width, sizes, clusters, seed, 3)
        scale = _median(z, width, c, n) or 1.0

        def shares(x: np.ndarray, c=c, scale=scale) -> np.ndarray:
            gap = distances2(x, c)
            r = np.exp(-(gap - gap.min(axis=1, keepdims=True)) / scale)
            return r / r.sum(axis=1, keepdims=True)

        def sums(_: tuple, x: np.ndarray, b: np.ndarray, shares=shares) -> np.ndarray:
            r = shares(x)
            return np.array([np.c_[r[b == i].sum(axis=0), r[b == i].T @ x[b == i]] for i in range(-1, len(names))])

        t = _sum(z, width, sums).reshape(len(names) + 1, len(c), width + 1)
        every = t.sum(axis=0)
        away = t[:, :, 1:] / np.maximum(t[:, :, :1], 1e-9) - every[:, 1:] / every[:, :1]
        away[0] = 0  # without a batch

        def moved(x: np.ndarray, b: np.ndarray, shares=shares, away=away) -> tuple[np.ndarray, float]:
            r, shift = shares(x), np.zeros_like(x)
            for i in range(len(names)):
                shift[b == i] = r[b == i] @ away[i + 1]
            return x - shift, float(np.abs(shift).max())

        old, z = z, _changed(z, width, moved).persist()
        old.unpersist()
        if z.agg(F.max("most")).first()[0] < 1e-4:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.round(np.frombuffer(r["x"], np.float64).reshape(-1, width), 6)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, x.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["sample"], np.int64)), lists], names=["sample", "features"])

    z.unpersist()
    return z.mapInArrow(run, "sample long, features array<double>")
