"""Approximate nearest neighbours by largest inner product: stable projections, a kd-tree, a chi-square stop.

A vector x with norm at most M becomes (x, sqrt(M^2 - |x|^2)), a query (q, 0):
the squared distance is then |q|^2 + M^2 - 2 q.x, so the nearest has the largest
inner product. Both are projected to ``DIMENSIONS`` Gaussian (2-stable)
directions. For a pair at distance d the squared projected distance over d^2 is
chi-square with that many degrees of freedom.

The upper levels of a kd-tree over the projections, fitted on a bounded sample,
deal all rows to cells; a cell's lower levels are built where the cell is
searched. A query takes projected neighbours leaf by leaf, nearest leaf first,
verifies them on the original vectors and stops when the next leaf's projected
distance d' passes the test P(chi-square <= d'^2 / d_k^2) >= ``CONFIDENCE`` with
d_k the distance of its k-th best so far: anything not yet seen is then nearer
than d_k with a chance of at most 1 - ``CONFIDENCE``. First every query searches
its own cell; with the d_k found there it goes to the other cells that the test
does not rule out. Nothing else ends a search: no candidate is capped.

A cell with many rows (one vector may hold a third of all) and a cell that many
queries visit are dealt out as a grid of blocks. In a block equal vectors are
one point: of their ids only the k + 1 smallest can be among the k nearest.

Defined cases: vectors that are null, empty or zero, that hold a null, NaN or
infinity, or that have another length than most rows (ties: the longer) take no
part; nor do rows without an id. An id names one vector: of several rows with one
id the smallest vector counts. Ties go to the smaller id. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, written

#: Projected dimensions (an even number) and the chance with which a nearer neighbour is seen.
DIMENSIONS, CONFIDENCE = 10, 0.97
#: Rows that the upper levels are fitted on, at most; rows wanted in a cell; cells at most (larger tables get larger cells, in blocks).
SAMPLE, CELL, CELLS = 65_536, 16_384, 2_048
#: Rows and queries of a block, points of a leaf.
ROWS, QUERIES, LEAF = 32_768, 8_192, 128


def chi_square(x: float, m: int = DIMENSIONS) -> float:
    """P(chi-square with an even number ``m`` of degrees of freedom <= x)."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_bound(p: float, m: int = DIMENSIONS) -> float:
    """The x at which ``chi_square`` reaches ``p``: a test on the CDF is a bound on d'^2 / d_k^2."""
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def splits_of(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a kd-tree, in heap order: medians along the widest axis."""
    axis, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    held = {0: points}
    for node in range(len(axis)):
        own = held.pop(node)
        if len(own):
            axis[node] = np.ptp(own, axis=0).argmax()
            cut[node] = np.median(own[:, axis[node]])
        left = own[:, axis[node]] <= cut[node]
        held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
    return axis, cut


def cells_of(points: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > cut[node])
    return node - len(axis)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j, None]
        out += np.maximum(0, np.maximum(low[None, :, j] - x, x - high[None, :, j])) ** 2
    return out


def leaves_of(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Points by leaf of a kd-tree: halves along the widest axis down to ``size``."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        along = points[own, np.ptp(points[own], axis=0).argmax()]
        order = np.argpartition(along, len(own) // 2)
        todo += own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
    return out


class Searcher:
    """One block of rows as points of a kd-tree; equal vectors are one point with their smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors, projected = ids[order], vectors[order], projected[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
        start = np.flatnonzero(new)
        place = np.arange(len(ids)) - np.repeat(start, np.diff(np.r_[start, len(ids)]))
        few = place <= k
        self.ids, self.of = ids[few], (np.cumsum(new) - 1)[few]
        self.first = np.r_[np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]]), len(self.ids)]
        self.vectors, self.projected = vectors[start], projected[start]
        self.leaves = leaves_of(self.projected)
        self.low = np.array([self.projected[x].min(axis=0) for x in self.leaves])
        self.high = np.array([self.projected[x].max(axis=0) for x in self.leaves])

    def rows(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the points, and for each its place in ``points``."""
        count = self.first[points + 1] - self.first[points]
        of = np.repeat(np.arange(len(points)), count)
        return np.repeat(self.first[points] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(of)), of

    def nearest(self, ids: np.ndarray, queries: np.ndarray, projected: np.ndarray, reach: np.ndarray, known: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Score and row of the best k for each query (-inf: none).

        ``reach``: |q|^2 + M^2; ``known``: the k-th score elsewhere (-inf: none yet).
        """
        n = len(ids)
        best, row = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        away = box_distances(projected, self.low, self.high)
        turn = away.argsort(axis=1, kind="stable")
        kth = known - 1e-12 * reach  # scores found elsewhere are added in another order
        for step in range(len(self.leaves)):
            leaf = turn[:, step]
            # the slack keeps equal vectors, whose distance is 0 but for rounding
            limit = np.maximum(reach - 2 * kth, 0) * bound + 1e-9 * reach
            active = np.flatnonzero(away[np.arange(n), leaf] <= limit)
            if not len(active):
                break
            active = active[leaf[active].argsort(kind="stable")]
            for own in np.split(active, np.flatnonzero(np.diff(leaf[active])) + 1):
                points = self.leaves[leaf[own[0]]]
                at, of = self.rows(points)
                score = (queries[own] @ self.vectors[points].T)[:, of]
                gap = ((projected[own] ** 2).sum(axis=1)[:, None] - 2 * projected[own] @ self.projected[points].T + (self.projected[points] ** 2).sum(axis=1))[:, of]
                score[(gap > limit[own, None] + 1e-9 * reach[own, None]) | (score < kth[own, None]) | (self.ids[at][None, :] == ids[own, None])] = -np.inf
                some = np.flatnonzero(np.isfinite(score).any(axis=1))
                if not len(some):
                    continue
                own = own[some]
                both = np.c_[best[own], score[some]]
                rows = np.c_[row[own], np.broadcast_to(at, (len(own), len(at)))]
                named = np.where(rows < 0, np.iinfo(np.int64).max, self.ids[rows])
                order = np.lexsort((named, -both), axis=1)[:, :k]
                best[own], row[own] = np.take_along_axis(both, order, 1), np.take_along_axis(rows, order, 1)
                kth[own] = np.maximum(kth[own], best[own, -1])
        return best, row


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def prepared(table: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id, vector of the rows that take part, and the length of the vectors."""
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is above infinity
    own = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    own = own.where(F.col("vec_id").isNotNull() & F.forall("vector", sound) & F.exists("vector", lambda x: x != 0))
    length = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return own, 0
    own = own.where(F.size("vector") == length["n"])
    # only the ids are shuffled to see whether one repeats
    if own.groupBy("vec_id").count().where("count > 1").limit(1).count():
        own = own.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return own, length["n"]


def nearest(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 11, cell: int = CELL, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query among all other rows.

    ``is_query`` is a condition on column ``vec_id``.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    own, width = prepared(table, vec_id, vector)
    if not width:
        return spark.createDataFrame([], schema)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top = own.agg(F.count("*"), F.max(square)).first()
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(width + 1, DIMENSIONS))

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows as candidates, and as queries."""
        flat = x @ directions[:-1]
        lift = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
        return flat + lift[:, None] * directions[-1], flat

    depth = max(0, min(CELLS, math.ceil(n / cell)) - 1).bit_length()
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    axis, cut = splits_of(projected(_matrix(sample, width))[0], depth)
    del sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["vector"], width)
            as_row, as_query = projected(x)
            point = lambda p: pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], pa.array(cells_of(as_row, axis, cut).astype(np.int32)), pa.array(cells_of(as_query, axis, cut).astype(np.int32)), point(as_row), point(as_query)], names=["vec_id", "vector", "cell", "home", "point", "asked"])

    kind = own.schema["vector"].dataType.simpleString()
    placed = written(map_batches(own, place, f"vec_id long, vector {kind}, cell int, home int, point array<double>, asked array<double>"), "placed")
    ends = [f(F.col("point")[j]) for j in range(DIMENSIONS) for f in (F.min, F.max)]
    # a row for each cell, of which there is a bounded number
    cells = placed.groupBy("cell").agg(F.count("*"), *ends).collect()
    held = {r[0]: r[1] for r in cells}
    names, boxes = np.array([r[0] for r in cells]), np.array([r[2:] for r in cells], dtype=float)
    bound = chi_square_bound(CONFIDENCE)
    asking = placed.where(is_query).select("vec_id", "vector", "home", F.col("asked").alias("point"))

    def search(visits: DataFrame) -> DataFrame:
        """``visits``: queries with a ``cell`` to search and the ``known`` k-th score."""
        asked = dict(visits.groupBy("cell").count().collect())
        table = lambda counts, size: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, m in counts.items() for x in (int(c), math.ceil(m / size))]), F.col("cell")), F.lit(1)) if counts else F.lit(1)
        over = lambda counts, size: {c: m for c, m in counts.items() if m > size}  # noqa: E731  the others have one block
        across, down = table(over(held, rows), rows), table(over(asked, queries), queries)
        own_block = lambda m: F.pmod(F.xxhash64("vec_id"), m).cast("int")
        candidates = placed.join(F.broadcast(spark.createDataFrame([(int(c),) for c in asked], "cell int")), "cell", "left_semi")
        candidates = candidates.withColumn("i", own_block(across)).withColumn("j", F.explode(F.sequence(F.lit(0), down - 1))).select("cell", "i", "j", "vec_id", "vector", "point")
        visits = visits.withColumn("j", own_block(down)).withColumn("i", F.explode(F.sequence(F.lit(0), across - 1))).select(*[F.col(c).alias(f"q_{c}") for c in ("cell", "i", "j", "vec_id", "vector", "point", "known")])

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return empty
            one = lambda t, c: t[c].combine_chunks()
            index = Searcher(one(left, "vec_id").to_numpy(), _matrix(one(left, "vector"), width), _matrix(one(left, "point"), DIMENSIONS), k)
            ids, vectors, points = one(right, "q_vec_id").to_numpy(), _matrix(one(right, "q_vector"), width), _matrix(one(right, "q_point"), DIMENSIONS)
            known = one(right, "q_known").to_numpy(zero_copy_only=False)
            best, row = index.nearest(ids, vectors, points, (vectors * vectors).sum(axis=1) + top, known, k, bound)
            q, slot = np.nonzero(np.isfinite(best))
            found = row[q, slot]
            # products added in order: equal vectors get equal scores in every block
            score = np.concatenate([np.cumsum(vectors[q[a : a + 4096]] * index.vectors[index.of[found[a : a + 4096]]], axis=1)[:, -1] for a in range(0, len(q), 4096)] or [np.empty(0)])
            return pa.table({"query_id": ids[q], "vec_id": index.ids[found], "score": score})

        return candidates.groupBy("cell", "i", "j").cogroup(visits.groupBy("q_cell", "q_i", "q_j")).applyInArrow(block, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    near = written(search(asking.withColumns({"cell": F.col("home"), "known": F.lit(float("-inf"))})), "home")
    kth = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    asking = asking.join(kth, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other cell that the test does not rule out."""
        for b in batches:
            x, points = _matrix(b["vector"], width), _matrix(b["point"], DIMENSIONS)
            reach = (x * x).sum(axis=1) + top
            limit = np.maximum(reach - 2 * b["known"].to_numpy(), 0) * bound + 1e-9 * reach
            q, c = np.nonzero((box_distances(points, boxes[:, ::2], boxes[:, 1::2]) <= limit[:, None]) & (names[None, :] != b["home"].to_numpy()[:, None]))
            for a in range(0, len(q), 8192):
                rows = pa.array(q[a : a + 8192])
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(rows), b["vector"].take(rows), b["point"].take(rows), b["known"].take(rows), pa.array(names[c[a : a + 8192]].astype(np.int32))], names=["vec_id", "vector", "point", "known", "cell"])

    onward = written(map_batches(asking, visit, f"vec_id long, vector {kind}, point array<double>, known double, cell int"), "visits")
    found = near.unionByName(search(onward)) if len(cells) > 1 else near
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbour_query(table: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table, F.col("vec_id") % 20 == 0)
