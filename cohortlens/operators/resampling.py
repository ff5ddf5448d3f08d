"""Resampled statistics of many units in shared passes: bootstrap intervals, permutation tests, null distributions.

No task or group holds a unit. A draw is arithmetic on a row, so that it does not
depend on partitions and other engines can repeat it:

- a bootstrap weight is the Poisson(1) quantile of a hash of row and draw;
- a permutation of the positions 0 to n - 1 is a swap-or-not shuffle: in each
  round a position and its mirror image about a key change places or stay, as a
  hashed bit of the larger one says. It is a bijection for every n, and needs
  nothing but the position and the keys of the draw.

Ranks come from ``rank.value_ranks`` (ranges of values, ties with the mean rank).
All sums of ranks are multiples of a quarter and exact in doubles up to 2^53.

``row`` identifies a row within its unit: a whole number, without repeats or
nulls. Rows without x or y (null, NaN) take no part; units without any have no
row. A statistic that is not defined (constant ranks) is null, in a draw it is
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cohortlens.operators.clustering import draw, stored
from cohortlens.operators.rank import ROWS_PER_RANGE, matched, ranged, value_ranks
from cohortlens.operators.scorers import rand_of_counts
from cohortlens.session import make_importable

ROUNDS = 48
PRIME = (1 << 31) - 1
#: Draws and rows of a group that counts pairs of labels.
DRAWS, SLICE = 100, 1 << 16


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def draw_column(row: Column, start: Column, step: int, seed: int) -> Column:
    """``clustering.draw`` as an expression: a number in [0, 1) from a 32-bit mix."""
    word = 1 << 32
    times = lambda x, by: ((F.shiftright(x, 16) * by) % 65536 * 65536 + x % 65536 * by) % word
    mix = lambda shift, by: lambda x: let(x.bitwiseXOR(F.shiftright(x, shift)), lambda v: times(v, by))
    x = let(F.pmod(row.cast("long"), F.lit(word)), lambda v: (times(v, 2654435761) + start.cast("long") * 40503 + (step * 9973 + seed * 65599)) % word)
    x = let(let(x, mix(16, 0x85EBCA6B)), mix(13, 0xC2B2AE35))
    return let(x, lambda v: v.bitwiseXOR(F.shiftright(v, 16)) / float(word))


def poisson_steps(most: int = 12) -> list[float]:
    """Distribution of a Poisson(1) number at 0, 1, ...: what a draw has to reach for the next weight."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append((out[-1] if out else 0.0) + term)
        term /= k + 1
    return out


def poisson(u: Column) -> Column:
    """The weight of a draw in [0, 1)."""
    edges = F.array(*map(F.lit, poisson_steps()))
    return let(u, lambda v: F.size(F.filter(edges, lambda e: v >= e)))


def keys_of(draws: int, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each draw and round of its shuffle the two numbers of its hash, and the place of its mirror."""
    u = np.stack([draw(np.arange(draws), 0, t, seed) for t in range(3 * rounds)], axis=1)
    return 1 + np.floor(u[:, 0::3] * (PRIME - 1)).astype(np.int64), np.floor(u[:, 1::3] * PRIME).astype(np.int64), u[:, 2::3]


def shuffled(place: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """draws x rows: where the shuffle of each draw puts a row's place of 0 to n - 1."""
    at = np.broadcast_to(place, (len(a), len(place)))
    for r in range(a.shape[1]):
        mirror = (np.floor(k[:, r, None] * n).astype(np.int64) + n - at) % n
        bit = (np.maximum(at, mirror) % PRIME * a[:, r, None] + b[:, r, None]) % PRIME % 2
        at = np.where(bit == 1, mirror, at)
    return at


def drawn(rows: DataFrame, draws: int, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Every row once for each draw, with ``_draw`` and ``_to``, the shuffled place of ``_p`` among ``_size``.

    Map only, in blocks of some 100,000 places; the keys follow from the seed in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = keys_of(draws, seed, rounds)
        for b in batches:
            for first in range(0, b.num_rows, 2000):
                part = b.slice(first, 2000)
                place, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_p", "_size"))
                step = max(1, 100_000 // max(part.num_rows, 1))
                for d in range(0, draws, step):
                    to = shuffled(place, n, *(x[d : d + step] for x in keys))
                    again = part.take(pa.array(np.tile(np.arange(part.num_rows), len(to))))
                    number = np.repeat(np.arange(d, d + len(to), dtype=np.int32), part.num_rows)
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(number), pa.array(to.ravel())], names=[*part.schema.names, "_draw", "_to"])

    make_importable(rows.sparkSession)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_draw", IntegerType()), StructField("_to", LongType())]))


def _held(pairs: DataFrame, by: Sequence[str], row: str, x: str, y: str) -> DataFrame:
    rows = pairs.select(*by, F.col(row).alias("_row"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return stored(rows.where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)"))


def _rho(by: Sequence[str], rows: DataFrame) -> DataFrame:
    """Rank correlation from weighted ranks (``_rx``, ``_ry``, ``_w``); weights add up to W, so ranks have the mean (W + 1) / 2."""
    w = F.col("_w").cast("double")
    sums = rows.groupBy(*by).agg(F.sum(w).alias("_n"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"), F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"))
    mean = F.col("_n") * ((F.col("_n") + 1) / 2) * ((F.col("_n") + 1) / 2)
    spread = (F.col("_xx") - mean) * (F.col("_yy") - mean)
    return sums.withColumn("_centre", mean).withColumn("_rho", F.when(spread > 0, (F.col("_xy") - mean) / F.sqrt(spread)))


def bootstrap_spearman(pairs: DataFrame, by: Sequence[str], row: str, x: str = "x", y: str = "y", draws: int = 2000, seed: int = 49, level: float = 0.95, range_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """n, spearman, ci_lo, ci_hi: rank correlation with its percentile interval over Poisson-weighted draws.

    A unit takes n x draws rows through three shuffles, keyed by unit, draw and range of values.
    """
    held = ranged(ranged(_held(pairs, by, row, x, y), by, "_x", "_bx", range_rows), by, "_y", "_by", range_rows)
    spread = stored(held).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))  # draw 0 is the data
    spread = spread.withColumn("_w", F.when(F.col("_draw") == 0, 1).otherwise(poisson(draw_column(F.col("_row"), F.col("_draw"), 0, seed)))).where("_w > 0")
    unit = [*by, "_draw"]
    both = spread
    for v, bucket, rank in (("_x", "_bx", "_rx"), ("_y", "_by", "_ry")):
        both = matched(both, value_ranks(spread, unit, v, rank, bucket, F.col("_w")).drop("_n"), [*unit, bucket, v])
    rho = _rho(unit, both)
    data = F.col("_draw") == 0
    tail = (1 - level) / 2
    ci = F.percentile(F.when(~data, F.col("_rho")), F.array(F.lit(tail), F.lit(1 - tail)))
    out = rho.groupBy(*by).agg(F.max(F.when(data, F.col("_n"))).cast("long").alias("n"), F.max(F.when(data, F.col("_rho"))).alias("spearman"), ci.alias("_ci"))
    return out.select(*by, "n", "spearman", F.col("_ci")[0].alias("ci_lo"), F.col("_ci")[1].alias("ci_hi"))


def positions(rows: DataFrame, by: Sequence[str], row: str, range_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``_p``: places 0 to n - 1 of a unit's rows in the order of ``row``, which does not repeat; ``_size``: n."""
    cut = ranged(rows, by, row, "_brow", range_rows)
    placed = matched(cut, value_ranks(cut, by, row, "_p", "_brow").drop("_n"), [*by, "_brow", row])
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    placed = matched(placed, sizes, list(by)) if by else placed.crossJoin(F.broadcast(sizes))  # one row
    return placed.withColumn("_p", (F.col("_p") - 1).cast("long")).drop("_brow")


def permutation_spearman(pairs: DataFrame, by: Sequence[str], row: str, x: str = "x", y: str = "y", draws: int = 500, seed: int = 49, range_rows: int = ROWS_PER_RANGE, rounds: int = ROUNDS) -> DataFrame:
    """n, spearman, perm_p: two-sided permutation p, (draws at least as far from 0 + 1) / (draws + 1).

    A shuffled place is a rank, but among ties: those places alone are looked up.
    """
    held = _held(pairs, by, row, x, y)
    for v, bucket, rank in (("_x", "_bx", "_rx"), ("_y", "_by", "_ry")):
        held = ranged(held, by, v, bucket, range_rows)
        ranks = value_ranks(held, by, v, rank, bucket)
        ties = ranks.where("_n > 1") if v == "_y" else None
        held = matched(held, ranks.drop("_n"), [*by, bucket, v]).drop(bucket)
    held = stored(positions(held.withColumn("_w", F.lit(1)), by, "_row", range_rows))
    start = (F.col("_ry") - (F.col("_n") + 1) / 2).cast("long")
    moved = ties.withColumn("_to", F.explode(F.sequence(start, start + F.col("_n") - 1))).select(*by, "_to", (F.col("_ry") - F.col("_to") - 1).alias("_off"))
    spread = drawn(held.select(*by, "_rx", "_p", "_size"), draws, seed, rounds)
    null = matched(spread, moved, [*by, "_to"], "left").groupBy(*by, "_draw").agg(F.sum(F.col("_rx") * (F.col("_to") + 1 + F.coalesce("_off", F.lit(0.0)))).alias("_s"))
    data = _rho(by, held)
    both = matched(null, data, list(by)) if by else null.crossJoin(F.broadcast(data))  # one row
    far = F.abs(F.col("_s") - F.col("_centre")) >= F.abs(F.col("_xy") - F.col("_centre"))
    return both.groupBy(*by, F.col("_n").cast("long").alias("n"), F.col("_rho").alias("spearman")).agg(((F.sum(far.cast("int")) + 1) / (draws + 1)).alias("perm_p")).select(*by, "n", "spearman", "perm_p")


def null_rand(labels: DataFrame, by: Sequence[str], sample: str = "sample", label: str = "label", draws: int = 3000, seed: int = 49, range_rows: int = ROWS_PER_RANGE, rounds: int = ROUNDS) -> DataFrame:
    """unit, _draw, ari: the labels against themselves in a random order, for each draw.

    The label at a shuffled place follows from the sizes of the labels (an array as
    long as there are labels). Some draws of a slice of a unit are a group, which
    gives the counts of its pairs of labels; no row is made for a row and draw.
    """
    rows = stored(positions(labels.select(*by, F.col(sample).alias("_row"), F.col(label).alias("_l")), by, "_row", range_rows))
    sizes = rows.groupBy(*by, "_l").agg(F.count("*").alias("_m")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_l", "_m"))).alias("_sizes"))
    codes = sizes.select(*by, F.col("_sizes")["_m"].alias("_ms"), F.posexplode("_sizes").alias("_code", "_s")).select(*by, "_ms", "_code", F.col("_s._l").alias("_l"))
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    names, chunks = list(by), -(-draws // DRAWS)

    def counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = key[len(names)].as_py() * DRAWS, None
        keys = [x[first : first + DRAWS] for x in keys_of(draws, seed, rounds)]
        for b in batches:
            place, n, code = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_p", "_size", "_code"))
            ends = np.cumsum(b.column("_ms")[0].as_py())
            many = len(ends)
            total = np.zeros((len(keys[0]), many * many), dtype=np.int64) if total is None else total
            for at in range(0, len(place), 2000):
                own = slice(at, at + 2000)
                other = np.searchsorted(ends, shuffled(place[own], n[own], *keys), side="right")
                cell = np.arange(len(total))[:, None] * many * many + code[own] * many + other
                total += np.bincount(cell.ravel(), minlength=total.size).reshape(total.shape)
        draw_, cell = np.nonzero(total)
        same = [pa.array([k.as_py()] * len(cell), k.type) for k in key[: len(names)]]
        found = [pa.array((draw_ + first).astype(np.int32)), pa.array((cell // many).astype(np.int32)), pa.array((cell % many).astype(np.int32)), pa.array(total[draw_, cell])]
        yield pa.RecordBatch.from_arrays([*same, *found], names=[*names, "_draw", "_l", "_o", "n"])

    make_importable(rows.sparkSession)
    held = matched(rows, codes, [*by, "_l"]).select(*by, "_p", "_size", "_code", "_ms", F.pmod("_p", F.ceil(F.col("_size") / SLICE)).alias("_slice"))
    spread = held.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(4 * chunks, *by, "_chunk", "_slice")
    parts = spread.groupBy(*by, "_chunk", "_slice").applyInArrow(counted, f"{kinds}_draw int, _l int, _o int, n long")
    counts = stored(parts.groupBy(*by, "_draw", "_l", "_o").agg(F.sum("n").alias("n")))
    return rand_of_counts(counts, "_l", "_o", [*by, "_draw"]).select(*by, "_draw", "ari")


def summary(values: DataFrame, by: Sequence[str], value: str = "ari") -> DataFrame:
    """draws, mean, sd and the upper quantiles of a statistic."""
    q = F.percentile(value, F.array(F.lit(0.95), F.lit(0.99)))
    out = values.groupBy(*by).agg(F.count(value).cast("int").alias("draws"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), q.alias("_q"))
    return out.select(*by, "draws", "mean", "sd", F.col("_q")[0].alias("q95"), F.col("_q")[1].alias("q99"))
