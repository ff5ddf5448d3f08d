"""Mixing a corpus to target weights with soft domain membership.

A classifier fitted on the labelled table gives each document posteriors over
the domains. Expected domain totals are sums of rate x tokens x posterior.
Nonnegative rates are fitted by least squares on the miss of these totals, with
projected gradient from a rate of 1 for all: every step moves each rate against
the gradient of the miss and projects it onto rate >= 0. The gradient for a
document is its posterior times one vector of the step, so that a rate follows
from the posterior and the few vectors so far; rates are never collected, and no
state lives on executors. A step is scaled by the inverse Gram matrix of the
documents with a rate above 0; where that does not bring the miss down, it is
taken back, and the Gram matrix of all documents scales it, with which a step
always helps. Each task sends back its share of totals and Gram matrices.

Targets that no nonnegative rates reach end near the least miss, once a step
brings less than a ten-thousandth of it or after ``STEPS``. ``target_gap`` is the largest difference between a share reached and its target; ``strict`` makes
a gap above ``MET`` an error.

Domains are the values of a label (``quality``: 1 and 0) that have a target;
labelled rows with other values are left out.

The classifier is multinomial logistic regression on byte pairs of the whole
text (frequencies hashed to ``FEATURES`` columns, square roots) fitted on a
bounded sample of about ``max_examples`` labelled rows by a hash of the id.

Defined cases: null and empty texts have no tokens, the posterior of no
features and the rate that follows from it; without labelled rows the posterior is uniform;
a domain without mass cannot be met and its target is spread over the others;
rows that repeat are separate documents with equal rates; a row labelled twice
is two examples; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, raw_text, written
from cohortlens.llm.hashing import FOLD

TARGETS = {1: 0.7, 0: 0.3}
FEATURES, STEPS, TOLERANCE = 2048, 60, 1e-9
#: A target share counts as met within this.
MET = 1e-4
_FOLD = np.frombuffer(FOLD, dtype=np.uint8).astype(np.uint16)


def byte_pairs(raw: bytes | None) -> np.ndarray:
    """Root frequencies of the byte pairs of a whole text, hashed; at the end a constant."""
    out = np.zeros(FEATURES + 1)
    out[-1] = 1
    if raw and len(raw) > 1:
        x = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
        code = (x[:-1].astype(np.uint32) << np.uint32(8) | x[1:]) * np.uint32(2654435761) >> np.uint32(21)
        out[:FEATURES] = np.sqrt(np.bincount(code, minlength=FEATURES) / len(code))
    return out


def fit(x: np.ndarray, y: np.ndarray, k: int, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient descent."""
    w = v = np.zeros((x.shape[1], k))
    target, rate = np.eye(k)[y], 2.0 / (x**2).sum(axis=1).max()
    for i in range(steps):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - rate * (x.T @ ((p - target) * weight[:, None]) + ridge * v)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w


def domain_weights(docs: DataFrame, labels: DataFrame, domains: tuple[int, ...], label: str, max_examples: int, text: str, doc_id: str) -> np.ndarray:
    """The classifier's weights, from the labelled rows that are among ``docs``; other domains are left out."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col(label).cast("int")) - 1
    known = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), number.cast("int").alias("_y")).where("_y >= 0")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not counts:
        return np.zeros((FEATURES + 1, len(domains)))
    share = {y: min(1.0, max_examples / len(domains) / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit("mixing sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < F.create_map(*[F.lit(v) for y, s in sorted(share.items()) for v in (y, s)])[F.col("_y")])
    sample = docs.select(F.col(doc_id).alias("_id"), raw_text(text).alias("_raw")).join(F.broadcast(chosen), "_id")  # bounded by max_examples

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [byte_pairs(r).astype(np.float32).tobytes() for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["o", "y", "x"])

    rows = map_batches(sample.select(F.xxhash64("_id"), "_y", "_raw"), featured, "o long, y int, x binary").collect()
    if not rows:
        return np.zeros((FEATURES + 1, len(domains)))
    rows.sort(key=lambda r: (r["o"], r["y"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).astype(np.float64)
    y = np.array([r["y"] for r in rows])
    stands = np.array([1 / share[k] for k in y.tolist()])  # the sample holds small domains in full
    return fit(x, y, len(domains), stands / stands.sum())


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after the steps: from 1, each a move along the posterior and a projection onto >= 0."""
    rates = np.ones(len(p))
    for step in steps:
        rates = np.maximum(rates - p @ step, 0)
    return rates


def solve(table: DataFrame, targets: np.ndarray, steps: int = STEPS) -> tuple[list[np.ndarray], float]:
    """Projected gradient over rows (p: posteriors, n_tokens): the steps, and the gap of the shares reached to the targets."""
    k = len(targets)

    def totals(taken: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram matrices of all documents and of those with a rate, and the domain totals."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2 * k + 1, k))
            for b in batches:
                p, n = np.array(b.column(0).flatten()).reshape(-1, k), b.column(1).to_numpy(zero_copy_only=False)[:, None]
                rates = rates_of(p, taken)[:, None]
                out += np.concatenate([p.T @ (n * p), p.T @ (n * p * (rates > 0)), (n * rates * p).sum(axis=0)[None, :]])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["part"])

        # one row for each partition, summed by position before anything reaches the driver
        rows = map_batches(table.select("p", "n_tokens"), part, "part array<double>").select(F.posexplode("part").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros((2 * k + 1) * k)
        for r in rows:
            out[r["i"]] = r["x"]
        out = out.reshape(2 * k + 1, k)
        return out[:k], out[k : 2 * k], out[2 * k]

    taken: list[np.ndarray] = []
    every, live, now = totals(taken)
    if not every.sum():
        return taken, 0.0
    alive = np.diag(every) > 1e-12 * every.sum()
    want = np.where(alive, targets, 0.0)
    want = want / want.sum() * now.sum() if want.sum() else now
    safe = np.linalg.pinv(every, rcond=1e-10)
    miss = now - want
    loss, fast = float(miss @ safe @ miss), True
    for _ in range(steps):
        if np.abs(miss[alive]).max() <= TOLERANCE * max(want.sum(), 1.0):
            break
        step = np.zeros(k)
        step[alive] = np.linalg.lstsq((live if fast else every)[np.ix_(alive, alive)], miss[alive], rcond=1e-10)[0]
        _, then_live, then = totals([*taken, step])
        then_loss = float((then - want) @ safe @ (then - want))
        if fast and not then_loss < 0.9 * loss:
            fast = False
            continue
        done = not then_loss < (1 - 1e-4) * loss
        if then_loss < loss:
            taken.append(step)
            fast, live, now, miss, loss = not fast or then_loss < 0.5 * loss, then_live, then, then - want, then_loss
        if done:
            break
    return taken, float(np.abs(now / max(now.sum(), 1e-300) - want / want.sum())[alive].max()) if want.sum() else 0.0


def mix(docs: DataFrame, labels: DataFrame, targets: dict[int, float] | None = None, label: str = "quality", max_examples: int = 3000, text: str = "text", doc_id: str = "doc_id", strict: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``p_<domain>``, ``domain``, ``rate`` and ``target_gap``.

    The expected domain token totals at these rates match the targets, in shares
    of the tokens that ``docs`` hold.
    """
    domains, goal = tuple(targets or TARGETS), np.array([*(targets or TARGETS).values()], dtype=np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(domain_weights(docs, labels, domains, label, max_examples, text, doc_id))
    added = ["n_tokens", *(f"p_{d}" for d in domains), "domain", "rate", "target_gap"]
    names = [c for c in docs.columns if c not in added]
    source = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), raw_text(text).alias("raw"))

    def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            raws = b.column(1).to_pylist()
            z = np.stack([byte_pairs(r) for r in raws]) @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            tokens = [len((r or b"").split()) for r in raws]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc", "n_tokens", "p"])

    schema = source.select("doc", F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0.0)).alias("p")).schema
    judged = written(map_batches(source, posterior, schema), "posteriors")
    steps, gap = solve(judged, goal)
    if strict and gap > MET:
        raise ValueError(f"no nonnegative rates reach the targets: a share is off by {gap:.4f}")
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(rate - sum((F.col("p")[i] * float(v) for i, v in enumerate(step)), F.lit(0.0)), F.lit(0.0))
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int")
    return judged.select(*[F.col("doc").getField(c).alias(c) for c in names], "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), rate.alias("rate"), F.lit(gap).alias("target_gap"))


def mixing_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return out.drop("text")
