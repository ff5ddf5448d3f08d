"""Language identification with string kernels.

Kernel: for each n of the blended spectrum (1, 2 and 3 by default) the presence
kernel, the number of n-grams two texts share over the root of the product of
their numbers of distinct n-grams; the mean over n. The alphabet holds every
letter of the fitted sample; letters that the sample has not are one symbol. Landmarks chosen among the
training pieces give the Nyström map, and one ridge regression against the rest
is solved for each language in it. Because a presence kernel is linear in the
presence vector, landmarks, map and ridge weights fold into one weight matrix
for each n, so that scoring is a batched matrix product.

Texts are read whole, in pieces of ``PIECE`` code points (the last one takes up
what is left); a document's decision values are the means over its pieces,
weighted by their letters.

The classifier is fitted on a bounded sample: about ``per_language`` training
rows of each of the ``max_languages`` languages with most rows, chosen by a hash
of the id, with up to ``per_row`` pieces each, spread over the text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
with no training rows at all every text is ``und``; training rows without a
language are not used; equal texts get equal predictions; ties between
languages go to the one that sorts first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, remainder

PIECE, ORDERS, DENSE = 1000, (1, 2, 3), 1 << 21


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, with one 0 for each run of anything else."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    gap = points == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return points[keep]


def pieces(points: np.ndarray) -> list[np.ndarray]:
    n = max(1, len(points) // PIECE)
    return [points[i * PIECE : (i + 1) * PIECE if i < n - 1 else len(points)] for i in range(n)]


def _all_codes(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """Codes of the n-grams of a piece, framed by a gap, one after the other."""
    framed = np.zeros(len(ids) + 2, dtype=np.int64)
    framed[1:-1] = ids
    code = framed[: len(framed) - n + 1].copy()
    for k in range(1, n):
        code = code * base + framed[k : len(framed) - n + 1 + k]
    return code


def _codes(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """Codes of the distinct n-grams of a piece, in order."""
    return np.unique(_all_codes(ids, n, base))


class Grams:
    """The columns of n-grams. Codes below ``DENSE`` are looked up in a table, others by bisection."""

    def __init__(self, codes: np.ndarray, n: int, base: int):
        self.codes, self.n, self.base, self.size = codes, n, base, len(codes)
        self.column = None
        if base**n <= DENSE:
            self.column = np.full(base**n, -1, dtype=np.int32)
            self.column[codes] = np.arange(len(codes))
            self.seen = np.zeros(base**n, dtype=np.int32)

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, int]:
        """The columns of a piece's n-grams that have one, and the number of its distinct n-grams."""
        if self.column is None:
            code = _codes(ids, self.n, self.base)
            at = np.minimum(np.searchsorted(self.codes, code), self.size - 1)
            return at[self.codes[at] == code], len(code)
        code = _all_codes(ids, self.n, self.base)
        own = np.arange(len(code), dtype=np.int32)
        self.seen[code] = own  # the last of equal codes stays, whatever stood there before
        at = self.column[code]
        return at[at >= 0], int(np.count_nonzero(self.seen[code] == own))


class Kernel:
    """The alphabet, the n-grams of the landmarks, and the folded weights."""

    def __init__(self, alphabet: np.ndarray):
        self.alphabet, self.base = alphabet, len(alphabet) + 2
        self.grams: list[Grams] = []
        self.weights: list[np.ndarray] = []
        self.names: list[str] = []

    def ids(self, points: np.ndarray) -> np.ndarray:
        """Code points to the alphabet: 0 a gap, the last one any letter outside it."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        out = np.where(self.alphabet[at] == points, at + 1, self.base - 1)
        out[points == 0] = 0
        return out

    def presence(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """For each n the pieces by landmark n-grams matrix of presence, over the root of all distinct n-grams of the piece."""
        out = [np.zeros((len(parts), g.size), dtype=np.float32) for g in self.grams]
        for row, points in enumerate(parts):
            ids = self.ids(points)
            for m, grams in zip(out, self.grams, strict=True):
                at, distinct = grams.place(ids)
                m[row, at] = 1 / np.sqrt(distinct)
        return out

    def decide(self, parts: list[np.ndarray]) -> np.ndarray:
        return sum(p @ w for p, w in zip(self.presence(parts), self.weights, strict=True))


def fit(samples: list[tuple[str, str]], landmarks: int = 160, ridge: float = 1e-3) -> Kernel | None:
    """Kernel ridge regression over (piece, language) pairs."""
    parts = [(folded(t), lang) for t, lang in samples]
    parts = [(p, lang) for p, lang in parts if (p > 0).any()]
    if not parts:
        return None
    names = sorted({lang for _, lang in parts})
    points = np.unique(np.concatenate([p for p, _ in parts]))
    kernel = Kernel(points[points > 0])
    by = {lang: [i for i, (_, x) in enumerate(parts) if x == lang] for lang in names}
    chosen = [i for lang in names for i in by[lang][: max(1, landmarks // len(names))]]
    held = [kernel.ids(parts[i][0]) for i in chosen]
    kernel.grams = [Grams(np.unique(np.concatenate([_codes(ids, n, kernel.base) for ids in held])), n, kernel.base) for n in ORDERS]
    marks = kernel.presence([parts[i][0] for i in chosen])
    gram = sum(m @ m.T for m in marks).astype(np.float64) / len(ORDERS)
    values, vectors = np.linalg.eigh(gram)
    use = values > 1e-6 * values.max()
    nystroem = vectors[:, use] / np.sqrt(values[use])
    phi = np.concatenate([sum(p @ m.T for p, m in zip(kernel.presence([x for x, _ in parts[at : at + 256]]), marks, strict=True)) for at in range(0, len(parts), 256)]).astype(np.float64) / len(ORDERS) @ nystroem
    # every language weighs the same, however many pieces it has
    weight = np.array([1 / len(by[lang]) for _, lang in parts])
    weight /= weight.sum()
    target = np.array([[1.0 if lang == x else -1.0 for x in names] for _, lang in parts])
    solved = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (target * weight[:, None]))
    dual = nystroem @ solved / len(ORDERS)
    kernel.weights = [(m.T @ dual).astype(np.float32) for m in marks]
    kernel.names = names
    return kernel


def sample_pieces(train: DataFrame, per_language: int, max_languages: int, per_row: int, text: str, lang: str, doc_id: str) -> list[tuple[str, str]]:
    """About ``per_language`` rows of each language, by a hash of the id, up to ``per_row`` pieces of each."""
    often = train.groupBy(F.col(lang).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages)
    counts = {r[0]: r[1] for r in often.collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    held = train.where(draw < share[F.col(lang).cast("string")])
    n = F.char_length(text)
    starts = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.floor(i * F.greatest(n - PIECE, F.lit(0)) / max(1, per_row - 1)) + 1)
    part = F.explode(F.array_distinct(F.transform(starts, lambda s: F.substring(F.col(text), s.cast("int"), F.lit(PIECE)))))
    rows = held.select(F.xxhash64(F.col(doc_id)).alias("_o"), F.col(lang).cast("string").alias("lang"), part.alias("part")).collect()
    return [(r["part"], r["lang"]) for r in sorted(rows, key=lambda r: (r["_o"], r["lang"], r["part"]))]


def identify(docs: DataFrame, is_training: Column, per_language: int = 400, max_languages: int = 256, per_row: int = 4, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Per document: id, ``lang_pred`` and ``score`` (0 to 1).

    ``lang`` and the id serve the choice of training rows only.
    """
    train = docs.where(is_training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample_pieces(train, per_language, max_languages, per_row, text, lang, doc_id)))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = shared.value
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            parts, owner = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if kernel and t and ((points := folded(t)) > 0).any():
                    for p in pieces(points):
                        parts.append(p)
                        owner.append(i)
            if parts:
                values = np.concatenate([kernel.decide(parts[at : at + 256]) for at in range(0, len(parts), 256)]).astype(np.float64)
                weight = np.array([np.count_nonzero(p) for p in parts], dtype=np.float64)
                total, mass = np.zeros((b.num_rows, len(kernel.names))), np.zeros(b.num_rows)
                np.add.at(total, owner, values * weight[:, None])
                np.add.at(mass, owner, weight)
                mean = total / np.maximum(mass, 1)[:, None]
                soft = np.exp(4 * (mean - mean.max(axis=1, keepdims=True)))
                soft /= soft.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(mass):
                    best = int(np.argmax(mean[i]))
                    langs[i], scores[i] = kernel.names[best], float(soft[i, best])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(source, predicted, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    """The contract: rows whose crc32(id) mod 4 is 2 are held out from training."""
    out = identify(docs, remainder(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
