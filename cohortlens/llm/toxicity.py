"""Toxicity from the nearest labelled examples.

Texts become TF-IDF vectors over every word of the labelled examples, and over
those four- and five-letter beginnings of words that tell the labels apart. A
term's weight is (1 + log tf) * idf * (FLOOR + phi), where phi is the strength of
its association with the label (root of the log-likelihood ratio over twice the
examples, 0 where it is not significant). No term is left out: without phi the
neighbours are those of the topic, not of the label.

An example's neighbours are found by exact cosine with a block-max inverted
index: the postings of a term are held by blocks of examples with the largest
weight in each block, so that a block whose bound cannot beat the k-th
neighbour is never scored. The neighbours vote with weights that fall with
distance; leave-one-out votes of the examples calibrate the vote to a
probability (logistic). Neighbours and their cosines are the evidence.

The examples are a bounded sample (``max_examples``) of the training labels by
a hash of the id; document frequencies of all terms come from all documents.

Defined cases: null, empty and wordless texts, and those without a word of the
examples, have the zero vector; a zero vector has no neighbours and gets the
score of the calibrated prior; with no training labels, or labels of one kind
only, every score is the share of toxic examples (0 without any); of equal
cosines the example with the smaller place in the index wins; a document
labelled twice is two examples; equal texts get equal scores; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import map_batches, remainder

WORD = re.compile(r"[^\W_]+")
#: ASCII characters that are neither letters nor digits, to blanks.
GAPS = {c: " " for c in range(128) if not chr(c).isalnum()}
BLOCK = 32
#: Weight of a term that says nothing about the label, and the log-likelihood ratio below which it says nothing.
FLOOR, SIGNIFICANT = 0.006, 10.83
#: Blocks of the largest bounds that are scored before any is left out.
FIRST = 4


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case: runs of letters and digits."""
    if not text:
        return []
    low = text.lower()
    return low.translate(GAPS).split() if low.isascii() else WORD.findall(low)


def stems(word: str) -> list[str]:
    """The beginnings of a longer word."""
    return [word[:n] for n in (4, 5) if len(word) > n]


def stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several stretches of lengths ``n``."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


class BlockMaxIndex:
    """Unit vectors of examples as postings (example, term, weight), by term and block of examples."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        self.n, self.n_blocks = n, max(1, -(-n // BLOCK))
        block = self.example // BLOCK
        self.start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.empty(0, dtype=np.int64)
        self.size = np.diff(np.r_[self.start, len(term)])
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.weight, self.start) if len(term) else np.empty(0)
        self.first = np.searchsorted(term[self.start], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, and the cosines; ties go to the smaller number."""
        first = self.first[terms]
        n = self.first[terms + 1] - first
        entry, value = stretches(first, n), np.repeat(values, n)
        block = self.block[entry]
        bound = np.bincount(block, value * self.most[entry], minlength=self.n_blocks)
        scores = np.zeros(self.n)

        def add(chosen: np.ndarray) -> None:
            held = chosen[block]
            own, size = entry[held], self.size[entry[held]]
            at = stretches(self.start[own], size)
            scores[:] += np.bincount(self.example[at], self.weight[at] * np.repeat(value[held], size), minlength=self.n)
            if leave >= 0:
                scores[leave] = 0

        done = np.zeros(self.n_blocks, dtype=bool)
        done[np.argsort(-bound, kind="stable")[:FIRST]] = True
        add(done)
        least = np.partition(scores, self.n - k)[self.n - k] if self.n > k else 0.0
        rest = (bound >= max(least - 1e-9, 1e-12)) & ~done
        if rest.any():
            add(rest)
        scores = np.round(scores, 12)
        found = np.flatnonzero(scores >= max(np.partition(scores, self.n - k)[self.n - k] if self.n > k else 0.0, 1e-12))
        found = found[np.argsort(-scores[found], kind="stable")][:k]
        return found, scores[found]


def log_likelihood(a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of a term's document frequencies in the two classes."""
    total, n, out = a + b, n_toxic + n_clean, np.zeros(len(a))
    for own, row, column in ((a, n_toxic, total), (b, n_clean, total), (n_toxic - a, n_toxic, n - total), (n_clean - b, n_clean, n - total)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(own > 0, 2 * own * np.log(own * n / (row * column)), 0)
    return out


class Model:
    """Terms with their weights, the index and the calibration.

    ``example``, ``word`` (numbers into ``words``) and ``tf`` are the word counts of the examples.
    """

    def __init__(self, words: list[str], example: np.ndarray, word: np.ndarray, tf: np.ndarray, labels: list[int], shares: dict[int, float], k: int = 15):
        self.labels, self.k = np.array(labels, dtype=np.float64), k
        # the sample holds as many toxic rows as others where it can: each example stands for 1 / share rows
        self.stands = np.array([1 / shares[y] for y in labels])
        self.prior = float((self.labels * self.stands).sum() / self.stands.sum()) if len(labels) else 0.0
        self.slope, self.offset = 1.0, 0.0
        self.index: BlockMaxIndex | None = None
        self.number = {w: i for i, w in enumerate(words)}
        phi = self.association(example, word, len(words))
        # beginnings of words are terms where they tell the labels apart
        begins: dict[str, int] = {}
        of_word = [(i, begins.setdefault(s, len(begins))) for i, w in enumerate(words) for s in stems(w)]
        first = np.searchsorted(np.array([i for i, _ in of_word], dtype=np.int64), np.arange(len(words) + 1))
        numbers = np.array([s for _, s in of_word], dtype=np.int64)
        n = first[word + 1] - first[word]
        held = np.repeat(example, n) * max(1, len(begins)) + numbers[stretches(first[word], n)]
        held, where = np.unique(held, return_inverse=True)
        counts = np.bincount(where, np.repeat(tf, n), minlength=len(held)).astype(np.int64)
        owner, begin = held // max(1, len(begins)), held % max(1, len(begins))
        strength = self.association(owner, begin, len(begins))
        kept = np.flatnonzero(strength > 0)
        place = np.full(len(begins), -1)
        place[kept] = len(words) + np.arange(len(kept))
        self.stems = {s: int(place[i]) for s, i in begins.items() if place[i] >= 0}
        self.begins: dict[str, list[int]] = {}
        for i, b in of_word:
            if place[b] >= 0:
                self.begins.setdefault(words[i], []).append(int(place[b]))
        use = place[begin] >= 0
        self.counts = np.r_[example, owner[use]], np.r_[word, place[begin[use]]], np.r_[tf, counts[use]]
        self.phi = np.r_[phi, strength[kept]]
        self.weight = np.ones(len(self.phi))

    def association(self, example: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        toxic = self.labels[example] if len(example) else np.empty(0)
        n_toxic = int(self.labels.sum())
        ratio = log_likelihood(np.bincount(term, toxic, minlength=n), np.bincount(term, 1 - toxic, minlength=n), n_toxic, len(self.labels) - n_toxic)
        return np.sqrt(np.where(ratio > SIGNIFICANT, ratio, 0) / max(1, 2 * len(self.labels)))

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Fix the term weights by the document frequencies, build the index and calibrate."""
        self.weight = (np.log((n_docs + 1) / (df + 1)) + 1e-3) * (FLOOR + self.phi)
        example, term, tf = self.counts
        value = (1 + np.log(tf)) * self.weight[term]
        value /= np.sqrt(np.bincount(example, value * value, minlength=len(self.labels)))[example]
        # examples of the same label and strongest term stand together, so that blocks have tight bounds
        strongest = np.full(len(self.labels), -1)
        by_value = np.argsort(value, kind="stable")
        strongest[example[by_value]] = term[by_value]
        order = np.lexsort((np.arange(len(self.labels)), strongest, self.labels))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.labels, self.stands = self.labels[order], self.stands[order] / (self.stands.mean() if len(order) else 1)
        example, self.counts = place[example], None
        self.index = BlockMaxIndex(example, term, value, len(order), len(self.weight))
        if 0 < self.prior < 1:
            by_example = np.lexsort((term, example))
            term, value, cut = term[by_example], value[by_example], np.searchsorted(example[by_example], np.arange(len(order) + 1))
            self.calibrate(np.array([self.vote(term[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]], i)[0] for i in range(len(order))]))

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text in order, and how often each occurs."""
        words = Counter(words_of(text))
        terms = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        n = np.fromiter(words.values(), dtype=np.int64, count=len(words))
        more: dict[int, int] = {}
        for w in self.begins.keys() & words.keys():
            for s in self.begins[w]:
                more[s] = more.get(s, 0) + words[w]
        if self.stems:
            for w, t in zip(words, terms.tolist(), strict=True):
                if t < 0 and len(w) > 4:  # a word that no example has
                    if (s := self.stems.get(w[:4])) is not None:
                        more[s] = more.get(s, 0) + words[w]
                    if len(w) > 5 and (s := self.stems.get(w[:5])) is not None:
                        more[s] = more.get(s, 0) + words[w]
        known = terms >= 0
        terms, n = np.r_[terms[known], np.array([*more], dtype=np.int64)], np.r_[n[known], np.array([*more.values()], dtype=np.int64)]
        order = np.argsort(terms)
        return terms[order], n[order]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        terms, n = self.counted(text)
        value = (1 + np.log(n)) * self.weight[terms]
        return terms, value / max(math.sqrt(float(value @ value)), 1e-300)

    def vote(self, terms: np.ndarray, values: np.ndarray, leave: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of the neighbours' weighted votes, with one vote of the prior; the neighbours and cosines."""
        near, cosine = self.index.nearest(terms, values, self.k, leave)
        weight = cosine**3 * self.stands[near]
        p = (float(weight @ self.labels[near]) + 0.05 * self.prior) / (float(weight.sum()) + 0.05)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p)), near, cosine

    def calibrate(self, votes: np.ndarray) -> None:
        """Logistic regression of the label on the vote, by Newton's method."""
        x = np.c_[votes, np.ones(len(votes))]
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (self.stands * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (self.stands * (self.labels - p)) - 1e-3 * (w - [1, 0]))
            w = w + np.clip(step, -5, 5)
        self.slope, self.offset = max(float(w[0]), 1e-3), float(w[1])

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        if not 0 < self.prior < 1 or self.index is None:
            return self.prior, np.empty(0, dtype=np.int64), np.empty(0)
        vote, near, cosine = self.vote(*self.vector(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * vote + self.offset)))), near, cosine


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, max_examples: int, text: str, label: str, doc_id: str) -> Model:
    """The model: sample, words of the examples, frequencies of its terms over all documents."""
    train = labels.where(is_training & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    n = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
    share = {y: min(1.0, max_examples / 2 / c) for y, c in n.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = train.where(draw < F.when(F.col("_y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # bounded by max_examples
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(words_of(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array([[x[w] for w in sorted(x)] for x in found], pa.list_(pa.int32()))], names=["o", "y", "w", "n"])

    rows = map_batches(sample.select(F.xxhash64("_id").alias("o"), "_y", "_t"), counted, "o long, y int, w array<string>, n array<int>").toArrow()
    rows = rows.take(pa.array(sorted(range(rows.num_rows), key=lambda i, o=rows["o"].to_pylist(), y=rows["y"].to_pylist(): (o[i], y[i])), pa.int64())).combine_chunks()
    flat = rows["w"].combine_chunks().flatten().dictionary_encode()
    sizes = np.array([len(x) for x in rows["n"]], dtype=np.int64)
    tf = rows["n"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    model = Model(flat.dictionary.to_pylist(), np.repeat(np.arange(len(sizes)), sizes), word, tf, rows["y"].to_pylist(), share)
    if not 0 < model.prior < 1:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        df, n = np.zeros(len(own.weight) + 1, dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for t in b.column(0).to_pylist():
                df[own.counted(t)[0]] += 1
        df[-1] = n
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(df[met])], names=["i", "x"])

    # a row for each term that a partition holds; the last number stands for the documents
    total = map_batches(docs.select(F.col(text)), frequencies, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    df_all = np.zeros(len(model.weight) + 1)
    df_all[total["i"].to_numpy()] = total["x"].to_numpy()
    shared.unpersist()
    model.weigh(df_all[:-1], int(df_all[-1]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, is_training: Column, max_examples: int = 2000, text: str = "text", label: str = "toxic", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``evidence``: the neighbours' labels and cosines.

    Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, is_training, max_examples, text, label, doc_id))
    names = [c for c in docs.columns if c not in ("score", "predicted", "evidence")]
    source = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), F.col(text).alias("_t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores, near, cosines, size = [], [], [], [0]
            for t in b.column(1).to_pylist():
                score, found, cosine = model.score(t)
                scores.append(score)
                near.append(found)
                cosines.append(cosine)
                size.append(size[-1] + len(found))
            pairs = pa.StructArray.from_arrays([pa.array(model.labels[np.concatenate(near)].astype(np.int32)), pa.array(np.concatenate(cosines))], names=["label", "cosine"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pairs)], names=["doc", "score", "evidence"])

    schema = source.select("doc").schema.add("score", "double").add("evidence", T.ArrayType(T.StructType().add("label", "integer").add("cosine", "double")))
    out = map_batches(source, scored, schema)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in names], "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract: rows whose crc32(id) mod 5 is 0 are held out from training."""
    out = score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), remainder(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))
