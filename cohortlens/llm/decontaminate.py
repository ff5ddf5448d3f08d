"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items feed one automaton. A document's words
are streamed through it, and at each word the length of the longest match that
ends there is known: a length of at least the window means that the last
``window`` words stand in some item. Items shorter than a window count as one
window of their own length. Words inside any such occurrence are hit.

The automaton is built for blocks of at most ``MAX_WORDS`` item words, so that
what is broadcast is bounded; a larger benchmark takes one pass over the
documents for each block, and the hits of the passes are united.

Defined cases: null and empty texts have no words and no hits; items without
words are never found; items that repeat count once for each distinct id; an
item with a null id can hit words but is not listed; repeated documents are
treated alike; extra columns are ignored (or pass through in
``remove_passages``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, raw_text, written

WINDOW = 10
#: Item words in one automaton: some 2 states a word, so about 100 MB of Python objects at most.
MAX_WORDS = 200_000
#: A-Z to a-z, and every ASCII byte that is neither a letter nor a digit to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton over word numbers; states carry the items they occur in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, set[int]] = {}
        texts = []
        for _, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            texts.append(ids)
            last = 0
            for c in ids:
                last = self.extend(last, c)
        self.items = [i for i, _ in items]
        self.found: list[set[int]] = [set() for _ in self.next]
        lengths = set()
        for k, ids in enumerate(texts):
            if not ids:
                continue
            if len(ids) < window:
                lengths.add(len(ids))
            at = 0
            for c in ids:
                at = self.next[at][c]
                s = at
                while s > 0 and k not in self.found[s]:  # every suffix of the prefix occurs in the item
                    self.found[s].add(k)
                    s = self.link[s]
            if len(ids) < window:  # the state that holds the whole item
                self.short.setdefault(at, set()).add(k)
        self.short_length = {k: len(ids) for k, ids in enumerate(texts) if 0 < len(ids) < window}
        self.least = min([window, *lengths])

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self.split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, c, q)
        return new

    def split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches of words, as (start, end) merged and in order, and the items found."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
        spans: list[list[int]] = []
        items: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for start, end in zip(known[::2], known[1::2], strict=True):
            if end - start < self.least:
                continue
            state = size = 0
            for at, c in enumerate(ids[start:end].tolist(), int(start)):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if (to := nxt[state].get(c)) is not None:
                    state, size = to, size + 1
                hit = 0
                if size >= window:
                    hit, s = window, state
                    while length[link[s]] >= window:
                        s = link[s]
                    items |= self.found[s]
                if self.short:
                    s = state
                    while s > 0:
                        for k in self.short.get(s, ()):
                            if (n := self.short_length[k]) <= size:
                                hit = max(hit, n)
                                items.add(k)
                        s = link[s]
                if hit:
                    if spans and spans[-1][1] >= at + 1 - hit:
                        spans[-1][0] = min(spans[-1][0], at + 1 - hit)
                        spans[-1][1] = at + 1
                        while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                            last = spans.pop()
                            spans[-1] = [min(spans[-1][0], last[0]), last[1]]
                    else:
                        spans.append([at + 1 - hit, at + 1])
        return [(a, b) for a, b in spans], items


def blocks_of(benchmark: DataFrame, window: int, text: str, item_id: str, max_words: int) -> Iterator[tuple[Automaton, bool]]:
    """One automaton after the other, each of at most ``max_words`` words (or one item), and whether it is the last."""
    held, n, ready = [], 0, None
    rows = benchmark.select(F.col(item_id).cast("string"), raw_text(text)).toLocalIterator()
    for item, raw in rows:
        words = words_of(bytes(raw)) if raw is not None else []
        if not words:
            continue
        if held and n + len(words) > max_words:
            if ready is not None:
                yield ready, False
            ready, held, n = Automaton(held, window), [], 0
        held.append((item, words))
        n += len(words)
    if ready is not None:
        yield ready, False
    yield Automaton(held, window), True


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


HITS = "n_words long, hit_at array<int>, hit_end array<int>, items array<string>"


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_text: str = "text", item_id: str = "item_id", max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` in a struct ``doc`` with, for each row, its words and its hit stretches."""
    spark = docs.sparkSession
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), raw_text(text).alias("raw"))
    held = held.select("doc", "raw", F.lit(0).cast("long").alias("n_words"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("hit_at", "int"), ("hit_end", "int"), ("items", "string"))])
    for automaton, last in blocks_of(benchmark, window, item_text, item_id, max_words):
        shared = spark.sparkContext.broadcast(automaton)

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                n, at, end, items = [], [], [], []
                for raw, x, y, z in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                    words = words_of(raw)
                    spans, hit = own.match(words)
                    if x:
                        spans = _union([*spans, *zip(x, y, strict=True)])
                    n.append(len(words))
                    at.append([a for a, _ in spans])
                    end.append([e for _, e in spans])
                    items.append(sorted({own.items[i] for i in hit if own.items[i] is not None} | set(z)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(end, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc", "raw", "n_words", "hit_at", "hit_end", "items"])

        held = map_batches(held, matched, held.schema)
        if not last:
            held = written(held, "decontaminate")
            shared.unpersist()
    return held


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: id, words, hit words, items found and their digest."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    n_hit = F.aggregate(F.zip_with("hit_end", "hit_at", lambda e, a: (e - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(F.col("doc.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_at") > 0).alias("contaminated"))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given stretches of words; white space at the seams becomes one line end."""
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"\n".join(x for x in (p.strip() for p in out) if x)


def remove_passages(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without benchmark passages.

    Stretches that reach the length limit (a window, or a whole shorter item)
    are cut out of the text, again and again until none is left; a document of
    which more than ``max_coverage`` of the words are hit goes altogether.
    Clean documents stay byte for byte.
    """
    spark, names = docs.sparkSession, docs.columns
    hits = with_hits(docs, benchmark, window, text, max_words=max_words)
    n_hit = F.aggregate(F.zip_with("hit_end", "hit_at", lambda e, a: (e - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    hits = hits.where(n_hit <= max_coverage * F.col("n_words")).select("doc", "raw", "hit_at", "hit_end", (F.size("hit_at") > 0).alias("touched"), F.lit(0).alias("cuts"))
    while True:  # one pass where one automaton holds the benchmark, else rounds of passes until one cuts nothing
        blocks = 0
        for automaton, last in blocks_of(benchmark, window, "text", "item_id", max_words):
            shared, blocks = spark.sparkContext.broadcast(automaton), blocks + 1

            def cleaned(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                own = shared.value
                for b in batches:
                    out, cuts = [], []
                    for raw, at, end, touched, n in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                        spans = list(zip(at, end, strict=True)) if at else own.match(words_of(raw))[0] if touched else []
                        while spans:
                            raw, n = cut(raw, spans), n + 1
                            spans = own.match(words_of(raw))[0]
                        out.append(raw)
                        cuts.append(n)
                    none = pa.array([[]] * b.num_rows, pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), none, none, b.column(4), pa.array(cuts, pa.int32())], names=["doc", "raw", "hit_at", "hit_end", "touched", "cuts"])

            hits = map_batches(hits, cleaned, hits.schema)
            if not last or blocks > 1:
                hits = written(hits, "decontaminate")
                shared.unpersist()
        if blocks == 1 or not hits.where("cuts > 0").take(1):
            break
        hits = hits.withColumn("cuts", F.lit(0))
    return hits.select(*[F.col("raw").cast("string").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in names])
