"""Spelling variants: words one edit apart, found through a positional q-gram index with a count filter.

``vocabulary`` counts the words of texts, ``near_words`` finds every pair of
words that differ by one inserted, deleted or replaced code point, and
``variant_forms`` groups them: the form of a word is its most frequent near
word, where that is frequent enough; the root follows forms to the last.

A word of L code points has L - 1 positional 2-grams. One edit leaves at least
L - 3 of them at their places (replaced), or L - 2 of the shorter word's at the
same place or one further (inserted): the one-edit overlap bound. It also leaves
one half of the longer word whole, and with it all grams of that half. That
routes words: an index row for each half (length, which half, its letters), and
a probe row for each half of a partner that the word may have. A task holds the
postings of the other grams of the words of a key; for each probe it merges the
shortest postings of its grams at the places allowed with a heap, counts the long
ones by binary search, and keeps words that reach the bound; those are verified.

A key with many rows is dealt out as a grid of index and probe blocks; nothing
is capped. Words of fewer than six code points are refused: half a word then
takes the bound by itself.

Null, empty and letterless texts give no word; an id that is null counts as the
empty text; a repeated row counts again; ties go to the smallest word; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, written

#: Letters of a word, lower-cased in ASCII.
LETTERS = "a-z\\u00C0-\\u00FF"
#: Rows of a key that one task indexes, and that it probes with.
BLOCK = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: str = "text", least: int = 6) -> Column:
    """The maximal runs of letters of at least ``least`` code points, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def slipped(word: Column, doc_id: Column, every: int) -> Column:
    """The word, or for one in ``every`` (by the crc32 of id and word) the word without one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5, slip: int | None = None) -> DataFrame:
    """word, n: the words of all texts with at least so many code points and occurrences.

    ``slip``: one occurrence in so many loses a code point (a planted misspelling).
    Occurrences are counted in each task before they are shuffled.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs(text, least_length)).alias("word"))
    if slip:
        words = words.select(slipped(F.col("word"), F.col("doc_id"), slip).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def routes(word: str) -> list[tuple[int, int, str, int]]:
    """Keys (length, half, letters) and roles: 0 holds the word; 1 asks for words of its length, 2 for longer ones."""
    n, half, wide = len(word), len(word) // 2, (len(word) + 1) // 2
    own = [(n, 0, word[:half]), (n, 1, word[half:])]
    longer = [(n + 1, 0, word[:wide]), (n + 1, 1, word[wide - 1 :])]
    return [(*key, role) for key in own for role in (0, 1)] + [(*key, 2) for key in longer]


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` becomes ``b`` by exactly one replaced code point, or one more."""
    if len(a) == len(b):
        at = next((i for i in range(len(a)) if a[i] != b[i]), None)
        return at is not None and a[at + 1 :] == b[at + 1 :]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at:] == b[at + 1 :]


class Postings:
    """The words of one key by positional gram outside the half that they share, in the order of arrival."""

    def __init__(self, size: int, part: int) -> None:
        self.half = size // 2
        self.part, self.shared = part, (size - self.half if part else self.half) - 1
        self.words: list[tuple[str, int]] = []
        self.lists: dict[tuple[str, int], list[int]] = {}

    def add(self, word: str, n: int) -> None:
        at = len(self.words)
        self.words.append((word, n))
        for p in range(self.half) if self.part else range(self.half - 1, len(word) - 1):
            self.lists.setdefault((word[p : p + 2], p), []).append(at)

    def near(self, word: str, longer: bool) -> Iterator[tuple[str, int]]:
        """Held words one edit from ``word``: one code point longer, or of its length and smaller."""
        get, least = self.lists.get, len(word) - (2 if longer else 3) - self.shared
        places = range(self.half - 1, len(word) - 1) if not self.part else range(self.half - longer)
        if longer:
            held = [[x for d in (0, 1) if (x := get((word[p : p + 2], p + d)))] for p in places]
        else:
            held = [[x] if (x := get((word[p : p + 2], p))) else [] for p in places]
        if sum(map(bool, held)) < least:
            return
        held.sort(key=lambda lists: sum(map(len, lists)))
        # a word in `least` of the lists is in one of the shortest `few`: those are merged, the long ones are only looked into
        few = len(held) - least + 1
        for at, same in groupby(heapq.merge(*[x for lists in held[:few] for x in lists])):
            count = sum(1 for _ in same)
            for left, lists in zip(range(len(held) - few, 0, -1), held[few:], strict=True):
                if count >= least or count + left < least:
                    break
                count += any(x[i] == at for x in lists if (i := bisect_left(x, at)) < len(x))
            if count >= least and (longer or self.words[at][0] < word) and one_edit(word, self.words[at][0]):
                yield self.words[at]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: every ordered pair of words (column ``word``, distinct, with ``n``) one edit apart."""
    key = ["length", "part", "letters"]
    if words.where(F.char_length("word") < 6).limit(1).count():
        raise ValueError("words of fewer than six code points cannot be told apart by halves and 2-grams")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*to, w, n) for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True) for to in routes(w)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*key, "probe", "word", "n"])

    routed = written(map_batches(words.select("word", "n"), route, "length int, part int, letters string, probe int, word string, n long"), "routes")
    # keys with more than a block of rows: at most rows / block of them; the others stay whole
    large = routed.groupBy(*key).agg(F.count_if(F.col("probe") == 0).alias("held"), F.count_if(F.col("probe") > 0).alias("asked")).where((F.col("held") > block) | (F.col("asked") > 3 * block))
    across = lambda count, size: F.coalesce(F.ceil(F.col(count) / size).cast("int"), F.lit(1))
    grid = routed.join(large, key, "left").withColumns({"rows": across("held", block), "columns": across("asked", 3 * block)})
    own = lambda count: F.array(F.pmod(F.xxhash64("word"), F.greatest(F.col(count), F.lit(1))).cast("int"))
    every = lambda count: F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1)
    dealt = grid.withColumn("i", F.explode(F.when(F.col("probe") == 0, own("rows")).otherwise(every("rows")))).withColumn("j", F.explode(F.when(F.col("probe") == 0, every("columns")).otherwise(own("columns"))))
    blocks = [*key, "i", "j"]
    dealt = dealt.select(*blocks, "probe", "word", "n").repartition(*blocks).sortWithinPartitions(*blocks, "probe", "word")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, Postings(0, 0)
        for b in batches:
            word, near, n = [], [], []
            columns = [b[c].to_pylist() for c in (*blocks, "probe", "word", "n")]
            for *where, probe, w, k in zip(*columns, strict=True):
                if where != at:
                    at, index = where, Postings(where[0], where[1])
                if probe == 0:
                    index.add(w, k)
                elif index.words:
                    for other, m in index.near(w, probe == 2):
                        word += w, other
                        near += other, w
                        n += m, k
            if word:
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    found = map_batches(dealt, merge, "word string, near string, near_n long")
    # the same pair may meet at several keys
    return found.repartition("word").dropDuplicates()


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root for words that have a ``form``: each round goes twice as far.

    A form is at least ``ratio`` times as frequent, so chains are short and have no ring.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        roots = written(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = roots.join(onward, "root", "left")
        if not further.where("next is not null").limit(1).count():
            return roots
        roots = further.select("word", F.coalesce("next", "root").alias("root"))


def variant_forms(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (``word``, ``n``).

    ``form``: the near word of the largest n (ties: the smallest word) if that n
    is at least ``ratio`` times the word's own.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = written(words.select("word", "n"), "words")
    best = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = F.col("best.less") * -1 >= ratio * F.col("n")
    held = written(
        words.join(best, "word", "left").select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    roots = roots_of(held.where("form is not null"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_query(docs: DataFrame) -> DataFrame:
    """Forms of the words of whole texts, one occurrence in 199 misspelt."""
    return variant_forms(vocabulary(docs, slip=199))
