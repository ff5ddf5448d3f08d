"""Token counts by rank-synchronous array merging.

The vocabulary of a byte-pair model becomes arrays: symbols, and for every pair
of symbols whose concatenation is a piece its rank and the resulting symbol.
Words that a worker has not met yet are held as one ragged array of symbols; in
each round every sequence applies its pair of lowest rank (the leftmost one)
at the same time, until no sequence has a pair left. The surviving symbols are
the tokens; a character outside the vocabulary costs its UTF-8 bytes.

Words of a text are the runs "blanks, then no blanks": no piece of the
vocabulary crosses from a non-blank to a blank, so they merge independently.
This is verified when the vocabulary is read.

Defined cases: a null text counts as empty and has no tokens; a text of blanks
alone is one run; very long words (over ``LONG`` symbols) merge by a heap, which
gives the same tokens in n log n; repeated rows get equal counts; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches

BLANK = "▁"
LONG = 400
#: Words whose counts a worker remembers before it starts over.
REMEMBERED = 400_000
NONE = np.int64(1) << 40


def read_vocabulary(path: str) -> dict:
    """Arrays of a byte-pair model file: bounded by the file, some 32,000 pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.name != "identity" or spec.precompiled_charsmap or not spec.escape_whitespaces or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models with the identity normaliser and a blank in front are supported")
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("only byte-pair models with byte fallback and without user-defined or unused pieces are supported")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
        raise ValueError("a piece crosses a word boundary")
    symbols = {p: i for i, p in enumerate(pieces)}
    cost = [1] * len(symbols)
    for ch in sorted({c for p in pieces for c in p} - set(symbols)):
        symbols[ch] = len(symbols)
        cost.append(len(ch.encode()))
    unknown = len(symbols)  # then one symbol for each length in bytes
    cost += [1, 2, 3, 4]
    ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
    size, pairs = len(cost), []
    for piece, score in pieces.items():
        for at in range(1, len(piece)):
            left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
            if left is not None and right is not None:
                pairs.append((left * size + right, ranks[score], symbols[piece]))
    pairs.sort()
    keys, rank, made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    inner = {c for p in pieces if len(p) > 1 for c in p}
    return {"chars": {s: i for s, i in symbols.items() if len(s) == 1}, "unknown": unknown, "cost": np.array(cost, dtype=np.int64), "size": size, "keys": keys, "rank": rank, "made": made, "newline_alone": "\n" not in inner}


class Counter:
    """Counts tokens; keeps the counts of words met before."""

    def __init__(self, vocabulary: dict):
        self.v = vocabulary
        self.known: dict[str, int] = {}
        self.newline = 0
        if vocabulary["newline_alone"]:
            self.newline = int(self.merged(["\n"])[0])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.v["size"] + right
        at = np.minimum(np.searchsorted(self.v["keys"], key), len(self.v["keys"]) - 1)
        found = self.v["keys"][at] == key
        return np.where(found, self.v["rank"][at], NONE), self.v["made"][at]

    def symbols(self, word: str) -> list[int]:
        get, unknown = self.v["chars"].get, self.v["unknown"]
        return [s if (s := get(c)) is not None else unknown + len(c.encode("utf-8", "surrogatepass")) - 1 for c in word]

    def merged(self, words: list[str]) -> np.ndarray:
        """Token counts of the words, all of which merge in the same rounds."""
        out = np.zeros(len(words), dtype=np.int64)
        lists, owner = [], []
        for i, w in enumerate(words):
            s = self.symbols(w)
            if len(s) > LONG:
                out[i] = self.by_heap(s)
            elif s:
                lists.append(s)
                owner.append(i)
        if not lists:
            return out
        owner_a = np.array(owner)
        lengths = np.array([len(s) for s in lists])
        sym = np.fromiter((x for s in lists for x in s), dtype=np.int64, count=int(lengths.sum()))
        seq = np.repeat(np.arange(len(lists)), lengths)
        rank, made = self.pairs(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            spans = np.diff(np.r_[starts, len(sym)])
            if not live.all():  # sequences without a pair are finished
                ended = np.repeat(~live, spans)
                np.add.at(out, owner_a[seq[ended]], self.v["cost"][sym[ended]])
                keep = ~ended
                sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
                least, spans = least[live], spans[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, spans))
            at = at[np.r_[True, seq[at[1:]] != seq[at[:-1]]]]  # the leftmost of each sequence
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            rank[at] = NONE
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            at = at - np.arange(len(at))  # places after the removals
            touched = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            touched = touched[touched < len(sym) - 1]
            r, m = self.ranks(sym[touched], sym[touched + 1])
            same = seq[touched] == seq[touched + 1]
            rank[touched], made[touched] = np.where(same, r, NONE), m
            rank[-1] = NONE
        return out

    def pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            r, m = self.ranks(sym[:-1], sym[1:])
            rank[:-1], made[:-1] = np.where(seq[:-1] == seq[1:], r, NONE), m
        return rank, made

    def by_heap(self, s: list[int]) -> int:
        """The same merges for one long sequence, with a heap of pairs."""
        n, sym = len(s), list(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, made = self.pairs(np.array(s, dtype=np.int64), np.zeros(n, dtype=np.int64))
        heap = [(int(rank[i]), i, int(made[i]), s[i], s[i + 1]) for i in np.flatnonzero(rank < NONE)]
        heapq.heapify(heap)
        keys, size = self.v["keys"], self.v["size"]

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                key = sym[i] * size + sym[j]
                at = int(np.searchsorted(keys, key))
                if at < len(keys) and keys[at] == key:
                    heapq.heappush(heap, (int(self.v["rank"][at]), i, int(self.v["made"][at]), sym[i], sym[j]))

        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i] if sym[i] == left else -1
            if j < 0 or sym[j] != right:
                continue
            sym[i], sym[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return int(sum(self.v["cost"][x] for x in sym if x >= 0))

    def words(self, text: str) -> tuple[list[str], int]:
        """The words of a text, as keys of ``known``, and the tokens counted already."""
        if not text:
            return [], 0
        extra = 0
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", BLANK + text.replace(" ", BLANK))
        else:
            parts = (BLANK + text.replace(" ", " " + BLANK)).split(" ")
        if self.v["newline_alone"] and "\n" in text:
            extra = text.count("\n") * self.newline
            parts = [x for p in parts for x in (p.split("\n") if "\n" in p else (p,)) if x]
        return parts, extra

    def count(self, texts: Iterable[str | None]) -> list[int]:
        split = [self.words(t or "") for t in texts]
        new = list(set().union(*(w for w, _ in split)).difference(self.known)) if split else []
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*(w for w, _ in split)))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self.merged(part).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, w)) + extra for w, extra in split]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            n = pa.array(counter.count(b.column(2).to_pylist()), type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, counted, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
