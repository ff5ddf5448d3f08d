"""Language-model scores with a log-frequency Bloom filter.

Counting: documents are packed into chunks of bounded size, and each chunk's
words become 64-bit hashes. A chunk sends, by ranges of the hash, its distinct
words and word pairs with their counts; each range is merged in one task. For
words the task answers every chunk with the exact counts of the words it asked
for. For pairs it builds its segment of the filter: a pair whose count has
level j (1 + floor(log2 count)) is entered under the labels 1 to j, so that its
level is found by probing label after label until one is missing; it answers
every chunk with the levels of the pairs it asked for.

Size: a segment lives only in the task of its range, so the filter grows with
the pairs and is never in one place. It keeps ``BITS`` bits for each entry and
has no cutoff: counting and the answers cover everything at every size.

Scoring: P(w | h) = (c(hw) + mu * p(w)) / (c(h) + mu), where c(hw) is the lower
end of the probed level, c(h) and p(w) = (c(w) + 1) / (N + V + 1) are exact. The
word before the first is the end of a document.

Defined cases: a null text is the empty one, whose only token is the end;
without training rows all counts are 0 and every score is 0; rows that repeat
count as often as they occur; a null id is held out as the empty text's
remainder decides; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, raw_text, remainder, written
from cohortlens.llm.hashing import mixed, word_hashes
from cohortlens.session import make_importable

END = np.uint64(0xE0D0C0B0A0908070)
BITS, PROBES, MAX_LEVEL = 12, 6, 40
CHUNK_BYTES, RANGE_BYTES = (3 << 20, 8 << 20), 12 << 20
#: Of 5 to 5000, 500 to 2000 do best on held-out text (log10 a token: -4.38 at 5, -3.98 at 500, -3.97 at 1000, -3.99 at 5000).
MU = 500.0


def pair_hashes(stream: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; the first follows an end."""
    with np.errstate(over="ignore"):
        before = np.r_[END, stream[:-1]]
        return mixed(mixed(before + np.uint64(1)) + stream)


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; sorted ones as differences."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel().astype(np.uint64)


def pack_levels(counts: np.ndarray) -> bytes:
    """The lower ends of levels, 0 for none, as compressed bytes."""
    levels = np.where(counts > 0, levels_of(counts), 0).astype(np.uint8)
    return pa.compress(levels.tobytes(), codec="zstd", asbytes=True)


def unpack_levels(blob: bytes, n: int) -> np.ndarray:
    levels = np.frombuffer(pa.decompress(blob, decompressed_size=n, codec="zstd", asbytes=True), dtype=np.uint8).astype(np.int64)
    return np.where(levels > 0, np.int64(1) << np.maximum(levels - 1, 0), 0)


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        steps = np.r_[keys[:1], keys[1:] - keys[:-1]]
    a, b = pack_numbers(steps), pack_numbers(counts)
    return len(keys).to_bytes(8, "little") + len(a).to_bytes(8, "little") + a + b


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    return np.cumsum(unpack_numbers(blob[16 : 16 + size], n), dtype=np.uint64), unpack_numbers(blob[16 + size :], n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def probe_places(hashes: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of a label of each pair in its segment."""
    with np.errstate(over="ignore"):
        x = mixed(hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        y = mixed(x) | np.uint64(1)
        for i in range(PROBES):
            yield (x + np.uint64(i) * y) % bits


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1).astype(np.float64))), MAX_LEVEL).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter segment for pair counts."""
    levels = levels_of(counts)
    n_bits = 8 * max(1, -(-int(levels.sum()) * BITS // 8))
    held = np.zeros(n_bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in probe_places(keys[levels >= level], level, np.uint64(n_bits)):
            held[place] = True
    return np.packbits(held, bitorder="little").tobytes()


class LogFrequencyFilter:
    """All segments, with the bits of each."""

    def __init__(self, segments: dict[int, bytes], n_ranges: int):
        sizes = np.array([len(segments.get(i, b"")) for i in range(n_ranges)], dtype=np.uint64)
        self.n_ranges, self.bits = n_ranges, sizes * np.uint64(8)
        self.start = np.r_[np.zeros(1, np.uint64), np.cumsum(self.bits)[:-1]].astype(np.uint64)
        self.held = np.frombuffer(b"".join(segments.get(i, b"") for i in range(n_ranges)), dtype=np.uint8)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The lower end of the level of each pair; 0 for those not held."""
        out = np.zeros(len(hashes), dtype=np.int64)
        at = np.arange(len(hashes))
        own = range_of(hashes, self.n_ranges).astype(np.int64)
        live = self.bits[own] > 0
        at, hashes, own = at[live], hashes[live], own[live]
        for level in range(1, MAX_LEVEL + 1):
            start, bits = self.start[own], self.bits[own]
            found = np.ones(len(at), dtype=bool)
            for place in probe_places(hashes, level, bits):
                bit = start + place
                found &= (self.held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, hashes, own = at[found], hashes[found], own[found]
            if not len(at):
                break
            out[at] = 1 << (level - 1)
        return out


def pack_documents(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of consecutive documents: chunk, ids, training flags, lengths and compressed texts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, train, texts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            blob = b"".join(t or b"" for t in texts)
            sizes = [len(t or b"") for t in texts]
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([ids], pa.list_(kind)), pa.array([train], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pa.compress(blob, codec="zstd", asbytes=True)], pa.binary())], names=["chunk", "ids", "train", "sizes", "texts"])

        for b in batches:
            kind = b.column(0).type
            for i, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                train.append(t)
                texts.append(x)
                held += len(x or b"")
                if held >= chunk_bytes:
                    yield row()
                    n, held = n + 1, 0
                    ids, train, texts = [], [], []
        if ids:
            yield row()

    return map_batches(docs, packed, f"chunk long, ids array<{id_type}>, train array<boolean>, sizes array<int>, texts binary")


def streams(sizes: list[int], texts: bytes) -> list[np.ndarray]:
    """For each document of a chunk its tokens, the end included."""
    blob, at, out = pa.decompress(texts, decompressed_size=sum(sizes), codec="zstd", asbytes=True), 0, []
    for n in sizes:
        out.append(np.r_[word_hashes(blob[at : at + n]), END])
        at += n
    return out


def asked(chunks: DataFrame, n_ranges: int) -> DataFrame:
    """Each chunk's distinct words and pairs (all, with training counts), by range."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, train, sizes, texts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                docs = streams(sizes, texts)
                taught = [d for d, t in zip(docs, train, strict=True) if t]
                known = np.concatenate(taught) if taught else np.empty(0, dtype=np.uint64)
                stream = np.concatenate(docs)
                ranges, kinds, blobs = [], [], []
                for kind, every, taught_keys in (("word", stream, known), ("pair", pair_hashes(stream), pair_hashes(known) if len(known) else known)):
                    keys = np.unique(every)
                    counts = np.zeros(len(keys), dtype=np.uint64)
                    found, n = np.unique(taught_keys, return_counts=True)
                    counts[np.searchsorted(keys, found)] = n.astype(np.uint64)
                    own = range_of(keys, n_ranges)
                    cuts = np.searchsorted(own, np.arange(n_ranges + 1, dtype=np.uint64))
                    for r in range(n_ranges):
                        if cuts[r] < cuts[r + 1]:
                            ranges.append(r)
                            kinds.append(kind)
                            blobs.append(pack_counts(keys[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(kinds), pa.array([chunk] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())], names=["range", "kind", "chunk", "blob"])

    return map_batches(chunks, parts, "range int, kind string, chunk long, blob binary")


ANSWER = "kind string, chunk long, range int, blob binary, n long, v long"


def merged(table: pa.Table) -> pa.Table:
    """One range: the word counts and the pair levels that each chunk asked for, and the range's totals."""
    r = table["range"][0].as_py()
    rows = []
    words = {"word": [], "pair": []}
    for kind, chunk, blob in zip(table["kind"].to_pylist(), table["chunk"].to_pylist(), table["blob"].to_pylist(), strict=True):
        words[kind].append((chunk, *unpack_counts(blob)))
    empty = np.empty(0, dtype=np.uint64)
    keys, counts = summed(*(np.concatenate([x[i] for x in words["word"]] or [empty]) for i in (1, 2)))
    for chunk, own, _ in words["word"]:
        rows.append({"kind": "answer", "chunk": chunk, "range": r, "blob": pack_numbers(counts[np.searchsorted(keys, own)]), "n": len(own), "v": 0})
    pairs, n_pairs = summed(*(np.concatenate([x[i] for x in words["pair"]] or [empty]) for i in (1, 2)))
    taught = n_pairs > 0
    held = LogFrequencyFilter({0: segment(pairs[taught], n_pairs[taught])}, 1)
    for chunk, own, _ in words["pair"]:
        rows.append({"kind": "levels", "chunk": chunk, "range": r, "blob": pack_levels(held.counts(own)), "n": len(own), "v": 0})
    rows.append({"kind": "totals", "chunk": None, "range": r, "blob": None, "n": int(counts.sum()), "v": int((counts > 0).sum())})
    kinds = [("kind", pa.string()), ("chunk", pa.int64()), ("range", pa.int32()), ("blob", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]
    return pa.Table.from_pylist(rows, schema=pa.schema(kinds))


def score_documents(docs: DataFrame, is_training: Column, mu: float = MU, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    Chunks and ranges meet in (text / chunk) x (text / range) messages; neither
    size changes a result. A task needs some 15 bytes of memory for a byte of its
    chunk, and 20 for a byte of text in its range.
    """
    make_importable(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("train"), raw_text(text).alias("raw"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_ranges = max(4, -(-total // range_bytes))
    chunks = written(pack_documents(source, chunk_bytes or min(max(total // 1000, CHUNK_BYTES[0]), CHUNK_BYTES[1])), "chunks")
    answers = written(asked(chunks, n_ranges).groupBy("range").applyInArrow(merged, ANSWER), "answers")
    totals = answers.where("kind = 'totals'").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, v = totals["n"] or 0, totals["v"] or 0
    id_type = source.schema["doc_id"].dataType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tokens, known, base, score = [], [], [], [], []
        parts = sorted(zip(right["range"].to_pylist(), right["kind"].to_pylist(), right["n"].to_pylist(), right["blob"].to_pylist(), strict=True), key=lambda x: x[0])
        counts = np.concatenate([unpack_numbers(x, n) for _, kind, n, x in parts if kind == "answer"] or [np.empty(0, dtype=np.uint64)]).astype(np.float64)
        held = np.concatenate([unpack_levels(x, n) for _, kind, n, x in parts if kind == "levels"] or [np.empty(0, dtype=np.int64)]).astype(np.float64)
        for own, sizes, texts in zip(left["ids"].to_pylist(), left["sizes"].to_pylist(), left["texts"].to_pylist(), strict=True):
            docs_here = streams(sizes, texts)
            stream = np.concatenate(docs_here)
            words, place = np.unique(stream, return_inverse=True)
            c = counts[place]
            plain = (c + 1) / (n_train + v + 1)
            pair = held[np.unique(pair_hashes(stream), return_inverse=True)[1]]
            end = counts[np.searchsorted(words, END)]
            before = np.r_[end, c[:-1]]
            smooth = np.minimum((np.minimum(pair, before) + mu * plain) / (before + mu), 1.0)
            first = np.cumsum([0, *map(len, docs_here)])[:-1]
            ids += own
            tokens += [len(d) for d in docs_here]
            known += np.add.reduceat((c > 0).astype(np.int64), first).tolist()
            base += np.add.reduceat(np.log10(plain), first).tolist()
            score += np.add.reduceat(np.log10(smooth), first).tolist()
        kind = left.schema.field("ids").type.value_type
        return pa.table({"doc_id": pa.array(ids, kind), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    both = chunks.groupBy("chunk").cogroup(answers.where("kind != 'totals'").select("chunk", "kind", "range", "n", "blob").groupBy("chunk"))
    out = both.applyInArrow(scored, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def lm_query(docs: DataFrame) -> DataFrame:
    """The contract: rows whose crc32(id) mod 7 is 2 are held out from training."""
    held = remainder(F.col("doc_id"), 7) == 2
    out = score_documents(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
