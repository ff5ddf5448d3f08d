"""Near-duplicate documents: an LSH forest of sorted MinHash signatures.

1. Every text becomes its set of word shingles; equal sets are one class, whose
   smallest row stands for it. A class has a MinHash signature of ``HASHES``
   values (16 bits of each are kept).
2. The signature is sorted in ``ORDERS`` different orders, each beginning at
   another value. Neighbours in a sorted order share the longest prefixes, so
   every class is paired with its neighbours there: in sparse regions with all
   that share ``MIN_DEPTH`` values, in dense regions with those that share the
   most, so that the depth adapts. The window bounds the pairs of a class
   however large a region is.
3. Pairs whose signatures agree too little are put aside (the margin is over
   four standard errors below the threshold).
4. Links are confirmed on the full shingle sets. Only links that matter for the
   components are looked at: in each round every component tries its
   likeliest candidates, confirmed links merge components, and rounds go on
   until no untested candidate joins two components. So a group of thousands of
   copies costs a few links for each member, not all pairs, and nothing is
   capped: every candidate is tested, or lies within one component, or falls
   to the last step.
5. In a dense region the window shows a document only some of its neighbours.
   So a document with a candidate in a large component that it is not in is
   contested: it is compared with every member of that component on full sets,
   in blocks of bounded size.
6. A region can be dense although nothing in it is linked (documents of one
   template). So a class whose window left out neighbours is crowded there, and
   the crowded classes that share ``MIN_DEPTH`` values in that order and are not
   in one component are compared with each other, likely pairs on full sets, in
   blocks of bounded size.

Rounds are cut by tables in the shared folder. Nothing but counts comes to the
driver.

Ids are whole numbers (another type is refused before anything runs) and are
taken to name one text; where rows with one id differ, they share a
component and the larger text in byte order stands in comparisons.

Defined cases: null and empty texts, and texts without words, have the empty
set and are linked with nothing; fewer words than a shingle are one shingle of
all of them; rows that repeat are in one class; a null id cannot be named by a
component, so such rows stand alone; ties go to the smaller id; extra columns
pass through in ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, raw_text, written
from cohortlens.llm.hashing import run_hashes, word_hashes

SHINGLE, HASHES, ORDERS, DEPTH, MIN_DEPTH = 5, 128, 32, 16, 3
#: Neighbours looked at on one side, by how many leading values are shared.
WINDOWS = ((3, 12), (6, 4), (9, 1))
#: Of the DEPTH values at hand so many must agree; of two sets at 0.75 that share a prefix of 3, 97 in 100 orders do.
AGREE = 10
#: Candidates a component tries in the first round; eight times as many in each later one.
TRIES = 4
#: Components from this size on can hold more neighbours than a window shows.
LARGE = 12
#: Documents and bytes of text in a block of contested documents and of members.
CONTESTED, MEMBERS, BLOCK_BYTES = 256, 1024, 4 << 20
#: Crowded classes in a block; two blocks meet at a time.
CROWDED = 512
#: Rows of one id are dealt to so many groups where stars are joined.
SALTS = 16
SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64)


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    return np.unique(run_hashes(word_hashes(text), k))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value under each hash function."""
    least = np.full(HASHES, ~np.uint32(0), dtype=np.uint32)
    a, b = (SEEDS[0] >> np.uint64(31)).astype(np.uint32) | np.uint32(1), (SEEDS[1] >> np.uint64(31)).astype(np.uint32)
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 2048):
            x = short[at : at + 2048, None] ^ b[None, :]
            x *= a[None, :]
            np.minimum(least, x.min(axis=0), out=least)
        least *= np.uint32(0x85EBCA6B)  # the smallest values have small leading bits: mix before cutting
    return (least >> np.uint32(16)).astype(np.uint16)


def signatures(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Per row: id, size of its set, digest of the set, signature, and the low byte of each of its values."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, sigs, sketches = [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingle_set(raw)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s) if len(s) else None
                sigs.append(sig.astype(">u2").tobytes() if len(s) else None)
                sketches.append(sig.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, sigs, sketches)]], names=["id", "n_shingles", "digest", "sig", "sketch"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("id"), raw_text(text)), signed, "id long, n_shingles long, digest binary, sig binary, sketch binary")


def joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``least`` rows, the last one excepted."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a < b) of neighbours in the sorted orders, each once.

    Rows with a ``place`` instead of ``b`` name the classes with neighbours beyond
    their window: ``place`` is the order and the values that they share.
    """
    step = 2 * (HASHES // ORDERS)
    doubled = F.concat("sig", "sig")
    orders = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda t: F.concat(F.substring(F.lpad(F.hex(t), 2, "0"), 1, 2).cast("binary"), F.substring(doubled, t * step + 1, F.lit(2 * DEPTH)))))
    keys = classes.select("id", orders.alias("key"))
    # rows that share MIN_DEPTH values are never parted, so that the windows do not depend on the partitions
    by_order = keys.repartitionByRange(F.substring("key", 1, 2 * (1 + MIN_DEPTH))).sortWithinPartitions("key", "id")
    widest = WINDOWS[0][1]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old_ids, old_keys = np.empty(0, dtype=np.int64), np.empty((0, 1 + DEPTH), dtype=np.uint16)
        for b in joined(batches, 16_000):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=">u2").reshape(len(ids), 1 + DEPTH)
            n_old = len(old_ids)
            ids, raw = np.r_[old_ids, ids], np.concatenate([old_keys, raw])
            same = raw[1:] == raw[:-1]
            shared = np.where(same.all(axis=1), DEPTH, np.where(same[:, 0], np.argmin(same, axis=1) - 1, -1))
            found_a, found_b = [], []
            crowded = np.zeros(len(ids), dtype=bool)
            prefix = shared.copy()
            for k in range(1, min(widest + 1, len(ids) - 1) + 1):
                if k > 1:
                    prefix = np.minimum(prefix[:-1], shared[k - 1 :])
                wide = np.zeros(DEPTH + 2, dtype=np.int64)
                for depth, width in WINDOWS:
                    wide[depth : DEPTH + 1] = width
                # new pairs only: the later one is of this batch
                fresh = np.arange(len(prefix)) + k >= n_old
                beyond = np.flatnonzero((prefix >= MIN_DEPTH) & (wide[prefix] < k) & fresh)
                crowded[beyond] = crowded[beyond + k] = True
                at = np.flatnonzero((wide[prefix] >= k) & fresh)
                at = at[(raw[at, 1:] == raw[at + k, 1:]).sum(axis=1) >= AGREE]
                found_a.append(np.minimum(ids[at], ids[at + k]))
                found_b.append(np.maximum(ids[at], ids[at + k]))
            old_ids, old_keys = ids[-widest - 1 :], raw[-widest - 1 :]
            if found_a:
                pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], names=["a", "b", "place"])
            if crowded.any():
                places = np.ascontiguousarray(raw[crowded, : 1 + MIN_DEPTH].astype(">u2")).view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[crowded]), pa.nulls(len(places), pa.int64()), pa.array(places)], names=["a", "b", "place"])

    return map_batches(by_order, neighbours, "a long, b long, place long").distinct()


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least the share ``least``, with the agreement."""
    a, b = (classes.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for i in (2, 3))
            share = (x == y).mean(axis=1)
            ok = pa.array(share >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(share).filter(ok)], names=["a", "b", "share"])

    return map_batches(both.select("a", "b", "sa", "sb"), agreed, "a long, b long, share double")


def confirmed(edges: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Each edge (a, b, ...) with ``linked``: 100 * intersection >= similarity * union on full sets."""
    ends = edges.select("a", "b", F.col("a").alias("id")).unionByName(edges.select("a", "b", F.col("b").alias("id"))).join(texts.hint("merge"), "id")
    both = ends.groupBy("a", "b").agg(F.max(F.when(F.col("id") == F.col("a"), F.col("raw"))).alias("ra"), F.max(F.when(F.col("id") == F.col("b"), F.col("raw"))).alias("rb"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = shingle_set(x), shingle_set(y)
                common = len(s) + len(t) - len(np.union1d(s, t))
                linked.append(100 * common >= similarity * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return map_batches(both, compared, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over ``links(u, v)``, for the ids in them.

    Alternating large and small stars, until nothing changes; each step groups by
    one id at a time and keeps at most one row for each link.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["u", "salt"])  # its size is not what it is estimated at
        hooked = joined.where("v > u") if large else joined
        out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    before = None
    while True:
        edges = written(star(star(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
        before = now


def linked_sets(mine: list[np.ndarray], theirs: list[np.ndarray], similarity: int) -> np.ndarray:
    """For each set of ``mine`` and each other one of ``theirs``: 100 * intersection >= similarity * union."""
    if not mine or not theirs:
        return np.zeros((len(mine), len(theirs)), dtype=bool)
    common = np.zeros((len(mine), len(theirs)), dtype=np.float32)
    if mine is theirs:
        every, n = np.unique(np.concatenate(mine), return_counts=True)
        every = every[n > 1]
    else:
        every = np.intersect1d(np.concatenate(mine), np.concatenate(theirs))
    for at in range(0, len(every), 2048):  # the sets side by side, a stretch of shingles at a time
        part = every[at : at + 2048]
        x, y = (np.zeros((len(sets), len(part)), dtype=np.float32) for sets in (mine, theirs))
        for sets, m in ((mine, x), (theirs, y)):
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                place = np.searchsorted(part, own)
                m[i, place[part[place] == own]] = 1
        common += x @ y.T
    n, m = (np.array([len(s) for s in sets], dtype=np.float32) for sets in (mine, theirs))
    return 100 * common >= similarity * (n[:, None] + m[None, :] - common)


def crowded_links(crowded: DataFrame, labels: DataFrame | None, classes: DataFrame, docs: DataFrame, similarity: int, least: float) -> DataFrame:
    """Links (u, v) between components, from comparing the crowded classes (id, place) of each place.

    ``labels`` holds (id, root) of all ids in components, ``docs`` (id, raw) of all rows.
    """
    rows = crowded.withColumn("root", F.col("id"))
    if labels is not None:
        rows = crowded.join(labels.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rows.groupBy("place").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most")
    # a place may hold a large share of all crowded classes: its rows are dealt to several groups where they meet its few figures
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = lambda few: few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    rows = written(rows.join(salted(mixed.select("place")), ["place", "salt"], "left_semi"), "crowded")
    # the orders in which a class is crowded, as bits: a pair is compared only in the first order in which both are, at one place
    hexed = lambda at: F.when(at <= 57, at - 48).otherwise(at - 55)
    order = hexed(F.shiftright("place", 56).bitwiseAND(255)) * 16 + hexed(F.shiftright("place", 48).bitwiseAND(255))
    masks = rows.withColumn("order", order.cast("int")).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, order))").alias("mask"))
    texts = docs.join(masks.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.max("raw").alias("raw"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(r).tobytes() for r in b.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    texts = map_batches(texts, as_sets, "id long, shingles binary").join(masks.hint("merge"), "id").join(classes.select("id", "sig").hint("merge"), "id")
    texts = written(texts, "crowdedsets")
    sized = rows.join(texts.select("id", F.octet_length("shingles").alias("size")).hint("merge"), "id")
    # the members of a place's largest component lie in one component: their blocks come last and do not meet each other
    parts = written(sized.groupBy("place", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "crowdedparts")
    main = parts.groupBy("place").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    slots = lambda own: F.greatest(F.ceil(F.sum(F.when(own, F.col("n"))) / CROWDED), F.ceil(F.sum(F.when(own, F.col("size"))) / BLOCK_BYTES), F.lit(1)).cast("int")
    many = parts.join(main.hint("merge"), "place").groupBy("place").agg(F.max("main").alias("main"), slots(F.col("root") == F.col("main")).alias("ms"), slots(F.col("root") != F.col("main")).alias("rs"))
    rows = rows.join(salted(many), ["place", "salt"]).withColumn("is_main", F.col("root") == F.col("main"))
    rows = rows.withColumn("slot", F.when(F.col("is_main"), F.col("rs") + F.pmod(F.xxhash64("id"), F.col("ms"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rs"))).cast("int"))
    # any other block meets each block and itself, each time in a group of its own
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rs") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("ms"))))).select("id", "root", "place", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))

    def compared(t: pa.Table) -> pa.Table:
        slot, root = t["slot"].to_numpy(), t["root"].to_numpy()
        left, right = np.flatnonzero(slot == t["i"][0].as_py()), np.flatnonzero(slot == t["j"][0].as_py())
        u, v = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if len(left) and len(right):
            open_ = root[left][:, None] != root[right][None, :]
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=">u2").reshape(-1, HASHES)
            mask, place = t["mask"].to_numpy(), t["place"][0].as_py() & ((1 << 64) - 1)
            here = int((place >> 48).to_bytes(2, "big").decode(), 16)
            for earlier in range(here):
                held = (mask >> earlier & 1).astype(bool)
                at = (np.arange(MIN_DEPTH) + earlier * (HASHES // ORDERS)) % HASHES
                same = np.ones(open_.shape, dtype=bool)
                for k in at:
                    same &= sig[left, k][:, None] == sig[right, k][None, :]
                open_ &= ~(same & held[left][:, None] & held[right][None, :])
            x, y = np.nonzero(open_)
            sketch = sig.astype(np.uint8)
            alike = [(sketch[left[x[at : at + 32768]]] == sketch[right[y[at : at + 32768]]]).mean(axis=1) >= least for at in range(0, len(x), 32768)]
            keep = np.concatenate(alike) if alike else np.empty(0, dtype=bool)
            x, y = left[x[keep]], right[y[keep]]
            held_sets = t["shingles"]
            sets = {int(k): np.frombuffer(held_sets[int(k)].as_py(), dtype=np.uint64) for k in np.unique(np.r_[x, y])}
            rows_x, rows_y = np.unique(x), np.unique(y)
            if len(x) > 2000:
                mine = [sets[int(k)] for k in rows_x]
                theirs = mine if np.array_equal(rows_x, rows_y) else [sets[int(k)] for k in rows_y]
                linked = linked_sets(mine, theirs, similarity)[np.searchsorted(rows_x, x), np.searchsorted(rows_y, y)]
            else:
                common = np.array([len(np.intersect1d(sets[int(a)], sets[int(b)], assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype=np.int64)
                union = np.array([len(sets[int(a)]) + len(sets[int(b)]) for a, b in zip(x, y, strict=True)], dtype=np.int64) - common
                linked = 100 * common >= similarity * union
            u, v = root[x[linked]], root[y[linked]]
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.table({"u": pa.array(pairs[0], pa.int64()), "v": pa.array(pairs[1], pa.int64())})

    both = rows.join(texts.hint("merge"), "id")
    return both.groupBy("place", "i", "j").applyInArrow(compared, "u long, v long").distinct()


def contested_links(failed: DataFrame, labels: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Links (u, v) between components, from comparing contested documents with whole components.

    ``failed`` holds candidate pairs that are not linked (yet), ``labels`` (id, root) of all ids in components.
    """
    sizes = labels.groupBy("root").count().where(F.col("count") >= LARGE)
    one = failed.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(failed.select(F.col("b").alias("x"), F.col("a").alias("y")))
    one = one.join(labels.select(F.col("id").alias("y"), F.col("root").alias("target")), "y").join(labels.select(F.col("id").alias("x"), F.col("root").alias("own")), "x", "left").withColumn("own", F.coalesce("own", "x"))
    one = one.where("own <> target").select("x", "own", "target").distinct()
    one = one.join(sizes.select(F.col("root").alias("target"), F.col("count").alias("n")), "target").join(sizes.select(F.col("root").alias("own"), F.col("count").alias("m")), "own", "left")
    contested = written(one.where("m is null or m < n or (m = n and own > target)").select("x", "own", "target"), "contested")

    def dealt(rows: DataFrame, limit: int, slot: str) -> tuple[DataFrame, DataFrame]:
        """Rows (target, id, own, raw) with a slot of bounded size, and the number of slots of each target."""
        many = rows.groupBy("target").agg(F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum(F.octet_length("raw")) / BLOCK_BYTES)).cast("int").alias(f"{slot}s"))
        return rows.join(many, "target").withColumn(slot, F.pmod(F.xxhash64("id"), F.col(f"{slot}s")).cast("int")).drop(f"{slot}s"), many

    queries, n_queries = dealt(contested.select(F.col("x").alias("id"), "own", "target").join(texts, "id"), CONTESTED, "q")
    members = labels.select("id", F.col("root").alias("target")).join(contested.select("target").distinct(), "target", "left_semi").join(texts, "id").withColumn("own", F.col("target"))
    members, n_members = dealt(members, MEMBERS, "m")
    # each block of queries meets each block of members of its target in a group of its own
    queries = queries.join(n_members, "target").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1))).select(*[F.col(c).alias(c) for c in ("target", "q", "m", "own", "raw")])
    members = members.join(n_queries, "target").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select(*[F.col(c).alias(c) for c in ("target", "q", "m", "raw")])

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = ([shingle_set(r) for r in t["raw"].to_pylist()] for t in (left, right))
        linked = linked_sets(mine, theirs, similarity).any(axis=1)
        keep = pa.array(linked)
        return pa.table({"u": left["own"].filter(keep).cast(pa.int64()), "v": left["target"].filter(keep).cast(pa.int64())})

    both = queries.groupBy("target", "q", "m").cogroup(members.groupBy("target", "q", "m"))
    return both.applyInArrow(compared, "u long, v long").distinct()


def relabelled(labels: DataFrame | None, merged: DataFrame) -> DataFrame:
    """(id, root) after the components of ``merged`` (id, root) over old roots."""
    if labels is None:
        return merged.unionByName(merged.select(F.col("root").alias("id"), "root").distinct())
    older = labels.join(merged.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    fresh = merged.unionByName(merged.select(F.col("root").alias("id"), "root").distinct())
    return older.unionByName(fresh.join(labels.select("id"), "id", "left_anti"))


def near_duplicates(docs: DataFrame, similarity: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be a whole number, not {docs.schema[doc_id].dataType.simpleString()}")
    rows = written(signatures(docs, text, doc_id), "signatures")
    ids = rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = written(ids.groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "classes")
    margin = similarity / 100 - 4.3 * (similarity / 100 * (1 - similarity / 100) / HASHES) ** 0.5
    found = written(candidate_pairs(classes), "neighbours")
    edges = written(likely(found.where("b is not null").select("a", "b"), classes, margin), "candidates")
    # what these joins meet grows with the input: they are never broadcast
    members = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    texts = written(docs.select(F.col(doc_id).cast("long").alias("id"), raw_text(text).alias("raw")).join(members.hint("merge"), "id", "left_semi"), "texts")

    labels, failed = None, None  # (id, root) of the ids in components; candidates that are not linked
    open_edges, tries = edges.select("a", "b", "share", F.col("a").alias("ca"), F.col("b").alias("cb")), TRIES
    while open_edges.take(1):
        ends = open_edges.select("a", "b", "share", F.col("ca").alias("c")).unionByName(open_edges.select("a", "b", "share", F.col("cb").alias("c")))
        # every component tries its likeliest candidates, one in each of a few slots
        best = ends.groupBy("c", F.pmod(F.xxhash64("a", "b"), F.lit(tries)).alias("slot")).agg(F.min(F.struct((-F.col("share")).alias("s"), "a", "b")).alias("e"))
        verdict = written(confirmed(best.select("e.a", "e.b").distinct(), texts, similarity), "verdicts")
        lost = verdict.where("not linked").select("a", "b")
        failed = lost if failed is None else failed.unionByName(lost)
        judged = open_edges.join(verdict, ["a", "b"], "left")
        new = judged.where("linked").select(F.col("ca").alias("u"), F.col("cb").alias("v"))
        rest = judged.where(F.col("linked").isNull()).drop("linked")
        if new.take(1):
            merged = written(components(new), "components")
            labels = written(relabelled(labels, merged), "labels")
            large = labels.groupBy("root").count().where(F.col("count") >= LARGE).select("root", F.lit(True).alias("is_large"))
            # old roots that moved, and large ones that stayed
            moves = merged.unionByName(large.select(F.col("root").alias("id"), "root").join(merged.select("id"), "id", "left_anti"))
            moves = written(moves.join(large, "root", "left"), "moves")
            for c in ("ca", "cb"):
                rest = rest.join(moves.select(F.col("id").alias(c), F.col("root").alias("to"), F.col("is_large").alias(f"{c}_large")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
            rest = written(rest.where("ca <> cb"), "rest")
            meets = F.coalesce("ca_large", "cb_large").isNotNull()  # left to the last step
            failed = failed.unionByName(rest.where(meets).select("a", "b"))
            rest = rest.where(~meets).drop("ca_large", "cb_large")
        open_edges, tries = written(rest.where("ca <> cb"), "open"), 8 * tries
    if labels is not None:
        more = written(contested_links(failed, labels, texts, similarity), "contested")
        if more.take(1):
            labels = written(relabelled(labels, components(more)), "labels")
    crowded = found.where("b is null").select(F.col("a").alias("id"), "place")
    if crowded.take(1):
        raws = docs.select(F.col(doc_id).cast("long").alias("id"), raw_text(text).alias("raw"))
        more = written(crowded_links(crowded, labels, classes, raws, similarity, margin), "crowdedlinks")
        if more.take(1):
            labels = written(relabelled(labels, components(more)), "labels")
    roots = classes.select("digest", F.col("id").alias("class_id"))
    if labels is not None:
        roots = roots.join(labels.select(F.col("id").alias("class_id"), "root"), "class_id", "left").select("digest", F.coalesce("root", "class_id").alias("component"))
    else:
        roots = roots.select("digest", F.col("class_id").alias("component"))
    out = rows.select("id", "n_shingles", "digest").join(roots, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: int = 75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (rows without an id all stay)."""
    own = docs[doc_id]
    gone = near_duplicates(docs, similarity, text, doc_id).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, own.cast("long") == F.col("_gone"), "left_anti")
