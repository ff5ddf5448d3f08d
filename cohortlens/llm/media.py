"""Media columns: payloads in archives, read by a custom Spark data source.

Writing: each task packs its rows into one archive file in a shared folder, one
member for each row. A member is a grey 8-bit PNG image, 64 samples a row, so
the payload is held losslessly; the archive ends with a directory of members
(offset, length, CRC-32, name). Only archives of tasks that succeeded are in the
manifest, so attempts that were lost or ran twice do no harm.

Reading: the data source ``archive_media`` plans partitions as byte ranges of
the archives from their lengths alone; a task reads the directory of its
archive and takes the members that begin in its range. It streams them as Arrow
batches of limited size, and tries a member again by its own offset when it
fails, independently of the others; one that keeps failing comes back with its
error instead of a payload. ``describe`` fails on such a member, whatever
columns are asked for, unless it is told to keep errors as rows.

Paths are opened with ``pyarrow.fs``, which knows file, HDFS and object-store
addresses.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes;
equal texts give equal members; null ids stay null; repeated rows are separate
members; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cohortlens.llm.common import map_batches, raw_text, scratch
from cohortlens.session import make_importable

ROW = 64
MAGIC = b"CLMEDIA1"
PNG = b"\x89PNG\r\n\x1a\n"
#: Directory entry: offset and length of the member, its CRC-32, length of its name.
ENTRY, TAIL = "<QQII", "<QQ8s"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A grey 8-bit image of 64 samples a row; ``n_bytes`` stands in a text chunk."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), dtype=np.uint8)  # filter type 0, then the samples
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\x00%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples of an image as ``to_png`` writes it, and its ``n_bytes``."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, n_bytes, size = 8, [], -1, None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\x00"):
            n_bytes = int(body[8:])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, ROW + 1)
    if size is None or size[:3] != (ROW, len(rows), 8) or rows[:, 0].any():
        raise ValueError("not an image of this kind")
    return rows[:, 1:].tobytes(), n_bytes


def write_archives(rows: DataFrame, folder: str, name: str = "name", text: str = "raw") -> DataFrame:
    """One archive for each task; returns the manifest (path, n_members, bytes) as a written table."""
    source = rows.select(F.col(name).alias("name"), F.col(text).alias("raw"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        path, out, entries, at = "", None, [], 0
        for b in batches:
            for member, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.arc"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(opened(path)[1])
                media = to_png(payload_of(raw or b""), len(raw or b""))
                label = json.dumps(member).encode()
                out.write(media)
                entries.append(struct.pack(ENTRY, at, len(media), zlib.crc32(media), len(label)) + label)
                at += len(media)
        if out is not None:
            directory = b"".join(entries)
            out.write(directory)
            out.write(struct.pack(TAIL, at, len(directory), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_members": len(entries), "bytes": at}], schema=pa.schema([("path", pa.string()), ("n_members", pa.int64()), ("bytes", pa.int64())]))

    manifest = map_batches(source, pack, "path string, n_members long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


class Range(InputPartition):
    """A byte range of one archive: its members are those that begin there."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def tail_of(f) -> tuple[int, int]:
    """Where the directory of an open archive begins, and its length."""
    f.seek(f.size() - struct.calcsize(TAIL))
    at, n, magic = struct.unpack(TAIL, f.read(struct.calcsize(TAIL)))
    if magic != MAGIC:
        raise ValueError("not an archive")
    return at, n


def directory_of(path: str) -> bytes:
    """The directory of an archive, without reading its members."""
    fs, local = opened(path)
    with fs.open_input_file(local) as f:
        at, n = tail_of(f)
        f.seek(at)
        return f.read(n)


def entries_in(directory: bytes) -> Iterator[tuple[int, int, int, str]]:
    """Offset, length, CRC-32 and name of each member."""
    at = 0
    while at < len(directory):
        offset, length, crc, n = struct.unpack_from(ENTRY, directory, at)
        end = at + struct.calcsize(ENTRY) + n
        yield offset, length, crc, directory[at + struct.calcsize(ENTRY) : end].decode()
        at = end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.ends = json.loads(options["ends"]) if "ends" in options else [None] * len(self.paths)
        if len(self.ends) != len(self.paths):
            raise ValueError("ends needs one number for each path")
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[InputPartition]:
        """Ranges of ``rangeBytes``; the driver opens no archive whose ``ends`` is given, and of others reads the last few bytes."""
        out: list[InputPartition] = []
        for path, end in zip(self.paths, self.ends, strict=True):
            if end is None:
                fs, local = opened(path)
                with fs.open_input_file(local) as f:
                    end, _ = tail_of(f)
            out += [Range(path, at, min(at + self.range_bytes, end)) for at in range(0, end, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def again(self, work):
        """The result of ``work``, tried several times on input errors."""
        for attempt in range(self.attempts):
            try:
                return work()
            except OSError:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(0.05 * 4**attempt)

    def member(self, f, offset: int, length: int, crc: int) -> bytes:
        f.seek(offset)
        media = f.read(length)
        if len(media) != length or zlib.crc32(media) != crc:
            raise OSError(f"member at {offset} is damaged")
        return media

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        names, media, errors, held = [], [], [], 0
        if not partition.path:
            return
        directory = self.again(lambda: directory_of(partition.path))
        fs, local = opened(partition.path)
        f = None
        try:
            for offset, length, crc, name in entries_in(directory):
                if not partition.start <= offset < partition.end:
                    continue
                found, error = None, None
                for attempt in range(self.attempts):
                    try:
                        f = f or fs.open_input_file(local)
                        found, error = self.member(f, offset, length, crc), None
                        break
                    except OSError as e:  # this member alone is tried again, on a fresh handle
                        error, f = str(e), None
                        time.sleep(0.05 * 4**attempt)
                names.append(name)
                media.append(found)
                errors.append(error)
                held += length
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], schema=schema)
                    names, media, errors, held = [], [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], schema=schema)
        finally:
            if f is not None:
                f.close()


class ArchiveMedia(DataSource):
    """``spark.read.format("archive_media").option("paths", json list)``.

    Options: ``rangeBytes`` for the planning, ``ends`` (JSON list, as the manifest's
    ``bytes``: where each archive's members end), ``batchBytes`` for the streaming,
    ``attempts`` for each member.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "name string, media binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """Members of the archives: name (JSON), media and error."""
    make_importable(spark)
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").option("paths", json.dumps(paths)).options(**options).load()


def features(payload: bytes) -> str:
    """Samples, mean, variance, zero share and the 8-band level histogram of a payload."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bands = np.bincount(x >> 5, minlength=8)
    level = x.astype(np.int64)
    n, total, squares = len(x), int(level.sum()), int((level * level).sum())
    return f"n={n};mean={total / n:.4f};var={squares / n - (total / n) ** 2:.4f};zeros={int((x == 0).sum())};bands={','.join(map(str, bands.tolist()))}"


DESCRIBED = "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def describe(members: DataFrame, keep_errors: bool = False) -> DataFrame:
    """Digest and features of each member, computed from the stored bytes that were read back.

    A member that could not be read, or is no image of this kind, fails the
    task (which Spark runs again), or is a row with its error where they are kept.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, media, error in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if error is None:
                    try:
                        payload, n_bytes = from_png(media)
                    except (ValueError, zlib.error, struct.error) as e:
                        error = str(e)
                if error is not None and not keep_errors:
                    raise OSError(f"member {name} could not be read: {error}")
                row = {"name": name, "error": error}
                if error is None:
                    row |= {"n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-ROW:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(payload)}
                rows.append(row)
            kinds = [("name", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return map_batches(members, described, DESCRIBED)


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every text stored as media, read back, and described.

    The manifest has one row for each archive, that is for each input split; it is
    all that the driver gathers, and what the ranges are planned from.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    id_type = docs.schema[doc_id].dataType.simpleString()
    manifest = write_archives(docs.select(F.col(doc_id).cast("string").alias("name"), raw_text(text).alias("raw")), folder)
    held = sorted((r["path"], r["bytes"]) for r in manifest.select("path", "bytes").collect())
    out = describe(read_archives(spark, [p for p, _ in held], ends=json.dumps([n for _, n in held])))
    # names are JSON, so that a null id and the text "null" differ
    own_id = F.get_json_object(F.concat(F.lit('{"v":'), F.col("name"), F.lit("}")), "$.v").cast(id_type)
    return out.select(own_id.alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
