"""What the corpus operators share: scratch tables, Arrow batching, row keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import make_importable

#: Rows handed to a worker function at once stay below this many bytes (one row may be larger).
BATCH_BYTES = 4 << 20


_held: list[str] = []
#: Temporary folders of local applications.
_own: dict[str, str] = {}


def discard(spark: SparkSession) -> None:
    """Delete the scratch tables made so far; frames that read them are void then."""
    while _held:
        path = spark._jvm.org.apache.hadoop.fs.Path(_held.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _discard_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        if _held and (spark := SparkSession.getActiveSession()) is not None:
            discard(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset
    and the master is local (tests, one machine) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        _own[spark.sparkContext.applicationId] = base
    _held.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _held[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    The copy survives lost executors, which a local checkpoint would not.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches of about ``limit`` bytes each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * limit / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def text_batches(spark: SparkSession) -> SparkSession:
    """A session whose Arrow batches suit rows that hold whole texts.

    Only where the session leaves the number of records at its default; it has no setting for one query.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return make_importable(spark)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches limited in bytes."""
    text_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(sized(batches)), schema)


def raw_text(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(text).cast("binary")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")
