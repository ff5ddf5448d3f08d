"""Which kinds of identifiers the texts of a growing store name, kept up to date file by file.

Before cohorts can be joined one must know what their papers, sample sheets and
notes call a feature: gene symbols, accession numbers, probes. The job takes the
files that arrived since its last run (a file stream with a checkpoint, started
for what is available and then ended) and keeps two tables:

- ``ledger``: for each document and kind of identifier the tokens, distinct tokens
  and the smallest one; a document without a token has the kind ``none``.
  Partitioned by epoch (the micro-batch) and kind.
- ``census``: the same by source and kind over all documents so far, partitioned
  by kind. It is merged from one small part for each epoch (``parts``).

A document is read off within its row, so no text is shuffled. An id that the
ledger has from an earlier epoch is a redelivery and is skipped (the first version
stays); of several rows with one id in one epoch the smallest entry stays; rows
without an id are left out. A repeated epoch replaces its own partitions with the
same rows, and the census is rebuilt from the parts, so a run that was killed
anywhere can be started again.

    python -m jobs.identifier_ledger --config jobs/identifier_ledger.json
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.streaming.cells import table_stream
from jobs.common import log, main, replace_partitions, stored

#: Letters and digits, with single marks between them.
TOKEN = r"[A-Za-z0-9]+(?:[._@/\-][A-Za-z0-9]+)*"
KINDS = (*(k for k, _ in S.ID_KINDS), "other")


@dataclass(frozen=True)
class Settings:
    """``input``: folder (or pattern of files) of documents in Parquet; ``output``, ``checkpoint``: folders of the job alone."""

    input: str
    output: str
    checkpoint: str
    doc_id: str = "doc_id"
    text: str = "text"
    source: str = "source"
    files_per_batch: int = 64


def entries(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, source and an array of (kind, n_tokens, n_distinct, example): one row a document, nothing shuffled."""
    tokens = F.regexp_extract_all(F.coalesce(s.text, F.lit("")), F.lit(TOKEN), F.lit(0))
    tagged = F.transform(tokens, lambda t: F.struct(S.id_kind(t).alias("kind"), t.alias("token")))

    def of_kind(held, kind: str):
        own = F.transform(F.filter(held, lambda x: x["kind"] == kind), lambda x: x["token"])
        return F.struct(F.lit(kind).alias("kind"), F.size(own).cast("long").alias("n_tokens"), F.size(F.array_distinct(own)).cast("long").alias("n_distinct"), F.array_min(own).alias("example"))

    # inside an array of one, so that the tokens of a text are found once
    each = F.transform(F.array(tagged), lambda held: F.filter(F.array(*[of_kind(held, k) for k in KINDS]), lambda e: e["n_tokens"] > 0))[0]
    none = F.array(F.struct(F.lit("none").alias("kind"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_distinct"), F.lit(None).cast("string").alias("example")))
    own = docs.where(F.col(s.doc_id).isNotNull()).select(F.col(s.doc_id).cast("long").alias("doc_id"), F.col(s.source).cast("string").alias("source"), each.alias("e"))
    own = own.withColumn("e", F.when(F.size("e") == 0, none).otherwise(F.col("e")))
    return own.groupBy("doc_id").agg(F.min(F.struct("source", "e")).alias("_one")).select("doc_id", "_one.source", "_one.e")


def part_of(ledger: DataFrame) -> DataFrame:
    """Sums by source and kind, which add up over epochs."""
    return ledger.groupBy("source", "kind").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("example").alias("example"))


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Take the documents that are new into the ledger and its census."""
    ledger, parts, census = (f"{s.output.rstrip('/')}/{name}" for name in ("ledger", "parts", "census"))
    schema = spark.read.parquet(s.input).select(*dict.fromkeys([s.doc_id, s.source, s.text])).schema
    written = 0

    def take(batch: DataFrame, epoch: int) -> None:
        nonlocal written
        fresh = entries(batch, s)
        if (held := stored(batch.sparkSession, ledger)) is not None:
            fresh = fresh.join(held.where(F.col("epoch") != epoch).select("doc_id"), "doc_id", "left_anti")
        rows = fresh.select("doc_id", "source", F.inline("e")).withColumn("epoch", F.lit(epoch))
        replace_partitions(rows, ledger, "epoch", "kind")
        if (held := stored(batch.sparkSession, ledger)) is None:
            return
        # read back: the texts are not gone through again
        own = held.where(F.col("epoch") == epoch)
        replace_partitions(part_of(own).withColumn("epoch", F.lit(epoch)), parts, "epoch")
        n = own.count()
        written += n
        log.info("epoch %d: %d ledger rows in %s", epoch, n, ledger)

    stream = table_stream(spark, s.input, schema, s.files_per_batch)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new documents from %s", read, s.input)
    kinds = 0
    if (held := stored(spark, parts)) is not None:
        merged = held.groupBy("source", "kind").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("example").alias("example"))
        merged.write.partitionBy("kind").mode("overwrite").parquet(census)
        kinds = spark.read.parquet(census).count()
        log.info("census of %d sources and kinds in %s", kinds, census)
    return {"read": read, "ledger": written, "census": kinds}


def output(spark: SparkSession, s: Settings) -> DataFrame:
    """Both tables as they stand, under each other."""
    base = s.output.rstrip("/")
    one = spark.read.parquet(f"{base}/ledger").select(F.lit("document").alias("level"), "doc_id", "source", "kind", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_distinct", "example")
    every = spark.read.parquet(f"{base}/census").select(F.lit("source").alias("level"), F.lit(None).cast("long").alias("doc_id"), "source", "kind", "n_docs", "n_tokens", F.lit(None).cast("long").alias("n_distinct"), "example")
    return one.unionByName(every)


if __name__ == "__main__":
    main("identifier_ledger", Settings, run)
