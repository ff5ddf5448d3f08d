"""Cross-site boilerplate removal by the spread of lines over distinct sites.

Every line hash carries a HyperLogLog sketch of the sites it was seen on; the
sketches merge by aggregation. Lines whose estimate lies near the threshold get
an exact distinct count. A line on at least ``min_sites`` sites is boilerplate:
its first occurrence (smallest document id, then position) stays, every other
one goes. DataFrame functions only.

Defined cases: a null text stays null and has no lines; a null site is not
counted as a site; empty and short lines (under ``min_chars`` code points after
trimming blanks) are never boilerplate; rows that repeat (same id, same text)
are treated alike; a null id sorts before all others; extra columns pass
through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written

#: Precision of the sketches (2^12 registers: 1.6 % standard error) and the width of the exact band.
LG_K, BAND = 12, 0.1


def _keyed(docs: DataFrame, text: str, site: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).alias("_text"), F.col(site).cast("string").alias("_site"))


def _lines(docs: DataFrame, text: str, site: str, doc_id: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough: its hashes, site and place."""
    one = _keyed(docs, text, site, doc_id).select("_id", "_th", "_site", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    one = one.withColumn("_line", F.trim("_line")).where(F.char_length("_line") >= min_chars)
    return one.select("_id", "_th", "_site", "_pos", F.xxhash64("_line").alias("_h"), F.hash("_line").alias("_g"))


def line_spread(docs: DataFrame, min_sites: int = 8, min_chars: int = 16, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Boilerplate lines: hashes ``_h, _g``, number of occurrences, spread and first occurrence."""
    lines = _lines(docs, text, site, doc_id, min_chars)
    width = max(1.0, BAND * min_sites)
    spread = (
        lines.groupBy("_h", "_g")
        .agg(F.count("*").alias("n_occ"), F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.min(F.struct("_id", "_th", "_pos")).alias("_first"))
        .where(F.col("n_occ") >= min_sites)
        .withColumn("spread", F.hll_sketch_estimate("_sketch"))
        .where(F.col("spread") >= min_sites - width)
        .drop("_sketch")
    )
    # few lines are left; as a table they meet the lines again without the aggregation's partitioning, so a hot line can be split
    spread = written(spread, "spread")
    over = spread.where(F.col("spread") > min_sites + width)
    near = spread.where(F.col("spread") <= min_sites + width)
    exact = lines.join(near.select("_h", "_g"), ["_h", "_g"], "left_semi").select("_h", "_g", "_site").distinct().groupBy("_h", "_g").agg(F.count("_site").alias("_exact")).where(F.col("_exact") >= min_sites)
    return over.unionByName(near.join(exact, ["_h", "_g"]).withColumn("spread", F.col("_exact")).drop("_exact"))


def remove_spread_lines(docs: DataFrame, min_sites: int = 8, min_chars: int = 16, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with the cleaned text, then ``n_lines`` and ``n_removed``.

    Columns of those two names in the input are replaced.
    """
    # as a table of known size it is broadcast only if small, and a line that a third of all documents hold can be split
    boiler = written(line_spread(docs, min_sites, min_chars, text, site, doc_id).select("_h", "_g", "_first"), "lines")
    hits = _lines(docs, text, site, doc_id, min_chars).join(boiler, ["_h", "_g"])
    gone = hits.where(~F.struct("_id", "_th", "_pos").eqNullSafe(F.col("_first"))).groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_gone"))
    # as a table of known size it is broadcast while it is small; beyond that the texts meet it by a sort-merge join
    gone = written(gone.select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), "_gone"), "removals")

    def kept(lines: Column, removed: Column) -> Column:
        """The lines at the places not removed: one hash set of places, and the text split once."""
        held = F.struct(lines.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed).alias("k"))
        return F.transform(F.array(held), lambda h: F.array_join(F.transform(h["k"], lambda i: h["l"][i]), "\n"))[0]

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*[docs[c] for c in names], docs[doc_id].alias("_id"), F.xxhash64(docs[text]).alias("_th"))
    both = base.join(gone, base["_id"].eqNullSafe(gone["_id2"]) & (base["_th"] == gone["_th2"]), "left")
    lines = F.split(F.col(text), "\n")
    return both.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept(lines, F.col("_gone"))).alias(c) if c == text else F.col(c) for c in names],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
