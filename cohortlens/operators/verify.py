"""Tracing printed values and references to what they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S


def numbers_in(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct numbers in each text, in plain form."""
    found = F.explode(F.regexp_extract_all(F.translate(F.col(text), "−–", "--"), F.lit(S.NUMBER), 0))
    return texts.select(key, found.alias("num")).select(key, S.plain_number(F.col("num")).alias("num")).distinct()


def nested_numbers(df: DataFrame, key: str, json: str, bound: float) -> DataFrame:
    """Numbers that stand as values anywhere in a JSON text, in objects and arrays alike, with |x| <= bound."""
    found = F.explode(F.regexp_extract_all(F.col(json), F.lit(r"[:\[,]\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)(?=\s*[,\]}])"), 1))
    return df.select(key, found.alias("x")).select(key, F.col("x").cast("double").alias("x")).where(F.abs("x") <= bound)


def edited(texts: DataFrame, text: str, edits: Sequence[tuple[str, str]], out: str = "edited") -> DataFrame:
    """Ordered replacements of anchors; ``missing`` lists the anchors that a text had not when their turn came."""
    now, missing = F.col(text), []
    for anchor, new in edits:
        missing.append(F.when(~F.coalesce(now.contains(anchor), F.lit(False)), F.lit(anchor)))
        now = F.replace(now, F.lit(anchor), F.lit(new))
    return texts.withColumn("missing", F.array_compact(F.array(*missing))).withColumn(out, now)


def frozen(text: str, edits: Sequence[tuple[str, str]], required: Sequence[str] = ()) -> str:
    """One document after ordered edits; an anchor that is missing, or a required one that is gone, is an error."""
    for anchor, new in edits:
        if anchor not in text:
            raise ValueError(f"nothing to replace: {anchor!r}")
        text = text.replace(anchor, new)
    if gone := [a for a in required if a not in text]:
        raise ValueError(f"missing after the edits: {gone}")
    return text


def missing_values(expected: DataFrame, numbers: DataFrame) -> DataFrame:
    """Expected numbers (column num) that no text holds."""
    return expected.select(S.plain_number(F.col("num")).alias("num")).distinct().join(numbers.select("num"), "num", "left_anti")


def provenance(printed: DataFrame, artefacts: DataFrame, places: int = 4) -> DataFrame:
    """Printed values (value) with how many artefact values (artefact, value) equal them to so many places."""
    k = F.round("value", places)
    known = artefacts.where("value is not null").groupBy(k.alias("_k")).agg(F.countDistinct("artefact").alias("n_artefacts"), F.min("artefact").alias("first_artefact"))
    return printed.withColumn("_k", k).join(known, "_k", "left").drop("_k").withColumn("n_artefacts", F.coalesce("n_artefacts", F.lit(0))).withColumn("traced", F.col("n_artefacts") > 0)


def cross_references(cited: DataFrame, defined: DataFrame) -> DataFrame:
    """References (ref) cited but not defined, and defined but not cited."""
    c, d = cited.select("ref").distinct(), defined.select("ref").distinct()
    return c.join(d, "ref", "left_anti").withColumn("problem", F.lit("not defined")).unionByName(d.join(c, "ref", "left_anti").withColumn("problem", F.lit("not cited")))


def numbering_gaps(refs: DataFrame) -> DataFrame:
    """Numbers missing between 1 and the largest reference (a whole number)."""
    most = refs.agg(F.max(F.col("ref").cast("int")).alias("n"))
    every = most.where("n is not null").select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ref"))
    return every.join(refs.select(F.col("ref").cast("int").alias("ref")).distinct(), "ref", "left_anti")


def fuzzy_key(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Each key's name: the equal one, else the only one whose tokens the key holds, else NULL.

    Keys and names meet by token; a name without tokens is held by no key.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))
    named = names.select("name").distinct().withColumn("_n", tokens(F.col("name")))
    met = keys.select("key").distinct().withColumn("_t", F.explode(tokens(F.col("key")))).join(named.select("name", F.size("_n").alias("_size"), F.explode("_n").alias("_t")), "_t")
    inside = met.groupBy("key", "name").agg(F.count("*").alias("_held"), F.max("_size").alias("_size")).where("_held = _size")
    only = inside.groupBy("key").agg(F.count("*").alias("_k"), F.min("name").alias("_only"))
    same = named.select(F.col("name").alias("key"), F.col("name").alias("_same"))
    return keys.join(same, "key", "left").join(only, "key", "left").select("key", F.coalesce("_same", F.when(F.col("_k") == 1, F.col("_only"))).alias("name"))


def core_set(members: DataFrame, layers: Sequence[str], sample: str = "sample", layer: str = "layer") -> DataFrame:
    """Running sizes of the intersection of a sample set with each layer in turn; a layer nobody has is skipped."""
    held = members.where(F.col(layer).isin(*layers)).groupBy(sample).agg(F.collect_set(layer).alias("_h"))
    present = members.where(F.col(layer).isin(*layers)).agg(F.collect_set(layer).alias("_all"))
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(x).alias("layer"), F.array(*map(F.lit, layers[: i + 1])).alias("need")) for i, x in enumerate(layers)]
    one = held.crossJoin(F.broadcast(present)).withColumn("s", F.explode(F.array(*steps)))  # one row
    need = F.array_intersect("s.need", "_all")
    return one.where(F.array_contains("_all", F.col("s.layer")) & (F.size(F.array_except(need, "_h")) == 0)).groupBy(F.col("s.step").alias("step"), F.col("s.layer").alias("layer")).agg(F.count("*").alias("n_samples"))


def family_correlation(pairs: DataFrame, families: DataFrame, r: str = "r") -> DataFrame:
    """Mean correlation of sample pairs (feature_a, feature_b, r) within and between families (unit, family)."""
    a, b = (families.select(F.col("unit").alias(f"feature_{s}"), F.col("family").alias(f"family_{s}")) for s in "ab")
    both = pairs.join(a, "feature_a").join(b, "feature_b")
    first, second = F.least("family_a", "family_b"), F.greatest("family_a", "family_b")
    return both.groupBy(first.alias("family_a"), second.alias("family_b")).agg(F.count("*").alias("n_pairs"), F.avg(r).alias("mean_r"))


def ledger(claims: DataFrame, evidence: DataFrame, near: Column | float = 1e-4) -> DataFrame:
    """Claims (claim, artefact, key, value) against evidence (artefact, key, value): verdict of each."""
    e = evidence.select("artefact", "key", F.col("value").alias("found"))
    gap = F.abs(F.col("value") - F.col("found"))
    verdict = F.when(F.col("found").isNull(), "no evidence").when(gap <= near, "agrees").otherwise("differs")
    return claims.join(e, ["artefact", "key"], "left").withColumn("verdict", verdict)
