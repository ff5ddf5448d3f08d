"""Registered queries that write files and read them back, with their SQL over the tables the files were made of."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.plans import fixtures as X
from cohortlens.plans.catalogue import query, r6
from cohortlens.session import scratch, table
from cohortlens.sources import files as FS
from cohortlens.sources import matrix as FM
from cohortlens.sources import records as FR

_ONE = "cohort = 'A' AND layer = 'F'"
#: The matrix as the file says it: printed values, gaps as NULL, feature 0 twice with values 1 apart.
_FILE = f""", c AS (SELECT feature, sample, round(value, 6) AS v FROM cells WHERE {_ONE}),
m AS (SELECT f.feature, s.sample, v + CASE WHEN f.feature = 0 THEN 0.5 ELSE 0 END AS value FROM (SELECT DISTINCT feature FROM c) f CROSS JOIN (SELECT DISTINCT sample FROM c) s LEFT JOIN c ON c.feature = f.feature AND c.sample = s.sample)"""


def _text(lines: DataFrame, name: str, compression: str = "none") -> str:
    """One text file of the lines (ord, line) in order; its folder."""
    path = scratch(lines.sparkSession, name)
    lines.repartition(1).sortWithinPartitions("ord").select("line").write.option("compression", compression).text(path)
    return path


def _matrix_file(spark: SparkSession, d: str) -> str:
    """A wide matrix, gzipped, with a comment, a blank line, quotes, gaps, a repeated, a ragged and a badly named row."""
    c = X.cells(spark, d).where(_ONE).select("feature", "sample", F.round("value", 6).alias("v"))
    names = c.agg(F.array_sort(F.collect_set("sample")).alias("samples"))
    # every feature has a field for every sample, so that the fields of a row follow from their order
    full = c.select("feature").distinct().crossJoin(c.select("sample").distinct()).join(c, ["feature", "sample"], "left")
    wide = full.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda x: x["v"]).alias("vs"))
    tab = F.lit("\t")

    def row(name, plus: float):
        return F.concat(name, tab, F.array_join(F.transform("vs", lambda v: F.coalesce((v + plus).cast("string"), F.lit("NA"))), "\t"))

    quoted = F.concat(F.lit('"g'), F.col("feature").cast("string"), F.lit('"'))
    parts = [
        names.select(F.lit(-3).alias("ord"), F.lit("# a comment").alias("line")),
        names.select(F.lit(-2), F.lit("")),
        names.select(F.lit(-1), F.concat(F.lit("ID\t"), F.array_join(F.transform("samples", lambda s: F.concat(F.lit("s"), s.cast("string"))), "\t"))),
        wide.select((2 * F.col("feature")).cast("int"), row(quoted, 0.0)),
        wide.where("feature = 0").select(F.lit(1), row(F.lit(" g0 "), 1.0)),
        names.select(F.lit(1000), F.concat(F.lit("short"), F.repeat(F.lit("\t1"), (F.size("samples") + 1).cast("int")))),
        wide.where("feature = 1").select(F.lit(1001), row(F.lit("?bad"), 0.0)),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.union(p)
    return _text(lines, "matrix", "gzip")


@query(_FILE + " SELECT concat('g', CAST(feature AS VARCHAR)) AS feature, concat('s', CAST(sample AS VARCHAR)) AS sample, round(value, 6) AS value FROM m", "cells")
def matrix_scan(spark, d):
    return FM.read_matrix(spark, _matrix_file(spark, d)).select("feature", "sample", r6("value"))


@query(_FILE + """ SELECT row, first, (SELECT count(DISTINCT sample) FROM c) + 1 AS n_fields FROM (SELECT 1 AS row, 'ID' AS first UNION ALL SELECT 2, 'g0' UNION ALL SELECT 3, 'g0') h""", "cells")
def matrix_head(spark, d):
    lines = FM.head_lines(spark, _matrix_file(spark, d), 3)
    return lines.select("row", S.clean_id(F.split_part("line", F.lit("\t"), F.lit(1))).alias("first"), F.size(F.split("line", "\t")).cast("long").alias("n_fields"))


@query(_FILE + """ SELECT concat('g', CAST(feature AS VARCHAR)) AS feature, CASE WHEN feature = 0 THEN 2 ELSE 1 END AS n FROM (SELECT DISTINCT feature FROM c) f UNION ALL SELECT 'short', 1 UNION ALL SELECT '?bad', 1""", "cells")
def matrix_ids(spark, d):
    return FM.feature_ids(spark, _matrix_file(spark, d)).groupBy("feature").agg(F.count("*").alias("n"))


@query(_FILE + """ SELECT concat('s', CAST(sample AS VARCHAR)) AS name, row_number() OVER (ORDER BY sample) AS place FROM (SELECT DISTINCT sample FROM c) s UNION ALL SELECT 'ID', 0""", "cells")
def matrix_header(spark, d):
    return FM.headers(spark, _matrix_file(spark, d)).select(F.posexplode("names").alias("place", "name")).select("name", F.col("place").cast("long").alias("place"))


@query("SELECT 3 AS n_features, 3 AS n_samples, 9 AS n_cells, 9 AS n_equal")
def matrix_sampled(spark, d):
    path = _matrix_file(spark, d)
    drawn, full = FM.read_matrix(spark, path, first_rows=4, sampled=3), FM.read_matrix(spark, path)
    both = drawn.join(full.select("feature", "sample", F.col("value").alias("whole")), ["feature", "sample"], "left")
    return both.agg(F.countDistinct("feature").alias("n_features"), F.countDistinct("sample").alias("n_samples"), F.count("*").alias("n_cells"), F.sum(F.col("value").eqNullSafe(F.col("whole")).cast("long")).alias("n_equal"))


@query(_FILE + " SELECT concat('g', CAST(feature AS VARCHAR)) AS feature, concat('s', CAST(sample AS VARCHAR)) AS sample, round(value, 6) AS value FROM m WHERE sample % 2 = 0 AND feature BETWEEN 3 AND 20", "cells")
def matrix_whitelist(spark, d):
    samples = X.cells(spark, d).where("sample % 2 = 0").select(F.concat(F.lit("s"), F.col("sample").cast("string")))
    features = spark.range(3, 21).select(F.concat(F.lit("g"), F.col("id").cast("string")))
    return FM.read_matrix(spark, _matrix_file(spark, d), keep_samples=samples, keep_features=features).select("feature", "sample", r6("value"))


_PROBES = _FILE + """, p AS (SELECT feature, unnest(range(len(g))) AS place, trim(unnest(g)) AS gene FROM (SELECT feature, string_split(CASE WHEN feature % 11 = 0 THEN '.' WHEN feature % 13 = 0 THEN ''
  WHEN feature % 2 = 0 THEN concat('G', CAST(feature % 7 AS VARCHAR), ', H', CAST(feature % 3 AS VARCHAR)) ELSE concat('G', CAST(feature % 7 AS VARCHAR)) END, ',') AS g FROM (SELECT DISTINCT feature FROM c) f))
SELECT rule, gene, concat('s', CAST(sample AS VARCHAR)) AS sample, round(avg(value) * 840, 6) AS value_840 FROM m JOIN p USING (feature) CROSS JOIN (SELECT unnest(['all', 'first']) AS rule) WHERE gene NOT IN ('', '.') AND (rule = 'all' OR place = 0) GROUP BY rule, gene, sample"""


@query(_PROBES, "cells")
def probe_means(spark, d):
    cells = FM.read_matrix(spark, _matrix_file(spark, d))
    f = F.col("id")
    text = lambda c: c.cast("string")
    genes = F.when(f % 11 == 0, ".").when(f % 13 == 0, "").when(f % 2 == 0, F.concat(F.lit("G"), text(f % 7), F.lit(", H"), text(f % 3))).otherwise(F.concat(F.lit("G"), text(f % 7)))
    path = _text(spark.range(50).select(f.alias("ord"), F.concat(F.lit("g"), text(f), F.lit("\t"), genes).alias("line")), "probes")
    probes = FM.probe_map(spark, path)
    out = [FM.probe_means(cells, probes, first_only=first).select(F.lit("first" if first else "all").alias("rule"), "gene", "sample", r6(F.col("value") * 840, "value_840")) for first in (False, True)]  # a mean of up to 8 printed values, times 840, has 6 places
    return out[0].unionByName(out[1])


@query("""WITH g AS (SELECT p_brand AS gene, p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS a, CAST(p_size AS DOUBLE) AS b FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0 AND p_size % 4 >= 1)
SELECT gene, 'a' AS sample, round(avg(a), 6) AS value FROM g GROUP BY gene UNION ALL SELECT gene, 'b', round(avg(b), 6) FROM g GROUP BY gene""")
def protein_group_means(spark, d):
    t, text, key = table(spark, d, "part"), lambda c: F.col(c).cast("string"), F.col("p_partkey")
    flag = lambda n: F.when(key % n == 0, "+").otherwise("")
    price = F.when(key % 5 != 0, text("p_retailprice")).otherwise("0")
    fields = [F.concat(F.lit("P"), text("p_partkey"), F.lit(";X")), F.when(key % 23 == 0, "").otherwise(F.concat("p_brand", F.lit(";other"))), (F.col("p_size") % 4).cast("string"), flag(17), flag(19), F.lit(""), price, text("p_size"), F.lit("9")]
    head = "Protein IDs\tGene names\tUnique peptides\tReverse\tPotential contaminant\tOnly identified by site\tLFQ intensity a\tLFQ intensity b\tIntensity"
    lines = t.select(key.alias("ord"), F.concat_ws("\t", *fields).alias("line")).union(spark.range(1).select(F.lit(-1), F.lit(head))).union(spark.range(1).select(F.lit(1 << 40), F.lit("P0;X\ttruncated")))
    groups = FM.protein_groups(spark, _text(lines, "proteins"), least_peptides=1)
    return FM.protein_means(groups).select("gene", "sample", r6("value"))


@query("""SELECT 'Tumor_Purity' AS "column", count(*) AS n, min(CAST(c_acctbal AS VARCHAR)) AS least FROM customer UNION ALL SELECT 'age at diagnosis', count(*), min(CAST(c_nationkey AS VARCHAR)) FROM customer""")
def clinical_columns(spark, d):
    t = table(spark, d, "customer")
    lines = t.select(F.col("c_custkey").alias("ord"), F.concat_ws("\t", "c_name", F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("line"))
    lines = lines.union(spark.range(1).select(F.lit(-1), F.lit("sampleID\tTumor_Purity\tage at diagnosis\tgroup")))
    return FM.clinical(spark, _text(lines, "clinical"), ["purity", "AGE"]).groupBy("column").agg(F.count("*").alias("n"), F.min("text").alias("least"))


@query("""SELECT domain, subset, pair, method, k, ari + k AS ari, degen, CASE WHEN degen = 1 THEN 0.9 ELSE 0.5 END AS max_fraction, 2 AS n_balance FROM records CROSS JOIN (SELECT unnest([3, 4]) AS k)
UNION ALL SELECT 'F', 'x', 'none', 'failed', NULL, NULL, NULL, NULL, NULL""", "records")
def records_round_trip(spark, d):
    r = X.records(spark, d).withColumn("k", F.explode(F.array(F.lit(3), F.lit(4)))).withColumn("ari", F.col("ari") + F.col("k"))
    flat = r.select("domain", "subset", "pair", "method", F.lit(10).alias("nA"), F.lit(12).alias("nB"), F.lit(50).alias("nfeat"), F.lit(None).cast("string").alias("err"), "k", "ari", "degen", F.array(F.lit(0.1), F.when(F.col("degen") == 1, 0.9).otherwise(0.5)).alias("balance"))
    failed = spark.range(1).select(F.lit("F").alias("domain"), F.lit("x").alias("subset"), F.lit("none").alias("pair"), F.lit("failed").alias("method"), F.lit(0).alias("nA"), F.lit(0).alias("nB"), F.lit(0).alias("nfeat"), F.lit("no shared samples").alias("err"), *[F.lit(None).cast(flat.schema[c].dataType).alias(c) for c in ("k", "ari", "degen", "balance")])
    path = scratch(spark, "records")
    FR.write_records(flat.unionByName(failed), path)
    out = FR.read_records(spark, path, lines=True)
    return out.select("domain", "subset", "pair", "method", "k", "ari", "degen", "max_fraction", F.when(F.col("balance").isNotNull(), F.size("balance")).alias("n_balance"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    t, schema = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey int, n_name string, n_regionkey int"
    path = scratch(spark, "csv")
    FR.write_csv(t, path, gzip=True)
    return FR.read_csv(spark, path, schema).unionByName(FR.read_csv(spark, path + "-missing", schema))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS row, 'name' AS \"column\", n_name AS text FROM nation UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), 'region', CAST(n_regionkey AS VARCHAR) FROM nation")
def sheet_cells(spark, d):
    from pyarrow import fs

    held = table(spark, d, "nation").orderBy("n_nationkey").select("n_name", F.col("n_regionkey").cast("string")).collect()  # 25 rows
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'
    rows = [("name", "region"), *map(tuple, held)]
    body = "".join(f'<row r="{i}">{cell(f"A{i}", a)}{cell(f"C{i}", b)}</row>' for i, (a, b) in enumerate(rows, 1))
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    path = scratch(spark, "sheets")
    system, local = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    system.create_dir(local, recursive=True)
    with system.open_output_stream(f"{local}/one.xlsx") as out:
        out.write(made.getvalue())
    return FS.read_sheets(spark, path).select("row", "column", "text")


@query("SELECT concat('b', CAST(batch AS VARCHAR)) AS array, feature AS i, sample AS j, round(value, 6) AS value FROM design WHERE value IS NOT NULL", "design")
def arrays_round_trip(spark, d):
    path = scratch(spark, "arrays")
    cells = X.design(spark, d).select(F.concat(F.lit("b"), F.col("batch").cast("string")).alias("array"), F.col("feature").alias("i"), F.col("sample").alias("j"), "value")
    FS.write_arrays(cells, path if "://" in path else f"file://{path.removeprefix('file:')}").collect()  # a row for each array
    out = FS.read_arrays(spark, path).where("value is not null")
    return out.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("array"), "i", "j", r6("value"))


@query("""WITH s AS (SELECT 'r' AS folder, sum(octet_length(encode(r_name)) + 1) AS bytes FROM region UNION ALL SELECT 'n', sum(octet_length(encode(n_name)) + 1) FROM nation UNION ALL SELECT 's', sum(octet_length(encode(s_name)) + 1) FROM supplier)
SELECT row_number() OVER (ORDER BY bytes DESC) AS place, folder, CAST(bytes AS BIGINT) AS bytes FROM s ORDER BY bytes DESC LIMIT 2""")
def file_listing(spark, d):
    path = scratch(spark, "listing")
    for name, t, c in (("r", "region", "r_name"), ("n", "nation", "n_name"), ("s", "supplier", "s_name")):
        table(spark, d, t).select(c).coalesce(1).write.text(f"{path}/{name}")
    from pyspark.sql import Window

    out = FR.list_files(spark, path, r"part-[^/]*\.txt$", top=2)
    return out.select(F.row_number().over(Window.orderBy(F.desc("bytes"))).alias("place"), F.regexp_extract("path", r"([a-z])/part-", 1).alias("folder"), "bytes")


@query("SELECT domain, count(*) AS n, round(sum(ari + CASE WHEN domain = 'O' THEN 1 ELSE 0 END), 4) AS total FROM records GROUP BY domain", "records")
def append_units(spark, d):
    path, r = scratch(spark, "units"), X.records(spark, d)
    FR.append_units(r, path, ("domain",))
    FR.append_units(r.where("domain = 'O'").withColumn("ari", F.col("ari") + 1), path, ("domain",))
    return spark.read.parquet(path).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.sum("ari"), 4).alias("total"))
