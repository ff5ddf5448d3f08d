"""The registered corpus queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import make_importable, table


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.line_spread import remove_spread_lines

    out = remove_spread_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.col("text").alias("text"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.mixing import mixing_query

    return mixing_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.language_id import language_query

    return language_query(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.lm_score import lm_query

    return lm_query(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cohortlens.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.toxicity import toxicity_query

    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.neighbours import neighbour_query

    return neighbour_query(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.spelling import spelling_query

    return spelling_query(table(spark, sf_dir, "documents"))


#: A-Z to a-z and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.root = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM v),
t AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g
  FROM d CROSS JOIN k WHERE len(w) >= n),
h AS (SELECT doc_id, item_id, t.n, i FROM t JOIN v USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""

OP10_SQL = """
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
marked AS (
  SELECT doc_id, pos, line, length(trim(line)) >= 16 AS long_enough,
         count(*) OVER (PARTITION BY trim(line)) AS n_occ,
         row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) AS rn, source FROM pieces),
spread AS (
  SELECT trim(line) AS line, count(DISTINCT source) AS sites FROM pieces GROUP BY 1),
judged AS (
  SELECT m.doc_id, m.pos, m.line, m.long_enough AND s.sites >= 8 AND m.rn > 1 AS removed
  FROM marked m JOIN spread s ON trim(m.line) = s.line),
clean AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE c.text END AS text
FROM documents d LEFT JOIN clean c ON d.doc_id = c.doc_id
"""

#: The CRC is taken byte by byte with the usual table; near words share a mask of one position, or one is the other without a code point.
OP12_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
found AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM found WHERE length(w) >= 6 GROUP BY ALL),
spelt AS (
  SELECT doc_id, w, n, list_concat([4294967295], flatten(list_transform(string_split(concat(CAST(doc_id AS VARCHAR), ':', w), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))) AS b FROM counted),
hashed AS (
  SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM spelt CROSS JOIN crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN concat(substring(w, 1, h % length(w)), substring(w, h % length(w) + 2)) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word UNION
  SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest UNION
  SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (
  SELECT word, other, n AS m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS rn FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND rn = 1),
walk AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return {name: (lambda spark, sf_dir, f=f: f(make_importable(spark), sf_dir)) for name, f in sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op10_line_spread": OP10_SQL, "op12_spelling": OP12_SQL}
