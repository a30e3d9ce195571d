"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import chat, decontam, divergence, exact, jaccard, lines, mixing, ngram, pii, spelling, suffixes, toxicity, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers, comma-joined."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    found = lines.line_decisions(rows)
    return found.select(F.col("_id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op5_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), n=4, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_texts(read(spark, sf_dir, "documents"), toxicity.held_out("doc_id", 10))


def op10_link_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message; path as text, the message in a chat template."""
    found = chat.link_quotes(read(spark, sf_dir, "conversations"))
    path = F.array_join(F.transform("path", lambda t: F.lpad(t.cast("string"), 10, "0")), "/")
    return found.withColumn("path", path).withColumn("chat", chat.chat_text(F.col("role"), F.col("body"))).drop("body")


def op11_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


def op12_group_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read(spark, sf_dir, "documents"))


#: Host, path and verdict of the rules on pages.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_mix_sources, op3_toxicity, op4_suffix_dedup, op5_find_pii, op6_decontaminate, op7_jaccard_join, op8_exact_dedup, op9_lm_scores, op10_link_quotes, op11_audit_sources, op12_group_spellings, op13_judge_urls)}


OP8_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS r,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM w
"""


#: For messages that quote nothing, which the tables given hold; quotations are tested on fixtures.
OP10_SQL = """
SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS n_quotes, CAST(0 AS BIGINT) AS n_linked,
       CAST(NULL AS BIGINT) AS reply_to, CAST(0 AS BIGINT) AS depth, lpad(CAST(turn AS VARCHAR), 10, '0') AS path,
       '<|' || coalesce(role, 'user') || '|>' || chr(10)
         || regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: rtrim(x)), chr(10)), '^\\s*\\n|\\s+$', '', 'g')
         || chr(10) AS chat
FROM conversations
"""


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS (SELECT lang, source, (SELECT count(*) FROM kept k WHERE k.lang = x.lang) AS v FROM (SELECT DISTINCT lang, source FROM d) x),
c AS (SELECT g.lang, g.source, g.v, k.term, coalesce(n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3) o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT *, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p,
      CAST(1 + (1000000000 * CAST(sum(n) OVER (PARTITION BY lang, term) + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q FROM c),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT i.lang, i.source AS l, j.source AS r, sum(abs(i.p - j.p)) AS value FROM s i JOIN s j ON i.lang = j.lang AND i.term = j.term GROUP BY 1, 2, 3) x
         ON x.lang = a.lang AND x.l = a.source AND x.r = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: crc32 byte by byte, bit by bit; the letters of a run have one byte, or C3 and the code point less 64.
OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+') AS runs
  FROM documents
), r AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(runs) AS run FROM d) WHERE length(run) >= 5 GROUP BY 1, 2),
b AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda y: CAST(y AS BIGINT))), lambda c, y: list_reduce([xor(c, y), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h FROM b),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
         UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(down := -near_n, near := near)) AS b FROM pair GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.down >= 2 * w.n THEN b.near END AS form, CASE WHEN -b.down >= 2 * w.n THEN -b.down END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS tip FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.tip = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, tip FROM walk JOIN f ON walk.tip = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(ends.tip, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON f.word = ends.word
"""

OP13_SQL = """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op10_link_quotes": OP10_SQL, "op11_audit_sources": OP11_SQL, "op12_group_spellings": OP12_SQL, "op13_judge_urls": OP13_SQL}
