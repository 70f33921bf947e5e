"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.llm import embedding_dedup, line_dedup, minhash, mixing, pieces, quality, rules, token_counts, toxicity, url_filter
from strataledger.llm.common import crc_mod, cut, table

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _judged(packed: DataFrame, held_out) -> DataFrame:
    return packed.select(
        F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return _judged(toxicity.score_toxicity(docs, model), crc_mod(F.col("row.doc_id"), 5) == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), max_epochs=3.0)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, round_trip (decoding gives the text back, U+2581 in it read as blank), ids."""
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return encoded.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return _judged(quality.score_quality(docs, model), crc_mod(F.col("row.doc_id"), 3) == 1)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_quality(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_counts.cache_of(spark, f"{sf_dir}/documents")  # what an earlier run on this table has counted is not encoded again
    return token_counts.token_counts(table(spark, sf_dir, "documents"), cache)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("clean_text").alias("text"), "n_lines", "n_dropped")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op10 with a crawler's redirects: the tables hold none, so every page whose id 3 divides stands for one to the page of 7/10 its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    source = pages.where("page_id % 3 = 0").select(F.col("url").alias("src_url"), F.expr("page_id * 7 div 10").alias("to"))
    edges = source.join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("dst_url")), "to").select("src_url", "dst_url")
    judged = url_filter.judge_urls(pages, URL_RULES, edges)
    return judged.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_sentencepiece, op4_quality, op5_embedding_dedup, op6_minhash, op7_quality_rules, op8_token_counts, op9_line_dedup, op10_url_filter, url_redirects, pipeline)}


#: white space of the line rule in DuckDB's regular expressions
_WS = r"[\x20\x09-\x0D]"

OP7_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
pos AS (SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT row_id, i, list(word) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM pos),
again AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM win WHERE len(win) = 8),
covered AS (SELECT row_id, count(DISTINCT spot) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS spot FROM again WHERE n > 1) GROUP BY row_id),
lines AS (SELECT row_id, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM t),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT row_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY row_id),
often AS (SELECT source, norm FROM worded GROUP BY source, norm HAVING count(DISTINCT doc_id) > {rules.MAX_DOCS}),
removed AS (SELECT row_id, sum(worded.n) AS n FROM worded JOIN often ON worded.norm = often.norm AND worded.source IS NOT DISTINCT FROM often.source GROUP BY row_id),
f AS (SELECT t.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed
  FROM t JOIN w USING (row_id) LEFT JOIN dup USING (row_id) LEFT JOIN covered USING (row_id) LEFT JOIN removed USING (row_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed, n_removed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words) AND n_removed <= n_words * {rules.MAX_REMOVED} AS kept
FROM f
"""

OP9_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, source, text FROM documents),
lines AS (SELECT row_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t),
n AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has,
  translate(trim(regexp_replace(line, '{_WS}+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM lines),
total AS (SELECT source, count(*) AS pages FROM t GROUP BY source),
bad AS (SELECT n.source, norm FROM n JOIN total ON n.source IS NOT DISTINCT FROM total.source WHERE has GROUP BY n.source, norm, pages
  HAVING count(DISTINCT row_id) >= {line_dedup.MIN_PAGES} AND count(DISTINCT row_id) > pages * CAST({line_dedup.MAX_RATIO} AS DOUBLE)),
marked AS (SELECT n.*, n.has AND bad.norm IS NOT NULL AS bad FROM n LEFT JOIN bad ON n.norm = bad.norm AND n.source IS NOT DISTINCT FROM bad.source),
made AS (SELECT row_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text, count(*) FILTER (WHERE has) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped FROM marked GROUP BY row_id)
SELECT t.doc_id, made.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM t LEFT JOIN made USING (row_id)
"""

_RULES_SQL = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)

def _url_sql(more: str = "") -> str:
    return rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {_RULES_SQL}),
page AS (SELECT row_number() OVER () AS row_id, page_id, url, coalesce(html, '') AS html FROM pages),
links AS (SELECT url AS base, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM page WHERE url IS NOT NULL
  UNION ALL SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM page WHERE url IS NOT NULL),
clean AS (SELECT base, replace(trim(link), '&amp;', '&') AS link FROM links),
absolute AS (SELECT base, CASE WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN regexp_extract(base, '(?s)^(.*?)://', 1) || ':' || link
  WHEN link LIKE '/%' THEN regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) || link
  WHEN link <> '' THEN rtrim(regexp_extract(base, '(?s)^(.*?://[^/?#]*(?:/(?:[^?#/]*/)*)?)', 1), '/') || '/' || link END AS target FROM clean{more}),
ends AS (SELECT base AS s, target AS d FROM absolute WHERE target LIKE '%://%' AND base LIKE '%://%'),
parts(url, node) AS (SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1)
  FROM (SELECT s AS u FROM ends UNION SELECT d FROM ends UNION SELECT url FROM page WHERE url LIKE '%://%')),
edge AS (SELECT a.node AS a, b.node AS b FROM ends JOIN parts a ON a.url = s JOIN parts b ON b.url = d WHERE a.node <> b.node),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
node_rule AS (SELECT n, max_by(verdict, (length(h || p), verdict = 'allow', h || p)) AS verdict FROM (SELECT DISTINCT b AS n FROM reach)
  JOIN rules ON (split_part(n, '/', 1) = h OR split_part(n, '/', 1) LIKE '%.' || h) AND starts_with(substr(n, length(regexp_extract(n, '^[^/?]*')) + 1), p) GROUP BY n),
alias AS (SELECT reach.a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict FROM reach LEFT JOIN node_rule ON reach.b = node_rule.n GROUP BY reach.a),
split AS (SELECT row_id, page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM page),
own AS (SELECT row_id, max_by(h || p, (length(h || p), verdict = 'allow', h || p)) AS rule, max_by(verdict, (length(h || p), verdict = 'allow', h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(own.verdict, alias.verdict, 'allow') AS verdict
FROM split LEFT JOIN own USING (row_id) LEFT JOIN parts ON parts.url = split.url LEFT JOIN alias ON alias.node = parts.node
"""


_REDIRECTS = " UNION ALL SELECT a.url, b.url FROM pages a JOIN pages b ON a.page_id % 3 = 0 AND b.page_id = a.page_id * 7 // 10"


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_url_filter": _url_sql(), "url_redirects": _url_sql(_REDIRECTS)}
