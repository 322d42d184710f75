"""One query for each operator, and the SQL of those that SQL can express.

A query takes (spark, sf_dir), applies its operator with production parameters to the
whole table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, html, langid, licenses, minhash, mixing, quality, urls
from .stage import NOT_SPACE, SPACE


def tokenizer() -> tuple[str, str]:
    """Path of the ranks, and the pattern that goes with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = chat.rotate(table(spark, sf_dir, "conversations"))
    return seen.withColumnsRenamed({"start": "start_char", "end": "end_char"})


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), *tokenizer())


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID of web pages, with all four kinds of evidence."""
    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    rows = pages.select(
        "page_id",
        "url",
        langid.declared_in(F.col("html")).alias("declared"),
        urls.host_of(F.col("url")).alias("host"),
        text.alias("text"),
    )
    model = langid.train(table(spark, sf_dir, "documents"))
    return langid.identify(rows, model, key="page_id", declared="declared", address="url", host="host")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_source_mixing, op3_language_id, op4_byte_bpe, op5_order_minhash, op6_html_extraction,
        op7_quality_rules, op8_embedding_dedup, op9_url_filters, op10_license_scan, page_language_id,
    )
}

_SPACE, _WORD = SPACE, NOT_SPACE

_OP1 = r"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS name, coalesce(text, '') AS text
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, name AS perspective FROM said WHERE name <> 'system'),
seen AS (
  SELECT said.*, perspective, name = perspective AS mask,
         CASE WHEN name = perspective THEN '<|assistant|>' WHEN name = 'system' THEN '<|system|>'
              ELSE '<|user name=' || name || '|>' END || chr(10) || text || chr(10) AS rendered
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM seen)
SELECT conv_id, perspective, turn, CASE WHEN mask THEN 'assistant' WHEN name = 'system' THEN name ELSE 'user' END AS role,
       name, rendered, mask, CAST(upto - length(rendered) AS BIGINT) AS start_char, CAST(upto AS BIGINT) AS end_char
FROM placed
"""

MIX_CTES = rf"""
sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM {{docs}}),
placed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][1 + place % 3] AS DOUBLE) AS weight FROM placed),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, place) AS k FROM weighed),
clamped AS (
  SELECT k, (SELECT sum(source_size) FROM weighed) - coalesce(sum(3 * source_size) OVER w, 0) AS free,
         (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS weights, 3 * source_size / weight AS ratio
  FROM ranked WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT CAST(free AS DOUBLE) / weights AS share FROM clamped WHERE CAST(free AS DOUBLE) / weights <= ratio ORDER BY k LIMIT 1),
filled AS (
  SELECT weighed.*, least(coalesce((SELECT share FROM share), 0) * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM weighed),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM filled),
keyed AS (
  SELECT source, key, sum(size) AS n FROM sizes GROUP BY ALL),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
mixed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         p.whole + CASE WHEN p.target - p.whole * p.source_size > 0 AND u.upto - u.n / 2 <= p.target - p.whole * p.source_size
                        THEN 1 ELSE 0 END AS copies
  FROM sizes s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
  JOIN upto u ON s.source IS NOT DISTINCT FROM u.source AND s.key = u.key)
"""

_OP2 = f"WITH {MIX_CTES.format(docs='documents')} SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM mixed"

_OP7 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(3) AS t(j) GROUP BY r),
split AS (SELECT r, unnest(lines) AS line FROM docs),
judged AS (
  SELECT r, line, len(regexp_extract_all(line, '{_WORD}+')) AS n, regexp_matches(line, '{_WORD}') AS spoken,
         len(regexp_extract_all(line, '{quality.MENU}')) AS menus, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         regexp_matches(line, '[.!?…。！？:;;]["''”’»)\]]*{_SPACE}*\z') OR len(regexp_extract_all(line, '{_WORD}+')) >= {quality.LONG} AS ended,
         len(regexp_extract_all(lower(line), '{"|".join(quality.BOILERPLATE)}')) AS phrases FROM split),
summed AS (
  SELECT r, count(*) FILTER (spoken) - count(DISTINCT line) FILTER (spoken) AS n_dup_lines,
         coalesce(sum(n) FILTER (spoken AND NOT (ended AND NOT (menus > 0 AND menus * 3 >= n) AND symbols <= n
           AND NOT (phrases > 0 AND (n < {quality.LONG} OR phrases * {quality.WORDS_OF_PHRASE} >= n)))), 0) AS lost
  FROM judged GROUP BY r),
final AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, lost
  FROM docs JOIN summed USING (r) LEFT JOIN repeated USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept, CAST(lost AS BIGINT) AS n_lost_words
FROM final
"""

_OP8 = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, min({'label': label, 'e': list_transform(embedding, lambda x: CAST(x AS DOUBLE))}) AS f FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
named AS (SELECT vec_id, f.label AS label, f.e AS e FROM good),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM named a JOIN named b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_reached AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u),
final AS (
  SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(v, vec_id)) AS BIGINT) AS component_id
  FROM embeddings LEFT JOIN degree ON vec_id = degree.u LEFT JOIN least_reached ON vec_id = least_reached.u)
SELECT *, vec_id = component_id AS kept FROM final
"""

_PLACES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.PLACES)
_PATTERNS = " OR ".join(f"regexp_matches(host || path, '{p}')" for p in urls.PATTERNS)
_OP9 = rf"""
WITH rules(verdict, h, p) AS (VALUES {_PLACES}),
places AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
fits AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_PATTERNS} THEN 'block' ELSE 'allow' END) AS verdict
FROM places LEFT JOIN fits USING (r)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(
    [f"({_quoted('phrase:' + t)}, {_quoted(label)}, 2, {_quoted(t)})" for t, label in licenses.PHRASES.items()]
    + [f"({_quoted('text:' + label)}, {_quoted(label)}, 5, {_quoted(t)})" for label, t in licenses.TEMPLATES.items()]
)


def _cut(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_OP10 = rf"""
WITH known(template, label, k, text) AS (VALUES {_KNOWN}),
kwords AS (SELECT template, label, k, {_cut('text')} AS w FROM known),
tgrams AS (
  SELECT template, label, k, len(w) - k + 1 AS n_grams, i AS tplace, array_to_string(w[i + 1 : i + k], ' ') AS gram
  FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM kwords)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_cut('text')} AS w FROM documents),
ks(k) AS (VALUES (2), (5)),
grams AS (
  SELECT r, k, i AS place, array_to_string(w[i + 1 : i + k], ' ') AS gram
  FROM (SELECT r, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM docs, ks)),
hits AS (SELECT r, template, label, k, n_grams, place, tplace, place - tplace AS diagonal FROM grams JOIN tgrams USING (k, gram)),
opened AS (
  SELECT *, CASE WHEN k = 2 THEN CAST(dense_rank() OVER (PARTITION BY r, template ORDER BY diagonal) AS INT)
                 WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal, place) <= 4 THEN 0 ELSE 1 END AS opens FROM hits),
spanned AS (
  SELECT *, CASE WHEN k = 2 THEN opens ELSE sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal, place
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS span FROM opened),
merged AS (
  SELECT r, template, label, k, n_grams, span, count(DISTINCT tplace) AS held, min(place) AS first_place
  FROM spanned GROUP BY r, template, label, k, n_grams, span),
believed AS (SELECT * FROM merged WHERE held >= CASE WHEN k = 2 THEN n_grams ELSE least({licenses.COVERAGE} * n_grams, {licenses.PASSAGE}) END),
per AS (
  SELECT r, count(*) FILTER (k = 2) AS n_base, min(first_place) FILTER (k = 2) AS first_word, max(first_place) FILTER (k = 2) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k = 2) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(held / n_grams) AS score FROM believed GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN per USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _OP1,
    "op2_source_mixing": _OP2,
    "op7_quality_rules": _OP7,
    "op8_embedding_dedup": _OP8,
    "op9_url_filters": _OP9,
    "op10_license_scan": _OP10,
}
