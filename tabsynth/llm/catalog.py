"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_languages

    return predict_languages(spark, table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(spark, table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import code_digests

    return code_digests(spark, table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page shows the document whose number is in its path
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*?://[^/?#]*[^?#]*?/([0-9]{1,18})", 1)
    shown = pages.select("url", F.when(number != "", number).cast("bigint").alias("doc_id"))
    labelled = shown.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(spark, pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"), order=3)


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import rank_documents

    return rank_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data_digest

    return personal_data_digest(spark, table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants

    return group_variants(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_document_fingerprints, op3_license_scan, op4_best_fit_packing, op5_simhash_near_dup,
        op6_bpe_codec, op7_exact_dedup, op8_url_filter, op9_lm_scoring, op10_warc_bundles, op11_lexical_search, op12_personal_data,
        op13_spelling_variants)
}

ORACLE: dict[str, str] = {}

ORACLE["op7_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

ORACLE["op8_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
toks AS (
  SELECT *, list_distinct(list_filter([
    CASE WHEN host <> '' THEN 'host=' || host END,
    CASE WHEN host <> '' THEN 'domain=' || array_to_string(string_split(host, '.')[-2:], '.') END,
    CASE WHEN string_split(host, '.')[1] <> '' THEN 'first=' || string_split(host, '.')[1] END,
    CASE WHEN string_split(host, '.')[2] <> '' THEN 'second=' || string_split(host, '.')[2] END,
    CASE WHEN regexp_extract(path, '^/([^/]+)/', 1) <> '' THEN 'dir=' || regexp_extract(path, '^/([^/]+)/', 1) END,
    CASE WHEN regexp_extract(path, '\.([A-Za-z0-9]{1,8})$', 1) <> '' THEN 'ext=' || lower(regexp_extract(path, '\.([A-Za-z0-9]{1,8})$', 1)) END,
    CASE WHEN regexp_extract(u, '(?s)\?([^#]*)', 1) <> '' THEN 'keys=' || array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(u, '(?s)\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]))), '+') END,
    CASE WHEN contains(u, '#') THEN 'fragment' END], lambda x: x IS NOT NULL)) AS tokens
  FROM parts),
labelled AS (
  SELECT row_number() OVER () AS k, tokens, (quality = 0 OR toxic = 1) AS bad
  FROM toks JOIN labels ON labels.doc_id = try_cast(nullif(regexp_extract(u, '^[^?#]*?://[^/?#]*[^?#]*?/([0-9]{1,18})', 1), '') AS bigint)
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL AND len(tokens) > 0),
-- every non-empty set of a URL's tokens, by the bits of a number
sets AS (
  SELECT k, bad, list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS terms
  FROM (SELECT k, bad, list_sort(tokens) AS tokens, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS mask FROM labelled)),
freq AS (SELECT terms, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM sets GROUP BY terms),
-- a rule that a smaller one makes needless changes no verdict, so none is pruned here
kept AS (
  SELECT terms FROM freq
  WHERE n_bad >= ceil(0.005 * (SELECT count(*) FROM labelled)) AND n_bad / n >= 0.5),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    EXISTS (SELECT 1 FROM kept WHERE list_has_all(tokens, kept.terms)) AS mined
  FROM toks)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN mined THEN 'block' ELSE 'allow' END END AS verdict
FROM judged
"""

ORACLE["op11_lexical_search"] = r"""
WITH tokens AS (
  SELECT doc_id, row_number() OVER () AS k,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
docs AS (SELECT *, len(terms) AS n FROM tokens WHERE len(terms) > 0),
total AS (SELECT count(*) AS nn, sum(n) AS ll FROM docs),
items AS (
  SELECT i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))),
tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(terms) AS t FROM docs) WHERE t IN (SELECT t FROM items) GROUP BY k, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
scores AS (
  SELECT i, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll))))) AS BIGINT) AS score
  FROM items JOIN tf USING (t) JOIN weights USING (t) JOIN docs USING (k), total GROUP BY i, item_id, k, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
