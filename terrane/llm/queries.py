"""The queries of the corpus operators: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontam, licenses, packing, pii, quality, secret_scan, sharding, simhash, tokencount, url_filter
from terrane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 decides without the trees."""
    d = url_filter.judged(table(spark, sf_dir, "pages"))
    return d.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts without the trees."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op4."""
    return op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 counts, without the verdict."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 without checksums and slots."""
    return op5_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "grown_shard")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pii, op2_url_filters, op3_decontamination, op4_secret_scans, op5_sharding, op6_quality_rules, op7_license_scans, op8_best_fit_packing, op9_simhash_near_dedup, op10_token_counts, url_rules, pii_base, secret_base, quality_base, jump_shards)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RULES = ", ".join(f"({h!r}, {p!r}, {v!r})" for h, p, v in url_filter.RULES)
_LUHN = "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[len(d) - i]::INT WHEN d[len(d) - i]::INT > 4 THEN 2 * d[len(d) - i]::INT - 9 ELSE 2 * d[len(d) - i]::INT END)) % 10 = 0"
_T = "coalesce(text, '')"
_KEY = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 15))::HUGEINT"


def _jump(shards: int) -> str:
    """The jump hash, a step a round; b is the last place before the jump that leaves."""
    return f"j{shards} AS (SELECT key AS k, key, -1::BIGINT AS b, 0::BIGINT AS j FROM keys UNION ALL SELECT k, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n >> 33) + 1)::DOUBLE))::BIGINT FROM (SELECT k, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM j{shards} WHERE j < {shards}))"


#: The ten queries but op3 have no SQL form for all their columns: models, XXH64, CRC-32, tokenizers. Tests hold them against brute force;
#: what SQL can express of op1, op2, op4, op5 and op6 is compared here.
ORACLE_SQL: dict[str, str] = {
    "url_rules": f"""WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, translate(h, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, path FROM u), r(h, pre, verdict) AS (VALUES {_RULES}),
m AS (SELECT page_id, arg_max(r.h || r.pre, len(r.h || r.pre)) AS rule, arg_max(verdict, len(r.h || r.pre)) AS verdict FROM p JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN m ON p.page_id = m.page_id""",
    "pii_base": f"""WITH m AS (SELECT doc_id, len(regexp_extract_all({_T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all({_T}, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ip,
list_transform(regexp_extract_all({_T}, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all({_T}, '\\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM documents)
SELECT doc_id, n_email::BIGINT AS n_email, len(list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS HUGEINT), 999) <= 255))))::BIGINT AS n_ip,
len(list_filter(card, lambda d: len(d) BETWEEN 14 AND 19 AND {_LUHN}))::BIGINT AS n_card, len(list_filter(phone, lambda d: len(d) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM m""",
    "secret_base": f"""SELECT doc_id, len(list_filter(regexp_extract_all({_T}, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 8))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all({_T}, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16))::BIGINT AS n_access, len(list_filter(regexp_extract_all({_T}, '[0-9a-f]+'), lambda x: len(x) >= 32))::BIGINT AS n_hex FROM documents""",
    "quality_base": f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_T} AS t, regexp_extract_all({_T}, '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d)), twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM win) WHERE n > 1),
hit AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k),
q AS (SELECT d.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(hit.n, 0) AS n FROM d LEFT JOIN hit USING (k))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * n > 30 * len(w) AS base_failed FROM q""",
    "jump_shards": f"""WITH RECURSIVE keys AS (SELECT DISTINCT {_KEY} AS key FROM documents), {_jump(16)}, {_jump(17)},
a AS (SELECT k, max(b) AS shard FROM j16 WHERE b < 16 GROUP BY k), g AS (SELECT k, max(b) AS shard FROM j17 WHERE b < 17 GROUP BY k)
SELECT doc_id, (strlen({_T}) + 1)::BIGINT AS size, 'key' AS law, a.shard::INT AS shard, g.shard::INT AS grown_shard FROM documents JOIN a ON a.k = {_KEY} JOIN g ON g.k = {_KEY}""",
    "op3_decontamination": f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins))),
met AS (SELECT doc_id, places.k AS k, i, item_id FROM places JOIN wins ON places.k = wins.k AND places.win = wins.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
