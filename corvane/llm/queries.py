"""Queries of the training-data operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import classifier, decontam, langid, licenses, neardup, packing, records, rules, shared, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')"

ORACLE["op3_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(len(w) - {decontam.SPAN - 1})) AS p FROM d WHERE len(w) >= {decontam.SPAN}),
bp AS (SELECT item_id, w, unnest(range(len(w) - {decontam.SPAN - 1})) AS q FROM b WHERE len(w) >= {decontam.SPAN}),
dg AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {decontam.SPAN}], ' ') AS g FROM dp),
bg AS (SELECT item_id, q, array_to_string(w[q + 1 : q + {decontam.SPAN}], ' ') AS g FROM bp),
m AS (SELECT doc_id, item_id, p, p - q AS diagonal FROM dg JOIN bg USING (g)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM m),
s AS (SELECT doc_id, item_id, min(p) AS start, count(*) + {decontam.SPAN - 1} AS n FROM r GROUP BY doc_id, item_id, diagonal, run)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS spans, CAST(max(n) AS INTEGER) AS longest,
       CAST(arg_min(start, struct_pack(a := -n, b := start)) AS INTEGER) AS start
FROM s GROUP BY doc_id, item_id
"""


@query
def spans_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_decontamination gives, by the join of fingerprints that a benchmark of any size takes."""
    return decontam.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), broadcast_bytes=0)


ORACLE["spans_by_join"] = ORACLE["op3_decontamination"]


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "archive")
    warc.write_archive(warc.records_of(table(spark, sf_dir, "pages")), path)
    rebuilt = warc.read_archive(spark, path)
    return rebuilt.select(F.col("record_id").alias("page_id"), "digest", "verified", "n_bytes", F.col("record").cast("string").alias("record"))


ORACLE["op5_warc"] = r"""
WITH p AS (SELECT page_id, url, html, sha256(html) AS digest, octet_length(encode(html)) AS n FROM pages),
r AS (SELECT page_id, digest, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || digest || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Length: ' || n || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p)
SELECT page_id, digest, TRUE AS verified, CAST(octet_length(encode(record)) AS BIGINT) AS n_bytes, record FROM r
"""


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def _count(pattern: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"


_CLASS_SQL = {
    "lower": _count("[a-z]"), "upper": _count("[A-Z]"), "digit": _count("[0-9]"), "space": _count(r"[ \t\n\v\f\r]"),
    "mark": _count(r"[.,;:!?''\"()-]"), "other": _count(r"[^\x00-\x7F]"),
}


def _distance_sql(group: str, source: str, name: str) -> str:
    """Jensen-Shannon distance from rows (group, p, q) of shares."""
    part = "CASE WHEN {0} > 0 THEN -{0} * log2({0}) ELSE 0 END"
    m, p, q = (part.format(x) for x in ("((p + q) / 2)", "p", "q"))
    return f"SELECT {group}, round(sqrt(greatest(sum({m}) - (sum({p}) + sum({q})) / 2, 0)), 4) AS {name} FROM {source} GROUP BY {group}"


ORACLE["op6_quality_rules"] = rf"""
WITH k AS (SELECT doc_id, lang, {', '.join(f'{v} AS c_{k}' for k, v in _CLASS_SQL.items())}, length(text) AS n_chars, {WORDS} AS w FROM documents),
c AS (SELECT *, n_chars - c_lower - c_upper - c_digit - c_space - c_mark - c_other AS c_symbol, len(w) AS n_words FROM k),
cl AS (SELECT doc_id, lang, n_chars, class, n FROM c UNPIVOT (n FOR class IN (c_lower, c_upper, c_digit, c_space, c_mark, c_symbol, c_other))),
cr AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cl GROUP BY lang, class),
cp AS (SELECT doc_id, n / n_chars AS p, q FROM cl JOIN cr USING (lang, class) WHERE n_chars >= {rules.MIN_CHARS}),
cd AS ({_distance_sql('doc_id', 'cp', 'class_distance')}),
dw AS (SELECT doc_id, lang, unnest(w) AS word FROM c),
wc AS (SELECT lang, word, count(*) AS n FROM dw GROUP BY lang, word),
wr AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS q, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM wc),
top AS (SELECT lang, word, q FROM wr WHERE place <= {rules.COMMON}),
bins AS (SELECT lang, word, q FROM top UNION ALL SELECT lang, NULL, 1 - sum(q) FROM top GROUP BY lang),
dc AS (SELECT dw.doc_id, top.word, count(*) AS n FROM dw LEFT JOIN top ON dw.lang = top.lang AND dw.word = top.word GROUP BY dw.doc_id, top.word),
wp AS (SELECT c.doc_id, coalesce(dc.n, 0) / c.n_words AS p, bins.q FROM c JOIN bins ON c.lang = bins.lang
       LEFT JOIN dc ON dc.doc_id = c.doc_id AND dc.word IS NOT DISTINCT FROM bins.word WHERE c.n_words >= {rules.MIN_WORDS}),
wd AS ({_distance_sql('doc_id', 'wp', 'word_distance')})
SELECT doc_id, lang, n_chars, n_words, class_distance, word_distance,
       n_words > 0 AND coalesce(class_distance <= {rules.MAX_CLASS_DISTANCE}, TRUE) AND coalesce(word_distance <= {rules.MAX_WORD_DISTANCE}, TRUE) AS keep
FROM c LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
"""


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


#: The list of op9_url_filter: pages of hosts with a hyphen in their first label, after "www.", "m." or "blog.".
LISTED = r"//(?:www\.|m\.|blog\.)?[^/:?#.]*-"


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filtered(pages, pages.where(F.col("url").rlike(LISTED)).select("url"))


ORACLE["op9_url_filter"] = rf"""
WITH a AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
b AS (SELECT page_id, url, bare, regexp_replace(lower(regexp_extract(bare, '{urlfilter.AUTHORITY}({urlfilter.HOST})', 1)), '^www\.', '') AS host,
  regexp_replace(regexp_extract(bare, '{urlfilter.AUTHORITY}{urlfilter.HOST}(:[0-9]*)', 1), '^:(?:80|443)?$', '') AS port,
  regexp_replace(regexp_replace(regexp_extract(bare, '{urlfilter.AUTHORITY}[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{urlfilter.TRACKING}'))) AS q FROM a),
c AS (SELECT page_id, url, CASE WHEN host <> '' THEN host || port || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM b),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(url, '{LISTED}'))
SELECT page_id, canonical, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) AS blocked FROM c
"""


@query
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_records(table(spark, sf_dir, "documents"), shared.new_path(spark, "tokens"))
