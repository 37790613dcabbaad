"""The library's registered queries over the standard tables, with DuckDB SQL for those that SQL can express.

Documents stand for chunks in the retrieval queries, benchmark passages for queries;
nations, flags and ship dates of line items are the facts of the audits; assistant turns
of conversations are the answers that are compared and evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import embed
from corvane.functions import periods as P
from corvane.functions import text as T
from corvane.functions.durable import materialize, spread
from corvane.operators import audit, compare, diagnose, evaluate, retrieve, rundiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CONFIG = replace(Config(), dominant_threshold=0.05, required_metadata=("lang", "source", "quality"), low_sim_threshold=0.8, no_match_threshold=0.7)


def query(sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("doc_ord"), "doc_id", F.lit(0).alias("pos"), "text", T.n_words(F.col("text")).alias("token_count"), F.array("source").alias("heading_path"))


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.array().cast("array<string>").alias("expect_docs"), F.col("item_id").alias("query_ord"))


def ranked(spark: SparkSession, sf_dir: str, by: str = "score") -> DataFrame:
    """The ranking that most queries here go on from, made once."""
    return materialize(retrieve.ranked(doc_chunks(spark, sf_dir), bench_queries(spark, sf_dir), CONFIG.top_k, by=by), "ranked")


def six(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double"), 6)


# -- text

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
DOC_WORDS = WORDS.format("text")
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(rf"""
WITH c AS (SELECT len({DOC_WORDS}) AS t, text FROM documents),
s AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, round(CAST(CAST(avg(t) AS FLOAT) AS DOUBLE), 3) AS avg_tokens, CAST(min(t) AS INTEGER) AS min_tokens, CAST(max(t) AS INTEGER) AS max_tokens,
  (SELECT CAST(max(t) AS INTEGER) FROM s WHERE i = floor(0.5 * (n - 1) + 0.5)) AS p50_tokens, (SELECT CAST(max(t) AS INTEGER) FROM s WHERE i = floor(CAST(CAST(0.95 AS FLOAT) * CAST(n - 1 AS FLOAT) AS DOUBLE) + 0.5)) AS p95_tokens,
  count(*) FILTER (t > 1200) AS large_chunks, count(*) FILTER (t < 60) AS small_chunks, count(*) - count(DISTINCT text) AS duplicate_chunks
FROM c
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.chunk_stats(doc_chunks(spark, sf_dir), documents(spark, sf_dir), CONFIG)
    return rows.withColumn("avg_tokens", F.round(F.col("avg_tokens").cast("double"), 3))


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')) AS l FROM documents)
SELECT doc_id, {TRIM.format("regexp_replace(array_to_string(l, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')".replace(chr(92) * 2, chr(92)))} AS text FROM l
""")
def doc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalized(F.col("text")).alias("text"))


@query(rf"""
SELECT doc_id, CASE WHEN t <> '' THEN {TRIM.format("regexp_replace(t, '^#+', '')")} END AS title
FROM (SELECT doc_id, {TRIM.format("regexp_extract(text, '(?m)^[^\\S\\n]*(\\S.*)$', 1)".replace(chr(92) * 2, chr(92)))} AS t FROM documents)
""")
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.title_of(F.col("text")).alias("title"))


@query("SELECT count(*) - count(DISTINCT text) AS duplicate_chunks FROM documents")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.duplicates(documents(spark, sf_dir))


@query(rf"""
SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: {TRIM.format("x")}), lambda x: x <> '')) AS claim_sentences,
  len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;])(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {TRIM.format("x")}), lambda x: x <> '')) AS chunk_sentences
FROM documents
""")
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.size(T.claim_sentences(text)).cast("bigint").alias("claim_sentences"), F.size(T.chunk_sentences(text)).cast("bigint").alias("chunk_sentences"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\s+$', '') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN FALSE WHEN contains('.!?»”', right(t, 1)) THEN FALSE WHEN right(t, 1) IN (',', ';', ':') THEN TRUE
  ELSE NOT regexp_matches(regexp_extract(right(t, 200), '[.!?]\s*([^\s.!?])[^.!?]*$', 1), '^\p{Lu}') END AS cut
FROM t
""")
def ends_mid_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.ends_mid_sentence(F.col("text")).alias("cut"))


BUCKET = "CAST('0x' || substr(sha256({0}), 1, 2) AS INTEGER) % 64"


@query(f"SELECT doc_id, {BUCKET.format('w')} AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({DOC_WORDS}) AS w FROM documents) GROUP BY ALL")
def bow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return spread(rows).select("doc_id", F.posexplode(embed.bow_array(F.col("text"))).alias("bucket", "n")).where("n > 0").withColumn("n", F.col("n").cast("bigint"))


@query(r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS terms, len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS tokens FROM documents
""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.size(T.terms(text)).cast("bigint").alias("terms"), F.size(T.tokens(text)).cast("bigint").alias("tokens"))


# -- retrieval

PAIRS = rf"""
d AS (SELECT doc_id, text, {DOC_WORDS} AS w FROM documents),
q AS (SELECT item_id, text, {DOC_WORDS} AS w FROM benchmark),
db AS (SELECT doc_id, {BUCKET.format('x')} AS b, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
qb AS (SELECT item_id, {BUCKET.format('x')} AS b, count(*) AS n FROM (SELECT item_id, unnest(w) AS x FROM q) GROUP BY ALL),
dn AS (SELECT doc_id, CAST(sqrt(CAST(sum(n * n) AS FLOAT)) AS FLOAT) AS r FROM db GROUP BY doc_id),
qn AS (SELECT item_id, CAST(sqrt(CAST(sum(n * n) AS FLOAT)) AS FLOAT) AS r FROM qb GROUP BY item_id),
dot AS (SELECT item_id, doc_id, CAST(sum(db.n * qb.n) AS FLOAT) AS dot FROM qb JOIN db USING (b) GROUP BY item_id, doc_id),
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS t FROM d),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS t FROM q),
qs AS (SELECT item_id, count(*) AS size FROM qt GROUP BY item_id),
ov AS (SELECT item_id, doc_id, count(*) AS n FROM qt JOIN dt USING (t) GROUP BY item_id, doc_id),
p AS (SELECT q.item_id, d.doc_id, len(d.w) AS token_count,
  CASE WHEN coalesce(qn.r, 0) = 0 OR coalesce(dn.r, 0) = 0 THEN CAST(0 AS FLOAT) ELSE coalesce(dot.dot, CAST(0 AS FLOAT)) / CAST(qn.r * dn.r AS FLOAT) END AS similarity,
  CAST(coalesce(ov.n, 0) AS INTEGER) AS keyword_overlap, CAST(coalesce(ov.n, 0) AS FLOAT) / CAST(greatest(coalesce(qs.size, 0), 1) AS FLOAT) AS share, contains(lower(d.text), lower(q.text)) AS phrase_match
  FROM q CROSS JOIN d LEFT JOIN qn ON qn.item_id = q.item_id LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN dot ON dot.item_id = q.item_id AND dot.doc_id = d.doc_id
  LEFT JOIN ov ON ov.item_id = q.item_id AND ov.doc_id = d.doc_id LEFT JOIN qs ON qs.item_id = q.item_id),
s AS (SELECT *, least(CAST(share * CAST(0.15 AS FLOAT) AS FLOAT), CAST(0.15 AS FLOAT)) AS keyword_boost, CASE WHEN phrase_match THEN CAST(0.08 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS phrase_boost,
  CASE WHEN token_count > 800 THEN least(CAST((CAST(token_count AS FLOAT) - CAST(800 AS FLOAT)) / CAST(800 AS FLOAT) AS FLOAT), CAST(0.3 AS FLOAT)) ELSE CAST(0 AS FLOAT) END AS length_penalty FROM p),
t AS (SELECT *, CAST(CAST(CAST(similarity + keyword_boost AS FLOAT) + phrase_boost AS FLOAT) - length_penalty AS FLOAT) AS score FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM t),
k AS (SELECT * FROM r WHERE rank <= {CONFIG.top_k})"""


@query(f"WITH {PAIRS} SELECT CAST(item_id AS VARCHAR) AS query_id, doc_id, rank, round(CAST(score AS DOUBLE), 6) AS score FROM k")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("query_id", "doc_id", "rank", six("score").alias("score"))


@query(f"""WITH {PAIRS} SELECT CAST(item_id AS VARCHAR) AS query_id, doc_id, rank, round(CAST(similarity AS DOUBLE), 6) AS similarity, keyword_overlap, round(CAST(share AS DOUBLE), 6) AS keyword_overlap_norm,
  round(CAST(keyword_boost AS DOUBLE), 6) AS keyword_boost, phrase_match, round(CAST(phrase_boost AS DOUBLE), 6) AS phrase_boost, CAST(token_count AS INTEGER) AS token_count, CAST(0 AS DOUBLE) AS metadata_boost, round(CAST(length_penalty AS DOUBLE), 6) AS length_penalty FROM k""")
def explain_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = ("similarity", "keyword_overlap_norm", "keyword_boost", "phrase_boost", "metadata_boost", "length_penalty")
    return ranked(spark, sf_dir).select("query_id", "doc_id", "rank", "keyword_overlap", "phrase_match", "token_count", *[six(c).alias(c) for c in real])


TOP = f"""WITH {PAIRS}, b AS (SELECT q.item_id, coalesce(k.score, CAST(0 AS FLOAT)) AS score FROM q LEFT JOIN k ON k.item_id = q.item_id AND k.rank = 1)"""
LOW, NONE = f"score < CAST({CONFIG.low_sim_threshold} AS FLOAT)", f"score < CAST({CONFIG.no_match_threshold} AS FLOAT)"


@query(f"""{TOP} SELECT count(*) AS queries, round(avg(CAST(score AS DOUBLE)), 5) AS avg_top1_similarity, count(*) FILTER ({LOW}) AS low_similarity_queries, count(*) FILTER ({NONE}) AS no_match_queries,
  coalesce(array_to_string(list(item_id ORDER BY item_id) FILTER ({LOW}), ','), '') AS low_ids, coalesce(array_to_string(list(item_id ORDER BY item_id) FILTER ({NONE}), ','), '') AS none_ids FROM b""")
def sim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = diagnose.sim_summary(ranked(spark, sf_dir), bench_queries(spark, sf_dir), CONFIG)
    return row.select("queries", F.round(F.col("avg_top1_similarity").cast("double"), 5).alias("avg_top1_similarity"), "low_similarity_queries", "no_match_queries", F.array_join("low_similarity_query_ids", ",").alias("low_ids"), F.array_join("no_match_query_ids", ",").alias("none_ids"))


@query(f"{TOP} SELECT count(*) AS queries, count(*) FILTER (NOT ({LOW})) AS good, count(*) FILTER ({LOW} AND NOT ({NONE})) AS weak, count(*) FILTER ({NONE} AND {LOW}) AS \"none\" FROM b")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.coverage(ranked(spark, sf_dir), bench_queries(spark, sf_dir), CONFIG)


@query(f"WITH {PAIRS} SELECT doc_id, count(*) AS count, min(item_id) AS first FROM k WHERE rank = 1 GROUP BY doc_id")
def top1_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.top1_frequency(ranked(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT doc_id, count(DISTINCT item_id) AS count FROM k WHERE rank <= 3 GROUP BY doc_id")
def top3_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.topk_frequency(ranked(spark, sf_dir), 3).select("doc_id", "count")


RATES = f"""WITH {PAIRS}, n AS (SELECT count(*) AS n FROM q), f AS (SELECT doc_id, CAST(count(*) FILTER (rank = 1) AS FLOAT) / CAST(any_value(n.n) AS FLOAT) AS rate_top1,
  CAST(count(DISTINCT item_id) AS FLOAT) / CAST(any_value(n.n) AS FLOAT) AS rate_topk FROM k, n GROUP BY doc_id)"""


@query(f"{RATES} SELECT doc_id, round(CAST(rate_top1 AS DOUBLE), 6) AS rate_top1, round(CAST(rate_topk AS DOUBLE), 6) AS rate_topk FROM f WHERE rate_top1 >= CAST({CONFIG.dominant_threshold} AS FLOAT)")
def dominant_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.dominant_documents(ranked(spark, sf_dir), bench_queries(spark, sf_dir), CONFIG)
    return rows.select("doc_id", six("rate_top1").alias("rate_top1"), six("rate_topk").alias("rate_topk"))


@query(f"{RATES} SELECT round(CAST(max(rate_top1) AS DOUBLE), 6) AS rate FROM f")
def max_dominant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.max_dominant_rate(ranked(spark, sf_dir), bench_queries(spark, sf_dir)).select(six("rate").alias("rate"))


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language, source and, where labelled, quality as metadata."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), F.col("quality").cast("string").alias("quality"))
    rows = documents(spark, sf_dir).join(labels, F.col("doc_id") == F.col("l"), "left")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("lang", "source", "quality")])
    return rows.select("doc_id", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("metadata"))


@query(f"""{RATES}, a AS (SELECT CAST(CAST(sum(len(w)) AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT) AS avg FROM d),
c AS (SELECT f.*, list_filter([CASE WHEN CAST(len(d.w) AS FLOAT) >= CAST({CONFIG.chunk_size * 1.25} AS FLOAT) OR CAST(len(d.w) AS FLOAT) >= CAST(a.avg * CAST(1.6 AS FLOAT) AS FLOAT) THEN 'oversized chunks' END,
  CASE WHEN (SELECT count(*) FROM documents x WHERE x.text = d.text) > 1 THEN 'duplicate chunk content' END,
  CASE WHEN f.doc_id NOT IN (SELECT doc_id FROM labels) THEN 'missing metadata fields' END], lambda x: x IS NOT NULL) AS l
  FROM f JOIN d ON d.doc_id = f.doc_id, a WHERE rate_top1 >= CAST({CONFIG.dominant_threshold} AS FLOAT) OR rate_topk >= CAST(CAST({CONFIG.dominant_threshold} AS FLOAT) * CAST(1.5 AS FLOAT) AS FLOAT))
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'broad lexical coverage' ELSE array_to_string(l, '; ') END AS causes FROM c WHERE len(l) > 0 OR rate_topk >= CAST(0.8 AS FLOAT)""")
def dominance_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.dominance_causes(ranked(spark, sf_dir), bench_queries(spark, sf_dir), doc_chunks(spark, sf_dir), doc_metadata(spark, sf_dir), CONFIG)
    return rows.select("doc_id", F.array_join("causes", "; ").alias("causes"))


def expecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark queries that expect the documents with their whole text."""
    queries = bench_queries(spark, sf_dir).drop("expect_docs")
    holds = retrieve.phrase_pairs(doc_chunks(spark, sf_dir), queries).groupBy("query_ord").agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("expect_docs"))
    return materialize(queries.join(holds, "query_ord", "left").withColumn("expect_docs", F.coalesce("expect_docs", F.array().cast("array<string>"))), "expecting")


@query(f"""WITH {PAIRS}, e AS (SELECT q.item_id, d.doc_id FROM q JOIN d ON contains(lower(d.text), lower(q.text))),
x AS (SELECT e.item_id, min(k.rank) AS best_rank, count(*) AS expected FROM e LEFT JOIN k ON k.item_id = e.item_id AND k.doc_id = e.doc_id GROUP BY e.item_id)
SELECT CAST(item_id AS VARCHAR) AS query_id, expected, CASE WHEN best_rank IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, best_rank,
  (SELECT array_to_string(list(k.doc_id ORDER BY k.rank), ',') FROM k WHERE k.item_id = x.item_id AND k.rank <= 3) AS top_docs FROM x""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.expectation_outcomes(ranked(spark, sf_dir), expecting(spark, sf_dir), CONFIG)
    return rows.select("query_id", F.size("expect_docs").cast("bigint").alias("expected"), "status", "best_rank", F.array_join("top_docs", ",").alias("top_docs"))


@query("""SELECT m.key, count(*) FILTER (CASE m.key WHEN 'lang' THEN lang IS NULL WHEN 'source' THEN source IS NULL ELSE l.doc_id IS NULL END) AS missing, count(*) AS documents
FROM (SELECT unnest(['lang', 'source', 'quality']) AS key) m CROSS JOIN documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY m.key""")
def metadata_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.metadata_missing(doc_metadata(spark, sf_dir), CONFIG.required_metadata).drop("place")


@query("SELECT source AS topic, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 5) AS share FROM documents GROUP BY source")
def topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.topic_shares(doc_chunks(spark, sf_dir)).select("topic", "count", F.round(F.col("share").cast("double"), 5).alias("share"))


@query(rf"""
WITH c AS (SELECT len({DOC_WORDS}) AS t, text, regexp_replace(text, '\s+$', '') AS r FROM documents),
n AS (SELECT count(*) FILTER (t > 1200) AS large, count(*) FILTER (t < 60) AS small, count(*) - count(DISTINCT text) AS dup, count(*) FILTER (t > 60 AND len(regexp_extract_all(text, '(?m)^[^\S\n]*#')) >= 3) AS topics,
  count(*) FILTER (t > 60 AND CASE WHEN contains('.!?»”', right(r, 1)) THEN FALSE WHEN right(r, 1) IN (',', ';', ':') THEN TRUE ELSE NOT regexp_matches(regexp_extract(right(r, 200), '[.!?]\s*([^\s.!?])[^.!?]*$', 1), '^\p{{Lu}}') END) AS cut FROM c)
SELECT * FROM (SELECT 'Medium' AS severity, 'OVERSIZED_CHUNK' AS code, large AS n FROM n UNION ALL SELECT 'Low', 'TINY_CHUNK', small FROM n UNION ALL SELECT 'Medium', 'MULTI_TOPIC_CHUNK', topics FROM n
  UNION ALL SELECT 'Low', 'SENTENCE_CUT', cut FROM n UNION ALL SELECT 'Medium', 'DUPLICATE_CHUNK', dup FROM n) WHERE n > 0
""")
def chunk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.chunk_findings(doc_chunks(spark, sf_dir), CONFIG)
    return rows.select("severity", "code", F.regexp_extract("message", r"^(\d+)", 1).cast("bigint").alias("n"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS size FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (a.size * b.size), 6) AS score FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, itself among them, of every vector whose id 50 divides."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", F.col("embedding").alias("vector"))
    return retrieve.vector_topk(vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), vectors, 10).select("query_id", "vec_id", "rank", "score")


# -- audit


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts: nation, flag, ship date and price."""
    item, order, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = item.join(order, item.l_orderkey == order.o_orderkey).join(customer, order.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.select("n_name", "l_returnflag", F.col("l_shipdate").alias("ship_date"), F.col("l_extendedprice").alias("revenue"))


SALES = "SELECT n_name, l_returnflag, l_shipdate, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
ANSWER = "Revenue growth came from nation 7 and flag R, with nation 12 up as well."
MONTHS, WEEKS = ("1996-03", "1996-04"), ("1996-W10", "1996-W11")


def _driver_sql(period: str, pair: tuple[str, str]) -> str:
    return f"""f AS ({SALES}), g AS (SELECT n_name, l_returnflag, {period} AS p, l_extendedprice AS x FROM f),
s AS (SELECT n_name, l_returnflag, coalesce(sum(x) FILTER (p = '{pair[0]}'), 0) AS baseline, coalesce(sum(x) FILTER (p = '{pair[1]}'), 0) AS current FROM g WHERE p IN {pair} GROUP BY ALL),
dr AS (SELECT *, current - baseline AS delta, sum(current - baseline) OVER () AS total FROM s)"""


MONTH_SQL = _driver_sql("strftime(l_shipdate, '%Y-%m')", MONTHS)
WEEK_SQL = _driver_sql("strftime(l_shipdate, '%G-W%V')", WEEKS)
DRIVER_ROW = "SELECT n_name || '|' || l_returnflag AS label, round(baseline, 2) AS baseline, round(current, 2) AS current, round(delta, 2) AS delta, round(CASE WHEN abs(total) < 2.3e-16 THEN 0 ELSE delta / total * 100 END, 3) AS contribution_pct FROM dr"


def _drivers(spark: SparkSession, sf_dir: str, granularity: str, pair: tuple[str, str]) -> DataFrame:
    return materialize(audit.drivers(sales(spark, sf_dir), ("n_name", "l_returnflag"), "revenue", "ship_date", *pair, granularity), "drivers")


def _driver_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.array_join("key_values", "|").alias("label"), *[F.round(c, 2).alias(c) for c in ("baseline", "current", "delta")], F.round("contribution_pct", 3).alias("contribution_pct"))


@query(f"WITH {MONTH_SQL} {DRIVER_ROW}")
def audit_drivers_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _driver_rows(_drivers(spark, sf_dir, "month", MONTHS))


@query(f"WITH {WEEK_SQL} {DRIVER_ROW}")
def audit_drivers_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _driver_rows(_drivers(spark, sf_dir, "week", WEEKS))


SEGMENT_SQL = f"""{MONTH_SQL}, sg AS (SELECT segment, sum(delta) AS delta, any_value(total) AS total FROM (SELECT unnest([n_name, l_returnflag]) AS segment, delta, total FROM dr) GROUP BY segment),
sp AS (SELECT segment, delta, CASE WHEN abs(total) < 2.3e-16 THEN 0 ELSE delta / total * 100 END AS pct FROM sg)"""


@query(f"WITH {SEGMENT_SQL} SELECT segment, round(delta, 2) AS delta, round(pct, 3) AS contribution_pct FROM sp")
def audit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.segments(_drivers(spark, sf_dir, "month", MONTHS)).select("segment", F.round("delta", 2).alias("delta"), F.round("contribution_pct", 3).alias("contribution_pct"))


ANSWER_TOKENS = f"regexp_extract_all(lower('{ANSWER}'), '[a-z0-9]+')"
NAMED_SQL = f"""{SEGMENT_SQL}, nm AS (SELECT *, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'flat' END AS actual FROM sp
  WHERE CASE WHEN length(segment) <= 2 THEN list_contains({ANSWER_TOKENS}, lower(segment)) ELSE list_has_all({ANSWER_TOKENS}, regexp_extract_all(lower(segment), '[a-z0-9]+')) END)"""


@query(f"WITH {NAMED_SQL} SELECT segment, 'increase' AS claimed_direction, actual AS actual_direction, round(delta, 2) AS delta, round(pct, 3) AS contribution_pct, actual = 'decrease' AS contradiction, abs(pct) < 10 AS weak FROM nm")
def audit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.mentions(audit.segments(_drivers(spark, sf_dir, "month", MONTHS)), ANSWER)
    return rows.withColumn("delta", F.round("delta", 2)).withColumn("contribution_pct", F.round("contribution_pct", 3))


NAMES_ROW = f"(list_contains({ANSWER_TOKENS}, lower(l_returnflag)) OR list_has_all({ANSWER_TOKENS}, regexp_extract_all(lower(n_name), '[a-z0-9]+')))"


@query(f"""WITH {NAMED_SQL}, c AS (SELECT count(*) FILTER (actual = 'decrease') AS c, count(*) FILTER (abs(pct) < 10) AS w, count(*) AS n FROM nm),
t3 AS (SELECT *, {NAMES_ROW} AS named FROM dr ORDER BY abs(delta) DESC, n_name, l_returnflag LIMIT 3),
top AS (SELECT {NAMES_ROW} AS named FROM dr WHERE sign(delta) = sign(total) ORDER BY abs(delta) DESC LIMIT 1),
m AS (SELECT CASE WHEN (SELECT named FROM top) THEN 0 ELSE 1 END AS m)
SELECT CASE WHEN c > 0 OR m > 0 THEN 'INCORRECT' WHEN w > 0 OR n = 0 THEN 'RISKY' ELSE 'SUPPORTED' END AS verdict, CAST(round(greatest(0, least(1, 1 - 0.4 * c - 0.3 * m - 0.1 * w)), 6) AS DOUBLE) AS alignment_score,
  CASE WHEN c > 0 OR m > 0 THEN 'HIGH' WHEN w > 0 OR n = 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round((SELECT avg(CASE WHEN named THEN 100.0 ELSE 0 END) FROM t3), 6) AS coverage_pct FROM c, m""")
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = audit.Request(("n_name", "l_returnflag"), "revenue", "ship_date", *MONTHS, ANSWER, "month")
    facts = sales(spark, sf_dir)
    rows = _drivers(spark, sf_dir, "month", MONTHS)
    issues = audit.issues(request, rows, audit.skipped_rows(facts, "ship_date", "month"))
    return audit.verdict(issues, rows, ANSWER).select("verdict", F.round("alignment_score", 6).alias("alignment_score"), "confidence", F.round("coverage_pct", 6).alias("coverage_pct"))


@query("""WITH o AS (SELECT CAST(o_orderstatus AS VARCHAR) AS o_orderstatus, CAST(o_orderpriority AS VARCHAR) AS o_orderpriority, CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders)
SELECT name, count(*) AS filled, count(*) FILTER (num) AS numeric, count(*) FILTER (num) / count(*) AS numeric_ratio, count(DISTINCT v) AS n_values
FROM (SELECT name, v, name IN ('o_totalprice', 'o_custkey') AS num FROM o UNPIVOT (v FOR name IN (o_orderstatus, o_orderpriority, o_totalprice, o_custkey))) GROUP BY name""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")])
    return audit.column_profile(rows).drop("place")


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%G-W%V') AS week FROM events")
def period_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", P.bucketed(raw, "month").alias("month"), P.bucketed(raw, "week").alias("week"))


# -- runs


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): assistant turns with the user turn before them."""
    rows = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = rows.withColumns({"question": F.lag("text").over(order), "asker": F.lag("role").over(order)})
    return before.where("role = 'assistant' AND asker = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


TURNS = """c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asker FROM conversations),
a AS (SELECT conv_id, turn, question, text AS answer FROM c WHERE role = 'assistant' AND asker = 'user')"""


def _set_sql(x: str, stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return rf"list_filter(list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}]+')), lambda w: w NOT IN ({words}))"


def _has_sql(s: str, words: list[str]) -> str:
    return f"list_has_any({s}, [{', '.join(repr(w) for w in words)}])"


@query(f"""WITH {TURNS}, n AS (SELECT conv_id, turn, answer AS b, lag(answer) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM a), t AS (SELECT *, {_set_sql('a', T.DIFF_STOP)} AS ta, {_set_sql('b', T.DIFF_STOP)} AS tb FROM n WHERE a IS NOT NULL),
u AS (SELECT *, {_has_sql('ta', T.DIFF_UP)} AND NOT {_has_sql('ta', T.DIFF_DOWN)} AS ua, {_has_sql('ta', T.DIFF_DOWN)} AND NOT {_has_sql('ta', T.DIFF_UP)} AS da,
  {_has_sql('tb', T.DIFF_UP)} AND NOT {_has_sql('tb', T.DIFF_DOWN)} AS ub, {_has_sql('tb', T.DIFF_DOWN)} AND NOT {_has_sql('tb', T.DIFF_UP)} AS db FROM t)
SELECT conv_id, turn, CASE WHEN array_to_string({WORDS.format('lower(a)')}, ' ') = array_to_string({WORDS.format('lower(b)')}, ' ') THEN 'equivalent' WHEN (ua AND db) OR (da AND ub) THEN 'contradictory'
  WHEN len(ta) = 0 OR len(tb) = 0 THEN 'emphasis_shift' WHEN len(list_intersect(ta, tb)) / len(ta) >= 0.7 AND len(tb) > len(ta) THEN 'more_specific' ELSE 'emphasis_shift' END AS change_type FROM u""")
def answer_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an assistant's answers change from turn to turn."""
    rows = turns(spark, sf_dir)
    before = F.lag("answer").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("before", before).where("before IS NOT NULL").select("conv_id", "turn", rundiff.answer_change(F.col("before"), F.col("answer")).alias("change_type"))


@query(f"""WITH {PAIRS}, w AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS vrank FROM t),
x AS (SELECT item_id, doc_id, round(CAST(score AS DOUBLE), 6) AS s FROM k), y AS (SELECT item_id, doc_id, round(CAST(similarity AS DOUBLE), 6) AS s FROM w WHERE vrank <= {CONFIG.top_k})
SELECT CAST(coalesce(x.item_id, y.item_id) AS VARCHAR) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, CASE WHEN x.s IS NULL THEN 'added' WHEN y.s IS NULL THEN 'removed' WHEN abs(y.s - x.s) > 0.15 THEN 'shifted' ELSE 'kept' END AS change,
  x.s AS baseline_score, y.s AS current_score, round(y.s - x.s, 6) AS score_delta FROM x FULL JOIN y ON x.item_id = y.item_id AND x.doc_id = y.doc_id""")
def run_diff_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scores against cosine similarity alone, as runs of one query: which documents come and go."""
    sides = {}
    for side, by in (("baseline", "score"), ("current", "similarity")):
        doc = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("text"), six(by).alias("score"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("map<string,string>").alias("metadata"))
        listed = ranked(spark, sf_dir, by).groupBy("query_id").agg(F.collect_list(doc).alias("docs"))
        sides[side] = listed.select("query_id", F.struct(F.col("query_id").alias("question"), F.lit("").alias("answer"), F.col("docs").alias("retrieved_docs")).alias(side))
    found = rundiff.diffed(sides["baseline"].join(sides["current"], "query_id"))
    real = lambda x: x.cast("double")
    row = lambda d, change, a, b: F.struct(d["id"].cast("bigint").alias("doc_id"), change.alias("change"), real(a).alias("baseline_score"), real(b).alias("current_score"))
    none = F.lit(None)
    shifted = lambda d: F.when(F.abs(d["score_delta"]) > rundiff.SHIFT, "shifted").otherwise("kept")
    rows = F.concat(
        F.transform("added_docs", lambda d: row(d, F.lit("added"), none, d["score"])), F.transform("removed_docs", lambda d: row(d, F.lit("removed"), d["score"], none)),
        F.transform("common_docs", lambda d: row(d, shifted(d), d["baseline_score"], d["current_score"])),
    )
    return found.select("query_id", F.explode(rows).alias("r")).select("query_id", "r.*", F.round(F.col("r.current_score") - F.col("r.baseline_score"), 6).alias("score_delta"))


@query(f"""WITH {TURNS}, s AS (SELECT *, {_set_sql('answer', T.EVAL_STOP)} AS ta, {_set_sql('question', T.EVAL_STOP)} AS tq FROM a),
o AS (SELECT *, CASE WHEN len(ta) = 0 THEN 0 ELSE len(list_intersect(ta, tq)) / len(ta) END AS overlap,
  list_filter(list_filter(list_transform(regexp_extract_all(answer, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: {TRIM.format('x')}), lambda x: x <> ''), lambda x: len({_set_sql('x', T.EVAL_STOP)}) >= 4 AND len(list_intersect({_set_sql('x', T.EVAL_STOP)}, tq)) / len({_set_sql('x', T.EVAL_STOP)}) < 0.2) AS claims FROM s),
i AS (SELECT *, list_filter([CASE WHEN NOT contains(lower(answer), 'the') THEN 'MISSING_REQUIRED_PHRASE' END, CASE WHEN contains(lower(answer), 'idiot') THEN 'FORBIDDEN_PHRASE' END,
  CASE WHEN length(answer) < 100 THEN 'ANSWER_TOO_SHORT' END, CASE WHEN length(answer) > 1000 THEN 'ANSWER_TOO_LONG' END, CASE WHEN overlap < 0.1 THEN 'LOW_GROUNDING_OVERLAP' END, CASE WHEN len(claims) > 0 THEN 'UNSUPPORTED_CLAIMS' END], lambda x: x IS NOT NULL) AS codes FROM o)
SELECT conv_id, turn, len(codes) = 0 AS pass, round(overlap, 6) AS grounded_overlap, len(claims) AS unsupported, array_to_string(codes, ',') AS codes FROM i""")
def eval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for every assistant turn, with the question as its only document."""
    rows = turns(spark, sf_dir)
    rule = rows.select(
        F.struct("conv_id", "turn").alias("rule_ord"), F.lit("rule").alias("id"), "question", "answer", F.array(F.struct(F.lit("q").alias("id"), F.col("question").alias("text"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("map<string,string>").alias("metadata"))).alias("retrieved_docs"),
        F.lit(True).alias("grounded"), F.array(F.lit("the")).alias("must_include"), F.array(F.lit("idiot")).alias("must_not_include"), F.lit(100).alias("min_chars"), F.lit(1000).alias("max_chars"), F.lit(False).alias("require_json"), F.array().cast("array<string>").alias("json_required_keys"),
    )
    cases = evaluate.checked(rule)
    return cases.select("rule_ord.conv_id", "rule_ord.turn", "pass", F.round("grounded_overlap", 6).alias("grounded_overlap"), F.size("unsupported_claims").cast("bigint").alias("unsupported"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query(f"""WITH {PAIRS}, w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS vrank FROM t),
x AS (SELECT doc_id, count(*) AS n FROM k WHERE rank = 1 GROUP BY doc_id), y AS (SELECT doc_id, count(*) AS n FROM w WHERE vrank = 1 GROUP BY doc_id)
SELECT doc_id, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM x FULL JOIN y USING (doc_id)""")
def compare_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on top by full scores, and by cosine similarity alone."""
    alone = ranked(spark, sf_dir, "similarity")
    return compare.merged_top1(diagnose.top1_frequency(ranked(spark, sf_dir)), diagnose.top1_frequency(alone))


SIDE = """SELECT count(*) AS queries, avg(CAST(s AS DOUBLE)) AS av, count(*) FILTER (s < CAST({low} AS FLOAT)) AS weak, count(*) FILTER (s < CAST({none} AS FLOAT)) AS nomatch FROM {rows}"""


@query(f"""WITH {PAIRS}, w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS vrank FROM t), k1 AS (SELECT doc_id, score AS s FROM k WHERE rank = 1), w1 AS (SELECT doc_id, similarity AS s FROM w WHERE vrank = 1),
a AS ({SIDE.format(rows='k1', low=CONFIG.low_sim_threshold, none=CONFIG.no_match_threshold)}), b AS ({SIDE.format(rows='w1', low=CONFIG.low_sim_threshold, none=CONFIG.no_match_threshold)}),
m AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM k1 GROUP BY doc_id)) / a.queries AS da, (SELECT max(n) FROM (SELECT count(*) AS n FROM w1 GROUP BY doc_id)) / b.queries AS db, a.av AS aa, b.av AS ab, a.weak AS wa, b.weak AS wb, a.nomatch AS na, b.nomatch AS nb FROM a, b),
g AS (SELECT *, [sign(ab - aa) * CAST(abs(ab - aa) > 1e-6 AS INTEGER), sign(wa - wb), sign(na - nb), sign(da - db) * CAST(abs(da - db) > 1e-6 AS INTEGER)] AS l, ['avg_top1_similarity', 'weak_matches', 'no_matches', 'top1_dominant_rate'] AS names FROM m),
h AS (SELECT *, array_to_string(list_transform(list_filter(range(1, 5), lambda i: l[i] > 0), lambda i: names[i]), ',') AS improved, array_to_string(list_transform(list_filter(range(1, 5), lambda i: l[i] < 0), lambda i: names[i]), ',') AS regressed, list_sum(l) AS gain FROM g)
SELECT improved, regressed, CASE WHEN gain > 0 THEN 'IMPROVED' WHEN gain < 0 THEN 'REGRESSED' ELSE 'NEUTRAL' END AS verdict, wa AS weak_before, wb AS weak_after, na AS none_before, nb AS none_after FROM h""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on going from full scores to cosine similarity alone."""
    queries = bench_queries(spark, sf_dir)
    alone = ranked(spark, sf_dir, "similarity").withColumn("score", F.col("similarity"))
    sides = []
    for side, rows in (("before", ranked(spark, sf_dir)), ("after", alone)):
        row = diagnose.sim_summary(rows, queries, CONFIG).crossJoin(diagnose.max_dominant_rate(rows, queries))
        sides.append(row.select(F.col("avg_top1_similarity").alias(f"avg_top1_similarity_{side}"), F.col("low_similarity_queries").alias(f"weak_matches_{side}"), F.col("no_match_queries").alias(f"no_matches_{side}"), F.col("rate").alias(f"top1_dominant_rate_{side}")))
    found = compare.verdict(sides[0].crossJoin(sides[1]))
    return found.select(F.array_join("improved_metrics", ",").alias("improved"), F.array_join("regressed_metrics", ",").alias("regressed"), "verdict", F.col("weak_matches_before").alias("weak_before"), F.col("weak_matches_after").alias("weak_after"), F.col("no_matches_before").alias("none_before"), F.col("no_matches_after").alias("none_after"))
