"""Diagnostics of a corpus and of ranked results, as aggregates, joins and threshold rules.

ranked has (query_id, query_ord, doc_id, rank, score); queries has (query_id, query,
query_ord[, expect_docs]); chunks has (doc_ord, doc_id, pos, text, token_count,
heading_path).  Findings are rows of (severity, code, message, data), data as JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import text as T


def real(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even as the usual formatting has them."""
    return F.format_string("%.0f", F.bround((share * real(100.0)).cast("double"), 0))


def finding(severity: Column | str, code: str, message: Column, **data: Column) -> list[Column]:
    made = F.to_json(F.struct(*[v.alias(k) for k, v in data.items()])) if data else F.lit("{}")
    return [(F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), made.alias("data")]


# -- of ranked results


def top1_frequency(ranked: DataFrame) -> DataFrame:
    """(doc_id, count, first): queries that have the document on top, and the first such."""
    return ranked.where("rank = 1").groupBy("doc_id").agg(F.count("*").alias("count"), F.min("query_ord").alias("first"))


def topk_frequency(ranked: DataFrame, k: int) -> DataFrame:
    """(doc_id, count, first): queries that have the document among the first k, each once, and where it was first seen."""
    return ranked.where(F.col("rank") <= k).groupBy("doc_id").agg(F.countDistinct("query_ord").alias("count"), F.min(F.struct("query_ord", "rank")).alias("first"))


def top_scores(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query_ord, score) of the best chunk of every query; 0 where there is none."""
    best = ranked.where("rank = 1").select(F.col("query_ord").alias("o"), "score")
    return queries.select("query_id", "query_ord").join(best, F.col("query_ord") == F.col("o"), "left").select("query_id", "query_ord", F.coalesce("score", real(0.0)).alias("score"))


def ids_in_order(condition: Column) -> Column:
    """The ids of the rows that fulfil a condition, in the order of the queries."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("query_ord", "query_id")))), lambda x: x["query_id"])


def sim_summary(ranked: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """One row: queries, average of the top scores, low and unmatched queries and their ids."""
    low, none = F.col("score") < real(config.low_sim_threshold), F.col("score") < real(config.no_match_threshold)
    return top_scores(ranked, queries).agg(
        F.count("*").alias("queries"),
        F.coalesce(F.avg(F.col("score").cast("double")), F.lit(0.0)).cast("float").alias("avg_top1_similarity"),
        F.count_if(low).alias("low_similarity_queries"), F.count_if(none).alias("no_match_queries"),
        ids_in_order(low).alias("low_similarity_query_ids"), ids_in_order(none).alias("no_match_query_ids"),
    )


def coverage(ranked: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """One row: queries, and how many are good, weak and without a match; these three never overlap."""
    good, none = F.col("score") >= real(config.low_sim_threshold), F.col("score") < real(config.no_match_threshold)
    return top_scores(ranked, queries).agg(F.count("*").alias("queries"), F.count_if(good).alias("good"), F.count_if(~good & ~none).alias("weak"), F.count_if(~good & none).alias("none"))


def _rates(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(doc_id, rate_top1, rate_topk, first): shares of the queries."""
    total = queries.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    tops = top1_frequency(ranked).select("doc_id", F.col("count").alias("n1"))
    joined = topk_frequency(ranked, k).select("doc_id", F.col("count").alias("nk"), "first").join(tops, "doc_id", "left").crossJoin(F.broadcast(total))
    return joined.select("doc_id", real(real(F.coalesce("n1", F.lit(0))) / real(F.col("total"))).alias("rate_top1"), real(real(F.col("nk")) / real(F.col("total"))).alias("rate_topk"), "first")


def max_dominant_rate(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the greatest share of queries that one document tops."""
    total = queries.agg(F.count("*").alias("n"))
    return top1_frequency(ranked).agg(F.max("count").alias("most")).crossJoin(F.broadcast(total)).select(real(real(F.col("most")) / real(F.col("n"))).alias("rate"))


def dominant_documents(ranked: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """(doc_id, rate_top1, rate_topk, first) of documents on top of too many queries."""
    return _rates(ranked, queries, config.top_k).where(F.col("rate_top1") >= real(config.dominant_threshold))


def dominance_causes(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, documents: DataFrame, config: Config) -> DataFrame:
    """(doc_id, rate_top1, rate_topk, causes, first): what may make a document dominate.

    documents: (doc_id, metadata).
    """
    rates = _rates(ranked, queries, config.top_k)
    rates = rates.where((F.col("rate_top1") >= real(config.dominant_threshold)) | (F.col("rate_topk") >= real(real(config.dominant_threshold) * real(1.5))))
    repeated = chunks.groupBy(F.xxhash64("text").alias("h"), F.col("text").alias("t")).agg(F.count("*").alias("copies")).where("copies > 1").select("t")
    repeats = chunks.join(repeated, F.col("text") == F.col("t"), "left_semi").groupBy("doc_id").agg(F.count("*").alias("repeated"))
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    corpus = chunks.agg(real(real(F.coalesce(F.sum("token_count"), F.lit(0))) / real(F.greatest(F.count("*"), F.lit(1)))).alias("corpus_avg"))
    absent = F.exists(T.strings(config.required_metadata), lambda k: ~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), k)) if config.required_metadata else F.lit(False)
    lacking = documents.select("doc_id", absent.alias("lacking"))
    joined = rates.join(sizes, "doc_id", "left").join(repeats, "doc_id", "left").join(lacking, "doc_id", "left").crossJoin(F.broadcast(corpus))
    average = real(real(F.col("tokens")) / real(F.col("n")))
    oversized = (F.coalesce("n", F.lit(0)) > 0) & ((average >= real(config.chunk_size * 1.25)) | ((F.col("corpus_avg") > 0) & (average >= real(F.col("corpus_avg") * real(1.6)))))
    causes = F.array_compact(F.array(
        F.when(oversized, "oversized chunks"),
        F.when(F.coalesce("repeated", F.lit(0)) > 0, "duplicate chunk content"),
        F.when(F.coalesce("lacking", F.lit(False)), "missing metadata fields"),
    ))
    broad = (F.size("causes") == 0) & (F.col("rate_topk") >= real(0.8))
    found = joined.select("doc_id", "rate_top1", "rate_topk", causes.alias("causes"), "first")
    return found.withColumn("causes", F.when(broad, F.array(F.lit("broad lexical coverage"))).otherwise(F.col("causes"))).where(F.size("causes") > 0)


def expectation_outcomes(ranked: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """One row for each query that expects documents: status, best rank, top documents and the ranks of the expected ones.

    Where ids are repeated, the results of the first query of the id count for all.
    """
    first = queries.groupBy("query_id").agg(F.min("query_ord").alias("first_ord"))
    specs = queries.where(F.size("expect_docs") > 0).join(first, "query_id")
    firsts = first.select(F.col("first_ord").alias("query_ord"))
    hits = ranked.where(F.col("rank") <= config.top_k).join(firsts, "query_ord", "left_semi")
    by_doc = hits.groupBy(F.col("query_ord").alias("first_ord"), F.col("doc_id").cast("string").alias("doc")).agg(F.min("rank").alias("rank"))
    expected = specs.select("query_ord", "first_ord", F.posexplode("expect_docs").alias("place", "doc")).join(by_doc, ["first_ord", "doc"], "left")
    ranks = expected.groupBy("query_ord").agg(
        F.min("rank").alias("best_rank"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "doc", "rank"))), lambda x: F.struct(x["doc"].alias("doc"), x["rank"].alias("rank"))).alias("expected_ranks"),
    )
    tops = by_doc.where("rank <= 3").groupBy("first_ord").agg(F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("docs"))
    joined = specs.join(ranks, "query_ord").join(tops, "first_ord", "left")
    docs = F.coalesce("docs", F.array().cast("array<struct<rank:int,doc:string>>"))
    return joined.select(
        "query_id", "query", "query_ord", "expect_docs", F.when(F.col("best_rank").isNotNull(), "PASS").otherwise("FAIL").alias("status"), "best_rank",
        F.transform(docs, lambda x: x["doc"]).alias("top_docs"), F.transform(docs, lambda x: F.struct(x["doc"].alias("doc"), x["rank"].alias("rank"))).alias("top_doc_ranks"),
        F.filter("expected_ranks", lambda x: x["rank"].isNotNull()).alias("expected_ranks"),
    )


def retrieval_findings(ranked: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """Dominant documents, then missed expectations."""
    dominant = dominant_documents(ranked, queries, config).orderBy("first")
    message = F.concat(F.col("doc_id").cast("string"), F.lit(" is the first hit of "), percent(F.col("rate_top1")), F.lit("% of queries (among the first "), F.lit(str(config.top_k)), F.lit(" of "), percent(F.col("rate_topk")), F.lit("%)"))
    one = dominant.select(*finding("High", "DOMINANT_DOCUMENT", message, doc=F.col("doc_id"), rate_topk=F.col("rate_topk"), rate_top1=F.col("rate_top1")))
    missed = expectation_outcomes(ranked, queries, config).where("status = 'FAIL'").orderBy("query_ord")
    message = F.concat(F.lit("Query "), F.col("query_id"), F.lit(": none of "), F.array_join("expect_docs", ", "), F.lit(f" in the first {config.top_k}"))
    return one.unionByName(missed.select(*finding("Fail", "EXPECTATION_MISS", message, query_id=F.col("query_id"), expected=F.col("expect_docs"))))


def cause_findings(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, documents: DataFrame, config: Config) -> DataFrame:
    found = dominance_causes(ranked, queries, chunks, documents, config).orderBy("first")
    message = F.concat(F.col("doc_id").cast("string"), F.lit(" may dominate because of: "), F.array_join("causes", ", "))
    return found.select(*finding("Medium", "DOMINANCE_CAUSE_HINT", message, doc=F.col("doc_id"), rate_topk=F.col("rate_topk"), rate_top1=F.col("rate_top1"), causes=F.col("causes")))


# -- of chunks


def nearest_ranks(rows: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """One row (p50, ...): values at rank round(p / 100 * (n - 1)), halves up, of all rows sorted.

    Values are counted first, so the only sort is over distinct values.
    """
    counted = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total"))))
    places = {p: F.floor(real(real(p / 100) * real(F.col("total") - 1)).cast("double") + 0.5) for p in percents}
    return upto.agg(*[F.coalesce(F.min(F.when(F.col("upto") > place, F.col("v"))), F.lit(0)).cast("int").alias(f"p{p}") for p, place in places.items()])


def chunk_stats(chunks: DataFrame, documents: DataFrame, config: Config) -> DataFrame:
    """One row: documents, chunks, their words on average, at least, at most and at two percentiles, large, small and repeated ones."""
    basic = chunks.agg(
        F.count("*").alias("chunks"), F.coalesce(F.avg("token_count"), F.lit(0.0)).cast("float").alias("avg_tokens"),
        F.coalesce(F.min("token_count"), F.lit(0)).alias("min_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("max_tokens"),
        F.count_if(F.col("token_count") > config.max_tokens).alias("large_chunks"), F.count_if(F.col("token_count") < config.min_tokens).alias("small_chunks"),
    )
    places = nearest_ranks(chunks, "token_count", (50, 95)).select(F.col("p50").alias("p50_tokens"), F.col("p95").alias("p95_tokens"))
    repeated = duplicates(chunks)
    number = documents.agg(F.count("*").alias("documents"))
    return number.crossJoin(basic).crossJoin(places).crossJoin(repeated)


def duplicates(chunks: DataFrame) -> DataFrame:
    """One row (duplicate_chunks): chunks beyond the first of each text, told apart by two hashes."""
    keys = chunks.groupBy(F.xxhash64("text").alias("a"), F.md5("text").alias("b")).agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_chunks"))


def overlaps(chunks: DataFrame) -> DataFrame:
    """(doc_id, doc_ord, pos, overlap): words that end a chunk and begin the next one of its document."""
    before = F.lag("w").over(Window.partitionBy("doc_ord", "doc_id").orderBy("pos"))
    pairs = chunks.select("doc_id", "doc_ord", "pos", T.words(F.col("text")).alias("w")).withColumn("before", before).where("before IS NOT NULL")
    return pairs.select("doc_id", "doc_ord", "pos", T.overlap_of(F.col("before"), F.col("w")).alias("overlap"))


def chunk_findings(chunks: DataFrame, config: Config) -> DataFrame:
    """The findings of seven rules on chunks, as one scan's aggregates turned into rows."""
    above = F.col("token_count") > config.min_tokens
    counts = chunks.agg(
        F.count_if(F.col("token_count") > config.max_tokens).alias("large"), F.count_if(F.col("token_count") < config.min_tokens).alias("small"),
        F.count_if(above & (T.n_headings(F.col("text")) >= 3)).alias("topics"), F.count_if(above & T.ends_mid_sentence(F.col("text"))).alias("cut"),
    )
    series = overlaps(chunks).agg(F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("overlap"), F.lit(0.0)).alias("std"), F.count_if(F.col("overlap") > 2 * config.chunk_overlap).alias("excess"))
    row = counts.crossJoin(series).crossJoin(duplicates(chunks))
    spread = F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))
    text = lambda x: F.col(x).cast("string")
    rules = (
        (1, F.col("large") > 0, "Medium", "OVERSIZED_CHUNK", F.concat(text("large"), F.lit(f" chunks have more than {config.max_tokens} tokens"))),
        (2, F.col("small") > 0, "Low", "TINY_CHUNK", F.concat(text("small"), F.lit(f" chunks have fewer than {config.min_tokens} tokens"))),
        (3, F.col("topics") > 0, "Medium", "MULTI_TOPIC_CHUNK", F.concat(text("topics"), F.lit(" chunks hold three headings or more"))),
        (4, F.col("cut") > 0, "Low", "SENTENCE_CUT", F.concat(text("cut"), F.lit(" chunks break off within a sentence"))),
        (5, F.coalesce(spread > 0.7, F.lit(False)), "Medium", "OVERLAP_VARIANCE", F.concat(F.lit("Overlaps differ widely (mean "), F.format_string("%.1f", F.col("mean")), F.lit(", variation "), F.format_string("%.2f", spread), F.lit(")"))),
        (6, F.col("excess") > 0, "Low", "OVERLAP_EXCESS", F.lit("Some overlaps are more than twice the configured one")),
        (7, F.col("duplicate_chunks") > 0, "Medium", "DUPLICATE_CHUNK", F.concat(text("duplicate_chunks"), F.lit(" chunks repeat another one"))),
    )
    made = F.array(*[F.when(when, F.struct(F.lit(k).alias("k"), *finding(severity, code, message))) for k, when, severity, code, message in rules])
    return row.select(F.explode(F.array_compact(made)).alias("f")).orderBy("f.k").select("f.severity", "f.code", "f.message", "f.data")


def topic_shares(chunks: DataFrame) -> DataFrame:
    """(topic, count, share, first): chunks by the first part of their heading path."""
    topic = F.coalesce(F.get("heading_path", 0), F.lit("general"))
    counted = chunks.groupBy(topic.alias("topic")).agg(F.count("*").alias("count"), F.min(F.struct("doc_ord", "pos")).alias("first"))
    total = counted.agg(F.sum("count").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("topic", "count", real(real(F.col("count")) / real(F.col("total"))).alias("share"), "first")


def topic_findings(chunks: DataFrame) -> DataFrame:
    shares = topic_shares(chunks)
    much, little = F.col("share") > real(0.4), F.col("share") < real(0.05)
    message = F.concat(F.lit("Topic "), F.col("topic"), F.when(much, " makes up ").otherwise(" has only "), percent(F.col("share")), F.lit("% of the chunks"))
    rows = shares.where(much | little).orderBy("first")
    return rows.select(F.when(much, "Medium").otherwise("Low").alias("severity"), F.when(much, "TOPIC_DOMINANCE").otherwise("TOPIC_LOW_COVERAGE").alias("code"), message.alias("message"), F.lit("{}").alias("data"))


# -- of documents


def metadata_missing(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(place, key, missing, documents): how many documents lack each required key, in one scan."""
    have = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    row = documents.agg(F.count("*").alias("documents"), *[F.count_if(~F.map_contains_key(have, F.lit(k))).alias(f"m{i}") for i, k in enumerate(keys)])
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.col(f"m{i}").alias("missing")) for i, k in enumerate(keys)])
    return row.select(F.explode(each).alias("x"), "documents").select("x.place", "x.key", "x.missing", "documents")


def metadata_findings(documents: DataFrame, config: Config) -> DataFrame:
    if not config.required_metadata:
        return documents.limit(0).select(*finding("Low", "MISSING_METADATA", F.lit("")))
    rows = metadata_missing(documents, config.required_metadata).where("missing > 0").orderBy("place")
    severity = F.when(F.col("missing") * 2 > F.col("documents"), "High").otherwise("Low")
    return rows.select(*finding(severity, "MISSING_METADATA", F.concat(F.col("missing").cast("string"), F.lit(" documents have no "), F.col("key"))))


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
