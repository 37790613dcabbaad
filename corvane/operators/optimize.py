"""Search over chunk sizes and overlaps.

The grid is a column: documents are read once and chunked for every grid point in one
pass, every chunk is scored once against all queries in one more, ranked within its grid
point, and every figure of a grid point comes from aggregates grouped by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions.chunking import chunked
from corvane.functions.durable import materialize
from corvane.operators import retrieve

SIZES = (200, 300, 400, 600)
OVERLAPS = (20, 40, 80)
POINT = ["chunk_size", "chunk_overlap"]


def real(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def grid_of(sizes, overlaps) -> tuple[list[tuple[int, int]], int]:
    """Distinct points with an overlap below the size, and how many pairs were left out."""
    pairs = [(s, o) for s in sorted(set(sizes)) for o in sorted(set(overlaps))]
    if not pairs:
        raise ValueError("a chunk size and an overlap at least are needed")
    kept = [(s, o) for s, o in pairs if o < s]
    return kept, len(pairs) - len(kept)


def candidates(documents: DataFrame, queries: DataFrame, config: Config, sizes=SIZES, overlaps=OVERLAPS, with_vectors: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """One row for each grid point with its figures and score, best first by `place`.

    documents: (doc_ord, doc_id, text), normalised; queries: (query_id, query, query_ord, expect_docs[, vector]).
    with_vectors adds a vector to the chunks, where a remote embedder gives them.
    """
    grid, _ = grid_of(sizes, overlaps)
    chunks = materialize(chunked(documents, grid), "grid")
    points = chunks.groupBy(*POINT).agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_ord").alias("documents"),
        F.count_if(F.col("token_count") > config.max_tokens).alias("large_chunks"), F.count_if(F.col("token_count") < config.min_tokens).alias("small_chunks"),
    )
    number = documents.agg(F.count("*").alias("documents"))
    points = points.drop("documents").crossJoin(F.broadcast(number))
    every = documents.sparkSession.createDataFrame(grid, "chunk_size int, chunk_overlap int")
    found = retrieve.ranked(with_vectors(chunks), queries, config.top_k, within=tuple(POINT))
    ranks = materialize(found.select(*POINT, "query_id", "query_ord", "doc_id", "rank", "score"), "ranks")
    first = queries.groupBy("query_id").agg(F.min("query_ord").alias("query_ord"))
    best = ranks.where("rank = 1").select(*POINT, "query_ord", "score", "doc_id")
    asked = queries.select("query_id", "query_ord").crossJoin(F.broadcast(every))
    score = F.coalesce("score", real(0.0))
    similar = asked.join(best, [*POINT, "query_ord"], "left").groupBy(*POINT).agg(
        F.avg(score.cast("double")).cast("float").alias("avg_top1_similarity"),
        F.count_if(score < real(config.low_sim_threshold)).alias("low_similarity_queries"), F.count_if(score < real(config.no_match_threshold)).alias("no_match_queries"), F.count("*").alias("queries"),
    )
    tops = best.groupBy(*POINT, "doc_id").agg(F.count("*").alias("n")).groupBy(*POINT).agg(F.max("n").alias("most"))
    specs = queries.where(F.size("expect_docs") > 0).select("query_id", F.col("query_ord").alias("spec"), F.explode("expect_docs").alias("doc")).join(first, "query_id")
    hits = ranks.select(*POINT, "query_ord", F.col("doc_id").cast("string").alias("doc")).distinct()
    met = specs.join(hits, ["query_ord", "doc"]).groupBy(*POINT).agg(F.countDistinct("spec").alias("met"))
    asking = queries.agg(F.count_if(F.size("expect_docs") > 0).alias("asking"))
    row = every.join(points, POINT, "left").join(similar, POINT, "left").join(tops, POINT, "left").join(met, POINT, "left").crossJoin(F.broadcast(asking))
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = row.select(
        *POINT, F.coalesce("avg_top1_similarity", real(0.0)).alias("avg_top1_similarity"), zero("low_similarity_queries").alias("low_similarity_queries"), zero("no_match_queries").alias("no_match_queries"),
        (F.col("asking") - zero("met")).alias("expectation_failures"), F.coalesce(real(real(F.col("most")) / real(F.col("queries"))), real(0.0)).alias("dominant_rate"),
        zero("documents").alias("documents"), zero("chunks").alias("chunks"), zero("large_chunks").alias("large_chunks"), zero("small_chunks").alias("small_chunks"),
    )
    return scored(row, config)


def scored(rows: DataFrame, config: Config) -> DataFrame:
    """Adds score and place to the figures of grid points."""
    uneven = F.when(F.col("chunks") == 0, real(0.0)).otherwise(real(real(F.col("large_chunks") + F.col("small_chunks")) / real(F.col("chunks"))))
    above = F.when(F.col("dominant_rate") > real(config.dominant_threshold), real((F.col("dominant_rate") - real(config.dominant_threshold)) * real(40.0))).otherwise(real(0.0))
    score = real(F.col("avg_top1_similarity") * real(100.0))
    for cost in (real(real(F.col("low_similarity_queries")) * real(2.0)), real(real(F.col("no_match_queries")) * real(4.0)), real(real(F.col("expectation_failures")) * real(5.0)), real(uneven * real(10.0)), above):
        score = real(score - cost)
    order = Window.orderBy(F.desc("score"), "expectation_failures", "no_match_queries", "low_similarity_queries", "chunk_size", "chunk_overlap")
    return rows.withColumn("score", score).withColumn("place", F.row_number().over(order))
