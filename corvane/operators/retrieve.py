"""Retrieval: every query against every chunk, scored and cut to the best of each query.

A score is the cosine of two bags of words, plus a share for common terms and for the
query as a phrase, less a penalty for long chunks, all in single precision.  Queries
are taken in blocks of MAX_QUERIES: vectors, postings of terms and phrases.  One block is
sent to every task; more are written to the shared folder, where each task reads
them one at a time, so the chunks are scanned once whatever the number of queries.
Each task scores some thousands of chunks against a block with matrix products and keeps
the best of each query, so what is shuffled is top_k rows a query and so many chunks.
A worker holds the chunks of one pass, bounded in rows and bytes, the scores of CELLS pairs
and some best rows, whatever the size of its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import embed
from corvane.functions import text as T
from corvane.functions.durable import in_blocks, spread

MAX_QUERIES = 5000
ROWS = 256
#: Chunks of a task that are scored before the best of each query are passed on.
TOGETHER, TOGETHER_BYTES = 8192, 32 << 20
#: Pairs of a chunk and a query that are scored at once, and rows of the best that are held before they are cut again.
CELLS, HELD = 1 << 20, 1 << 18
_TERM = re.compile(r"[a-z0-9]{2,}")
f32 = np.float32

COMPONENTS = "similarity float, keyword_overlap int, keyword_overlap_norm float, keyword_boost float, phrase_match boolean, phrase_boost float, token_count int, metadata_boost float, length_penalty float"
_COMPONENTS = [x.split()[0] for x in COMPONENTS.split(", ")]


class QueryBlock:
    """Vectors, terms and phrases of some queries."""

    def __init__(self, ids: list[str], texts: list[str], orders: list[int], vectors: np.ndarray | None = None) -> None:
        self.ids, self.orders = ids, orders
        self.lower = [(t or "").lower() for t in texts]
        self.vectors = embed.bow(texts) if vectors is None else vectors
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1, dtype=f32)).astype(f32)
        sets = [set(_TERM.findall(t)) for t in self.lower]
        self.sizes = np.array([max(len(s), 1) for s in sets], f32)
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*sets)))} if sets else {}
        # Postings: the queries of each term, one list after the other, so the block grows with its queries alone.
        found = np.array(sorted((self.terms[t], q) for q, s in enumerate(sets) for t in s), np.int64).reshape(-1, 2)
        self.who = found[:, 1]
        self.begin = np.searchsorted(found[:, 0], np.arange(len(self.terms) + 1))
        self.phrases: dict[str, list[int]] = {}
        for q, t in enumerate(self.lower):
            self.phrases.setdefault(t, []).append(q)
        self.finder: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finder": None}

    def _phrases_in(self, low: str) -> list[int]:
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for phrase in self.phrases:
                if phrase:
                    self.finder.add_word(phrase, phrase)
            if len(self.finder):
                self.finder.make_automaton()
        found = {p for _, p in self.finder.iter(low)} if len(self.finder) else set()
        # An empty query is a phrase of every chunk.
        return [q for p in (*found, "") for q in self.phrases.get(p, ())]

    def score(self, texts: list[str | None], counts: np.ndarray, vectors: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """(chunks, queries) arrays of every component of the score, and the total."""
        v = embed.bow(texts) if vectors is None else vectors
        norms = np.sqrt((v * v).sum(1, dtype=f32)).astype(f32)
        size = norms[:, None] * self.norms[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            similarity = np.where(size > 0, (v @ self.vectors.T) / size, f32(0)).astype(f32)
        similarity[~np.isfinite(similarity)] = 0
        overlap = np.zeros((len(texts), len(self.ids)), np.int32)
        phrase = np.zeros((len(texts), len(self.ids)), bool)
        for row, text in enumerate(texts):
            low = (text or "").lower()
            known = np.array([self.terms[t] for t in set(_TERM.findall(low)) if t in self.terms], np.int64)
            each = self.begin[known + 1] - self.begin[known]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.begin[known], each)
            overlap[row] = np.bincount(self.who[at], minlength=len(self.ids))
            phrase[row, self._phrases_in(low)] = True
        share = (overlap / self.sizes[None, :]).astype(f32)
        keyword = np.minimum(share * f32(0.15), f32(0.15))
        boost = np.where(phrase, f32(0.08), f32(0))
        penalty = np.where(counts > 800, np.minimum((counts.astype(f32) - f32(800)) / f32(800), f32(0.3)), f32(0)).astype(f32)
        total = ((similarity + keyword) + boost) + f32(0) - penalty[:, None]
        return {"score": total.astype(f32), "similarity": similarity, "keyword_overlap": overlap, "keyword_overlap_norm": share, "keyword_boost": keyword, "phrase_match": phrase, "phrase_boost": boost, "length_penalty": penalty}


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) that may be among the k best of their query: ties with the k-th stay."""
    if len(score) > k:
        least = np.partition(score, len(score) - k, axis=0)[len(score) - k]
        return np.nonzero(score >= least)
    return np.nonzero(np.ones_like(score, bool))


def _query_blocks(queries: DataFrame, max_queries: int) -> Iterable[QueryBlock]:
    """The queries as one block that is sent, or as blocks in the shared folder."""
    rows = queries.select("query_id", "query", "query_ord", *["vector"] * ("vector" in queries.columns))

    def build(table: pa.Table) -> QueryBlock:
        vectors = np.array(table.column("vector").to_pylist(), f32) if "vector" in table.column_names else None
        return QueryBlock(*[table.column(c).to_pylist() for c in ("query_id", "query", "query_ord")], vectors)

    first = rows.orderBy("query_ord").limit(max_queries + 1).toArrow()
    if first.num_rows <= max_queries:
        return Sent(queries.sparkSession.sparkContext.broadcast(build(first)))
    return in_blocks(rows, "query_ord", -(-rows.count() // max_queries), build)


class Sent:
    """One block, held by every worker."""

    def __init__(self, held: Broadcast) -> None:
        self.held = held

    def __iter__(self) -> Iterator:
        yield self.held.value


def _passes(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER, size: int = TOGETHER_BYTES) -> Iterator[pa.Table]:
    """The batches of a task in tables that end with the batch in which they reach so many rows or bytes."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
        if n >= rows or held_bytes >= size:
            yield pa.Table.from_batches(held)
            held, n, held_bytes = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


def _best_of_each(own: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k greatest scores of each query; of equal ones those of least place."""
    order = np.lexsort((place, -score, own))
    q = own[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    size = np.diff(np.append(begin, len(q)))
    return order[np.arange(len(q)) - np.repeat(begin, size) < k]


def _places(table: pa.Table, columns: list[str]) -> np.ndarray:
    """The place of each row in the order of some columns, nulls first."""
    order = np.asarray(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in columns], null_placement="at_start"))
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return places


def _scored(chunks: DataFrame, blocks: Iterable[QueryBlock], top_k: int, by: str, extra: list[str]) -> DataFrame:
    fields = [f"{x} {chunks.schema[x].dataType.simpleString()}" for x in (*extra, "doc_ord", "doc_id", "pos")]
    with_vector = "vector" in chunks.columns

    def score(table: pa.Table, queries: QueryBlock) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, np.ndarray]] = []
        places = _places(table, ["doc_ord", "pos"])
        step = max(1, min(ROWS, CELLS // len(queries.ids)))

        def cut() -> dict[str, np.ndarray]:
            held = {c: np.concatenate([x[c] for x in found]) for c in found[0]}
            best = _best_of_each(held["own"], held[by], places[held["row"]], top_k)
            return {c: v[best] for c, v in held.items()}

        for at in range(0, table.num_rows, step):
            part = table.slice(at, step)
            vectors = np.array(part.column("vector").to_pylist(), f32) if with_vector else None
            scored = queries.score(part.column("text").to_pylist(), np.asarray(part.column("token_count").fill_null(0)), vectors)
            rows, own = _best(scored[by], top_k)
            found.append({"row": rows + at, "own": own} | {c: v[rows] if v.ndim == 1 else v[rows, own] for c, v in scored.items()})
            if len(found) > 1 and sum(len(x["row"]) for x in found) > HELD + top_k * len(queries.ids):
                found = [cut()]
        best = cut()
        taken, own = pa.array(best.pop("row")), pa.array(best.pop("own"))
        columns = {x: table.column(x).combine_chunks().take(taken) for x in (*extra, "doc_ord", "doc_id", "pos", "token_count")}
        columns |= {"query_id": pa.array(queries.ids, pa.string()).take(own), "query_ord": pa.array(queries.orders, pa.int64()).take(own), "metadata_boost": pa.array(np.zeros(len(taken), f32))}
        columns |= {c: pa.array(v) for c, v in best.items()}
        yield pa.RecordBatch.from_pydict({c: columns[c] for c in names})

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _passes(batches):
            # Chunks of different grid points are never ranked together.
            for part in _apart(table, extra):
                for queries in blocks:
                    if queries.ids:
                        yield from score(part, queries)

    schema = ", ".join([*fields, "query_id string, query_ord bigint, score float", COMPONENTS])
    names = [*extra, "doc_ord", "doc_id", "pos", "query_id", "query_ord", "score", *_COMPONENTS]
    wanted = [*extra, "doc_ord", "doc_id", "pos", "text", "token_count"] + ["vector"] * with_vector
    return spread(chunks.select(*wanted)).mapInArrow(make, schema)


def _apart(table: pa.Table, columns: list[str]) -> Iterator[pa.Table]:
    """The rows of each combination of values."""
    if not columns:
        yield table
        return
    codes = np.zeros(table.num_rows, np.int64)
    for column in columns:
        values = table.column(column).combine_chunks().dictionary_encode()
        codes = codes * len(values.dictionary) + np.asarray(values.indices)
    for code in np.unique(codes):
        yield table.filter(pa.array(codes == code))


def ranked(chunks: DataFrame, queries: DataFrame, top_k: int, max_queries: int = MAX_QUERIES, by: str = "score", within: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, query_ord, doc_ord, doc_id, pos, rank, score, components): the best top_k chunks of each query.

    chunks: (doc_ord, doc_id, pos, text, token_count[, vector]); queries: (query_id, query, query_ord[, vector]).
    Ties go to the chunk that comes first in the corpus.  by="similarity" ranks by the cosine alone.
    With columns to rank within, each combination of their values has a ranking of its own.
    """
    found = _scored(chunks, _query_blocks(queries, max_queries), top_k, by, list(within))
    best = Window.partitionBy(*within, "query_id", "query_ord").orderBy(F.desc(by), "doc_ord", "pos")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def phrase_pairs(chunks: DataFrame, queries: DataFrame, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, query_ord, doc_id): the documents that have a whole query as a phrase, found in one scan."""
    blocks = _query_blocks(queries, max_queries)
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _passes(batches):
            for queries in blocks:
                for at in range(0, table.num_rows, ROWS):
                    part = table.slice(at, ROWS)
                    hits = [(row, q) for row, text in enumerate(part.column(1).to_pylist()) for q in queries._phrases_in((text or "").lower())]
                    ids = part.column(0).combine_chunks().take(pa.array([r for r, _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array([queries.ids[q] for _, q in hits], pa.string()), "query_ord": pa.array([queries.orders[q] for _, q in hits], pa.int64()), "doc_id": ids})

    return spread(chunks.select("doc_id", "text")).mapInArrow(find, f"query_id string, query_ord bigint, doc_id {kind}").distinct()


def explained(chunks: DataFrame, query: str, top_k: int) -> DataFrame:
    """The best chunks of one query with the components of their scores."""
    spark = chunks.sparkSession
    one = spark.createDataFrame([("query", query, 0)], "query_id string, query string, query_ord bigint")
    return ranked(chunks, one, top_k).drop("query_id", "query_ord")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, max_queries: int = MAX_QUERIES, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, rank, score): the k nearest vectors of every query vector by cosine, ties to the lesser id.

    queries: (query_id, vector); vectors: (vec_id, vector).  Exact: every pair is scored in double precision, some
    thousands of vectors against a block of queries at a time, and a task keeps the best of each query and as many
    vectors.  Queries beyond one block lie in the shared folder, so vectors are scanned once.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    rows = queries.select("query_id", "vector")

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        v = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
        size = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def build(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        return table.column("query_id").combine_chunks(), unit(table.column("vector"))

    first = rows.limit(max_queries + 1).toArrow()
    if first.num_rows <= max_queries:
        blocks = Sent(vectors.sparkSession.sparkContext.broadcast(build(first)))
    else:
        blocks = in_blocks(rows, "query_id", -(-rows.count() // max_queries), build)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _passes(batches):
            own_ids, own, places = table.column(0).combine_chunks(), unit(table.column(1)), _places(table, ["vec_id"])
            for ids, q in blocks:
                if not len(q):
                    continue
                found = []
                for at in range(0, len(own), 1024):
                    scores = np.round(own[at : at + 1024] @ q.T, digits) + 0.0
                    row, col = _best(scores, k)
                    found.append((row + at, col, scores[row, col]))
                row, col, value = (np.concatenate(x) for x in zip(*found, strict=True))
                best = _best_of_each(col, value, places[row], k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(col[best])), own_ids.take(pa.array(row[best])), pa.array(value[best])], names=["query_id", "vec_id", "score"])

    made = spread(vectors.select("vec_id", "vector")).mapInArrow(score, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return made.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def corpus_chunks(documents: DataFrame, config: Config) -> DataFrame:
    """The chunks of a corpus of (doc_ord, doc_id, text), normalised first."""
    from corvane.functions.chunking import chunks

    return chunks(documents.withColumn("text", T.normalized(F.col("text"))), config.chunk_size, config.chunk_overlap)
