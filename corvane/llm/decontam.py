"""Benchmark decontamination by winnowing.

Texts are lower-cased word sequences.  Every GRAM consecutive words are hashed;
of each WINDOW consecutive hashes the least is kept as a fingerprint.  Two texts
that share GRAM + WINDOW - 1 = SPAN words or more share a whole window, so they
share a fingerprint.  Each fingerprint in common is extended both ways to the
maximal run of equal words, and runs of SPAN words or more are reported.

A benchmark of up to BROADCAST_BYTES of text is held by every worker, and hits are
found and extended while documents are scanned: no shuffle.  A larger one is
joined on the fingerprints, and the candidate pairs are extended after; both ways
give the same rows.

Defined results: null or empty texts, and texts of fewer than SPAN words, match
nothing; texts of any length are searched in full; each row of the documents is reported
by itself, repeated or not, and a null id stays null; repeated items are reported as
often as they are there; decontaminate() judges each row by its own text, whatever its
id; an empty table, or an empty benchmark, has no match; extra columns of any name are
kept by decontaminate() and left out by shared_spans().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared

GRAM = 8
WINDOW = 6
SPAN = GRAM + WINDOW - 1
BROADCAST_BYTES = 16 << 20


def winnowed(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, row, word position) of all rows with SPAN words or more; ties within a window all count."""
    counts = np.diff(first)
    n = len(hashes) - GRAM + 1
    if n < WINDOW or not (counts >= SPAN).any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    h = hashes[:n].copy()
    for j in range(1, GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += hashes[j : n + j]
    h = shared.mix(h)
    m = n - WINDOW + 1
    low = h[:m].copy()
    for j in range(1, WINDOW):
        np.minimum(low, h[j : m + j], out=low)
    # A window counts if all its SPAN words lie in one row.
    ends = np.zeros(len(hashes) + 1, bool)
    ends[first[1:]] = True
    room = np.cumsum(ends)
    whole = room[SPAN - 1 : SPAN - 1 + m] == room[:m]
    chosen = np.zeros(n, bool)
    for j in range(WINDOW):
        chosen[j : m + j] |= (low == h[j : m + j]) & whole
    at = np.flatnonzero(chosen)
    row = np.searchsorted(first, at, side="right") - 1
    return h[at], row, at - first[row]


class Benchmark:
    """Item words and sorted fingerprints, small enough to be held whole."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        texts = pc.utf8_lower(shared.as_texts(texts))
        self.ids = ids
        self.words, self.first = shared.hashed(texts, 0, len(texts)) if len(texts) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        h, row, at = winnowed(self.words, self.first)
        order = np.argsort(h, kind="stable")
        self.hash, self.row, self.at = h[order], row[order], at[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def spans(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item row, spans, longest, start of the longest) for all rows and items that share a span."""
        h, row, at = winnowed(hashes, first)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        h, row, at = h[maybe], row[maybe], at[maybe]
        left, right = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
        each = right - left
        if not each.sum():
            return []
        own = np.repeat(np.arange(len(h)), each)
        other = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(left, each)
        hits = np.stack([row[own], self.row[other], at[own] - self.at[other], at[own]], 1)
        hits = hits[np.lexsort(hits.T[::-1])]
        found: dict[tuple[int, int], list[int]] = {}
        last, reach = (-1, -1, 0), -1
        for r, i, diagonal, p in hits.tolist():
            if (r, i, diagonal) == last and p < reach:
                continue
            doc = hashes[first[r] : first[r + 1]]
            item = self.words[self.first[i] : self.first[i + 1]]
            lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
            unequal = np.flatnonzero(doc[lo:hi] != item[lo - diagonal : hi - diagonal]) + lo
            k = int(np.searchsorted(unequal, p))
            start = int(unequal[k - 1]) + 1 if k else lo
            reach = int(unequal[k]) if k < len(unequal) else hi
            last = (r, i, diagonal)
            if reach - start >= SPAN:
                best = found.setdefault((r, i), [0, 0, 0])
                best[0] += 1
                if (reach - start, -start) > (best[1], -best[2]):
                    best[1:] = [reach - start, start]
        return [(r, i, *best) for (r, i), best in found.items()]


def _rows(ids: pa.Array, texts: pa.Array, bench: Benchmark) -> Iterator[tuple[pa.Array, list[tuple]]]:
    texts = pc.utf8_lower(shared.as_texts(texts))
    for start, end in shared.slices(texts):
        found = bench.spans(*shared.hashed(texts, start, end))
        if found:
            yield ids.take(pa.array([start + x[0] for x in found])), found


def _batch(ids: pa.Array, items: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([x[j] for x in found], pa.int32()) for j in (2, 3, 4)]
    return pa.RecordBatch.from_arrays([ids, items, *columns], names=["doc_id", "item_id", "spans", "longest", "start"])


def shared_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, spans, longest, start): documents and benchmark items that share SPAN words in a row.

    spans counts the maximal shared runs, longest is the words of the longest, start its first word in the document.
    """
    docs = shared.plain(docs, doc_id=id_col, text=text_col)
    items = shared.plain(benchmark, item_id=item_col, item_text=item_text_col).where("item_text IS NOT NULL")
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, spans int, longest int, start int"
    bench = _held(items, broadcast_bytes)
    if bench is None:
        return _joined(docs, items, schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bench.value
        for batch in batches:
            for ids, found in _rows(batch.column(0), batch.column(1), known):
                yield _batch(ids, known.ids.take(pa.array([x[1] for x in found])), found)

    return docs.mapInArrow(shared.lean(scan), schema)


def _held(items: DataFrame, broadcast_bytes: int) -> Broadcast | None:
    """The benchmark for every worker, or None where it is larger than that."""
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size > broadcast_bytes:
        return None
    held = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Benchmark(held.column("item_id").combine_chunks(), held.column("item_text")))


def _joined(docs: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """The way for a benchmark of any size: join fingerprints, then extend each candidate pair."""

    def fingerprints(rows: DataFrame, name: str) -> DataFrame:
        # The text's hash tells rows of a repeated id apart.
        keyed = rows.select(F.col(rows.columns[0]).alias(name), F.xxhash64(rows.columns[1]).alias(f"{name}_text"), F.col(rows.columns[1]).alias("text"))
        kind = keyed.schema[name].dataType.simpleString()

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pc.utf8_lower(shared.as_texts(batch.column(2)))
                for start, end in shared.slices(texts):
                    h, row, _ = winnowed(*shared.hashed(texts, start, end))
                    pairs = np.unique(np.stack([h.view(np.int64), row + start], 1), axis=0)
                    row = pa.array(pairs[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), batch.column(0).take(row), batch.column(1).take(row)], names=["hash", name, f"{name}_text"])

        return keyed.mapInArrow(shared.lean(make), f"hash bigint, {name} {kind}, {name}_text bigint")

    pairs = fingerprints(docs, "d").join(fingerprints(items, "i"), "hash").select("d", "d_text", "i", "i_text").distinct()
    left = docs.select("doc_id", F.xxhash64("text").alias("d_text2"), "text")
    right = items.select("item_id", F.xxhash64("item_text").alias("i_text2"), "item_text")
    whole = pairs.join(left, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("d_text") == F.col("d_text2"))).join(right, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("i_text") == F.col("i_text2")))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each text of a batch is hashed once, however many pairs it is in.
        for batch in batches:
            texts, items = (batch.column(k).cast(pa.large_string()).dictionary_encode() for k in (1, 3))
            bench = Benchmark(list(range(len(items.dictionary))), items.dictionary)
            low = pc.utf8_lower(texts.dictionary)
            spans = {}
            for start, end in shared.slices(low):
                spans |= {(start + row, item): best for row, item, *best in bench.spans(*shared.hashed(low, start, end))}
            pairs = zip(np.asarray(texts.indices).tolist(), np.asarray(items.indices).tolist(), strict=True)
            found = [(row, 0, *spans[pair]) for row, pair in enumerate(pairs) if pair in spans]
            if found:
                rows = pa.array([x[0] for x in found])
                yield _batch(batch.column(0).take(rows), batch.column(2).take(rows), found)

    return whole.select("doc_id", "text", "item_id", "item_text").mapInArrow(shared.lean(extend), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that share no span with any benchmark item, all columns kept.

    With a benchmark that every worker holds this is a filter, row by row.  A larger one
    gives a list of ids with their texts' hashes, and rows are kept by a null-safe join on both.
    """
    docs = shared.spread(docs)
    items = shared.plain(benchmark, item_id=item_col, item_text=item_text_col).where("item_text IS NOT NULL")
    bench = _held(items, broadcast_bytes)
    if bench is None:
        # The text's hash is part of the id here, so that rows of a repeated or null id are told apart.
        rows = shared.plain(docs, doc_id=id_col, text=text_col).select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
        kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
        found = _joined(rows, items, f"doc_id {kinds[0]}, item_id {kinds[1]}, spans int, longest int, start int")
        gone = shared.materialize(found.select(F.col("doc_id.doc_id").alias("_gone"), F.col("doc_id.hash").alias("_gone_text")).distinct(), "leaks")
        same = docs[f"`{id_col}`"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[f"`{text_col}`"]) == gone["_gone_text"])
        return docs.join(gone, same, "left_anti")

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), bool)
        for places, _ in _rows(pa.array(np.arange(len(texts))), texts, bench.value):
            keep[np.asarray(places)] = False
        return pa.array(keep)

    return docs.where(clean(F.col(f"`{text_col}`")))
