"""Cutting documents into chunks: headings first, then sentences, then words, with whole lines of overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.durable import materialize, spread

#: Rows and characters of chunks that a task holds before it passes them on.
MADE_ROWS, MADE_CHARS = 4096, 1 << 22
#: Documents a bucket when chunks are numbered: only sums of buckets are ordered in one task.
BUCKET = 1 << 16
_SENTENCE_END = re.compile(r"(?<=[.!?;])(?=\s|$)")


def sentences(line: str) -> list[str]:
    found = [x.strip() for x in _SENTENCE_END.split(line)]
    return [x for x in found if x] or [line]


def segments(line: str, most: int) -> list[str]:
    """A line in parts of at most so many words: whole sentences where they fit, else cut between words."""
    if most <= 0 or len(line.split()) <= most:
        return [line]
    done: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in sentences(line):
        own = sentence.split()
        if size and (len(own) > most or size + len(own) > most):
            done.append(" ".join(held))
            held, size = [], 0
        if len(own) > most:
            done += [" ".join(own[at : at + most]) for at in range(0, len(own), most)]
        else:
            held.append(sentence)
            size += len(own)
    if held:
        done.append(" ".join(held))
    return done


def heading_parts(line: str) -> list[str]:
    return [x.strip() for x in line.lstrip("#").strip().split("/") if x.strip()]


class _Buffer:
    """The lines of the chunk being made, with their words counted."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int]] = []

    @property
    def size(self) -> int:
        return sum(n for _, n in self.lines)

    def keep_tail(self, overlap: int) -> None:
        """Leave the last lines, at least one, as long as they stay within the overlap."""
        kept = 0
        for at in range(len(self.lines) - 1, -1, -1):
            if kept and kept + self.lines[at][1] > overlap:
                break
            kept += self.lines[at][1]
        else:
            at = -1
        self.lines = self.lines[at + 1 :]


def chunk_text(text: str | None, chunk_size: int, overlap: int) -> list[tuple[str, int, list[str]]]:
    """(text, words, heading path) of each chunk of one document."""
    out: list[tuple[str, int, list[str]]] = []
    path: list[str] = []
    buffer, size = _Buffer(), 0

    def emit() -> None:
        out.append(("\n".join(line for line, _ in buffer.lines).strip(), size, path))

    for raw in (text or "").split("\n"):
        line = raw.strip()
        if not line:
            continue
        if line.startswith("#"):
            if buffer.lines:
                emit()
                buffer, size = _Buffer(), 0
            path = heading_parts(line)
            parts = [line]
        else:
            parts = segments(line, chunk_size)
        for part in parts:
            n = len(part.split())
            if buffer.lines and size + n > chunk_size:
                emit()
                if overlap > 0:
                    buffer.keep_tail(overlap)
                    size = buffer.size
                else:
                    buffer, size = _Buffer(), 0
            buffer.lines.append((part, n))
            size += n
    if buffer.lines:
        emit()
    return out


_MADE = {"chunk_size": pa.int32(), "chunk_overlap": pa.int32(), "pos": pa.int32(), "text": pa.string(), "token_count": pa.int32(), "heading_path": pa.list_(pa.string())}


def chunk_batches(batch: pa.RecordBatch, grid: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Chunks of a batch of (doc_ord, doc_id, text), passed on as they come: MADE_ROWS and MADE_CHARS bound what is held."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        at, *values = zip(*rows, strict=True)
        index = pa.array(at, pa.int64())
        made = {name: pa.array(x, kind) for (name, kind), x in zip(_MADE.items(), values, strict=True)}
        return pa.RecordBatch.from_pydict({"doc_ord": batch.column(0).take(index), "doc_id": batch.column(1).take(index)} | made)

    rows: list[tuple] = []
    chars = 0
    for row, scalar in enumerate(batch.column(2)):
        text = scalar.as_py()
        for size, overlap in grid:
            for pos, (part, n, path) in enumerate(chunk_text(text, size, overlap)):
                rows.append((row, size, overlap, pos, part, n, path))
                chars += len(part)
                if len(rows) >= MADE_ROWS or chars >= MADE_CHARS:
                    yield packed(rows)
                    rows, chars = [], 0
    if rows:
        yield packed(rows)


def chunked(documents: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Chunks of (doc_ord, doc_id, text) for each (chunk_size, overlap) of the grid, in one pass over the text."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from chunk_batches(batch, grid)

    schema = f"doc_ord bigint, doc_id {kind}, chunk_size int, chunk_overlap int, pos int, text string, token_count int, heading_path array<string>"
    return spread(documents.select("doc_ord", "doc_id", "text")).mapInArrow(make, schema)


def chunks(documents: DataFrame, chunk_size: int, overlap: int) -> DataFrame:
    """(doc_ord, doc_id, pos, text, token_count, heading_path): the chunks of a corpus, not numbered."""
    return chunked(documents, [(chunk_size, overlap)]).drop("chunk_size", "chunk_overlap")


def numbered(chunk_rows: DataFrame) -> DataFrame:
    """Adds chunk_ord, the running number over the corpus, and chunk_id.

    The chunks are written to the shared folder first, so they are made once.  Documents
    are counted, their counts are summed by buckets of document numbers, and
    only the bucket sums, one for every 65536 documents, are accumulated in one task.
    """
    chunk_rows = materialize(chunk_rows, "chunks")
    per_doc = chunk_rows.groupBy("doc_ord").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("doc_ord") / BUCKET))
    sums = per_doc.groupBy("bucket").agg(F.sum("n").alias("n"))
    starts = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    within = per_doc.select("doc_ord", "bucket", (F.sum("n").over(Window.partitionBy("bucket").orderBy("doc_ord")) - F.col("n")).alias("inner"))
    first = within.join(starts, "bucket").select("doc_ord", (F.col("start") + F.col("inner")).alias("first"))
    found = chunk_rows.join(first, "doc_ord").withColumn("chunk_ord", F.col("first") + F.col("pos")).drop("first")
    return found.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_ord").cast("string")))
