"""Vectors: the deterministic bag of words, cosine similarity, and a remote embedder with its cache."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import text as T

DIM = 64
BATCH_TEXTS = 64
BATCH_TOKENS = 2000
REMOTE_DIM = 1536


@lru_cache(maxsize=1 << 16)  # frequent words; more would hold what a corpus has of rare ones
def place_of(word: str) -> int:
    return hashlib.sha256(word.encode()).digest()[0] % DIM


def bow(texts: list[str | None]) -> np.ndarray:
    """(texts, 64) counts: a word's place is its SHA-256 modulo 64, for which the first byte is enough."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in enumerate(texts):
        if text:
            out[row] = np.bincount([place_of(w) for w in text.split()] or [0], minlength=DIM) if text.split() else 0
    return out


def bow_array(text: Column) -> Column:
    """The 64 word counts of a text as an array of floats, in Arrow batches."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        counts = bow(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * DIM), pa.array(counts.reshape(-1)))

    return vectors(text)


# -- remote


def rough_tokens(text: str) -> int:
    """An estimate: four tokens for every three words, rounded up."""
    return int(np.ceil(np.float32(len(text.split())) * np.float32(1.33)))


def batches_of(texts: list[str]) -> list[list[str]]:
    """Consecutive batches, each closed at 64 texts or once it has 2000 rough tokens."""
    out: list[list[str]] = []
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += rough_tokens(text)
        if len(held) >= BATCH_TEXTS or size >= BATCH_TOKENS:
            out.append(held)
            held, size = [], 0
    return out + [held] if held else out


def worth_retrying(status: int) -> bool:
    return status == 429 or status >= 500


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class BagOfWords:
    """The deterministic embedder."""

    dim = DIM

    def embed(self, texts: list[str]) -> list[list[float]]:
        return bow(texts).tolist()


Post = Callable[[str, dict, dict, float], tuple[int, bytes]]


def post(url: str, headers: dict, body: dict, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


class Remote:
    """Vectors from an HTTP service: batched, retried with a linear back-off; the client can be replaced."""

    dim = REMOTE_DIM

    def __init__(self, config: Config, key: str, client: Post = post, wait: Callable[[float], None] = time.sleep) -> None:
        self.config, self.key, self.client, self.wait = config, key, client, wait

    def _one(self, batch: list[str]) -> list[list[float]]:
        where = self.config.embedder
        last = ""
        for attempt in range(self.config.max_retries + 1):
            try:
                status, reply = self.client(f"{where.base_url.rstrip('/')}/embeddings", {"Authorization": f"Bearer {self.key}"}, {"model": where.model, "input": batch}, self.config.request_timeout_ms / 1000)
            except OSError as error:
                status, reply, last = 0, b"", str(error)
            if 200 <= status < 300:
                vectors = [x["embedding"] for x in json.loads(reply)["data"]]
                if len(vectors) != len(batch):
                    raise RuntimeError(f"{len(vectors)} vectors came back for {len(batch)} texts")
                return vectors
            if status and not worth_retrying(status):
                raise RuntimeError(f"the embedding service answered {status}: {reply[:200]!r}")
            last = last or f"status {status}"
            if attempt < self.config.max_retries:
                self.wait(self.config.retry_backoff_ms * (attempt + 1) / 1000)
        raise RuntimeError(f"no vectors after {self.config.max_retries + 1} attempts: {last}")

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for batch in batches_of(texts) for v in self._one(batch)]


def embedder_of(config: Config) -> Embedder:
    if config.embedder.provider == "null":
        return BagOfWords()
    key = os.environ.get("OPENAI_API_KEY")
    if not key:
        raise RuntimeError("OPENAI_API_KEY must be set for the remote embedder")
    return Remote(config, key)


def cache_key(text: Column, dim: int, tag: str) -> Column:
    """SHA-256 over the text, the dimension as eight little-endian bytes, and the model."""
    return F.sha2(F.concat(F.encode(text, "UTF-8"), F.lit(dim.to_bytes(8, "little")), F.lit(tag.encode())), 256)


def embedded(rows: DataFrame, embedder: Embedder, tag: str, cache: str | None = None) -> DataFrame:
    """rows with `vector`; with a cache, a Parquet folder, only texts that it lacks are embedded, and then added."""
    keyed = rows.withColumn("vector_key", cache_key(F.coalesce("text", F.lit("")), embedder.dim, tag))
    spark = rows.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.embed([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["vector_key", "vector"])

    known = None
    if cache:
        try:
            known = spark.read.parquet(cache).select("vector_key", "vector")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    needed = keyed.select("vector_key", "text").dropDuplicates(["vector_key"])
    if known is not None:
        needed = needed.join(known.select("vector_key"), "vector_key", "left_anti")
    fresh = needed.mapInArrow(make, "vector_key string, vector array<float>")
    if cache:
        fresh.write.mode("append").parquet(cache)
        fresh = spark.read.schema("vector_key string, vector array<float>").parquet(cache).dropDuplicates(["vector_key"])
    return keyed.join(fresh, "vector_key").drop("vector_key")
