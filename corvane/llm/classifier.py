"""A quality classifier on random-indexing word vectors.

Each token has a sparse random index vector: NONZERO places of DIM, each +1 or -1,
fixed by its hash.  A token's word vector is the sum of the index vectors of the
tokens within REACH places of it, and of its own, over all documents.  Every token that
occurs MIN_COUNT times in the corpus has a vector of its own; the rarer ones share the
sum of theirs, and one coordinate that says so.  A document is the mean of its tokens'
unit vectors, weighted so that frequent tokens count less, with the length of that mean.
A network of two layers gives a probability, whose temperature is fitted on labelled
documents that were held out from training.

Contexts are added up by token within each task, then by token over all tasks; the
vocabulary is a table in the shared folder that grows with the corpus.  The vectors of
the HELD most frequent tokens are sent to every task (36 MB); if the vocabulary has more,
documents' other tokens that pass a Bloom filter of it (8 MB) are joined with the table.
Unit vectors are whole numbers of 16 bits, so sums don't depend on their order and both
ways give the same result.

The network is fitted on MAX_LABELLED of the given documents that have a label and a
token, those whose ids have the least hash, which bounds the fit and nothing else.

Tokens are runs of word characters, in their own case, and runs of other visible
characters.  Defined results: a document without tokens has probability 0 and is
rejected; labels that are null, or of unknown documents, are left out; of repeated
labels the least counts; rows of a repeated id in the sample are the ones of least text
hash, one for each id; each row of the documents is scored by itself, by its whole text;
with labels of one kind alone there is nothing to tell apart, and every document with
tokens gets that kind's probability, 1 or 0; without any labels it is 1; an empty table
gives an empty one; extra columns are kept by passing() and left out by scored().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared

DIM = 32
NONZERO = 2
REACH = 2
#: Tokens with fewer occurrences share one vector.
MIN_COUNT = 10
#: The most vectors that are sent to every task.
HELD = 1 << 19
MAX_LABELLED = 8000
HIDDEN = 24
#: Tokens as frequent as this, or more, weigh half or less.
RARE = 1e-3
#: Every document also counts the mean token of the corpus, at this weight: short texts stay near the middle.
PRIOR = 40.0
#: Documents whose probability of good quality is less are rejected.
THRESHOLD = 0.5
_SEED = 20240229
_SCALE = 32767
#: Of a weighted vector: the unit vector, whether the token is rare, and the weight.
_WIDTH = DIM + 2
_FEATURES = DIM + 2
#: Bits of the filter of the vocabulary beyond the held tokens.
_BLOOM = 1 << 26
#: Tokens of a task whose contexts are added up before they are passed on.
_TOGETHER = 250_000


# -- word vectors


def _index(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the NONZERO places of a token's index vector: the place and the sign."""
    made = []
    for j in range(NONZERO):
        h = shared.mix(hashes + np.uint64(j + 1))
        made.append(((h & np.uint64(DIM - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)))
    return made


def _added(tokens: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one row for each token, in order."""
    if not len(tokens):
        return tokens, counts, sums
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    return tokens[begin], np.add.reduceat(counts[order], begin), np.add.reduceat(sums[order], begin, axis=0)


def contexts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, counts, summed contexts) of each block of the texts."""
    texts = shared.as_texts(texts)
    for start, end in shared.slices(texts):
        hashes, first = shared.hashed(texts, start, end, symbols=True)
        if not len(hashes):
            continue
        tokens, row = np.unique(hashes, return_inverse=True)
        of = np.repeat(np.arange(end - start), np.diff(first))
        flat = np.zeros(len(tokens) * DIM)
        for place, sign in _index(tokens):
            place, sign = place[row], sign[row]
            for shift in range(REACH + 1):
                n = len(row) - shift
                if n <= 0:
                    continue
                same = of[shift:] == of[:n]
                at = [row[:n] * DIM + place[shift:]]
                weight = [sign[shift:] * same]
                if shift:
                    at.append(row[shift:] * DIM + place[:n])
                    weight.append(sign[:n] * same)
                flat += np.bincount(np.concatenate(at), np.concatenate(weight), len(flat))
        yield tokens, np.bincount(row), flat.reshape(-1, DIM).astype(np.int32)


_SUMS = "token bigint, n bigint, v binary"


def _sum_batches(tokens: np.ndarray, counts: np.ndarray, sums: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The wanted rows as _SUMS; most contexts fit in a byte for each place, the others take eight.

    A task passes its sums on long before one of them fills 32 bits.
    """
    narrow = (sums.max(1, initial=0) < 128)[wanted] & (sums.min(1, initial=0) > -128)[wanted]
    for rows, kind in ((wanted[narrow], np.int8), (wanted[~narrow], np.int64)):
        for at in range(0, len(rows), 8192):
            part = rows[at : at + 8192]
            data = np.ascontiguousarray(sums[part].astype(kind))
            offsets = np.arange(len(part) + 1, dtype=np.int32) * (data.itemsize * DIM)
            v = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), pa.array(counts[part]), v], names=["token", "n", "v"])


def _sums_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = batch.column("v").cast(pa.binary())
    offsets = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
    data = np.frombuffer(v.buffers()[2], np.uint8)
    wide = np.diff(offsets) > DIM
    sums = np.empty((len(v), DIM), np.int64)
    sums[~wide] = data[offsets[:-1][~wide][:, None] + np.arange(DIM)].view(np.int8)
    if wide.any():
        sums[wide] = np.ascontiguousarray(data[offsets[:-1][wide][:, None] + np.arange(8 * DIM)]).view(np.int64)
    return np.asarray(batch.column("token")), np.asarray(batch.column("n")), sums


def unit(sums: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers."""
    return np.round(sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) * _SCALE).astype(np.int16)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each token of parts that have each of theirs once; takes the room of the result beside the parts."""
    tokens = np.unique(np.concatenate([x for x, _, _ in parts]))
    counts, sums = np.zeros(len(tokens), np.int64), np.zeros((len(tokens), DIM), np.int32)
    for own, n, v in parts:
        at = np.searchsorted(tokens, own)
        counts[at] += n
        sums[at] += v
    return tokens, counts, sums


def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SUMS of a task's texts; a token has several where there are more than _TOGETHER of them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        for part in contexts(batch.column(0)):
            held.append(part)
            rows += len(part[0])
            if rows > _TOGETHER:
                held = [_merged(held)]
                if (rows := len(held[0][0])) > _TOGETHER * 3 // 4:
                    # Frequent tokens stay: they will come again.
                    rare = np.ones(rows, bool)
                    rare[np.argpartition(held[0][1], -(_TOGETHER // 4))[-(_TOGETHER // 4) :]] = False
                    frequent = tuple(x[~rare] for x in held[0])
                    yield from _sum_batches(*held.pop(), np.flatnonzero(rare))
                    held, rows = [frequent], len(frequent[0])
    if held:
        merged = _merged(held)
        held.clear()
        yield from _sum_batches(*merged, np.arange(len(merged[0])))


def word_vectors(docs: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """((token, n, u) of the vocabulary, a table; tokens in the corpus; the unit vector of rare ones), over all documents of (text)."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        rare_n, rare = 0, np.zeros(DIM, np.int64)

        def done(tokens: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            nonlocal rare_n, rare
            few = counts < MIN_COUNT
            rare_n, rare = rare_n + int(counts[few].sum()), rare + sums[few].sum(0)
            keep = ~few
            return row_batch(tokens[keep], counts[keep], unit(sums[keep]))

        def row_batch(tokens: np.ndarray | None, counts: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * DIM), pa.array(u.reshape(-1)))
            ids = pa.nulls(len(u), pa.int64()) if tokens is None else pa.array(tokens)
            return pa.RecordBatch.from_arrays([ids, pa.array(counts), lists, pa.nulls(len(u), pa.list_(pa.int64()))], names=["token", "n", "u", "rare"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found = _sums_of(batch)
            if last is not None:
                found = tuple(map(np.concatenate, zip(last, found, strict=True)))
            found = _added(*found)
            yield done(*(x[:-1] for x in found))
            last = tuple(x[-1:] for x in found)
        if last is not None:
            yield done(*last)
        # What the rare tokens of this partition add up to.
        rows = row_batch(None, np.array([rare_n]), np.zeros((1, DIM), np.int16))
        sums = pa.ListArray.from_arrays(pa.array([0, DIM], pa.int32()), pa.array(rare))
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], sums], names=rows.schema.names)

    sums = docs.mapInArrow(shared.lean(collected), _SUMS).repartition("token").sortWithinPartitions("token")
    words = shared.materialize(sums.mapInArrow(shared.lean(total), "token bigint, n bigint, u array<smallint>, rare array<bigint>"), "words")
    known = words.where("token IS NOT NULL").drop("rare")
    rest = words.where("token IS NULL").agg(F.sum("n").alias("n"), *[F.sum(F.col("rare")[j]).alias(f"u{j}") for j in range(DIM)]).first()
    n = (known.agg(F.sum("n")).first()[0] or 0) + (rest["n"] or 0)
    return known, n, unit(np.array([[rest[f"u{j}"] or 0 for j in range(DIM)]], float))[0]


def weighted(n: np.ndarray, u: np.ndarray, total: int, rare: bool = False) -> np.ndarray:
    """(rows, _WIDTH) whole numbers: unit vectors, whether rare, and weights, all times the weights."""
    weight = RARE / (RARE + (0 if rare else n / max(total, 1)))
    out = np.empty((len(u), _WIDTH), np.int16)
    out[:, :DIM] = np.round(u * np.reshape(weight, (-1, 1)))
    out[:, DIM] = np.round(weight * _SCALE) if rare else 0
    out[:, DIM + 1] = np.round(weight * _SCALE)
    return out


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """Three places of a hash in the filter."""
    mixed = [shared.mix(hashes + np.uint64(seed)) for seed in (101, 102, 103)]
    return [(x & np.uint64(_BLOOM - 1)).astype(np.int64) for x in mixed]


def bloom_of(words: DataFrame) -> np.ndarray:
    """The filter of all tokens of a vocabulary, made by the tasks and put together by place."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BLOOM, bool)
        for batch in batches:
            for at in _bits(np.asarray(batch.column(0)).view(np.uint64)):
                bits[at] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(packed[part])], names=["place", "bits"])

    found = words.select("token").mapInArrow(shared.lean(fill), "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(_BLOOM // 64, np.int64)
    out[np.asarray(found.column("place").combine_chunks())] = np.asarray(found.column("bits").combine_chunks())
    return out.view(np.uint8)


class Words:
    """Weighted vectors of the held tokens, the vector of rare ones, and the mean over the corpus."""

    def __init__(self, table: pa.Table, total: int, rare: np.ndarray, mean: np.ndarray, bloom: np.ndarray | None = None) -> None:
        tokens = np.asarray(table.column("token").combine_chunks()).view(np.uint64)
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        u = np.asarray(table.column("u").combine_chunks().flatten()).reshape(-1, DIM)
        self.rows = np.concatenate([weighted(np.asarray(table.column("n").combine_chunks()), u, total)[order], weighted(np.zeros(1), rare[None, :], total, True)])
        self.mean, self.bloom = mean, bloom
        self.begin = np.searchsorted(self.tokens, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        self.begin = np.append(self.begin, np.int32(len(self.tokens)))
        self.depth = int(np.diff(self.begin).max(initial=0)).bit_length()

    @property
    def whole(self) -> bool:
        return self.bloom is None

    def perhaps(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be in the rest of the vocabulary."""
        return np.logical_and.reduce([(self.bloom[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1 for bit in _bits(hashes)])

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's row, or the last one, that of rare tokens."""
        top = (hashes >> np.uint64(48)).astype(np.int64)
        low, high = self.begin[top], self.begin[top + 1]
        end = high
        # A search within the hashes of equal leading bits; at most `depth` steps.
        for _ in range(self.depth):
            middle = (low + high) >> 1
            less = (middle < high) & (self.tokens[np.minimum(middle, len(self.tokens) - 1)] < hashes)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        at = np.minimum(low, len(self.tokens) - 1)
        hit = (low < end) & (self.tokens[at] == hashes) if len(self.tokens) else np.zeros(len(hashes), bool)
        return np.where(hit, at, len(self.tokens))


def pooled(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(rows, _WIDTH) sums of each text's weighted vectors, which texts have a token, and, unless the vocabulary is held whole, each text's other tokens that may be in it with their numbers.

    Tokens that aren't held count as rare ones here.
    """
    texts = shared.as_texts(texts)
    out = np.zeros((len(texts), _WIDTH), np.int64)
    some = np.zeros(len(texts), bool)
    others: list[tuple[np.ndarray, np.ndarray]] = []
    for start, end in shared.slices(texts):
        hashes, first = shared.hashed(texts, start, end, symbols=True)
        row = words.place(hashes)
        of = np.repeat(np.arange(end - start), np.diff(first))
        for at in range(0, len(row), 1 << 15):
            part = of[at : at + (1 << 15)]
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            # At most 2**15 numbers of 15 bits: the sum fits.
            out[start + part[begin]] += np.add.reduceat(words.rows[row[at : at + (1 << 15)]].astype(np.int32), begin)
        some[start:end] = np.diff(first) > 0
        if not words.whole:
            new = row == len(words.tokens)
            new[new] = words.perhaps(hashes[new])
            for k in range(end - start):
                own = slice(first[k], first[k + 1])
                others.append(np.unique(hashes[own][new[own]], return_counts=True))
    return out, some, others


def features(sums: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """(rows, _FEATURES): the weighted mean of each text's vectors, and its length."""
    total = sums / _SCALE + PRIOR * mean
    x = total[:, : DIM + 1] / np.maximum(total[:, DIM + 1 :], 1e-9)
    return np.concatenate([x, np.linalg.norm(x[:, :DIM], axis=1, keepdims=True)], 1)


# -- the network


@dataclass
class Network:
    """Two layers and a temperature: probability = sigmoid((relu(x W1 + b1) W2 + b2) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> Network | None:
    """Adam on four fifths of the rows, temperature on the rest; None without labels of both kinds.

    The least loss on the rest, over the epochs, chooses the weights.
    """
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(_SEED)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(held) or y[train].min() == y[train].max() or y[held].min() == y[held].max():
        # Too few rows to hold some out: all of them do both.
        held, train = order, order.copy()
    net = Network(x[train].mean(0), x[train].std(0) + 1e-6, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array([0.0])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, best = 0, (np.inf, [w.copy() for w in weights])
    ones = np.ones(len(held))
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 64):
            part = train[at : at + 64]
            hidden = np.maximum(z[part] @ weights[0] + weights[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, weights[2]) * (hidden > 0)
            step += 1
            for k, g in enumerate((z[part].T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * weights[k] * (k in (0, 2)))
        loss = _loss(np.maximum(z[held] @ weights[0] + weights[1], 0) @ weights[2] + weights[3], y[held], ones)
        if loss < best[0]:
            best = (loss, [w.copy() for w in weights])
    net.w1, net.b1, net.w2, net.b2 = *best[1][:3], float(best[1][3][0])
    logit = net.logit(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=lambda t: _loss(logit / t, y[held], ones)))
    return net


# -- over tables


@dataclass
class Model:
    """What scoring needs: the vocabulary, the held part of it in every worker, and the network or the one known answer."""

    words: DataFrame
    total: int
    rare: np.ndarray
    held: Broadcast
    net: Network | None = None
    otherwise: float = 1.0


def vocabulary(docs: DataFrame, held: int = HELD) -> Model:
    """Word vectors of all documents of (text)."""
    words, total, rare = word_vectors(docs)
    size = words.count()
    first = (words.orderBy(F.desc("n"), "token").limit(held) if size > held else words).toArrow()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"))
            u = np.asarray(batch.column("u").flatten()).reshape(-1, DIM)
            sums = (weighted(n, u, total).astype(np.int64) * n[:, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), *[pa.array([int(x)]) for x in sums]], names=["n", *[f"s{j}" for j in range(_WIDTH)]])

    sums = words.select("n", "u").mapInArrow(shared.lean(add), "n bigint, " + ", ".join(f"s{j} bigint" for j in range(_WIDTH)))
    row = sums.agg(*[F.sum(c).alias(c) for c in sums.columns]).first()
    rest = total - (row["n"] or 0)
    mean = np.array([float(row[f"s{j}"] or 0) for j in range(_WIDTH)]) + weighted(np.zeros(1), rare[None, :], total, True)[0].astype(float) * rest
    mean = mean / mean[DIM + 1] if mean[DIM + 1] else mean
    broadcast = docs.sparkSession.sparkContext.broadcast(Words(first, total, rare, mean, bloom_of(words) if size > held else None))
    return Model(words, total, rare, broadcast)


def summed(rows: DataFrame, model: Model, whole: bool) -> DataFrame:
    """rows, whose last column is text, with (some, sums) in its place; a token that isn't held counts by the table of the vocabulary."""
    held, total, rare = model.held, model.total, model.rare
    names, kinds = rows.columns[:-1], [f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]]

    def lists(values: np.ndarray, offsets: np.ndarray | None = None) -> pa.Array:
        offsets = np.arange(len(values) + 1) * values.shape[1] if offsets is None else offsets
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.reshape(-1)))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, some, others = pooled(batch.column("text"), held.value)
            columns = [*batch.columns[:-1], pa.array(some), lists(sums)]
            if not whole:
                offsets = np.append(0, np.cumsum([len(x) for x, _ in others]))
                empty = np.zeros(0, np.int64)
                columns += [lists(np.concatenate([x.view(np.int64) for x, _ in others] or [empty]), offsets), lists(np.concatenate([n for _, n in others] or [empty]).astype(np.int64), offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "some", "sums", *["tokens", "times"] * (not whole)])

    schema = ", ".join([*kinds, "some boolean", "sums array<bigint>"])
    if whole:
        return rows.mapInArrow(shared.lean(pool), schema)
    first = shared.materialize(rows.mapInArrow(shared.lean(pool), f"{schema}, tokens array<bigint>, times array<bigint>").withColumn("_row", F.monotonically_increasing_id()), "pooled")
    low = weighted(np.zeros(1), rare[None, :], total, True)[0].astype(np.int32)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A token of the vocabulary was counted as a rare one: take that back.
        for batch in batches:
            u = np.asarray(batch.column("u").flatten()).reshape(-1, DIM)
            rows = np.ascontiguousarray(weighted(np.asarray(batch.column("n")), u, total) - low, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array([x.tobytes() for x in rows], pa.binary())], names=["token", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_sum = None, np.zeros(_WIDTH, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, times = np.asarray(batch.column("_row")), np.asarray(batch.column("times"))
            own = np.frombuffer(b"".join(batch.column("change").to_pylist()), np.int32).reshape(-1, _WIDTH) * times[:, None]
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            rows, sums = row[begin], np.add.reduceat(own, begin)
            if last == rows[0]:
                sums[0] += held_sum
            elif last is not None:
                rows, sums = np.append(last, rows), np.concatenate([held_sum[None, :], sums])
            last, held_sum = int(rows[-1]), sums[-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:-1]), lists(sums[:-1])], names=["_row", "change"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), lists(held_sum[None, :])], names=["_row", "change"])

    # Tokens that aren't held are rare enough for none of them to make a hot key.
    table = model.words.mapInArrow(shared.lean(change), "token bigint, change binary")
    pairs = first.select("_row", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("_row", "t.tokens", "t.times")
    changes = pairs.join(table, F.col("tokens") == F.col("token")).select("_row", "times", "change")
    changes = changes.repartition("_row").sortWithinPartitions("_row").mapInArrow(shared.lean(add), "_row bigint, change array<bigint>")
    out = first.join(changes, "_row", "left")
    both = F.when(F.col("change").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "change", lambda a, b: a + b))
    return out.select(*[F.col(f"`{x}`") for x in names], "some", both.alias("sums"))


def _matrix(sums: pa.Array) -> np.ndarray:
    return np.asarray(sums.flatten()).reshape(-1, _WIDTH)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, held: int = HELD) -> Model:
    """Word vectors from all documents, and a network from a bounded sample of the labelled ones."""
    model = vocabulary(shared.plain(docs, text=text_col).where("text IS NOT NULL"), held)
    known = shared.plain(labels, label_id=label_id_col, y=label_col).where("label_id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("label_id").agg(F.min("y").alias("y"))
    texts = shared.plain(docs, doc_id=id_col, text=text_col)
    # Labels that no document with a token has don't use up the bound.
    usable = texts.where(F.col("text").rlike(r"[^\t-\r ]")).select("doc_id")
    known = known.join(usable, F.col("label_id") == F.col("doc_id"), "left_semi")
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    # The sample has a bound of its own, so it is sent to the scan instead of shuffling the documents.
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.col("y").cast("double").alias("y"), "text")
    mean = model.held.value.mean
    one = summed(rows, model, model.held.value.whole).where("some").groupBy("doc_id").agg(F.min_by(F.struct("y", "sums"), F.struct("h", "sums")).alias("r"))
    got = one.select("doc_id", "r.*").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return model
    y = np.asarray(got.column("y").combine_chunks())
    model.net = fit(features(_matrix(got.column("sums").combine_chunks()), mean), y)
    model.otherwise = float(y.min() > 0)
    return model


def _probability(model: Model):
    """A function of (some, sums) columns that gives the probability of good quality."""
    mean, net, otherwise = model.held.value.mean, model.net, model.otherwise

    @F.arrow_udf("double")
    def probability(some: pa.Array, sums: pa.Array) -> pa.Array:
        p = net.probability(features(_matrix(sums), mean)) if net is not None else np.full(len(sums), otherwise)
        return pa.array(np.where(np.asarray(some), p, 0.0))

    return probability


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held: int = HELD) -> DataFrame:
    """(doc_id, probability, keep) for every row."""
    model = trained(docs, labels, id_col, text_col, held=held)
    rows = summed(shared.plain(docs, doc_id=id_col, text=text_col), model, model.held.value.whole)
    made = rows.select("doc_id", _probability(model)("some", "sums").alias("probability"))
    return made.withColumn("keep", F.col("probability") >= threshold)


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, held: int = HELD) -> DataFrame:
    """The rows that the classifier keeps, all columns kept."""
    docs = shared.spread(docs)
    model = trained(docs, labels, id_col, text_col, held=held)
    if model.held.value.whole:
        words, net, otherwise = model.held, model.net, model.otherwise

        @F.arrow_udf("boolean")
        def keep(text: pa.Array) -> pa.Array:
            sums, some, _ = pooled(text, words.value)
            p = net.probability(features(sums, words.value.mean)) if net is not None else np.full(len(sums), otherwise)
            kept = pa.array(np.where(some, p, 0.0) >= threshold)
            del sums, some
            shared.release()
            return kept

        return docs.where(keep(F.col(f"`{text_col}`")))

    def keys(text: Column) -> list[Column]:
        return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]

    # Equal texts have equal probabilities, so two hashes of the text stand for the row.
    rows = shared.plain(docs, text=text_col).select(*[k.alias(f"_h{i}") for i, k in enumerate(keys(F.col("text")))], "text")
    sums = summed(rows, model, False).where(~(_probability(model)("some", "sums") >= threshold))
    gone = shared.materialize(sums.select("_h0", "_h1").distinct(), "rejected")
    own = keys(F.col(f"`{text_col}`"))
    return docs.join(gone, (own[0] == gone["_h0"]) & (own[1] == gone["_h1"]), "left_anti")
