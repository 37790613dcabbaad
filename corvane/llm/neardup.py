"""MinHash near-duplicate groups by a multi-index Hamming join.

A document's signature is HASHES minima over its word shingles, each cut to 16
bits; the distance of two signatures is the number of places at which they
differ.  Signatures are split into CHUNKS chunks.  By the pigeonhole principle,
two signatures at a distance of at most CHUNKS * (ERRORS + 1) - 1 agree, in some
chunk, everywhere but for at most ERRORS places.  So each signature is listed
under every chunk with every choice of ERRORS places struck out, and pairs that
share such a key are compared in full: every pair within the distance is found.

Equal signatures are folded together before the join, so exact copies cost one
row however many there are.  Within a key, groups are found by a search that
compares each member with those not yet reached, so a key with thousands of near
copies doesn't take all its pairs.

A key of more than HOT signatures is never gathered in one task.  Its members are first
compared with its least one, each by itself; the links so far are drawn together, and
a key whose members are all in one group by then is done, which is so for copies
however many.  What is left, keys that unlike texts share, is compared in blocks: each
two blocks of a key meet in one task.

Defined results: a null or wordless text has no signature and is in no group; a
text of fewer words than a shingle is one shingle; texts of any length count in full;
near_duplicates() leaves null ids out and takes a repeated id for one document (a row of
each text), deduplicate() goes by row; of equals the least id stays; an empty table gives
an empty one; extra columns of any name are kept by deduplicate() and left out otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import shared

SHINGLE = 3
HASHES = 32
CHUNKS = 8
ERRORS = 1
#: The largest distance that the chunks and errors guarantee; a Jaccard similarity of about 0.53.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: The most signatures of a key that one task compares.
HOT = 4096
#: The most removed rows whose list deduplicate() sends to every task (100 bytes each); a longer list is joined by a shuffle.
SENT_ROWS = 1_000_000

_WIDTH = HASHES // CHUNKS
_STRUCK = list(combinations(range(_WIDTH), ERRORS))
_KEEP = [[i for i in range(_WIDTH) if i not in struck] for struck in _STRUCK]
_SEEDS = shared.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def minhashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of HASHES 16-bit minima for each text, and which texts have a word."""
    texts = pc.utf8_lower(shared.as_texts(texts))
    out = np.zeros((len(texts), HASHES), np.uint16)
    some = np.zeros(len(texts), bool)
    for start, end in shared.slices(texts):
        hashes, first = shared.hashed(texts, start, end)
        h, begin = shared.grams(hashes, first, SHINGLE)
        full = np.flatnonzero(np.diff(begin) > 0)
        if not len(full):
            continue
        some[start + full] = True
        for j in range(HASHES):
            low = np.minimum.reduceat(h * _SEEDS[j], begin[full])
            out[start + full, j] = (shared.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out, some


def _signed(rows: DataFrame) -> DataFrame:
    """The rows that have a word, with their signature in place of their text, the last column."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, some = minhashes(batch.column("text"))
            keep = pa.array(some)
            raw = pa.array([x.tobytes() for x in sig[some]], pa.binary())
            yield pa.RecordBatch.from_arrays([*[x.filter(keep) for x in batch.columns[:-1]], raw], names=[*batch.schema.names[:-1], "sig"])

    kinds = [f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]]
    return rows.mapInArrow(shared.lean(make), ", ".join([*kinds, "sig binary"]))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig): the signature of each document that has a word."""
    return _signed(shared.plain(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL"))


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary())
    at = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint16, len(column) * HASHES, at).reshape(-1, HASHES)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * choices) keys: chunk, choice of struck places, and the values left."""
    out = np.empty((len(sig), CHUNKS * len(_KEEP)), np.uint64)
    wide = sig.astype(np.uint64)
    for c in range(CHUNKS):
        for m, keep in enumerate(_KEEP):
            key = np.full(len(sig), c * len(_KEEP) + m, np.uint64)
            for i in keep:
                key = (key << np.uint64(16)) | wide[:, c * _WIDTH + i]
            if len(keep) > 3:
                key = shared.mix(key)
            out[:, c * len(_KEEP) + m] = key
    return out


def _listed(rows: DataFrame) -> DataFrame:
    """(key, node): a row for each signature under each of its keys, for rows of (node, sig)."""
    kind = rows.schema["node"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(_matrix(part.column("sig")))
                again = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.reshape(-1).view(np.int64)), "node": part.column("node").take(again)})

    return rows.select("node", "sig").mapInArrow(shared.lean(make), f"key bigint, node {kind}")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, n, lead, node, sig): the signatures under the keys that several of them have; n of them, of which lead is the least.

    Most documents of a corpus share no key, so keys are first counted and joined without
    signatures; those of the candidates alone travel afterwards, under their shared keys.
    """
    listed = _listed(rows)
    several = listed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    return listed.join(several, "key").join(rows.select("node", "sig"), "node").select("key", "n", "lead", "node", "sig")


def _by_key(rows: DataFrame, handle, schema: str) -> DataFrame:
    """Apply handle(sorted group rows) to whole keys: one shuffle, then a stream over sorted rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            table = pa.Table.from_batches([batch])
            cut = int(np.searchsorted(key, key[-1]))
            if held and cut == 0 and key[0] == at:
                held.append(table)
                continue
            if held or cut:
                yield from handle(pa.concat_tables([*held, table.slice(0, cut)]))
            held, at = [table.slice(cut)], key[-1]
        if held:
            yield from handle(pa.concat_tables(held))

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared.lean(make), schema)


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray] | None:
    """Of the keys with two members or more: starts, lengths, signatures, nodes and keys."""
    key = np.asarray(table.column("key"))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts = np.diff(np.append(starts, len(key)))
    many = counts > 1
    if not many.any():
        return None
    rows = pa.array(np.flatnonzero(np.repeat(many, counts)))
    counts = counts[many]
    starts = np.append(0, np.cumsum(counts)[:-1])
    return starts, counts, _matrix(_flat(table.column("sig").take(rows))), _flat(table.column("node").take(rows)), key[np.asarray(rows)]


def forest(sig: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges that connect exactly what the pairs within the distance connect, each to the first of its group."""
    left = np.arange(len(sig))
    edges = []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            near = (sig[left] != sig[front.pop()]).sum(1) <= distance
            front += left[near].tolist()
            edges += [(root, int(x)) for x in left[near]]
            left = left[~near]
    return edges


def _searched(keyed: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect what the pairs within the distance connect, in each key by itself, for rows of (key, node, sig)."""
    kind = keyed.schema["node"].dataType.simpleString()

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _groups(table)
        if found is None:
            return
        starts, counts, sig, nodes, _ = found
        lead = np.repeat(starts, counts)
        near = np.empty(len(sig), bool)
        for at in range(0, len(sig), 1 << 16):
            near[at : at + (1 << 16)] = (sig[at : at + (1 << 16)] != sig[lead[at : at + (1 << 16)]]).sum(1) <= distance
        a = [lead[near]]
        b = [np.flatnonzero(near)]
        for g in np.flatnonzero(np.add.reduceat((~near).astype(np.int64), starts)):
            # Somebody is too far from the first member: search this key in full.
            s = starts[g]
            made = np.array(forest(sig[s : s + counts[g]], distance), np.int64).reshape(-1, 2) + s
            a.append(made[:, 0])
            b.append(made[:, 1])
        low, high = np.concatenate(a), np.concatenate(b)
        real = low != high
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(high[real])), nodes.take(pa.array(low[real]))], names=["a", "b"])

    return _by_key(keyed.select("key", "node", "sig"), handle, f"a {kind}, b {kind}").where("a <> b")


def _to_lead(hot: DataFrame, distance: int) -> DataFrame:
    """(a, b): each member of a key that is near its least one, linked to that."""
    kind = hot.schema["node"].dataType.simpleString()
    leads = shared.materialize(hot.where("node = lead").select(F.col("key").alias("k"), F.col("sig").alias("lead_sig")).distinct(), "leads")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = pa.array((_matrix(batch.column("sig")) != _matrix(batch.column("lead_sig"))).sum(1) <= distance)
                yield pa.RecordBatch.from_arrays([batch.column("node").filter(close), batch.column("lead").filter(close)], names=["a", "b"])

    rows = hot.where("node <> lead").join(leads, F.col("key") == F.col("k")).select("node", "lead", "sig", "lead_sig")
    return rows.mapInArrow(shared.lean(near), f"a {kind}, b {kind}")


def _in_blocks(hot: DataFrame, most: int) -> DataFrame:
    """(key, node, sig): the members of each key in blocks of half of `most`, under a new key for every two of them."""
    number = F.ceil(F.col("n") * 2 / most)
    own = F.pmod(F.xxhash64("node"), number)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1))
    two = hot.withColumn("own", own).withColumn("other", other)
    return two.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "sig")


def _roots(rows: DataFrame, distance: int, most: int = HOT) -> DataFrame:
    """(node, root): the components of the pairs of (node, sig) within the distance, for nodes in pairs."""
    shared_keys = shared.materialize(_shared(rows), "keys")
    edges = _searched(shared_keys.where(F.col("n") <= most), distance)
    hot = shared_keys.where(F.col("n") > most)
    if hot.isEmpty():
        return components(edges)
    edges = shared.materialize(edges.unionByName(_to_lead(hot, distance)), "links")
    first = components(edges)
    labelled = hot.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    rest = shared.materialize(hot.join(mixed, "key").select("key", "n", "node", "sig"), "mixed")
    if rest.isEmpty():
        return first
    return components(edges.unionByName(_searched(_in_blocks(rest, most), distance)))


def near_pairs(sigs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id") -> DataFrame:
    """(a, b, distance), a < b: every pair of rows of (doc_id, sig) within the distance, each once."""
    if distance > DISTANCE:
        raise ValueError(f"the chunks guarantee distances up to {DISTANCE}")
    rows = sigs.select(F.col(id_col).alias("node"), "sig")
    kind = rows.schema["node"].dataType.simpleString()

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _groups(table)
        if found is None:
            return
        starts, counts, sig, nodes, key = found
        for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
            own = chunk_keys(sig[s : s + n])
            here = int(np.flatnonzero(own[0].view(np.int64) == key[s])[0])
            for i in range(n - 1):
                apart = (sig[s + i + 1 : s + n] != sig[s + i]).sum(1)
                # A pair counts under the first key that it has in common, and under no other.
                take = np.flatnonzero((apart <= distance) & ((own[i + 1 :] == own[i]).argmax(1) == here))
                if len(take):
                    left, right = nodes.take(pa.array(np.full(len(take), s + i))), nodes.take(pa.array(take + s + i + 1))
                    yield pa.RecordBatch.from_arrays([pc.min_element_wise(left, right), pc.max_element_wise(left, right), pa.array(apart[take].astype(np.int32))], names=["a", "b", "distance"])

    return _by_key(_shared(rows).select("key", "node", "sig"), handle, f"a {kind}, b {kind}, distance int").where("a < b")


def _contract(edges: DataFrame) -> DataFrame:
    """Within each partition, the same connections by fewer edges, each to the least of its part."""
    schema = edges.schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [x for x in batches if x.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks])
        codes = both.combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(codes.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        at = rank[np.asarray(codes.indices)]
        parent = least(at[: table.num_rows], at[table.num_rows :], len(order))
        child = np.flatnonzero(parent != np.arange(len(parent)))
        values = codes.dictionary.take(order)
        yield pa.RecordBatch.from_arrays([values.take(pa.array(child)), values.take(pa.array(parent[child]))], schema=pa.schema([("a", values.type), ("b", values.type)]))

    return edges.mapInArrow(shared.lean(make), schema)


def least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, by hooking and pointer jumping."""
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        if (parent == before).all():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge (a, b) with the least node of its component, itself included.

    Alternates the large-star and small-star steps until nothing changes; every
    round is written to the shared folder, so lineage stays short and a lost
    executor costs a task, not the rounds before it.  The first step contracts
    each partition by itself, which removes the repeated edges of different keys.
    """
    now = shared.materialize(_contract(edges), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        # Large star: each node's greater neighbours go to its least neighbour (or itself).
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, go to its least neighbour.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        base = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(base, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(base.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = shared.materialize(small, "edges")
        # Done when the graph is a set of stars: no node is both a leaf and a root, and each leaf has one root.
        check = new.groupBy("a").agg(F.count("*").alias("n"))
        loose = check.where("n > 1").limit(1).count() or new.join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        shared.discard(now)
        now = new
        if not loose:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, most: int = HOT) -> DataFrame:
    """(doc_id, duplicate_of): every document but the first of its group, with that first (the least id).

    Groups are the connected components of the pairs within the distance.
    """
    if distance > DISTANCE:
        raise ValueError(f"the chunks guarantee distances up to {DISTANCE}")
    kept = shared.materialize(signatures(docs, id_col, text_col), "signatures")
    distinct = shared.materialize(kept.groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "distinct")
    roots = _roots(distinct.select("node", "sig"), distance, most).where("node <> root")
    exact = kept.join(distinct.where("n > 1").select("sig", "node"), "sig").where("doc_id <> node").select("doc_id", "node")
    nodes = exact.unionByName(roots.select(F.col("node").alias("doc_id"), "node"))
    found = nodes.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("duplicate_of"))
    return found.groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of")).where("doc_id <> duplicate_of")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_rows: int = SENT_ROWS) -> DataFrame:
    """One row of each group of near duplicates, and all rows without a signature; all columns kept.

    Groups are those of near_duplicates(), but of rows: repeated rows are copies of each
    other, rows with a null id take part, and rows of one id with several texts are judged
    each by its own.  The row of least id stays, null last, then the one of least text hash.
    """
    rows = shared.plain(docs, doc_id=id_col, text=text_col)
    kept = shared.materialize(_signed(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")), "signatures")
    # Signatures get numbers, which hold once they are written.
    counted = kept.groupBy("sig").agg(F.count("*").alias("n"))
    distinct = shared.materialize(counted.select(F.monotonically_increasing_id().alias("node"), "sig", "n"), "distinct")
    linked = _roots(distinct.select("node", "sig"), DISTANCE)
    several = distinct.join(linked, "node", "left").where("n > 1 OR root IS NOT NULL").select("sig", F.coalesce("root", "node").alias("root"))
    members = kept.join(several, "sig").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = members.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    found = members.join(first, "root").withColumn("_again", is_first).where("n > 1 OR NOT _again")
    gone = shared.materialize(found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text"), "_again"), "copies")

    send = F.broadcast if gone.count() <= sent_rows else lambda x: x

    def among(those: DataFrame, how: str) -> DataFrame:
        return docs.join(send(those), docs[f"`{id_col}`"].eqNullSafe(those["_gone"]) & (F.xxhash64(docs[f"`{text_col}`"]) == those["_gone_text"]), how)

    left = among(gone, "left_anti")
    again = gone.where(gone["_again"])
    if again.isEmpty():
        return left
    # Rows with the same id and text as the one that stays: one of them, by their other columns.
    place, order = "_corvane_place", [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    of_row = Window.partitionBy(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).orderBy(*order)
    return left.unionByName(among(again, "left_semi").withColumn(place, F.row_number().over(of_row)).where(F.col(place) == 1).drop(place))
