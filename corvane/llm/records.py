"""Token sequences as length-delimited binary records, with an offset index.

A document becomes the ids of its tokens and an end mark, little-endian, 16 bits each
(32 for vocabularies that need them).  A record frames that sequence: its length (8
bytes), the masked CRC-32C of the length, the sequence, and its masked CRC-32C.  Each
attempt of a task writes a shard of its own, whose name the index rows of that attempt
carry, so a retried or speculative attempt never touches what another one wrote, and
what the index names is what the winning attempts wrote.  Shards that the index doesn't
name (lost attempts, an earlier run under the same path) are deleted once it is written.
The index, a Parquet table, has the shard, offset and size of every record, so that any
order of reading is a read by ranges.

Runs of white space from LONG_RUN characters on are cut out before the pattern sees
them and encoded as the pieces that it makes of them, since its look-ahead backtracks
over the whole run; the tokens are the same.

Defined results: a text that is null or empty is a record of the end mark alone; a text
of any length is one record, a single word or run of white space of any length too; each
row is a record, repeated or not; a null id stays null in the index; an empty table
gives an empty index; extra columns are left out; a record that doesn't match its
checksums can't be read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import shared

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: White space of so many characters in a row is encoded apart.
LONG_RUN = 1000
BLOCK = 256
_MASK_DELTA = 0xA282EAD8


# -- CRC-32C over many records at once


def _tables() -> np.ndarray:
    table = np.zeros((8, 256), np.uint32)
    for i in range(256):
        value = i
        for _ in range(8):
            value = (value >> 1) ^ (0x82F63B78 if value & 1 else 0)
        table[0, i] = value
    for j in range(1, 8):
        table[j] = table[0][table[j - 1] & 255] ^ (table[j - 1] >> 8)
    return table


_T = _tables()


def _advance(state: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The states after eight more bytes, given as two little-endian words."""
    x = state ^ low
    return (
        _T[7][x & 255] ^ _T[6][(x >> 8) & 255] ^ _T[5][(x >> 16) & 255] ^ _T[4][x >> 24]
        ^ _T[3][high & 255] ^ _T[2][(high >> 8) & 255] ^ _T[1][(high >> 16) & 255] ^ _T[0][high >> 24]
    )


@lru_cache(maxsize=1)
def _skip_block() -> np.ndarray:
    """(4, 256): what each byte of a state becomes after a block of zeros."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).reshape(-1).astype(np.uint32)
    zero = np.zeros_like(state)
    for _ in range(BLOCK // 8):
        state = _advance(state, zero, zero)
    return state.reshape(4, 256)


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of each range of at least four bytes: blocks first, all at once, then blocks into records."""
    n_blocks = -(-sizes // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    flat = np.zeros(int(n_blocks.sum()) * BLOCK, np.uint8)
    # Zeros in front leave a state of zero as it is, so records are aligned to the ends of their blocks.
    ends = (first + n_blocks) * BLOCK
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[at + np.repeat(ends - sizes, sizes)] = data[at + np.repeat(starts, sizes)]
    for j in range(4):
        flat[ends - sizes + j] ^= 255
    words = np.ascontiguousarray(flat.view(np.uint32).reshape(-1, BLOCK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for j in range(0, BLOCK // 4, 2):
        state = _advance(state, words[j], words[j + 1])
    skip = _skip_block()
    order = np.argsort(-n_blocks, kind="stable")
    out = np.zeros(len(sizes), np.uint32)
    deep = n_blocks[order]
    for depth in range(int(n_blocks.max(initial=0))):
        # Records of fewer blocks come later, each aligned to its own start.
        live = order[: int(np.searchsorted(-deep, -depth, side="left"))]
        s = out[live]
        out[live] = skip[0][s & 255] ^ skip[1][(s >> 8) & 255] ^ skip[2][(s >> 16) & 255] ^ skip[3][s >> 24] ^ state[first[live] + depth]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(_MASK_DELTA)


def _checksum(payload: bytes) -> int:
    if len(payload) < 4:
        state = np.uint32(0xFFFFFFFF)
        for byte in payload:
            state = _T[0][(int(state) ^ byte) & 255] ^ (state >> np.uint32(8))
        return int(masked(np.array([~state], np.uint32))[0])
    one = np.frombuffer(payload, np.uint8)
    return int(masked(crc32c(one, np.zeros(1, np.int64), np.array([len(one)])))[0])


def frame(sequences: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, sizes, checksums) of the records of some sequences, back to back."""
    sizes = np.array([len(x) for x in sequences], np.int64)
    data = np.frombuffer(b"".join(sequences), np.uint8)
    starts = np.cumsum(sizes) - sizes
    sums = np.zeros(len(sizes), np.uint32)
    long = sizes >= 4
    if long.any():
        sums[long] = masked(crc32c(data, starts[long], sizes[long]))
    for k in np.flatnonzero(~long):
        sums[k] = _checksum(sequences[k])
    lengths = sizes.astype("<u8")
    heads = np.zeros((len(sizes), 12), np.uint8)
    heads[:, :8] = lengths.view(np.uint8).reshape(-1, 8)
    if len(sizes):
        heads[:, 8:] = masked(crc32c(lengths.view(np.uint8), np.arange(len(sizes)) * 8, np.full(len(sizes), 8))).astype("<u4").view(np.uint8).reshape(-1, 4)
    tails = sums.astype("<u4").view(np.uint8).reshape(-1, 4)
    out = b"".join(y for k, x in enumerate(sequences) for y in (heads[k].tobytes(), x, tails[k].tobytes()))
    return out, np.cumsum(sizes + 16) - (sizes + 16), sizes + 16, sums


def unframe(record: bytes) -> bytes:
    """The sequence of one record; a ValueError unless both checksums hold."""
    size = int.from_bytes(record[:8], "little")
    if len(record) != size + 16:
        raise ValueError("a record's length doesn't fit its index")
    if int.from_bytes(record[8:12], "little") != _checksum(record[:8]) or int.from_bytes(record[-4:], "little") != _checksum(record[12:-4]):
        raise ValueError("a record's checksum doesn't hold")
    return record[12:-4]


# -- tokens


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SPACES = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")
_ONE_PIECE = r"(?s).+"


def tokens_of(text: str | None, path: str) -> np.ndarray:
    """The ids of a text's tokens: what the pattern's pieces give, whatever the runs of white space."""
    if not text:
        return np.zeros(0, np.uint32)
    known = encoding(path)
    if len(text) < LONG_RUN:
        return known.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for run in _SPACES.finditer(text):
        # The last character of a run goes with what follows it; at the end of the text, the run is one piece.
        stop = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(known.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        parts.append(encoding(path, _ONE_PIECE).encode_to_numpy(text[run.start() : stop], disallowed_special=()))
        at = stop
    parts.append(known.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts)


def sequence(text: str | None, path: str, end: int, kind: str) -> bytes:
    return np.append(tokens_of(text, path), np.uint32(end)).astype(kind).tobytes()


# -- shards


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark takes for it, so that shards and index lie on one file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Write shards under path, and the index under path/index; return the index.

    (shard, place, doc_id, offset, n_bytes, n_tokens, checksum), a row for each document.
    """
    kind = "<u2" if end < 1 << 16 else "<u4"
    path = qualified(docs.sparkSession, path)
    rows = shared.plain(docs, doc_id=id_col, text=text_col)
    type_of_id = rows.schema["doc_id"].dataType.simpleString()
    where, root = _place(path)
    where.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        task = TaskContext.get()
        shard = f"shard-{task.partitionId():06d}-{task.taskAttemptId():x}-{uuid.uuid4().hex[:8]}.rec"
        offset = place = 0
        out = None
        done = False
        try:
            for batch in batches:
                texts = shared.as_texts(batch.column(1))
                for start, stop in shared.slices(texts):
                    if out is None:
                        out = system.open_output_stream(f"{folder}/{shard}")
                    framed, offsets, sizes, sums = frame([sequence(x.as_py(), tokenizer, end, kind) for x in texts[start:stop]])
                    out.write(framed)
                    n = stop - start
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([shard] * n), "place": pa.array(np.arange(place, place + n)), "doc_id": batch.column(0).slice(start, n), "offset": pa.array(offsets + offset),
                        "n_bytes": pa.array(sizes), "n_tokens": pa.array((sizes - 16) // np.dtype(kind).itemsize), "checksum": pa.array(sums.astype(np.int64)),
                    })
                    offset, place = offset + len(framed), place + n
            done = True
        finally:
            if out is not None:
                out.close()
                if not done:
                    system.delete_file(f"{folder}/{shard}")

    index = rows.mapInArrow(write, f"shard string, place bigint, doc_id {type_of_id}, offset bigint, n_bytes bigint, n_tokens bigint, checksum bigint")
    index.write.mode("overwrite").parquet(f"{path}/index")
    index = docs.sparkSession.read.schema(index.schema).parquet(f"{path}/index")
    _sweep(where, root, index)
    return index


def _sweep(where: fs.FileSystem, root: str, index: DataFrame) -> None:
    """Delete the shards under root that the index doesn't name; there is about one for each task."""
    named = {r["shard"] for r in index.select("shard").distinct().toLocalIterator()}
    for info in where.get_file_info(fs.FileSelector(root)):
        if info.type == fs.FileType.File and info.base_name.lstrip(".").startswith("shard-") and info.base_name not in named:
            where.delete_file(info.path)


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None, end: int = END) -> DataFrame:
    """(shard, place, doc_id, tokens) of the records of an index, in its order; the whole index by default."""
    path = qualified(spark, path)
    index = index if index is not None else spark.read.parquet(f"{path}/index")
    rows = index.select("shard", "place", "doc_id", "offset", "n_bytes")
    kind = "<u2" if end < 1 << 16 else "<u4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        files: dict[str, pa.NativeFile] = {}
        for batch in batches:
            tokens = []
            for shard, offset, size in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if shard not in files:
                    files[shard] = system.open_input_file(f"{folder}/{shard}")
                tokens.append(np.frombuffer(unframe(files[shard].read_at(size, offset)), kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.list_(pa.int32()))], names=["shard", "place", "doc_id", "tokens"])

    return rows.mapInArrow(read, f"shard string, place bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens array<int>")
