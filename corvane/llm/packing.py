"""Best-fit packing planned on a histogram of lengths.

Documents are cut into pieces of at most CAPACITY tokens (runs of visible
characters).  Best-fit decreasing then runs over counts of equal lengths, not over
documents: bins in the same state are one group, and a step places as many pieces
as a group takes.  The plan has a row for each step, so its size depends on the
capacity and not on the corpus.  Pieces take their slots by a join on their rank
within their length.

Ranks run over hash buckets: a piece's rank is the number of pieces of its length in
earlier buckets plus its place in its own, so no length, however common, is sorted
in one task.

Defined results: texts that are null or have no token take no slot; repeated rows
are packed once each; null ids are packed as null.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import shared

CAPACITY = 2048
BUCKETS = 256


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first bin, offset, pieces a bin): best-fit decreasing over counts.

    The piece of rank r goes to bin first_bin + (r - first) // a_bin, at offset + (r - first) % a_bin * length.
    """
    free: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    steps = []
    bins = 0

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(free, room)
                groups[room] = []
            groups[room].append((start, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError("a length must be from 1 to the capacity")
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                room = free[at]
                start, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], free[at]
            else:
                room, start, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            a_bin = room // length
            full = min(n, left // a_bin)
            rest = min(left - full * a_bin, a_bin - 1) if full < n else 0
            steps.append((length, rank, rank + full * a_bin + rest, start, capacity - room, a_bin))
            put(room - a_bin * length, start, full)
            if rest:
                put(room - rest * length, start + full, 1)
            put(room, start + full + bool(rest), n - full - bool(rest))
            rank += full * a_bin + rest
            left -= full * a_bin + rest
    return steps


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length) of every document's pieces."""
    rows = shared.plain(docs, doc_id=id_col, text=text_col).select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / capacity).cast("int")
    cut = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length, bin_id, position): the slot of every piece; position counts the tokens before it in its bin."""
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = shared.materialize(pieces(docs, id_col, text_col, capacity).select("*", bucket), "pieces")
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = shared.materialize(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    names = ("s_length", "first", "after", "bin0", "offset", "a_bin")
    steps = plan(histogram, capacity)
    columns = [pa.array([s[j] for s in steps], pa.int64()) for j in range(6)]
    slots = spark.createDataFrame(pa.Table.from_arrays(columns, names=list(names)))
    of_length = Window.partitionBy("length").orderBy("bucket")
    before = counts.select("length", "bucket", (F.sum("n").over(of_length) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("place", place).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    # The plan's size follows the capacity alone, so it goes to every task.
    taken = ranked.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    step = F.col("rank") - F.col("first")
    return taken.select(
        "doc_id", "piece", "length",
        (F.col("bin0") + F.floor(step / F.col("a_bin"))).alias("bin_id"),
        (F.col("offset") + step % F.col("a_bin") * F.col("length")).cast("int").alias("position"),
    )
