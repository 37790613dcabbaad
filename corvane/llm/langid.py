"""Language identification by compression.

Each language has a zstandard dictionary of raw content: the lower-cased texts of
labelled documents, whole ones, taken in the order of their hash while they fit in
DICTIONARY_BYTES, from the SAMPLE documents of least hash (the bounds of the fit).  A
text is cut into segments of SEGMENT bytes, all of them are compressed with every
language's dictionary at one level, and the language of the least total wins.  Segments
keep a long text from becoming its own dictionary.  Where the second language comes
within MARGIN of the first, none is chosen.

Where documents are judged by dictionaries of their own table, there are FOLDS sets of
them: a text belongs to the fold of its hash, and is judged by the dictionaries of the
other folds, so that neither it nor a copy of it is in the dictionary that judges it.

Defined results: a text that is null or has no letter or digit gets null sizes and
"und"; ties are within the margin, so they are "und"; with one language known, or
none, that language, or "und", is the answer; each row is judged by itself, repeated
or not, and texts of any length in full; labels that are null, or not among the LANGUAGES
most frequent ones, have no dictionary; a language without a document that fits has the
first that doesn't; an empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import shared

SAMPLE = 200
DICTIONARY_BYTES = 1 << 16
LANGUAGES = 200
FOLDS = 2
SEGMENT = 4096
LEVEL = 6
#: Share of the second best size by which the best must be smaller.
MARGIN = 0.01
UNKNOWN = "und"


class Languages:
    """A compressor for each language; made anew in every worker, from the dictionaries' bytes."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL) -> None:
        self.content = dict(sorted(content.items()))
        self.level = level
        self._made: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    @property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._made is None:
            self._made = []
            for data in self.content.values():
                known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(self.level)
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._made

    def judge(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Language, size with it, and margin to the second, of each text."""
        texts = pc.utf8_lower(shared.as_texts(texts))
        data, offsets = shared.byte_view(texts)
        names = list(self.content)
        sizes = np.zeros((len(texts), max(len(names), 1)), np.int64)
        some = np.zeros(len(texts), bool)
        whole = memoryview(data)
        for row in range(len(texts)):
            start, end = int(offsets[row]), int(offsets[row + 1])
            if not shared.WORD[data[start:end]].any():
                continue
            some[row] = True
            for at in range(start, end, SEGMENT):
                part = whole[at : min(at + SEGMENT, end)]
                for k, c in enumerate(self.compressors):
                    sizes[row, k] += len(c.compress(part))
        order = np.argsort(sizes, axis=1, kind="stable")
        best = np.take_along_axis(sizes, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(sizes, order[:, 1:2], 1)[:, 0] if len(names) > 1 else best
        margin = (second - best) / np.maximum(second, 1)
        sure = some & (margin > MARGIN) if len(names) > 1 else some & bool(names)
        chosen = [names[k] if ok else UNKNOWN for k, ok in zip(order[:, 0], sure, strict=True)]
        return {"predicted": pa.array(chosen, pa.string()), "size": pa.array(best, mask=~some), "margin": pa.array(np.round(margin, 4), mask=~some)}


def fold_of(text: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), text), F.lit(folds)).cast("int")


def dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", folds: int = 1, sample: int = SAMPLE, most: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> list[dict[str, bytes]]:
    """Raw dictionary content of each language, a set for each fold, from a bounded sample of the labelled documents outside that fold.

    What is collected is at most `most` bytes a language and fold, but for a language of longer texts alone.
    """
    rows = shared.plain(docs, lang=lang_col, text=text_col).where("lang IS NOT NULL AND text IS NOT NULL")
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select(F.col("lang").alias("l"))
    rows = rows.join(F.broadcast(common), F.col("lang") == F.col("l")).drop("l")
    low = rows.select("lang", F.lower("text").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), fold_of(F.col("text"), folds).alias("own"))
    low = low.where(F.lit(folds == 1) | (F.col("fold") != F.col("own"))).select("lang", "fold", "text", (F.octet_length("text") > most).alias("long"), F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang", "fold").orderBy("long", "h", "text")
    # The rank cuts each partition of the scan first; only SAMPLE rows a language and fold are shuffled.
    first = low.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    size = F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = first.withColumn("size", size).where((F.col("size") <= most) | (F.col("place") == 1))
    found: list[dict[str, bytes]] = [{} for _ in range(folds)]
    for row in fits.orderBy("fold", "lang", "place").collect():
        held = found[row["fold"]]
        held[row["lang"]] = held.get(row["lang"], b"") + row["text"].encode() + b"\n"
    return found


def identified(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: int = LEVEL) -> DataFrame:
    """(doc_id, predicted, size, margin) for every row; dictionaries come from labelled, or, by folds, from the documents' own labels."""
    folds = FOLDS if labelled is None else 1
    known = [Languages(x, level) for x in dictionaries(docs if labelled is None else labelled, text_col, lang_col, folds)]
    held = docs.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("predicted string, size bigint, margin double")
    def judge(text: pa.Array, fold: pa.Array) -> pa.Array:
        folds = np.asarray(fold.fill_null(0))
        parts, order = [], []
        for k, languages in enumerate(held.value):
            own = np.flatnonzero(folds == k)
            order.append(own)
            parts.append(shared.struct_of(languages.judge(text.take(pa.array(own)))))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))

    rows = shared.plain(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", judge("text", fold_of(F.col("text"), folds)).alias("j")).select("doc_id", "j.*")
