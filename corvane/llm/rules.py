"""Quality rules by distribution divergence.

A document is compared with references of its own language: the shares of seven
character classes, and the shares of the COMMON most frequent words with one share for
all other words.  The measure is the Jensen-Shannon distance (base 2, 0 to 1).  A
document is judged by its characters only from MIN_CHARS characters on, and by its words
only from MIN_WORDS words on, since short texts stray by chance.

References are a table, a row for each language, that references() sums over all
documents of a corpus: a trusted one, or, where none is given, the one that is judged.
Those of up to HELD languages are sent to every task (about 1 KB each); a larger table
is joined with the documents.

Defined results: a text that is null or has no word is rejected with null
distances; a text too short for a comparison has a null distance there and isn't
rejected by it, and neither is one of a language without references; texts of any length
are counted in full; a null language is a language of its own; each row is judged by
itself, repeated or not; ties among common words go to the lesser word; an empty table
gives an empty one; extra columns of any name are kept by passing(), left out by judged().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import shared

COMMON = 30
MIN_CHARS = 250
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.35
#: Languages whose references are sent to every task.
HELD = 10_000

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
NO_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
#: Continuation bytes of UTF-8 go to an eighth class, which is not counted.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(x) for x in ".,;:!?'\"()-"]] = 4
_CLASS[192:], _CLASS[128:192] = 6, 7


def class_counts(texts: pa.Array) -> np.ndarray:
    """(rows, 7) characters of each class."""
    data, offsets = shared.byte_view(texts)
    out = np.empty((len(texts), 7), np.int64)
    for row in range(len(texts)):
        part = data[offsets[row] : offsets[row + 1]]
        if len(part) <= shared.BLOCK_BYTES:
            out[row] = np.bincount(_CLASS[part], minlength=8)[:7]
        else:
            out[row] = sum(np.bincount(_CLASS[part[at : at + shared.BLOCK_BYTES]], minlength=8)[:7] for at in range(0, len(part), shared.BLOCK_BYTES))
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts in the same row of q."""
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (p, q))
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1))).sum(1)

    return np.sqrt(np.maximum(entropy(m) - (entropy(p) + entropy(q)) / 2, 0))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n, total, place): the most frequent words of each language over all documents."""
    words = docs.select("lang", F.explode(F.split(F.lower("text"), NO_WORD)).alias("word")).where("word <> ''")
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    ranked = counted.withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    return ranked.join(totals.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).drop("l")


def class_totals(docs: DataFrame) -> DataFrame:
    """(lang, lower, upper, ...): characters of each class over all documents of a language."""
    names = [f"c_{x}" for x in CLASSES]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = class_counts(shared.as_texts(batch.column(1)))
            langs = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = np.asarray(langs.indices)
            sums = [np.bincount(codes, counts[:, j], len(langs.dictionary)).astype(np.int64) for j in range(7)]
            yield pa.RecordBatch.from_arrays([langs.dictionary, *map(pa.array, sums)], names=["lang", *names])

    schema = "lang string, " + ", ".join(f"{x} bigint" for x in names)
    return docs.select("lang", "text").mapInArrow(shared.lean(count), schema).groupBy("lang").agg(*[F.sum(x).alias(x) for x in names])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, classes, words, total): both references of every language, summed over all documents; a table in the shared folder."""
    rows = shared.plain(docs, text=text_col, lang=lang_col).where("text IS NOT NULL")
    words = common_words(rows).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("words"), F.max("total").alias("total"))
    classes = class_totals(rows).select(F.col("lang").alias("l"), F.array(*[f"c_{x}" for x in CLASSES]).alias("classes"))
    both = classes.join(words, F.col("l").eqNullSafe(F.col("lang")), "left")
    return shared.materialize(both.select(F.col("l").alias("lang"), "classes", "words", F.coalesce("total", F.lit(0)).alias("total")), "references")


class References:
    """Both references of some languages: COMMON words and seven numbers for each, whatever the size of the corpus."""

    def __init__(self, rows: list) -> None:
        self.langs = {row["lang"]: i for i, row in enumerate(rows)}
        # The last row is that of languages without references.
        self.classes = np.array([row["classes"] for row in rows] + [[0] * 7], float)
        self.words = np.zeros((len(rows) + 1, COMMON + 1))
        found = [(i, w["word"], w["place"] - 1, w["n"]) for i, row in enumerate(rows) for w in row["words"] or ()]
        texts = pa.array([x[1] for x in found], pa.large_string())
        hashes = shared.hashed(texts, 0, len(texts))[0] if len(texts) else np.zeros(0, np.uint64)
        lang, place = (np.array([x[k] for x in found], np.int64) for k in (0, 2))
        keys = hashes + self._salt(lang)
        order = np.argsort(keys)
        self.known, self.bin = keys[order], np.append(place[order], COMMON)
        self.words[lang, place] = [x[3] for x in found]
        self.words[:-1, COMMON] = [row["total"] for row in rows] - self.words[:-1, :COMMON].sum(1)

    @staticmethod
    def _salt(lang: np.ndarray) -> np.ndarray:
        return shared.mix(lang.astype(np.uint64) + np.uint64(1))

    def judge(self, texts: pa.Array, langs: pa.Array) -> dict[str, pa.Array]:
        texts = shared.as_texts(texts)
        codes = np.array([self.langs.get(x, len(self.langs)) for x in langs.to_pylist()], np.int64)
        classes = class_counts(texts)
        words = np.zeros((len(texts), COMMON + 1), np.int64)
        low = pc.utf8_lower(texts)
        for start, end in shared.slices(low):
            hashes, first = shared.hashed(low, start, end)
            row = np.repeat(np.arange(end - start), np.diff(first))
            keys = hashes + self._salt(codes[start:end])[row]
            k = np.searchsorted(self.known, keys)
            k[k == len(self.known)] = 0
            if len(self.known):
                k = np.where(self.known[k] == keys, k, len(self.known))
            words[start:end] = np.bincount(row * (COMMON + 1) + self.bin[k], minlength=(end - start) * (COMMON + 1)).reshape(-1, COMMON + 1)
        n_chars, n_words = classes.sum(1), words.sum(1)
        by_class, by_word = distance(classes, self.classes[codes]), distance(words, self.words[codes])
        long_chars = (n_chars >= MIN_CHARS) & (n_words > 0) & (self.classes[codes].sum(1) > 0)
        long_words = (n_words >= MIN_WORDS) & (self.words[codes].sum(1) > 0)
        keep = (n_words > 0) & ~(long_chars & (by_class > MAX_CLASS_DISTANCE)) & ~(long_words & (by_word > MAX_WORD_DISTANCE))
        return {
            "n_chars": pa.array(n_chars), "n_words": pa.array(n_words),
            "class_distance": pa.array(np.round(by_class, 4), mask=~long_chars), "word_distance": pa.array(np.round(by_word, 4), mask=~long_words),
            "keep": pa.array(keep),
        }


JUDGEMENT = "n_chars bigint, n_words bigint, class_distance double, word_distance double, keep boolean"


def _with_judgement(docs: DataFrame, known: DataFrame | None, text_col: str, lang_col: str, held: int) -> DataFrame:
    """The documents with one more column, _judgement."""
    known = references(docs, text_col, lang_col) if known is None else known.select("lang", "classes", "words", "total")
    shared.small_batches(docs.sparkSession)
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    if known.count() <= held:
        sent = docs.sparkSession.sparkContext.broadcast(References(known.collect()))

        @F.arrow_udf(JUDGEMENT)
        def judge(text: pa.Array, lang: pa.Array) -> pa.Array:
            return shared.struct_of(sent.value.judge(text, lang))

        return docs.withColumn("_judgement", judge(text, lang))

    @F.arrow_udf(JUDGEMENT)
    def judge_by(text: pa.Array, lang: pa.Array, known: pa.Array) -> pa.Array:
        # The references of the batch's languages, each once.
        first = {x: row for row, x in enumerate(lang.to_pylist())}
        rows = known.take(pa.array(list(first.values()), pa.int64())).to_pylist()
        return shared.struct_of(References([x | {"lang": name} for name, x in zip(first, rows, strict=True) if x is not None]).judge(text, lang))

    table = known.select(F.col("lang").alias("_l"), F.struct("classes", "words", "total").alias("_known"))
    joined = docs.join(table, lang.eqNullSafe(table["_l"]), "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], judge_by(docs[f"`{text_col}`"], docs[f"`{lang_col}`"], F.col("_known")).alias("_judgement"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", known: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """(doc_id, lang, n_chars, n_words, class_distance, word_distance, keep) for every row; known is a table of references()."""
    rows = _with_judgement(shared.plain(docs, doc_id=id_col, lang=lang_col, text=text_col), known, "text", "lang", held)
    return rows.select("doc_id", "lang", "_judgement.*")


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", known: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """The rows that the rules keep, all columns kept."""
    rows = _with_judgement(shared.spread(docs), known, text_col, lang_col, held)
    return rows.where(rows["_judgement"]["keep"]).drop("_judgement")
