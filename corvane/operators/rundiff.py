"""What changed between two runs of one question, for any number of pairs at once.

A pair is a row with two structs, `baseline` and `current`, of the artifact schema.
Every part of the report is an expression on that row, so a table of pairs is
compared in one pass without a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

SHIFT = 0.15


def plain_answer(text: Column) -> Column:
    """ASCII letters lower-cased, white space squeezed."""
    return F.translate(F.array_join(T.words(text), " "), string.ascii_uppercase, string.ascii_lowercase)


def answer_change(a: Column, b: Column) -> Column:
    """equivalent, contradictory, more_specific or emphasis_shift."""
    ta, tb = T.token_set(a, T.DIFF_STOP), T.token_set(b, T.DIFF_STOP)
    da, db = T.direction(ta, T.DIFF_UP, T.DIFF_DOWN), T.direction(tb, T.DIFF_UP, T.DIFF_DOWN)
    opposite = ((da == "up") & (db == "down")) | ((da == "down") & (db == "up"))
    grown = (T.overlap_share(ta, tb) >= 0.7) & (F.size(tb) > F.size(ta))
    return (
        F.when(plain_answer(a) == plain_answer(b), "equivalent").when(opposite, "contradictory")
        .when((F.size(ta) == 0) | (F.size(tb) == 0), "emphasis_shift").when(grown, "more_specific").otherwise("emphasis_shift")
    )


def _docs(run: Column) -> Column:
    return F.coalesce(run["retrieved_docs"], F.array().cast("array<struct<id:string,text:string,score:double,source:string,metadata:map<string,string>>>"))


def _last_of_each(docs: Column) -> Column:
    """Documents sorted by id, the last of each id."""
    ids = F.array_sort(F.array_distinct(F.transform(docs, lambda d: d["id"])))
    return F.transform(ids, lambda i: F.element_at(F.filter(docs, lambda d: d["id"] == i), -1))


def _without(docs: Column, others: Column) -> Column:
    ids = F.transform(others, lambda d: d["id"])
    return F.filter(docs, lambda d: ~F.array_contains(ids, d["id"]))


def common(a: Column, b: Column) -> Column:
    """(id, baseline_score, current_score, score_delta) of the documents of both runs."""
    ids = F.transform(b, lambda d: d["id"])
    shared = F.filter(a, lambda d: F.array_contains(ids, d["id"]))

    def of(d: Column) -> Column:
        other = F.element_at(F.filter(b, lambda x: x["id"] == d["id"]), 1)
        return F.struct(d["id"].alias("id"), d["score"].alias("baseline_score"), other["score"].alias("current_score"), (other["score"] - d["score"]).alias("score_delta"))

    return F.transform(shared, of)


def search_text(doc: Column) -> Column:
    """All of a document that an answer may draw on."""
    meta = F.coalesce(doc["metadata"], F.create_map().cast("map<string,string>"))
    return F.concat_ws(" ", doc["text"], doc["id"], doc["source"], F.array_join(F.map_keys(meta), " "), F.array_join(F.map_values(meta), " "))


def best_overlap(answer: Column, docs: Column) -> Column:
    """(id, overlap) of the document that shares most with the answer, the least id of equals; null without documents."""
    words = T.token_set(answer, T.DIFF_STOP)
    scored = F.transform(docs, lambda d: F.struct((-T.overlap_share(words, T.token_set(search_text(d), T.DIFF_STOP))).alias("o"), d["id"].alias("id")))
    best = F.array_min(scored)
    return F.when(F.size(docs) > 0, F.struct(best["id"].alias("id"), (-best["o"]).alias("overlap")))


def diffed(pairs: DataFrame) -> DataFrame:
    """The pairs with answer_change, added, removed and common documents, alignment, root cause, confidence and reasons."""
    one = pairs.withColumns({"_a": _last_of_each(_docs(F.col("baseline"))), "_b": _last_of_each(_docs(F.col("current")))})
    two = one.withColumns({
        "question": F.col("baseline.question"), "change_type": answer_change(F.col("baseline.answer"), F.col("current.answer")),
        "added_docs": _without(F.col("_b"), F.col("_a")), "removed_docs": _without(F.col("_a"), F.col("_b")), "common_docs": common(F.col("_a"), F.col("_b")),
        "_best_a": best_overlap(F.col("baseline.answer"), _docs(F.col("baseline"))), "_best_b": best_overlap(F.col("current.answer"), _docs(F.col("current"))),
    })
    swapped = (F.size("added_docs") > 0) | (F.size("removed_docs") > 0)
    shifted = F.exists("common_docs", lambda d: F.coalesce(F.abs(d["score_delta"]) > SHIFT, F.lit(False)))
    none = F.col("_best_a").isNull() & F.col("_best_b").isNull()
    zero = F.lit(0.0)
    three = two.withColumns({
        "answer_changed": F.col("change_type") != "equivalent", "retrieval_changed": swapped | shifted,
        "alignment": F.when(~none, F.struct(F.col("_best_a.id").alias("baseline_best_doc_id"), F.col("_best_b.id").alias("current_best_doc_id"), F.coalesce("_best_a.overlap", zero).alias("baseline_overlap"), F.coalesce("_best_b.overlap", zero).alias("current_overlap"))),
    })
    cause = (
        F.when(F.col("answer_changed") & F.col("retrieval_changed"), "retrieval_changed").when(F.col("answer_changed"), "answer_generation_changed")
        .when(F.col("retrieval_changed"), "retrieval_changed_but_answer_stable").otherwise("no_meaningful_change")
    )
    same = plain_answer(F.col("baseline.question")) == plain_answer(F.col("current.question"))
    best = F.col("alignment.current_best_doc_id")
    from_added = F.coalesce(F.array_contains(F.transform("added_docs", lambda d: d["id"]), best), F.lit(False))
    firm = from_added & (F.col("alignment.current_overlap") + 1e-9 >= F.col("alignment.baseline_overlap"))
    steady = F.col("change_type").isin("emphasis_shift", "more_specific")
    say = lambda level, reason: F.struct(F.lit(level).alias("level"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    sure = (
        F.when(~same, say("low", "the two runs don't ask the same question"))
        .when(F.col("root_cause") == "no_meaningful_change", say("high", "neither answer nor retrieval changed"))
        .when((F.col("root_cause") == "answer_generation_changed") & (F.col("change_type") == "contradictory"), say("medium", "the answer now says the opposite, from the same documents"))
        .when(F.col("root_cause") == "answer_generation_changed", say("medium", "the answer changed, the documents didn't"))
        .when((F.col("root_cause") == "retrieval_changed") & swapped & firm, say("high", F.concat(F.lit("the new document '"), best, F.lit("' fits the current answer best"))))
        .when((F.col("root_cause") == "retrieval_changed") & swapped & steady, say("medium", "documents were swapped and the emphasis shifted, without a contradiction"))
        .when((F.col("root_cause") == "retrieval_changed") & swapped, say("medium", "documents were swapped, but the evidence is mixed"))
        .when(F.col("root_cause") == "retrieval_changed", say("low", "only scores changed, no documents"))
        .when(swapped, say("medium", "documents were swapped, the answer stayed"))
        .otherwise(say("low", "the answer stayed and only scores changed"))
    )
    late = best_overlap(F.col("current.answer"), F.col("added_docs"))
    message = (
        F.when(F.col("root_cause") == "no_meaningful_change", "Nothing meaningful changed in the answer or the retrieval.")
        .when(F.col("root_cause") == "answer_generation_changed", "The same documents gave another answer: look at the generation.")
        .when(F.col("root_cause") == "retrieval_changed_but_answer_stable", "The retrieval changed, the answer didn't.")
        .when(from_added, F.concat(F.lit("The new document '"), best, F.lit("' probably brought more specific guidance into the answer.")))
        .when(F.coalesce(late["overlap"] >= 0.15, F.lit(False)), F.concat(F.lit("The new document '"), late["id"], F.lit("' probably shaped the answer, though '"), F.coalesce(best, F.lit("<none>")), F.lit("' is closest in words.")))
        .otherwise("Swapped documents probably moved the answer.")
    )
    four = three.withColumn("root_cause", cause).withColumn("_sure", sure)
    return four.withColumns({"confidence": F.col("_sure.level"), "confidence_reason": F.col("_sure.reason"), "root_cause_message": message}).drop("_a", "_b", "_best_a", "_best_b", "_sure")
