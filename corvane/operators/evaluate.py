"""Runs held against rules.

Runs are (run_ord, run_id, question, answer, retrieved_docs), rules as in schemas.RULE.
Rules take runs greedily, one each, in order: by id, else by question.  Only ids and
questions decide that, so only digests of those are gathered, 16 bytes each; the checks run on the joined rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.durable import materialize

LOW_OVERLAP = 0.10
CLAIM_OVERLAP = 0.20
CLAIM_TOKENS = 4
PREVIEW = 220
Key = str | bytes
MISSING = "<missing run artifact for rule>"


def stem(run_id: str) -> str:
    return PurePosixPath(run_id).stem


def match(rules: Iterable[tuple[int, Key, Key]], runs: Iterable[tuple[int, list[Key], Key]]) -> dict[int, int]:
    """rule number -> run number, for rules (number, id, question) and runs (number, ids, question), all made plain before."""
    by_id: dict[Key, deque[int]] = {}
    by_question: dict[Key, deque[int]] = {}
    for number, ids, question in runs:
        for one in dict.fromkeys(ids):
            by_id.setdefault(one, deque()).append(number)
        by_question.setdefault(question, deque()).append(number)
    used: set[int] = set()
    taken: dict[int, int] = {}
    nothing: deque[int] = deque()
    for number, rule_id, question in rules:
        for candidates in (by_id.get(rule_id, nothing), by_question.get(question, nothing)):
            # A run that is taken stays so: it is passed over once, however many rules ask for it.
            while candidates and candidates[0] in used:
                candidates.popleft()
            if candidates:
                used.add(candidates[0])
                taken[number] = candidates.popleft()
                break
    return taken


def matched(rules: DataFrame, runs: DataFrame) -> DataFrame:
    """(rule_ord, run_ord): which run each rule takes, in a table of its own."""
    digest = lambda x: F.unhex(F.md5(x))
    plain_rules = materialize(rules.select("rule_ord", digest(T.bare_id(F.col("id"))).alias("i"), digest(T.squeezed(F.col("question"))).alias("q")), "rules")
    file_name = F.regexp_extract("run_id", r"([^/]*)$", 1)
    own_stem = F.when(file_name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(file_name, r"\.[^.]*$", "")).otherwise(file_name)
    plain_runs = runs.select("run_ord", digest(T.bare_id(F.col("run_id"))).alias("whole"), digest(T.bare_id(own_stem)).alias("stem"), digest(T.squeezed(F.col("question"))).alias("q"))
    plain_runs = materialize(plain_runs, "runs")
    # Only runs that some rule could take are gathered: by either of their ids, or by their question.
    keys = {c: plain_rules.select(F.col(c).alias("k")).distinct() for c in ("i", "q")}
    could = [plain_runs.join(keys[k], F.col(c) == F.col("k"), "left_semi").select("run_ord") for c, k in (("whole", "i"), ("stem", "i"), ("q", "q"))]
    plain_runs = plain_runs.join(could[0].union(could[1]).union(could[2]).distinct(), "run_ord", "left_semi")

    def columns(rows: DataFrame, order: str) -> list[list]:
        found = rows.toArrow().sort_by(order)
        return [x.to_pylist() for x in found.columns]

    number, whole, own, question = columns(plain_runs.select("run_ord", "whole", "stem", "q"), "run_ord")
    pairs = match(zip(*columns(plain_rules, "rule_ord"), strict=True), zip(number, zip(whole, own, strict=True), question, strict=True))
    made = pa.table({"rule_ord": pa.array(pairs.keys(), pa.int32()), "run_ord": pa.array(pairs.values(), pa.int64())})
    return materialize(rules.sparkSession.createDataFrame(made), "pairs")


def issue(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def best_overlap(text_tokens: Column, doc_sets: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(doc_sets, lambda d: T.overlap_share(text_tokens, d))), F.lit(0.0))


def unsupported(answer: Column, doc_sets: Column) -> Column:
    """Sentences of enough words that share too little with every document."""
    judged = F.transform(T.claim_sentences(answer), lambda s: F.struct(s.alias("s"), T.token_set(s, T.EVAL_STOP).alias("t")))
    return F.transform(F.filter(judged, lambda x: (F.size(x["t"]) >= CLAIM_TOKENS) & (best_overlap(x["t"], doc_sets) < CLAIM_OVERLAP)), lambda x: x["s"])


def _issues() -> Column:
    """The issues of a row of a rule and its run, in the order of the rules."""
    answer, low = F.col("answer"), F.lower("answer")
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    quoted = lambda head, x: F.concat(F.lit(head + " '"), x, F.lit("'"))
    absent = F.transform(F.filter(texts(F.col("must_include")), lambda p: ~F.contains(low, F.lower(p))), lambda p: issue("MISSING_REQUIRED_PHRASE", quoted("the answer lacks the phrase", p)))
    banned = F.transform(F.filter(texts(F.col("must_not_include")), lambda p: F.contains(low, F.lower(p))), lambda p: issue("FORBIDDEN_PHRASE", quoted("the answer has the forbidden phrase", p)))
    length = F.char_length("answer")
    short = F.when(length < F.col("min_chars"), issue("ANSWER_TOO_SHORT", F.concat(F.lit("the answer is shorter than "), F.col("min_chars").cast("string"))))
    long = F.when(length > F.col("max_chars"), issue("ANSWER_TOO_LONG", F.concat(F.lit("the answer is longer than "), F.col("max_chars").cast("string"))))
    keys = texts(F.col("json_required_keys"))
    wanted = F.coalesce("require_json", F.lit(False)) | (F.size(keys) > 0)
    valid = F.try_parse_json(answer).isNotNull()
    bad_json = F.when(wanted & ~valid, issue("INVALID_JSON_ANSWER", F.lit("the answer is no valid JSON")))
    own_keys = F.coalesce(F.json_object_keys("answer"), F.array().cast("array<string>"))
    no_key = F.when(wanted & valid, F.transform(F.filter(keys, lambda k: ~F.array_contains(own_keys, k)), lambda k: issue("MISSING_JSON_KEY", quoted("the answer's JSON lacks the key", k))))
    grounded = F.coalesce("grounded", F.lit(False))
    no_docs = F.when(grounded & (F.col("n_docs") == 0), issue("NO_RETRIEVED_DOCS", F.lit("grounding is asked for, but there are no documents")))
    weak = F.when(grounded & (F.col("grounded_overlap") < LOW_OVERLAP), issue("LOW_GROUNDING_OVERLAP", F.concat(F.lit("the answer shares little with its documents ("), F.format_string("%.2f", F.col("grounded_overlap")), F.lit(")"))))
    claims = F.when(grounded & (F.size("unsupported_claims") > 0), issue("UNSUPPORTED_CLAIMS", F.concat(F.size("unsupported_claims").cast("string"), F.lit(" sentences have no support in the documents"))))
    none = F.array().cast("array<struct<code:string,message:string>>")
    return F.concat(absent, banned, F.array_compact(F.array(short, long, bad_json)), F.coalesce(no_key, none), F.array_compact(F.array(no_docs, weak, claims)))


def checked(joined: DataFrame) -> DataFrame:
    """Case results for rows of a rule with its run's answer and retrieved_docs."""
    sets = F.transform(F.coalesce("retrieved_docs", F.array().cast("array<struct<id:string,text:string,score:double,source:string,metadata:map<string,string>>>")), lambda d: T.token_set(d["text"], T.EVAL_STOP))
    rows = joined.withColumn("_sets", sets)
    rows = rows.withColumns({"n_docs": F.size("_sets"), "grounded_overlap": best_overlap(T.token_set(F.col("answer"), T.EVAL_STOP), F.col("_sets")), "unsupported_claims": unsupported(F.col("answer"), F.col("_sets"))})
    rows = rows.withColumn("issues", _issues())
    return rows.select("rule_ord", "id", "question", (F.size("issues") == 0).alias("pass"), T.preview(F.col("answer"), PREVIEW).alias("answer_preview"), F.col("n_docs").alias("retrieved_docs"), "grounded_overlap", "unsupported_claims", "issues")


def evaluated(rules: DataFrame, runs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A case result for every rule, those without a run included; pairs, where they are there already, as of matched()."""
    pairs = matched(rules, runs) if pairs is None else pairs
    found = runs.join(pairs, "run_ord").select("rule_ord", "answer", "retrieved_docs")
    cases = checked(rules.join(found, "rule_ord"))
    lost = rules.join(pairs.select("rule_ord"), "rule_ord", "left_anti")
    gap = F.array(issue("MISSING_RUN", F.concat(F.lit("no run answers '"), F.col("question"), F.lit("'"))))
    missing = lost.select("rule_ord", "id", "question", F.lit(False).alias("pass"), F.lit(MISSING).alias("answer_preview"), F.lit(0).alias("retrieved_docs"), F.lit(0.0).alias("grounded_overlap"), F.array().cast("array<string>").alias("unsupported_claims"), gap.alias("issues"))
    return cases.unionByName(missing)


def unmatched(rules: DataFrame, runs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(run_ord, run_id) of the runs that no rule took."""
    pairs = matched(rules, runs) if pairs is None else pairs
    return runs.select("run_ord", "run_id").join(pairs, "run_ord", "left_anti")


def totals(cases: DataFrame) -> DataFrame:
    """One row: cases, passed, failed and the pass rate."""
    row = cases.agg(F.count("*").alias("total_cases"), F.count_if("pass").alias("passed_cases"))
    return row.select("total_cases", "passed_cases", (F.col("total_cases") - F.col("passed_cases")).alias("failed_cases"), F.when(F.col("total_cases") == 0, F.lit(0.0)).otherwise(F.col("passed_cases") / F.col("total_cases")).alias("pass_rate"))


def report(rules: DataFrame, runs: DataFrame, run_input: str, rules_input: str) -> dict:
    pairs = matched(rules, runs)
    cases = materialize(evaluated(rules, runs, pairs), "cases")
    total = totals(cases).first().asDict()
    listed = [r.asDict(recursive=True) for r in cases.orderBy("rule_ord").drop("rule_ord").collect()]
    left = [r["run_id"] for r in unmatched(rules, runs, pairs).orderBy("run_ord").collect()]
    return {"run_input": run_input, "rules_input": rules_input, **total, "cases": listed, "unmatched_runs": left}


def regression(current: dict, baseline: dict) -> dict:
    sides = {"baseline": baseline, "current": current}
    out = {f"{side}_{short}": report[key] for short, key in (("pass_rate", "pass_rate"), ("failed", "failed_cases")) for side, report in sides.items()}
    return out | {f"{short}_delta": out[f"current_{short}"] - out[f"baseline_{short}"] for short in ("pass_rate", "failed")}
