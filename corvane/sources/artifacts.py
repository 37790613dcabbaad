"""Run artifacts, rules and reports as JSON and YAML."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.schemas import ARTIFACT, RULE
from corvane.sources.documents import SourceError, load_yaml, read_text


def problem(run: dict) -> str | None:
    """What is wrong with an artifact, if anything is."""
    for key in ("question", "answer"):
        if not isinstance(run.get(key), str):
            return f"'{key}' must be a text"
        if not run[key].strip():
            return f"'{key}' must not be empty"
    docs = run.get("retrieved_docs", [])
    if not isinstance(docs, list):
        return "'retrieved_docs' must be a list"
    seen = set()
    for doc in docs:
        if not isinstance(doc, dict) or not isinstance(doc.get("id"), str) or not isinstance(doc.get("text"), str):
            return "each retrieved document must have the texts 'id' and 'text'"
        if not doc["id"].strip():
            return "a retrieved document has an empty 'id'"
        if doc["id"] in seen:
            return f"the document id '{doc['id']}' is repeated"
        seen.add(doc["id"])
    return None


def complete(run: dict) -> dict:
    """An artifact with every field, defaults filled in."""
    docs = [{"id": d["id"], "text": d["text"], "score": d.get("score"), "source": d.get("source"), "metadata": d.get("metadata")} for d in run.get("retrieved_docs", [])]
    return {"question": run["question"], "answer": run["answer"], "retrieved_docs": docs, "claims": run.get("claims", []), "metrics": run.get("metrics"), "context": run.get("context")}


def load_artifact(path: str) -> dict:
    """One artifact, validated."""
    try:
        run = json.loads(read_text(path))
    except (OSError, ValueError) as error:
        raise SourceError(f"can't read the run {path}: {error}") from error
    wrong = problem(run) if isinstance(run, dict) else "it must be an object"
    if wrong:
        raise SourceError(f"invalid run {path}: {wrong}")
    return complete(run)


def row_of(run: dict) -> dict:
    """An artifact as a row: scores as doubles, metadata values that aren't text as nulls."""
    docs = [d | {"score": None if d["score"] is None else float(d["score"]), "metadata": None if d["metadata"] is None else {k: v if isinstance(v, str) else None for k, v in d["metadata"].items()}} for d in run["retrieved_docs"]]
    claims = [{"text": c["text"], "supported": c.get("supported"), "evidence_doc_ids": c.get("evidence_doc_ids", [])} for c in run["claims"]]
    metrics = run["metrics"] and {"total_delta": run["metrics"].get("total_delta")}
    context = run["context"] and {"model": run["context"].get("model"), "top_k": run["context"].get("top_k")}
    return run | {"retrieved_docs": docs, "claims": claims, "metrics": metrics, "context": context}


def artifact_table(spark: SparkSession, runs: list[dict]) -> DataFrame:
    return spark.createDataFrame([row_of(r) for r in runs], ARTIFACT)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_ord, run_id, question, answer, retrieved_docs) of a file, or of all JSON files under a folder.

    In a folder, files that aren't JSON, and objects with neither question nor answer,
    are passed over; a broken run counts only if there is no sound one.
    """
    place = Path(path)
    if place.is_file():
        run = load_artifact_loosely(place)
        return artifact_table(spark, [run]).select(F.lit(0).cast("bigint").alias("run_ord"), F.lit(place.stem).alias("run_id"), "question", "answer", "retrieved_docs")
    if not place.is_dir():
        raise SourceError(f"{path} is neither a file nor a folder")
    root = place.resolve().as_uri()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.where(F.lower("path").endswith(".json")).select("path", F.try_parse_json(F.decode("content", "UTF-8")).alias("v"), F.decode("content", "UTF-8").alias("raw"))
    prefix = len(root.rstrip("/")) - len("file://") + 1
    bare = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    prefix = len(str(place.resolve()).rstrip("/")) + 1
    rows = found.where("v IS NOT NULL").select(F.substring(bare, F.lit(prefix + 1), F.length(bare)).alias("run_id"), F.json_object_keys("raw").alias("keys"), F.from_json("raw", ARTIFACT).alias("run"))
    alike = rows.where(F.array_contains("keys", "question") | F.array_contains("keys", "answer"))
    filled = lambda c: F.coalesce(T.trimmed(F.col(c)) != "", F.lit(False))
    whole = F.coalesce(F.forall("run.retrieved_docs", lambda d: d["id"].isNotNull() & d["text"].isNotNull()), F.lit(True))
    sound = alike.withColumn("sound", filled("run.question") & filled("run.answer") & whole)
    counts = sound.agg(F.count_if("sound").alias("n"), F.min(F.when(~F.col("sound"), F.col("run_id"))).alias("bad")).first()
    if not counts["n"]:
        raise SourceError(f"the run {counts['bad']} needs a question, an answer and sound documents" if counts["bad"] else f"no run is under {path}")
    # The order of paths is the order of runs; only ids are ordered in one place.
    from corvane.sources.documents import in_order

    return in_order(sound.where("sound"), "run_id").select(F.col("doc_ord").alias("run_ord"), "run_id", "run.question", "run.answer", "run.retrieved_docs")


def load_artifact_loosely(path: Path) -> dict:
    """One artifact whose document ids may repeat."""
    try:
        run = json.loads(read_text(str(path)))
    except (OSError, ValueError) as error:
        raise SourceError(f"can't read the run {path}: {error}") from error
    wrong = problem(run) if isinstance(run, dict) else "it must be an object"
    if wrong and "repeated" not in wrong and "empty 'id'" not in wrong:
        raise SourceError(f"invalid run {path}: {wrong}")
    return complete(run)


def load_docs(path: str) -> list[dict]:
    """Retrieved documents: a list, or an object that has them."""
    found = json.loads(read_text(path))
    docs = found if isinstance(found, list) else found.get("retrieved_docs") if isinstance(found, dict) else None
    if not isinstance(docs, list):
        raise SourceError(f"{path} must be a list of documents, or have a list 'retrieved_docs'")
    return docs


def load_rules(path: str) -> list[dict]:
    """Rules: a list, or an object with a list `cases`; at least one."""
    try:
        found = load_yaml(read_text(path))
    except (OSError, yaml.YAMLError) as error:
        raise SourceError(f"can't read the rules {path}: {error}") from error
    cases = found.get("cases") if isinstance(found, dict) else found
    if not isinstance(cases, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("question"), str) for c in cases):
        raise SourceError(f"the rules {path} must be a list of cases with the texts id and question")
    if not cases:
        raise SourceError(f"the rules {path} have no case")
    return cases


def rule_table(spark: SparkSession, cases: list[dict]) -> DataFrame:
    rows = []
    for i, case in enumerate(cases):
        e = case.get("expected") or {}
        rows.append((i, case["id"], case["question"], bool(e.get("grounded", False)), e.get("must_include", []), e.get("must_not_include", []), e.get("min_chars"), e.get("max_chars"), bool(e.get("require_json", False)), e.get("json_required_keys", [])))
    return spark.createDataFrame(rows, RULE)


def load_report(path: str) -> dict:
    try:
        found = json.loads(read_text(path))
    except (OSError, ValueError) as error:
        raise SourceError(f"can't read the report {path}: {error}") from error
    if not isinstance(found, dict):
        raise SourceError(f"{path} is no report")
    return found
