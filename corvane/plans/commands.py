"""The analyses as a user asks for them: each reads its sources, runs its plan and gives a report as a dictionary."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import __version__
from corvane.config import Config
from corvane.functions import chunking, embed
from corvane.functions import text as T
from corvane.functions.durable import materialize
from corvane.operators import audit, compare, diagnose, evaluate, fix, optimize, retrieve, rundiff
from corvane.sources import artifacts, documents, facts, queries, traces


class GateFailure(Exception):
    """A limit that was set for continuous integration is exceeded; code is the process's exit code."""

    def __init__(self, message: str, code: int) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Corpus:
    """Documents and numbered chunks, both written to the shared folder."""

    documents: DataFrame
    chunks: DataFrame


@dataclass
class Simulation:
    queries: DataFrame
    ranked: DataFrame


def meta(command: str) -> dict:
    return {"schema_version": "1", "tool_version": __version__, "command": command}


def prepare(spark: SparkSession, root: str, config: Config) -> Corpus:
    docs = materialize(documents.read_documents(spark, root).withColumn("text", T.normalized(F.col("text"))), "documents")
    chunks = chunking.numbered(chunking.chunks(docs, config.chunk_size, config.chunk_overlap))
    return Corpus(docs, materialize(chunks, "numbered"))


def with_vectors(rows: DataFrame, config: Config, text_col: str, cache: bool) -> DataFrame:
    """rows with remote vectors where those are configured; the deterministic ones are made while scoring."""
    if config.embedder.provider == "null":
        return rows
    named = rows if text_col == "text" else rows.withColumnRenamed(text_col, "text")
    out = embed.embedded(named, embed.embedder_of(config), config.embedder.tag, f"{config.cache_dir}/embeddings" if cache else None)
    return out if text_col == "text" else out.withColumnRenamed("text", text_col)


def simulate_on(corpus: Corpus, query_rows: DataFrame, config: Config) -> Simulation:
    chunks = with_vectors(corpus.chunks, config, "text", True)
    asked = with_vectors(query_rows, config, "query", False)
    found = retrieve.ranked(chunks, asked, config.top_k)
    named = corpus.chunks.select("doc_ord", "pos", "chunk_id")
    return Simulation(query_rows, materialize(named.join(found, ["doc_ord", "pos"]), "ranked"))


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def finding_rows(df: DataFrame) -> list[dict]:
    return [r | {"data": json.loads(r["data"])} for r in rows_of(df)]


def frequencies(ranked: DataFrame, k: int) -> list[dict]:
    rows = diagnose.topk_frequency(ranked, k) if k > 1 else diagnose.top1_frequency(ranked)
    return [{"doc_id": r["doc_id"], "count": r["count"]} for r in rows.orderBy("first").collect()]


def summary_of(sim: Simulation, config: Config) -> dict:
    row = diagnose.sim_summary(sim.ranked, sim.queries, config).first().asDict()
    return row | {"top1_freq": frequencies(sim.ranked, 1), "top3_freq": frequencies(sim.ranked, 3)}


def results_of(sim: Simulation) -> list[dict]:
    item = F.struct("rank", "chunk_id", "score")
    lists = sim.ranked.groupBy("query_ord").agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    rows = sim.queries.select("query_id", "query", "query_ord").join(lists, "query_ord", "left").orderBy("query_ord").collect()
    return [{"query_id": r["query_id"], "query_text": r["query"], "ranked": [{"chunk_id": x["chunk_id"], "score": x["score"], "rank": x["rank"]} for x in r["ranked"] or []]} for r in rows]


def gates(config: Config, summary: dict, rate: float | None, dominant: float | None, weak: int | None, no_match: int | None) -> str | None:
    """What the first exceeded limit says: weak queries, then queries without a match, then dominance."""
    if weak is not None and summary["low_similarity_queries"] > weak:
        return f"Fail: {summary['low_similarity_queries']} weak queries, more than {weak} (below {config.low_sim_threshold:.2f})"
    if no_match is not None and summary["no_match_queries"] > no_match:
        return f"Fail: {summary['no_match_queries']} queries without a match, more than {no_match} (below {config.no_match_threshold:.2f})"
    if dominant is not None and rate is not None and rate > dominant:
        return f"Fail: one document is on top of {rate:.2f} of the queries, more than {dominant:.2f}"
    return None


def counts_of(corpus: Corpus) -> dict:
    return {"documents": corpus.documents.count(), "chunks": corpus.chunks.count()}


def readiness(spark: SparkSession, root: str, query_file: str | None, config: Config) -> dict:
    corpus = prepare(spark, root, config)
    parts = [diagnose.metadata_findings(corpus.documents, config), diagnose.chunk_findings(corpus.chunks, config)]
    report = {"meta": meta("readiness"), **counts_of(corpus), "retrievals": [], "chunk_stats": diagnose.chunk_stats(corpus.chunks, corpus.documents, config).first().asDict(), "config": config.snapshot()}
    if query_file:
        sim = simulate_on(corpus, queries.read_queries(spark, query_file), config)
        parts += [diagnose.retrieval_findings(sim.ranked, sim.queries, config), diagnose.cause_findings(sim.ranked, sim.queries, corpus.chunks, corpus.documents, config)]
        report |= {"sim_summary": summary_of(sim, config), "coverage": diagnose.coverage(sim.ranked, sim.queries, config).first().asDict(), "dominant_rate": diagnose.max_dominant_rate(sim.ranked, sim.queries).first()["rate"]}
    report["findings"] = [f for part in parts for f in finding_rows(part)]
    return report


def simulate(spark: SparkSession, root: str, query_file: str | None, config: Config) -> dict:
    corpus = prepare(spark, root, config)
    asked = queries.read_queries(spark, query_file) if query_file else queries.synthetic_queries(corpus.documents)
    sim = simulate_on(corpus, asked, config)
    outcomes = rows_of(diagnose.expectation_outcomes(sim.ranked, sim.queries, config).orderBy("query_ord"))
    findings = finding_rows(diagnose.retrieval_findings(sim.ranked, sim.queries, config)) + finding_rows(diagnose.cause_findings(sim.ranked, sim.queries, corpus.chunks, corpus.documents, config))
    keep = ("query_id", "best_rank", "top_docs", "status", "top_doc_ranks", "expected_ranks")
    report = {
        "meta": meta("simulate"), **counts_of(corpus), "passes": sum(o["status"] == "PASS" for o in outcomes), "fails": sum(o["status"] == "FAIL" for o in outcomes), "findings": findings, "retrievals": results_of(sim),
        "expectations": [{k: o[k] for k in keep} | {"expected": o["expect_docs"]} for o in outcomes], "sim_summary": summary_of(sim, config), "config": config.snapshot(), "dominant_rate": diagnose.max_dominant_rate(sim.ranked, sim.queries).first()["rate"],
    }
    return report


def chunk_report(spark: SparkSession, root: str, config: Config) -> dict:
    corpus = prepare(spark, root, config)
    report = {"meta": meta("chunks"), **counts_of(corpus), "findings": finding_rows(diagnose.chunk_findings(corpus.chunks, config)), "chunk_stats": diagnose.chunk_stats(corpus.chunks, corpus.documents, config).first().asDict(), "config": config.snapshot()}
    return report


def coverage_report(spark: SparkSession, root: str, query_file: str | None, config: Config) -> dict:
    """Coverage of queries where there are some, else the topics of the corpus."""
    corpus = prepare(spark, root, config)
    report = {"meta": meta("coverage"), **counts_of(corpus), "config": config.snapshot()}
    if query_file:
        sim = simulate_on(corpus, queries.read_queries(spark, query_file), config)
        report |= {"findings": finding_rows(diagnose.retrieval_findings(sim.ranked, sim.queries, config)), "coverage": diagnose.coverage(sim.ranked, sim.queries, config).first().asDict()}
    else:
        report["findings"] = finding_rows(diagnose.topic_findings(corpus.chunks))
    return report


def explain(spark: SparkSession, root: str, query: str, config: Config, most: int | None = None, command: str = "explain") -> dict:
    corpus = prepare(spark, root, config)
    one = spark.createDataFrame([("query", query, [], 0)], "query_id string, query string, expect_docs array<string>, query_ord bigint")
    sim = simulate_on(corpus, one, config)
    parts = ("similarity", "keyword_overlap", "keyword_overlap_norm", "keyword_boost", "phrase_match", "phrase_boost", "token_count", "metadata_boost", "length_penalty")
    rows = sim.ranked.orderBy("rank").collect()[:most]
    hits = [{"rank": r["rank"], "chunk_id": r["chunk_id"], "doc_id": r["doc_id"], "score": r["score"], "explanation": {"chunk_id": r["chunk_id"], **{p: r[p] for p in parts}, "total_score": r["score"]}} for r in rows]
    return {"meta": meta(command), "query": query, "ranked": hits}


def optimize_report(spark: SparkSession, root: str, query_file: str, sizes, overlaps, top_n: int, config: Config) -> dict:
    if top_n <= 0:
        raise ValueError("top_n must be above 0")
    docs = materialize(documents.read_documents(spark, root).withColumn("text", T.normalized(F.col("text"))), "documents")
    _, skipped = optimize.grid_of(sizes, overlaps)
    asked = with_vectors(queries.read_queries(spark, query_file), config, "query", False)
    found = optimize.candidates(docs, asked, config, sizes, overlaps, lambda chunks: with_vectors(chunks, config, "text", True))
    rows = rows_of(found.orderBy("place").drop("place"))
    return {"meta": meta("optimize"), "queries_file": query_file, "considered": len(rows), "skipped": skipped, "top_n": top_n, "candidates": rows, "best": rows[0] if rows else None}


def fix_report(spark: SparkSession, root: str, query_file: str, config: Config) -> dict:
    corpus = prepare(spark, root, config)
    sim = simulate_on(corpus, queries.read_queries(spark, query_file), config)
    summary = summary_of(sim, config)
    stats = diagnose.chunk_stats(corpus.chunks, corpus.documents, config).first().asDict()
    failures = diagnose.expectation_outcomes(sim.ranked, sim.queries, config).where("status = 'FAIL'").count()
    top = compare.dominant(diagnose.top1_frequency(sim.ranked), max(summary["queries"], 1)).first()
    dominant = (top["doc_id"], top["rate"]) if top["doc_id"] is not None else None
    report = fix.advice(config, stats, summary, failures, dominant)
    return {
        "meta": meta("fix"), **report, "rerun": f"corvane simulate {root} --queries {query_file}", "avg_top1_similarity": summary["avg_top1_similarity"], "low_similarity_queries": summary["low_similarity_queries"],
        "no_match_queries": summary["no_match_queries"], "expectation_failures": failures, "dominant_doc": dominant[0] if dominant else None, "dominant_rate": dominant[1] if dominant else 0.0,
    }


def self_test(spark: SparkSession, root: str, query_file: str, config: Config) -> dict:
    corpus = prepare(spark, root, config)
    sim = simulate_on(corpus, queries.read_queries(spark, query_file), config)
    number = counts_of(corpus) | {"queries": sim.queries.count()}
    failed = diagnose.expectation_outcomes(sim.ranked, sim.queries, config).where("status = 'FAIL'").count()
    checks = [{"name": name, "pass": number[key] > 0, "detail": f"{key}={number[key]}"} for name, key in (("documents_loaded", "documents"), ("chunks_produced", "chunks"), ("queries_loaded", "queries"))]
    checks.append({"name": "expectations", "pass": failed == 0, "detail": f"failed_expectations={failed}"})
    return {"meta": meta("self-test"), "ok": all(c["pass"] for c in checks), **number, "checks": checks}


def answer_audit(spark: SparkSession, data: str, answer: str, **settings) -> tuple[dict, list[str]]:
    rows = facts.read_facts(spark, data)
    request, notes = audit.resolve(rows, answer, **settings)
    return {"meta": meta("answer-audit"), **audit.audited(rows, request)}, notes


def diff(spark: SparkSession, baseline: str, current: str) -> dict:
    runs = [artifacts.load_artifact(p) for p in (baseline, current)]
    table = artifacts.artifact_table(spark, runs).coalesce(1)
    both = [table.limit(1).select(F.struct("*").alias("baseline")), artifacts.artifact_table(spark, runs[1:]).select(F.struct("*").alias("current"))]
    r = rundiff.diffed(both[0].crossJoin(both[1])).first().asDict(recursive=True)
    return {
        "question": r["question"], "answer_diff": {"changed": r["answer_changed"], "change_type": r["change_type"], "baseline_answer": runs[0]["answer"], "current_answer": runs[1]["answer"]},
        "retrieval_diff": {"added_docs": r["added_docs"], "removed_docs": r["removed_docs"], "common_docs": r["common_docs"], "changed": r["retrieval_changed"]},
        "alignment": r["alignment"], "root_cause": r["root_cause"], "root_cause_message": r["root_cause_message"], "confidence": r["confidence"], "confidence_reason": r["confidence_reason"],
    }


def _write_run(run: dict, out: str) -> dict:
    wrong = artifacts.problem(run)
    if wrong:
        raise documents.SourceError(f"invalid run: {wrong}")
    made = artifacts.complete(run)
    place = Path(out)
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(json.dumps(made, indent=2, ensure_ascii=False), encoding="utf-8")
    return made


def save_run(out: str, question: str, answer: str, docs_file: str | None = None, model: str | None = None, top_k: int | None = None) -> dict:
    context = {"model": model, "top_k": top_k} if model is not None or top_k is not None else None
    return _write_run({"question": question, "answer": answer, "retrieved_docs": artifacts.load_docs(docs_file) if docs_file else [], "context": context}, out)


def import_trace(source: str, out: str, **pointers) -> dict:
    try:
        root = json.loads(documents.read_text(source))
    except (OSError, ValueError) as error:
        raise documents.SourceError(f"can't read the trace {source}: {error}") from error
    return _write_run(traces.import_trace(root, **pointers), out)


def evaluate_runs(spark: SparkSession, run: str, rules: str) -> dict:
    return evaluate.report(artifacts.rule_table(spark, artifacts.load_rules(rules)), artifacts.read_runs(spark, run), run, rules)


def report(spark: SparkSession, run: str, rules: str | None, baseline: str | None) -> dict:
    if rules:
        found = evaluate_runs(spark, run, rules)
    else:
        found = artifacts.load_report(run)
        if not {"total_cases", "pass_rate", "cases"} <= found.keys():
            raise documents.SourceError(f"{run} is no evaluation; give --rules to evaluate runs")
    before = artifacts.load_report(baseline) if baseline else None
    return {"eval": found} | ({"regression": evaluate.regression(found, before)} if before else {})


def compare_reports(spark: SparkSession, before: str, after: str) -> dict:
    return compare.compared(spark, artifacts.load_report(before), artifacts.load_report(after))


def import_pages(spark: SparkSession, url_file: str, out: str, timeout: float = 20, fetch=None) -> int:
    """Save the pages of a list of URLs as text documents, each written by its task; returns how many were kept."""
    urls = documents.url_list(documents.read_text(url_file))
    rows = documents.page_documents(documents.fetch_pages(spark, urls, timeout, fetch))
    Path(out).mkdir(parents=True, exist_ok=True)
    folder = str(Path(out).resolve())

    def write(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (Path(folder) / name).write_text(text, encoding="utf-8")
            yield batch.select(["name"])

    return rows.mapInArrow(write, "name string").count()
