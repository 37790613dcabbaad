"""The command line: python -m corvane COMMAND ...

Exit codes: 0 all well, 1 an error, 2 a limit or the self-test failed, 3 a comparison gate failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from corvane.config import Config
from corvane.operators import compare, optimize
from corvane.plans import commands as C
from corvane.plans import render as R

NAMES = {"readiness": "readiness", "simulate": "simulation", "chunks": "chunks", "coverage": "coverage", "explain": "explain", "compare-query": "compare", "compare-runs": "compare_runs", "optimize": "optimize", "fix": "fix", "answer-audit": "answer_audit", "diff": "diff", "eval": "eval", "report": "report", "self-test": "self_test"}
GATED = ("readiness", "simulate")
CHANGES = "weak-increases no-match-increases similarity-drops regressed query-count-mismatch top1-dominant-rate-increases".split()
RATE = "top1-dominant-rate-exceeds"


def session() -> SparkSession:
    return SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def integers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    for flag, kind in (("config", str), ("embedder", str), ("cache-dir", str), ("low-sim-threshold", float), ("no-match-threshold", float), ("artifacts-dir", str), ("json-out", str), ("html-out", str), ("fail-on-dominant", float), ("fail-on-weak", int), ("fail-on-no-match", int)):
        common.add_argument(f"--{flag}", type=kind)
    top = argparse.ArgumentParser(prog="corvane", description="Diagnose document retrieval.")
    subs = top.add_subparsers(dest="command", required=True, metavar="{simulate,explain,diff,save-run,eval,report,mcp-import,fix}")

    def add(name: str, *arguments, hidden: bool = False, aliases=()) -> None:
        sub = subs.add_parser(name, parents=[common], aliases=aliases, **({} if hidden else {"help": arguments[0]}))
        for flags, options in arguments[1:]:
            sub.add_argument(*flags.split(), **options)

    flag = {"action": "store_true"}
    need = {"required": True}
    json_flag = ("--json", flag)
    add("readiness", "", ("path", {}), ("--queries", {}), json_flag, hidden=True)
    add("simulate", "run queries against the documents", ("path", {}), ("--queries", need), json_flag)
    add("explain", "why documents rank for a query", ("path", {}), ("--query", need), json_flag)
    add("diff", "compare two runs", ("--baseline", need), ("--current", need), ("--format", {"choices": ("text", "json"), "default": "text"}), json_flag)
    add("save-run", "save a run", ("--out", need), ("--question", need), ("--answer", need), ("--retrieved-docs", {}), ("--model", {}), ("--top-k", {"type": int}))
    add("eval", "hold runs against rules", ("--run", need), ("--rules", need), json_flag)
    add("report", "a report to share", ("--run", need), ("--rules", {}), ("--baseline", {}), ("--format", {"choices": ("markdown", "html", "json"), "default": "markdown"}), json_flag)
    add("mcp-import", "a run from a trace", ("--in", {"dest": "input", **need}), ("--out", need), ("--question-pointer", {}), ("--answer-pointer", {}), ("--docs-pointer", {}), ("--model", {}), ("--top-k", {"type": int}))
    add("fix", "what to try first", ("path", {}), ("--queries", need), json_flag)
    add(
        "answer-audit", "", ("--data", need), ("--auto", flag), ("--period-granularity", {"choices": ("raw", "month", "week"), "default": "raw"}), ("--group-by", {"type": names, "default": []}), ("--metric", {}), ("--period-col", {}),
        ("--baseline", {}), ("--current", {}), ("--question", {}), ("--answer", need), ("--weak-contribution-threshold", {"type": float, "default": 0.1}), json_flag, hidden=True,
    )
    add("chunks", "", ("path", {}), json_flag, hidden=True)
    add("coverage", "", ("path", {}), ("--queries", {}), json_flag, hidden=True)
    add("compare-query", "", ("path", {}), ("--query", need), json_flag, hidden=True)
    add("optimize", "", ("path", {}), ("--queries", need), ("--chunk-sizes", {"type": integers, "default": list(optimize.SIZES)}), ("--chunk-overlaps", {"type": integers, "default": list(optimize.OVERLAPS)}), ("--top-n", {"type": int, "default": 5}), ("--write-config", {}), json_flag, hidden=True)
    add(
        "compare-runs", "", ("before", {}), ("after", {}), ("--format", {"choices": ("summary", "table"), "default": "summary"}), 
        *[(f"--fail-if-{x}", flag) for x in CHANGES], (f"--fail-if-{RATE}", {"type": float}), json_flag, hidden=True, aliases=("compare", "compare-sim"),
    )
    add("self-test", "", ("--docs", {"default": "examples/docs"}), ("--queries", {"default": "examples/queries_structured.txt"}), json_flag, hidden=True)
    add("import-pages", "", ("urls", {}), ("out", {}), ("--timeout", {"type": float, "default": 20}), hidden=True)
    add("audit", "", ("path", {}), ("--queries", need), ("--out", {"default": "artifacts"}), hidden=True)
    return top


def emit(args: argparse.Namespace, command: str, payload: dict, text: str, page: str | None = None, markdown: str | None = None) -> None:
    """Write what was asked for, then print JSON or text."""
    shown = json.dumps(payload, indent=2, ensure_ascii=False)

    def write(place: Path, content: str) -> None:
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(content, encoding="utf-8")

    folder = Path(args.artifacts_dir) if args.artifacts_dir else None
    if args.json_out:
        write(Path(args.json_out), shown)
    elif folder:
        write(folder / f"{NAMES[command]}.json", shown)
    if page is not None and args.html_out:
        write(Path(args.html_out), page)
    elif page is not None and folder:
        write(folder / f"{NAMES[command]}.html", page)
    if markdown is not None and folder:
        write(folder / f"{NAMES[command]}.md", markdown)
    print(shown if getattr(args, "json", False) else text)


def _check(args: argparse.Namespace, config: Config, report: dict) -> None:
    if "sim_summary" in report:
        message = C.gates(config, report["sim_summary"], report.get("dominant_rate"), args.fail_on_dominant, args.fail_on_weak, args.fail_on_no_match)
        if message:
            raise C.GateFailure(message, 2)


def run(args: argparse.Namespace, spark_of=session) -> None:
    command = {"compare": "compare-runs", "compare-sim": "compare-runs"}.get(args.command, args.command)
    limits = (args.fail_on_dominant, args.fail_on_weak, args.fail_on_no_match)
    if any(x is not None for x in limits):
        if command not in GATED:
            raise ValueError(f"--fail-on limits apply to readiness and simulate, not to {command}")
        if command == "readiness" and not args.queries:
            raise ValueError("--fail-on limits need --queries")
        if args.fail_on_dominant is not None and not 0 <= args.fail_on_dominant <= 1:
            raise ValueError("--fail-on-dominant must be from 0 to 1")
    config = Config.load(args.config).overridden(args.embedder, args.cache_dir, args.low_sim_threshold, args.no_match_threshold)
    if command == "save-run":
        C.save_run(args.out, args.question, args.answer, args.retrieved_docs, args.model, args.top_k)
        print(f"Saved the run {args.out}")
        return
    if command == "mcp-import":
        C.import_trace(args.input, args.out, question=args.question_pointer, answer=args.answer_pointer, docs=args.docs_pointer, model=args.model, top_k=args.top_k)
        print(f"Saved the run {args.out}")
        return
    spark = spark_of()
    if command in ("readiness", "simulate"):
        report = (C.readiness if command == "readiness" else C.simulate)(spark, args.path, args.queries, config)
        emit(args, command, report, R.corpus_report(report))
        _check(args, config, report)
    elif command == "chunks":
        report = C.chunk_report(spark, args.path, config)
        emit(args, command, report, R.corpus_report(report))
    elif command == "coverage":
        report = C.coverage_report(spark, args.path, args.queries, config)
        emit(args, command, report, R.corpus_report(report))
    elif command in ("explain", "compare-query"):
        report = C.explain(spark, args.path, args.query, config, None if command == "explain" else 5, command)
        emit(args, command, report, R.explanation(report), R.explanation_html(report))
    elif command == "optimize":
        report = C.optimize_report(spark, args.path, args.queries, args.chunk_sizes, args.chunk_overlaps, args.top_n, config)
        if args.write_config and report["best"]:
            place = Path(args.write_config)
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text("".join(f"{k} = {report['best'][k]}\n" for k in ("chunk_size", "chunk_overlap")), encoding="utf-8")
        emit(args, command, report, R.optimization(report))
    elif command == "fix":
        report = C.fix_report(spark, args.path, args.queries, config)
        emit(args, command, report, R.advice(report))
    elif command == "self-test":
        report = C.self_test(spark, args.docs, args.queries, config)
        emit(args, command, report, R.self_test(report))
        if not report["ok"]:
            raise C.GateFailure("Fail: the self-test failed", 2)
    elif command == "answer-audit":
        report, notes = C.answer_audit(spark, args.data, args.answer, auto=args.auto, granularity=args.period_granularity, group_by=args.group_by, metric=args.metric, period_col=args.period_col, baseline=args.baseline, current=args.current, question=args.question, weak_threshold=args.weak_contribution_threshold)
        emit(args, command, report | ({"notes": notes} if notes else {}), R.audit(report, notes))
    elif command == "diff":
        report = C.diff(spark, args.baseline, args.current)
        args.json = args.json or args.format == "json"
        emit(args, command, report, R.diff(report))
    elif command == "eval":
        report = C.evaluate_runs(spark, args.run, args.rules)
        emit(args, command, report, R.evaluation(report))
    elif command == "report":
        payload = C.report(spark, args.run, args.rules, args.baseline)
        args.json = args.json or args.format == "json"
        if args.format == "html":
            page = R.report_html(payload)
            emit(args, command, payload, page, page=page)
        else:
            text = R.markdown(payload)
            emit(args, command, payload, text, markdown=text if args.format == "markdown" else None)
    elif command == "compare-runs":
        report = C.compare_reports(spark, args.before, args.after)
        message = compare.gate_failure(report, args.fail_if_weak_increases, args.fail_if_no_match_increases, args.fail_if_similarity_drops, args.fail_if_regressed, args.fail_if_query_count_mismatch, args.fail_if_top1_dominant_rate_exceeds, args.fail_if_top1_dominant_rate_increases)
        emit(args, command, report, R.comparison(report, args.format == "table"))
        if message:
            raise C.GateFailure(message, 3)
    elif command == "import-pages":
        print(f"{C.import_pages(spark, args.urls, args.out, args.timeout)} pages saved in {args.out}")
    elif command == "audit":
        args.artifacts_dir = args.out
        for name, report in (("readiness", C.readiness(spark, args.path, args.queries, config)), ("simulate", C.simulate(spark, args.path, args.queries, config))):
            emit(args, name, report, R.corpus_report(report))


def main(argv: list[str] | None = None, spark_of=session) -> int:
    args = parser().parse_args(argv)
    try:
        run(args, spark_of)
    except C.GateFailure as failure:
        print(failure, file=sys.stderr)
        return failure.code
    except (ValueError, RuntimeError, OSError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0
