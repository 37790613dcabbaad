"""Reports as text, Markdown and HTML."""

from __future__ import annotations

import html

TITLES = {"readiness": "Readiness", "simulate": "Simulation", "chunks": "Chunks", "coverage": "Coverage"}


def head(title: str) -> list[str]:
    return [title, "=" * len(title), ""]


def findings(rows: list[dict]) -> list[str]:
    if not rows:
        return ["No findings."]
    return ["Findings:", *[f"[{r['severity'].upper()}] {r['code']}: {r['message']}" for r in rows]]


def settings(config: dict) -> str:
    return f"chunk size {config['chunk_size']}, overlap {config['chunk_overlap']} | top {config['top_k']} | low {config['low_sim_threshold']:.2f}, no match {config['no_match_threshold']:.2f} | {config['embedder']}"


def sizes(stats: dict) -> str:
    return f"Words per chunk: {stats['avg_tokens']:.1f} on average, {stats['min_tokens']} to {stats['max_tokens']}, median {stats['p50_tokens']}, 95th percentile {stats['p95_tokens']}"


def corpus_report(report: dict) -> str:
    """Readiness, simulation, chunks or coverage."""
    out = head(TITLES[report["meta"]["command"]]) + [f"{report['documents']} documents, {report['chunks']} chunks", settings(report["config"])]
    if "chunk_stats" in report:
        stats = report["chunk_stats"]
        out += [sizes(stats), f"{stats['large_chunks']} large, {stats['small_chunks']} small, {stats['duplicate_chunks']} repeated"]
    if "passes" in report:
        out.append(f"Expectations: {report['passes']} met, {report['fails']} missed")
        out += [f"  {e['query_id']:<16} {e['status']:<5} rank {e['best_rank'] or '-'}  expected {', '.join(e['expected'])}  top {', '.join(e['top_docs'])}" for e in report["expectations"]]
    summary = report.get("sim_summary")
    if summary:
        out.append(f"{summary['queries']} queries, average best score {summary['avg_top1_similarity']:.3f}")
        for name, key in (("weak", "low_similarity_query_ids"), ("without a match", "no_match_query_ids")):
            if summary[key]:
                out.append(f"  {name}: {', '.join(summary[key][:3])}" + (", ..." if len(summary[key]) > 3 else ""))
    if report.get("coverage"):
        c = report["coverage"]
        out.append(f"Coverage of {c['queries']} queries: {c['good']} good, {c['weak']} weak, {c['none']} none")
    return "\n".join([*out, "", *findings(report["findings"])])


def explanation(report: dict) -> str:
    out = head("Explanation" if report["meta"]["command"] == "explain" else "Comparison") + [f"Query: {report['query']}", ""]
    for hit in report["ranked"]:
        e = hit["explanation"]
        out.append(f"{hit['rank']}. {hit['chunk_id']} ({hit['doc_id']}) {hit['score']:.4f}")
        out.append(f"   cosine {e['similarity']:.4f}, words +{e['keyword_boost']:.4f} ({e['keyword_overlap']} in common), phrase +{e['phrase_boost']:.2f}, length -{e['length_penalty']:.4f} ({e['token_count']} words)")
    return "\n".join(out)


def page(title: str, body: str) -> str:
    return (
        f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title>'
        "<style>body{font:15px/1.5 sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em}</style>"
        f"</head><body><h1>{html.escape(title)}</h1>{body}</body></html>\n"
    )


def explanation_html(report: dict) -> str:
    columns = ("similarity", "keyword_overlap", "keyword_boost", "phrase_match", "phrase_boost", "length_penalty", "token_count")
    cell = lambda x: f"<td>{html.escape(f'{x:.4f}' if isinstance(x, float) else str(x), quote=True)}</td>"
    rows = "".join("<tr>" + "".join(map(cell, (h["rank"], h["chunk_id"], h["doc_id"], h["score"], *[h["explanation"][c] for c in columns]))) + "</tr>" for h in report["ranked"])
    names = "".join(f"<th>{c}</th>" for c in ("rank", "chunk", "document", "score", *columns))
    return page("Explanation", f"<p>Query: <b>{html.escape(report['query'], quote=True)}</b></p><table><tr>{names}</tr>{rows}</table>")


def optimization(report: dict) -> str:
    out = head("Search over chunk sizes") + [f"{report['considered']} settings tried, {report['skipped']} left out", ""]
    for c in report["candidates"][: report["top_n"]]:
        out.append(f"size {c['chunk_size']:>5}, overlap {c['chunk_overlap']:>4}: {c['score']:.2f} (average {c['avg_top1_similarity']:.3f}, weak {c['low_similarity_queries']}, none {c['no_match_queries']}, missed {c['expectation_failures']}, dominance {c['dominant_rate']:.2f}, chunks {c['chunks']})")
    return "\n".join(out)


def advice(report: dict) -> str:
    return "\n".join([*head("First fix"), f"Issue: {report['issue']}", "Likely causes:", *[f"- {c}" for c in report["likely_causes"]], f"Try first: {report['first_fix']}", f"Then: {report['rerun']}"])


def self_test(report: dict) -> str:
    return "\n".join([*head("Self-test"), f"{report['documents']} documents, {report['chunks']} chunks, {report['queries']} queries", *[f"- {'PASS' if c['pass'] else 'FAIL'}: {c['name']} ({c['detail']})" for c in report["checks"]]])


def audit(report: dict, notes: list[str]) -> str:
    out = head("Answer audit") + [f"Verdict: {report['verdict']} (confidence {report['confidence']}, alignment {report['alignment_score']:.2f}, coverage {report['coverage_pct']:.0f}%)"]
    out += [f"Note: {n}" for n in notes] + [f"{report['baseline_period']} -> {report['current_period']}: {report['total_delta']:+.2f}", "", "Main drivers:"]
    out += [f"- {d['label']}: {d['baseline']:.2f} -> {d['current']:.2f} ({d['delta']:+.2f}, {d['contribution_pct']:+.1f}%)" for d in report["top_drivers"]]
    out += ["", "Named segments:", *([f"- {m['segment']}: claimed {m['claimed_direction']}, in fact {m['actual_direction']} ({m['delta']:+.2f})" for m in report["mentions"]] or ["- none"])]
    return "\n".join([*out, "", "Issues:", *([f"- {i['code']}: {i['message']}" for i in report["issues"]] or ["- none"])])


CHANGES = {"equivalent": "equivalent", "emphasis_shift": "emphasis shift, no contradiction", "more_specific": "more specific, no contradiction", "contradictory": "contradictory"}


def score_of(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.3f}"


def doc_line(doc: dict) -> str:
    words = " ".join(doc["text"].split())
    words = words if len(words) <= 120 else words[:117] + "..."
    return doc["id"] + ("" if doc["score"] is None else f" (score {doc['score']:.2f})") + (f' "{words}"' if words else "")


def diff(report: dict) -> str:
    a, r = report["answer_diff"], report["retrieval_diff"]
    out = head("Diff") + [f"Question: {report['question']}", "", f"Answer: {CHANGES[a['change_type']]}"]
    if a["changed"]:
        out += [f"- before: {a['baseline_answer']}", f"- now:    {a['current_answer']}"]
    out += ["", "Retrieval: " + ("changed" if r["changed"] else "no meaningful change")]
    out += [f"  + {doc_line(d)}" for d in r["added_docs"]] + [f"  - {doc_line(d)}" for d in r["removed_docs"]]
    if r["changed"] and not r["added_docs"] and not r["removed_docs"]:
        moved = sorted((d for d in r["common_docs"] if d["score_delta"] is not None and abs(d["score_delta"]) > 0.15), key=lambda d: (-abs(d["score_delta"]), d["id"]))
        out += [f"  * {d['id']}: {score_of(d['baseline_score'])} -> {score_of(d['current_score'])} ({d['score_delta']:+.3f})" for d in moved[:3]]
    if report["alignment"]:
        m = report["alignment"]
        out += ["", "Evidence:", f"- before: {m['baseline_best_doc_id'] or '<none>'} ({m['baseline_overlap']:.2f})", f"- now:    {m['current_best_doc_id'] or '<none>'} ({m['current_overlap']:.2f})"]
    return "\n".join([*out, "", f"Likely cause: {report['root_cause_message']}", f"Confidence: {report['confidence'].upper()}: {report['confidence_reason']}"])


def evaluation(report: dict) -> str:
    rate = report["pass_rate"]
    out = head("Evaluation") + [f"PASS: {rate * 100:.0f}% ({report['passed_cases']}/{report['total_cases']})", f"FAIL: {(1 - rate) * 100:.0f}% ({report['failed_cases']}/{report['total_cases']})", ""]
    failed = [c for c in report["cases"] if not c["pass"]]
    out += ["No case failed."] if not failed else ["Failures:", *[line for c in failed[:10] for line in (f"- {c['id']}:", *[f"  - {i['code']} {i['message']}" for i in c["issues"]])]]
    if report["unmatched_runs"]:
        out += ["", "Runs without a rule:", *[f"- {r}" for r in report["unmatched_runs"][:10]]]
    return "\n".join(out)


def markdown(payload: dict) -> str:
    report = payload["eval"]
    out = ["## Summary", f"- Pass rate: {report['pass_rate'] * 100:.0f}% ({report['passed_cases']}/{report['total_cases']})", f"- Failed cases: {report['failed_cases']}"]
    if "regression" in payload:
        g = payload["regression"]
        out.append(f"- Against the baseline: {g['pass_rate_delta'] * 100:+.1f} points, {g['failed_delta']:+d} failed cases")
    failed = [c for c in report["cases"] if not c["pass"]]
    first = lambda c: f"{c['issues'][0]['code']} {c['issues'][0]['message']}" if c["issues"] else "no reason given"
    out += ["", "## Top failures", *([f"- {c['id']} -> {first(c)}" for c in failed[:10]] or ["- none"])]
    left = len(report.get("unmatched_runs", []))
    return "\n".join([*out, "", "## Notes", f"- {left} runs have no rule" if left else "- every run has a rule", ""])


def report_html(payload: dict) -> str:
    return page("Evaluation report", "<div>" + html.escape(markdown(payload), quote=True).replace("\n", "<br>") + "</div>")


def comparison(d: dict, table: bool) -> str:
    out = head("Comparison of runs")
    rows = (
        ("queries", d["queries_before"], d["queries_after"]), ("average best score", f"{d['avg_top1_similarity_before']:.3f}", f"{d['avg_top1_similarity_after']:.3f}"),
        ("weak", d["weak_before"], d["weak_after"]), ("without a match", d["no_match_before"], d["no_match_after"]),
        ("dominant document", d["top1_dominant_doc_before"] or "-", d["top1_dominant_doc_after"] or "-"), ("dominant rate", f"{d['top1_dominant_rate_before']:.3f}", f"{d['top1_dominant_rate_after']:.3f}"),
    )
    out += [f"{name:<20} {before!s:>16} -> {after!s:<16}" for name, before, after in rows]
    if table:
        out += ["", *[f"{x['doc_id']:<40} {x['before']:>6} -> {x['after']:<6} ({x['delta']:+d})" for x in d["top1_docs"]]]
    out += ["", f"Verdict: {d['verdict']}", f"Better: {', '.join(d['improved_metrics']) or '-'}", f"Worse: {', '.join(d['regressed_metrics']) or '-'}"]
    if d["query_count_mismatch"]:
        out.append("The runs have different numbers of queries.")
    return "\n".join(out)
