"""Two simulations, before and after: frequencies side by side, a verdict, and gates for continuous integration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, NO_MATCH = 0.35, 0.25
EPS = 1e-6


def real(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def merged_top1(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, before, after, delta): a full outer join of (doc_id, count), missing counts as 0."""
    a, b = before.select("doc_id", F.col("count").alias("before")), after.select("doc_id", F.col("count").alias("after"))
    both = a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("delta", F.col("after") - F.col("before"))


def dominant(counts: DataFrame, queries: int | Column) -> DataFrame:
    """One row (doc_id, rate): the most frequent document, the least id of equals, and its share of the queries."""
    number = queries if isinstance(queries, Column) else F.lit(queries)
    row = counts.agg(F.min_by("doc_id", F.struct(-F.col("count"), F.col("doc_id"))).alias("doc_id"), F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    return row.select(F.when(number > 0, F.col("doc_id")).alias("doc_id"), F.when(number > 0, real(real(F.col("most")) / real(number))).otherwise(real(0.0)).alias("rate"))


def verdict(rows: DataFrame) -> DataFrame:
    """Adds improved_metrics, regressed_metrics and verdict to rows with *_before and *_after of the four signals."""
    signals = (("avg_top1_similarity", EPS, 1), ("weak_matches", 0, -1), ("no_matches", 0, -1), ("top1_dominant_rate", EPS, -1))

    def better(name: str, eps: float, sign: int, way: int) -> Column:
        before, after = F.col(f"{name}_before"), F.col(f"{name}_after")
        high, low = (after, before) if sign * way > 0 else (before, after)
        return F.when(high > (real(low + real(eps)) if eps else low), F.lit(name))

    listed = lambda way: F.array_compact(F.array(*[better(*s, way) for s in signals]))
    found = rows.withColumns({"improved_metrics": listed(1), "regressed_metrics": listed(-1)})
    gain = F.size("improved_metrics") - F.size("regressed_metrics")
    return found.withColumn("verdict", F.when(gain > 0, "IMPROVED").when(gain < 0, "REGRESSED").otherwise("NEUTRAL"))


def summary_of(report: dict) -> dict:
    """Queries, average, weak and unmatched counts and top-1 frequencies of a report, recomputed where it has no summary."""
    given = report.get("sim_summary")
    if given:
        return {"queries": given["queries"], "avg": given["avg_top1_similarity"], "weak": given["low_similarity_queries"], "none": given["no_match_queries"], "top1": [(d["doc_id"], d["count"]) for d in given.get("top1_freq", [])]}
    config = report.get("config") or {}
    low, none = np.float32(config.get("low_sim_threshold", LOW)), np.float32(config.get("no_match_threshold", NO_MATCH))
    results = report.get("retrievals") or []
    tops = [r["ranked"][0] if r["ranked"] else None for r in results]
    scores = [np.float32(t["score"]) if t else np.float32(0) for t in tops]
    counts: dict[str, int] = {}
    for t in tops:
        if t:
            doc = t["chunk_id"].split("#")[0]
            counts[doc] = counts.get(doc, 0) + 1
    total = np.float32(0)
    for s in scores:
        total = np.float32(total + s)
    return {"queries": len(results), "avg": float(np.float32(total / np.float32(len(results)))) if results else 0.0, "weak": sum(bool(s < low) for s in scores), "none": sum(bool(s < none) for s in scores), "top1": sorted(counts.items())}


def compared(spark, before: dict, after: dict) -> dict:
    """The comparison of two simulation reports."""
    a, b = summary_of(before), summary_of(after)
    schema = "doc_id string, count bigint"
    left, right = (spark.createDataFrame(x["top1"], schema) for x in (a, b))
    da, db = dominant(left, a["queries"]).first(), dominant(right, b["queries"]).first()
    columns = {}
    for side, s, d in (("before", a, da), ("after", b, db)):
        columns |= {f"avg_top1_similarity_{side}": real(float(s["avg"])), f"weak_matches_{side}": F.lit(s["weak"]), f"no_matches_{side}": F.lit(s["none"]), f"top1_dominant_rate_{side}": real(float(d["rate"]))}
    row = verdict(spark.range(1).select(*[v.alias(k) for k, v in columns.items()])).first()
    docs = merged_top1(left, right).orderBy(F.desc("after"), "doc_id").collect()
    return {
        "queries_before": a["queries"], "queries_after": b["queries"], "query_count_mismatch": a["queries"] != b["queries"],
        "avg_top1_similarity_before": a["avg"], "avg_top1_similarity_after": b["avg"], "weak_before": a["weak"], "weak_after": b["weak"], "no_match_before": a["none"], "no_match_after": b["none"],
        "top1_dominant_doc_before": da["doc_id"], "top1_dominant_rate_before": da["rate"], "top1_dominant_doc_after": db["doc_id"], "top1_dominant_rate_after": db["rate"],
        "top1_docs": [r.asDict() for r in docs], "verdict": row["verdict"], "improved_metrics": row["improved_metrics"], "regressed_metrics": row["regressed_metrics"],
    }


def gate_failure(diff: dict, weak: bool = False, no_match: bool = False, similarity: bool = False, regressed: bool = False, mismatch: bool = False, rate_above: float | None = None, rate_increases: bool = False) -> str | None:
    """What the first gate that fails says; gates are tried in a fixed order."""
    if rate_above is not None and not 0 <= rate_above <= 1:
        raise ValueError("the dominant rate threshold must be from 0 to 1")
    rate_a, rate_b = diff["top1_dominant_rate_before"], diff["top1_dominant_rate_after"]
    if weak and diff["weak_after"] > diff["weak_before"]:
        return f"Fail: weak matches rose from {diff['weak_before']} to {diff['weak_after']}"
    if no_match and diff["no_match_after"] > diff["no_match_before"]:
        return f"Fail: queries without a match rose from {diff['no_match_before']} to {diff['no_match_after']}"
    if similarity and np.float32(diff["avg_top1_similarity_after"]) + np.finfo(np.float32).eps < np.float32(diff["avg_top1_similarity_before"]):
        return f"Fail: average similarity fell from {diff['avg_top1_similarity_before']:.3f} to {diff['avg_top1_similarity_after']:.3f}"
    if regressed and diff["verdict"] == "REGRESSED":
        return "Fail: the verdict is REGRESSED"
    if mismatch and diff["query_count_mismatch"]:
        return f"Fail: {diff['queries_before']} queries before, {diff['queries_after']} after"
    if rate_above is not None and rate_b > rate_above:
        return f"Fail: {diff['top1_dominant_doc_after'] or '<unknown>'} tops {rate_b:.3f} of the queries, above {rate_above:.3f}"
    if rate_increases and rate_b > rate_a:
        return f"Fail: the dominant rate rose from {rate_a:.3f} ({diff['top1_dominant_doc_before'] or '<none>'}) to {rate_b:.3f} ({diff['top1_dominant_doc_after'] or '<none>'})"
    return None
