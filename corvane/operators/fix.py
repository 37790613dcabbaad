"""The first thing to try when retrieval is poor: a cascade of rules on figures that are there already."""

from __future__ import annotations

import math

from corvane.config import Config


def smaller_size(config: Config, ratio: float) -> int:
    """A smaller chunk size, above the overlap; the present one where there is no room."""
    least = config.chunk_overlap + 1
    if config.chunk_size <= least:
        return config.chunk_size
    return min(max(math.floor(config.chunk_size * ratio + 0.5), least), config.chunk_size - 1)


def _shrink(config: Config, ratio: float, words: str) -> str:
    size = smaller_size(config, ratio)
    if size < config.chunk_size:
        return words.format(old=config.chunk_size, new=size)
    return f"chunks can't shrink below an overlap of {config.chunk_overlap}: reduce chunk_overlap first"


def advice(config: Config, stats: dict, summary: dict, expectation_failures: int, dominant: tuple[str, float] | None) -> dict:
    """Issue, likely causes and first fix; the first rule that applies decides."""
    chunks, rate = stats["chunks"], dominant[1] if dominant else 0.0
    tiny = stats["small_chunks"] / chunks if chunks else 0.0
    if dominant and rate >= config.dominant_threshold:
        causes = []
        if stats["p95_tokens"] > int(config.chunk_size * 1.4):
            causes.append("chunks are too large for documents of several topics")
        if stats["duplicate_chunks"] > 0:
            causes.append("repeated chunks favour one document")
        causes = causes or ["one broad document fits many queries better than specific ones do"]
        return {"issue": f"{dominant[0]} is the first hit of {rate * 100:.0f}% of queries", "likely_causes": causes, "first_fix": _shrink(config, 0.5, "reduce chunk_size from {old} to {new}")}
    if stats["large_chunks"] > 0:
        return {"issue": f"{stats['large_chunks']} chunks are too large (95th percentile {stats['p95_tokens']} tokens)", "likely_causes": ["chunk boundaries are too coarse for the documents"], "first_fix": _shrink(config, 0.7, "reduce chunk_size from {old} to {new}")}
    if tiny >= 0.35:
        return {"issue": f"{tiny * 100:.0f}% of chunks are too small", "likely_causes": ["documents are cut too finely"], "first_fix": f"increase chunk_size from {config.chunk_size} to {math.floor(config.chunk_size * 1.4 + 0.5)}"}
    if expectation_failures > 0:
        return {"issue": f"{expectation_failures} expectations aren't met", "likely_causes": ["passages are split or diluted over several chunks", "expected documents may lack the words of the queries"], "first_fix": _shrink(config, 0.5, "try smaller chunks: chunk_size {old} -> {new}")}
    if summary["no_match_queries"] > 0:
        return {"issue": f"{summary['no_match_queries']} queries have no match to rely on", "likely_causes": ["the corpus may not cover them", "queries and documents may use different words"], "first_fix": "add documents for these questions, in the words that users use"}
    if summary["low_similarity_queries"] > 0:
        return {"issue": f"{summary['low_similarity_queries']} queries match weakly", "likely_causes": ["queries and documents use different words"], "first_fix": "add examples and other names to the documents, as users phrase them"}
    return {"issue": "no larger problem shows in these queries", "likely_causes": ["chunking and retrieval suit the queries that were tried"], "first_fix": "leave the settings; try harder queries first"}
