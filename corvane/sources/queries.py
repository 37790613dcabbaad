"""Query files: YAML, lines of tab-separated columns, or plain lines."""

from __future__ import annotations

from pathlib import PurePosixPath

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.schemas import QUERY
from corvane.sources.documents import SourceError, load_yaml, read_text

SYNTHETIC = 16


def _from_yaml(text: str) -> list[tuple[str, str, list[str]]]:
    found = load_yaml(text)
    if not isinstance(found, dict) or not isinstance(found.get("queries"), list):
        raise SourceError("a YAML query file must have a list `queries`")
    out = []
    for item in found["queries"]:
        if not isinstance(item, dict) or not all(isinstance(item.get(k), str) for k in ("id", "query")):
            raise SourceError("each query must have the texts `id` and `query`")
        expected = item.get("expect_docs", [])
        if not isinstance(expected, list) or not all(isinstance(x, str) for x in expected):
            raise SourceError("expect_docs must be a list of texts")
        out.append((item["id"], item["query"], expected))
    return out


def parse_queries(text: str, extension: str = "") -> list[tuple[str, str, list[str]]]:
    """(id, query, expected documents) of each query."""
    if extension.lower() in ("yaml", "yml") or text.lstrip().startswith("queries:"):
        try:
            return _from_yaml(text)
        except yaml.YAMLError as error:
            raise SourceError(f"invalid YAML: {error}") from error
    try:
        return _from_yaml(text)
    except (yaml.YAMLError, SourceError):
        pass
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        own = f"q{len(out) + 1}"
        parts = line.split("\t", 2)
        if len(parts) == 1:
            out.append((own, line, []))
        else:
            expected = [x.strip() for x in parts[2].split(",") if x.strip()] if len(parts) == 3 else []
            out.append((parts[0].strip() or own, parts[1].strip(), expected))
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expect_docs, query_ord) of a query file."""
    try:
        text = read_text(path)
    except (OSError, UnicodeDecodeError) as error:
        raise SourceError(f"can't read the queries {path}: {error}") from error
    rows = [(i, q, e, n) for n, (i, q, e) in enumerate(parse_queries(text, PurePosixPath(path).suffix[1:]))]
    return spark.createDataFrame(rows, QUERY)


def synthetic_queries(documents: DataFrame) -> DataFrame:
    """Queries from the first documents: their titles, or ids, each expecting its document."""
    first = documents.orderBy("doc_ord").limit(SYNTHETIC)
    name = F.col("doc_id").cast("string")
    return first.select(F.concat(F.lit("auto_"), F.col("doc_ord").cast("string")).alias("query_id"), F.coalesce("title", name).alias("query"), F.array(name).alias("expect_docs"), F.col("doc_ord").alias("query_ord"))
