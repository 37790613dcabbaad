"""Tables of facts from CSV, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text; a row of another length ends the query; of equal headers the last counts."""
    raw = spark.read.option("header", "false").option("mode", "FAILFAST").option("multiLine", "true").option("escape", '"').csv(path)
    head = raw.first() if raw.columns else None
    if head is None:
        raise ValueError(f"{path} has no header")
    names = [(x or "").strip().lstrip("﻿") for x in head]
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("mode", "FAILFAST").option("multiLine", "true").option("escape", '"').csv(path)
    last = {name: i for i, name in enumerate(names)}
    return rows.select(*[T.trimmed(F.coalesce(f"c{i}", F.lit(""))).alias(name) for name, i in last.items()])
