"""Documents from a folder: recursive, with front matter and titles."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import yaml
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.durable import materialize

EXTENSIONS = ("md", "txt", "html", "json")
FRONT = r"(?s)\A-{3}\s*\n(.*?)\r?\n-{3}\s*"


class SourceError(ValueError):
    """Input that can't be read."""


def read_text(path: str) -> str:
    """A whole file as UTF-8 text, from the local disk or, by URI, from any store that the cluster reads."""
    if "://" not in str(path):
        return Path(path).read_text(encoding="utf-8")
    system, place = fs.FileSystem.from_uri(str(path))
    with system.open_input_stream(place) as file:
        return file.read().decode("utf-8")


class _Plain(yaml.SafeLoader):
    """YAML in which only true, false, whole numbers and null are more than text."""


_Plain.yaml_implicit_resolvers = {}
_Plain.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Plain.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*)$"), list("-+0123456789"))
_Plain.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$"), list("-+.0123456789"))
_Plain.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])


def load_yaml(text: str):
    return yaml.load(text, Loader=_Plain)  # noqa: S506


def front_matter(text: str) -> dict[str, str]:
    """Strings, whole numbers and truth values of a YAML mapping as text; nothing for invalid YAML."""
    try:
        found = load_yaml(text)
    except yaml.YAMLError:
        return {}
    if not isinstance(found, dict) or not all(isinstance(k, str) for k in found):
        return {}
    out = {}
    for key, value in found.items():
        if isinstance(value, bool):
            out[key] = str(value).lower()
        elif isinstance(value, int | str) and (isinstance(value, str) or -(1 << 63) <= value < 1 << 63):
            out[key] = str(value)
    return out


def split_front_matter(rows: DataFrame) -> DataFrame:
    """Rows of (text) with the front matter cut off the text and parsed into metadata."""
    head = F.regexp_extract("text", FRONT, 1)

    @F.arrow_udf("map<string,string>")
    def parsed(heads: pa.Array) -> pa.Array:
        return pa.array([list(front_matter(h).items()) if h else [] for h in heads.to_pylist()], pa.map_(pa.string(), pa.string()))

    return rows.withColumn("metadata", parsed(head)).withColumn("text", F.regexp_replace("text", FRONT, ""))


def title(text: Column) -> Column:
    return T.title_of(text)


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """Adds doc_ord, the running number by the key, from 0: numbered within ranges, whose sizes are added up.

    Ranges are drawn from a sample, so they are written once: drawn again, they could be others.
    """
    ranged = rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    marked = materialize(ranged.select("*", within.alias("_at")), "order")
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = marked.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return joined.withColumn("doc_ord", F.col("_before") + F.col("_at")).drop("_part", "_at", "_p", "_before")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, title, text, metadata, doc_ord) of the supported files under a folder, by relative path.

    A file that isn't UTF-8 ends the query with an error.
    """
    place = Path(root)
    if "://" not in root:
        if not place.exists():
            raise SourceError(f"there is no folder {root}")
        if not place.is_dir():
            raise SourceError(f"{root} is no folder")
        root = place.resolve().as_uri()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    base = root.rstrip("/") + "/"
    bare = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    prefix = bare(F.lit(base))
    found = files.where(extension.isin(*EXTENSIONS)).select(bare(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("text"))
    found = found.withColumn("doc_id", F.substring(F.col("path"), F.length(prefix) + 1, F.length("path")))
    split = split_front_matter(found).withColumn("title", title(F.col("text")))
    out = in_order(split, "doc_id").select("doc_id", "path", "title", "text", "metadata", "doc_ord")
    if out.isEmpty():
        raise SourceError(f"no document ({', '.join(EXTENSIONS)}) is under {root}")
    return out


def page_documents(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = 80, entities: dict[str, str] | None = None) -> DataFrame:
    """(name, text) of web pages as documents: markup removed, entities replaced, short pages dropped, their source on top.

    All entities of HTML are replaced, old ones also where their semicolon is missing; with entities, those alone, as written there.
    """
    named = re.compile("|".join(map(re.escape, entities))) if entities else None

    def replaced(x: str) -> str:
        return named.sub(lambda m: entities[m[0]], x) if named else html.unescape(x)

    @F.arrow_udf("string")
    def text_of(raw: pa.Array) -> pa.Array:
        out = []
        for x in raw.to_pylist():
            if x is None:
                out.append(None)
                continue
            x = re.sub(r"(?is)<(script|style).*?>.*?</\1>", " ", x)
            out.append(" ".join(replaced(re.sub(r"(?s)<[^>]+>", " ", x)).split()))
        return pa.array(out, pa.string())

    rows = pages.select(F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("body")).where(F.char_length("body") >= least)
    return rows.select(T.page_slug(F.col("url")).alias("name"), F.concat(F.lit("Source: "), "url", F.lit("\n\n"), "body").alias("text"))


def url_list(text: str) -> list[str]:
    """The URLs of a list: a line each, blank lines and # comments left out."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def fetch_pages(spark: SparkSession, urls: list[str], timeout: float = 20, fetch=None) -> DataFrame:
    """(url, html) of pages, fetched by the tasks; pages that can't be fetched are left out."""
    import urllib.request

    def get(url: str) -> str:
        request = urllib.request.Request(url, headers={"User-Agent": "corvane-import/1"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read().decode("utf-8", errors="ignore")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                try:
                    yield pa.RecordBatch.from_pydict({"url": [url], "html": [(fetch or get)(url)]})
                except OSError:
                    continue

    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return rows.repartition(max(1, min(len(urls), 64))).mapInArrow(load, "url string, html string")
