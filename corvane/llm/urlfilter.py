"""URL filtering: a blocked Bloom filter in front of an exact hash join.

URLs are made canonical first: scheme, user, default port, "www.", fragment,
tracking parameters, index pages and closing slashes go, the host is lower-cased and
the other parameters are sorted.  Each listed URL sets eight bits of one block of
eight 64-bit words.  The blocks are built by an aggregate (bit_or), so no task holds
the filter while it is made, and tested by a join on the block number.  What passes
is joined exactly with the list, so the filter decides on cost alone.

The blocks are sent to every task while they take up to FILTER_BYTES (about 2.5 bytes
a listed URL); a larger filter is joined on the block number by a shuffle.  Pages are
read, made canonical and tested once, and the verdicts of the filter are written to the
shared folder; only the pages that pass take part in the exact join.

Defined results: a null URL, or one without a host, has a null canonical form and
isn't blocked; URLs of any length are canonical in full; an IPv6 host keeps its brackets;
repeated rows stay repeated, and repeated list entries change nothing; an empty list
blocks nothing, and an empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared

#: The most bytes of filter that are sent to every task.
FILTER_BYTES = 64 << 20
#: A block's number and words, with what a row takes.
_BLOCK_BYTES = 80
#: Listed URLs for each block of 512 bits: 16 bits a URL.
A_BLOCK = 32
WORDS = 8
AUTHORITY = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?"
HOST = r"(?:\[[^\]/?]*\]|[^/?:\[]+)"
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(?:=.*)?$"


def canonical(url: Column) -> Column:
    """host[:port]/path[?sorted parameters] of a URL; null without a host."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, AUTHORITY + f"({HOST})", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    port = F.regexp_replace(F.regexp_extract(bare, AUTHORITY + HOST + "(:[0-9]*)", 1), r"^:(?:80|443)?$", "")
    path = F.regexp_extract(bare, AUTHORITY + r"[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    parameters = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    joined = F.array_join(parameters, "&")
    return F.when(host != "", F.concat(host, port, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def listed_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): the distinct canonical forms of the list."""
    return shared.plain(urls, url=url_col).select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit(7), key)
    return [F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]


def blocks(keys: DataFrame, n: int) -> DataFrame:
    """(block, w0..w7): the filter of n keys, a row for each block that isn't empty."""
    number = max(1, -(-n // A_BLOCK))
    block = F.pmod(F.xxhash64("key"), F.lit(number)).alias("block")
    one = F.lit(1).cast("long")
    words = keys.select(block, *[F.call_function("shiftleft", one, bit).alias(f"w{j}") for j, bit in enumerate(_bits(F.col("key")))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def filtered(pages: DataFrame, urls: DataFrame, id_col: str = "page_id", url_col: str = "url", list_col: str = "url", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(page_id, canonical, blocked) for every row of pages."""
    keys = shared.materialize(listed_keys(urls, list_col), "listed")
    n = keys.count()
    number = max(1, -(-n // A_BLOCK))
    rows = shared.plain(pages, page_id=id_col, url=url_col).select("page_id", canonical(F.col("url")).alias("canonical"))
    probed = rows.withColumn("probe", F.pmod(F.xxhash64("canonical"), F.lit(number)))
    held = blocks(keys, n)
    tested = probed.join(F.broadcast(held) if number * _BLOCK_BYTES <= filter_bytes else held, F.col("probe") == F.col("block"), "left")
    passed = F.lit(True)
    for j, bit in enumerate(_bits(F.col("canonical"))):
        passed = passed & F.coalesce(F.getbit(f"w{j}", bit) == 1, F.lit(False))
    tested = shared.materialize(tested.select("page_id", "canonical", (passed & F.col("canonical").isNotNull()).alias("maybe")), "tested")
    clear = tested.where("NOT maybe").select("page_id", "canonical", F.lit(False).alias("blocked"))
    exact = keys.select(F.col("key"), F.lit(True).alias("hit"))
    checked = tested.where("maybe").join(exact, F.col("canonical") == F.col("key"), "left")
    return clear.unionByName(checked.select("page_id", "canonical", F.coalesce("hit", F.lit(False)).alias("blocked")))
