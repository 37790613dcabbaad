"""The library from sources to reports, on small inputs of our own."""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.config import Config, ConfigError, Embedding
from corvane.functions import chunking, embed
from corvane.functions import periods as P
from corvane.functions import text as T
from corvane.operators import audit, compare, diagnose, evaluate, fix, optimize, retrieve, rundiff
from corvane.plans import cli, render
from corvane.sources import artifacts, documents, facts, queries, traces

ROOT = Path(__file__).resolve().parents[1]
EXAMPLES = ROOT / "examples"


def column(spark, values, function, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("x")).alias("r")).collect()]


@pytest.fixture()
def run(spark, capsys):
    """Run a command in this process: exit code, what it printed, its errors."""

    def call(*argv):
        code = cli.main([str(a) for a in argv], lambda: spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    return call


# -- config


def test_config_files_and_overrides(tmp_path):
    assert Config.load(tmp_path / "none.toml") == Config()
    file = tmp_path / "c.toml"
    file.write_text('chunk_size = 120\nchunk_overlap = 20\nrequired_metadata = ["a"]\n[embedder]\nprovider = "openai"\nmodel = "m"\n')
    found = Config.load(file)
    assert (found.chunk_size, found.required_metadata, found.embedder) == (120, ("a",), Embedding("openai", "m"))
    assert found.overridden(embedder="NULL").embedder.provider == "null"
    file.write_text('provider = "openai"\n')
    assert Config.load(file).embedder.model == "text-embedding-3-small"
    with pytest.raises(ConfigError):
        found.overridden(embedder="other")


@pytest.mark.parametrize("bad", [{"chunk_size": 0, "chunk_overlap": -1}, {"chunk_overlap": 400}, {"top_k": 0}, {"min_tokens": 2000}, {"dominant_threshold": 1.5}, {"low_sim_threshold": 2.0}, {"no_match_threshold": 0.5}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ConfigError):
        Config(**bad).checked()


# -- sources


def test_documents(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.MD").write_bytes("---\r\nproduct: x\r\nversion: 2\r\nlive: true\r\nprice: 1.5\r\nday: 2024-01-02\r\nyes: yes\r\n---\r\n\r\n## The title\r\nBody".encode())
    (tmp_path / "b/c d.txt").write_text("plain first line\nmore")
    (tmp_path / "b/bad.html").write_text("---\na: [1\n---\nbody")
    (tmp_path / "skip.py").write_text("no")
    rows = documents.read_documents(spark, str(tmp_path)).orderBy("doc_ord").collect()
    assert [r["doc_id"] for r in rows] == ["a.MD", "b/bad.html", "b/c d.txt"] and [r["doc_ord"] for r in rows] == [0, 1, 2]
    assert rows[0]["metadata"] == {"product": "x", "version": "2", "live": "true", "day": "2024-01-02", "yes": "yes"}
    assert rows[0]["title"] == "The title" and rows[0]["text"].strip().startswith("## The title")
    assert rows[1]["metadata"] == {} and rows[1]["text"] == "body" and rows[2]["title"] == "plain first line"
    with pytest.raises(documents.SourceError):
        documents.read_documents(spark, str(tmp_path / "none"))
    (tmp_path / "e").mkdir()
    with pytest.raises(documents.SourceError):
        documents.read_documents(spark, str(tmp_path / "e"))


def test_numbers_in_order_over_many_partitions(spark):
    rows = spark.range(1000).select(F.format_string("%05d", F.col("id") * 7 % 1000).alias("k")).repartition(6)
    found = {r["k"]: r["doc_ord"] for r in documents.in_order(rows, "k").collect()}
    assert all(found[k] == int(k) for k in found) and len(found) == 1000


def test_query_files():
    assert queries.parse_queries("id1\tfirst query\ta.md, b.md\n# note\n\nplain one\nid2\tno docs") == [("id1", "first query", ["a.md", "b.md"]), ("q2", "plain one", []), ("id2", "no docs", [])]
    assert queries.parse_queries("queries:\n - id: a\n   query: b\n   expect_docs: [c]") == [("a", "b", ["c"])]
    for text, extension in (("queries: [", ""), ("- 1", "yaml")):
        with pytest.raises(documents.SourceError):
            queries.parse_queries(text, extension)


def test_single_files_by_path_or_uri(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("a\tb c\td\n", encoding="utf-8")
    (tmp_path / "r.json").write_text('{"total_cases": 1}', encoding="utf-8")
    for root in (str(tmp_path), tmp_path.as_uri()):
        assert [tuple(r)[:2] for r in queries.read_queries(spark, f"{root}/q.tsv").collect()] == [("a", "b c")]
        assert artifacts.load_report(f"{root}/r.json") == {"total_cases": 1}
        with pytest.raises(documents.SourceError):
            queries.read_queries(spark, f"{root}/none")


def test_synthetic_queries(spark):
    rows = spark.createDataFrame([(f"d{i:02}", None if i % 2 else f"title {i}", i) for i in range(20)], "doc_id string, title string, doc_ord bigint")
    found = queries.synthetic_queries(rows).orderBy("query_ord").collect()
    assert len(found) == 16 and found[0]["query"] == "title 0" and found[1]["query"] == "d01" and found[1]["expect_docs"] == ["d01"] and found[15]["query_id"] == "auto_15"


def test_facts(spark, tmp_path):
    file = tmp_path / "f.csv"
    file.write_text('a, b ,a\n1,"x, y",3\n 4 ,,6\n')
    rows = facts.read_facts(spark, str(file))
    assert rows.columns == ["a", "b"] and [tuple(r) for r in rows.collect()] == [("3", "x, y"), ("6", "")]
    file.write_text("a,b\n1\n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        facts.read_facts(spark, str(file)).collect()


def test_traces():
    basic = {"request": {"question": "why"}, "response": {"answer": {"text": "so"}}, "context": {"docs": [{"doc_id": 7, "content": "c", "similarity": "0.5", "url": "u", "metadata": {"k": 1}}, {"text": "t"}]}}
    run = traces.import_trace(basic, model="m")
    assert run["question"] == "why" and run["answer"] == "so" and run["context"] == {"model": "m", "top_k": None}
    assert run["retrieved_docs"] == [{"id": "7", "text": "c", "score": 0.5, "source": "u", "metadata": {"k": 1}}, {"id": "doc_2", "text": "t", "score": None, "source": None, "metadata": None}]
    deep = {"p": {"q": "x", "final": ["", "y"], "ctx": {"z": [{"hits": [{"body": "b"}]}]}}}
    run = traces.import_trace(deep, question="/p/q", answer="/p/final/1")
    assert run["answer"] == "y" and run["retrieved_docs"][0]["text"] == "b"
    assert traces.at({"a/b": {"~": [5]}}, "/a~1b/~0/0") == 5
    for bad in ({"question": "q", "answer": "a", "docs": []}, {"question": "q", "answer": "a"}, {"answer": "a", "docs": [{"text": "t"}]}, {"question": "q", "answer": "a", "docs": [{"id": "x"}]}):
        with pytest.raises(documents.SourceError):
            traces.import_trace(bad)


def test_traces_of_a_table(spark):
    rows = spark.createDataFrame([(1, json.dumps({"question": "q", "answer": "a", "docs": [{"text": "t"}]})), (2, "{"), (3, None)], "k int, raw string")
    got = {r["k"]: r for r in traces.imported(rows, "k", "raw").collect()}
    assert json.loads(got[1]["artifact"])["question"] == "q" and got[2]["artifact"] is None and got[2]["error"] and got[3]["error"]


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame([("https://ex.com:8080/a/b/?q", "<html><style>x{}</style><script>if (a<b) {}</script><p>" + "caf&eacute; &amp; more " * 10 + "</p>"), ("https://ex.com", "<p>short</p>"), ("https://x.y", None)], "url string, html string")
    rows = documents.page_documents(pages).collect()
    assert len(rows) == 1 and rows[0]["name"] == "ex.com_8080_a_b.txt" and rows[0]["text"].startswith("Source: https://ex.com:8080/a/b/?q\n\ncafé & more café")
    cut = spark.createDataFrame([("https://ex.com/a", "<title>one&amp;&amp</title>" + "&eacute; two&lt; &amp;lt; &quot " * 10)], "url string, html string")
    bodies = [documents.page_documents(cut, entities=x).first()["text"].split("\n\n")[1] for x in (None, {"&lt;": "<", "&amp;": "&"})]
    assert bodies[0].startswith('one&& é two< &lt; " é') and bodies[1].startswith("one&&amp &eacute; two< &lt; &quot &eacute;")  # F2
    (tmp_path / "urls").write_text("# list\nhttps://one.example/a\n\nhttps://two.example/b\n")

    def fetch(url):
        if "two" in url:
            raise OSError("gone")
        return "<p>" + "words " * 40

    from corvane.plans import commands

    assert commands.import_pages(spark, str(tmp_path / "urls"), str(tmp_path / "out"), fetch=fetch) == 1
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one.example_a.txt"]


# -- text


def test_text_columns(spark):
    assert column(spark, ["﻿a  \r\n\n\n\nb\t\n", "", None], T.normalized) == ["a\n\nb", "", None]
    assert column(spark, ["a b　c \u0085d", "  "], T.n_words) == [4, 0]
    assert column(spark, ["a. b", "c d,", "One. Two three", "One. two three", "x!. B y", ""], T.ends_mid_sentence) == [True, True, False, True, False, False]
    assert column(spark, ["One. Two! v1.2 ok; end"], T.chunk_sentences) == [["One.", "Two!", "v1.2 ok;", "end"]]
    assert column(spark, ["One. v1.2"], T.claim_sentences) == [["One.", "v1.", "2"]]
    assert column(spark, ["## A / B //"], T.heading_path) == [["A", "B"]]
    assert column(spark, ["# a\n  ## b\nc # d"], T.n_headings) == [2]
    assert column(spark, ["  A-b  ", "--"], T.bare_id) == ["ab", "--"]
    assert column(spark, ["x" * 221], T.preview) == ["x" * 220 + "..."]


def test_mentions(spark):
    answer = F.lit("Business in Latin America grew, US Direct too")
    got = column(spark, ["US", "us", "EU", "Latin America", "America Latin", "usa", "", "si"], lambda v: T.mentions(T.tokens(answer), v))
    assert got == [True, True, False, True, True, False, False, False]


@pytest.mark.parametrize(("a", "b", "n"), [("a b c", "b c d", 2), ("a b", "c", 0), ("", "a", 0), ("x x", "x x", 2)])
def test_overlap(spark, a, b, n):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.overlap_of(T.words(F.col("a")), T.words(F.col("b")))).first()
    assert row[0] == n


def test_periods_and_figures(spark):
    days = ["2026-01", "2026/02", "2026-1-3", "03/04/2026", "05-06-2026", "2026-01-31T23:30:00+05:00", "2026-01-31 10:00", "2026-01-31T10:00:00.5Z", "2026-13", "soon", "", "2026-01-15 99:99", "2026-01-15T10:00+00:00", "2026-01-15 10:00:00.5", "2026-01-15 24:00", "2026-1-5T9:5:60", "2026-01-15 10:00:00.5+01:00", "2026-01-15T10:00:00z", "2026-01-15Z", "2026-01-15T10:00:00+0530"]
    assert column(spark, days, lambda c: P.bucketed(c, "month")) == ["2026-01", "2026-02", "2026-01", "2026-03", "2026-06", "2026-01", "2026-01", "2026-01", "", "", "", "", "", "", "", "2026-01", "2026-01", "2026-01", "", "2026-01"]
    assert column(spark, ["2027-01-01"], lambda c: P.bucketed(c, "week")) == ["2026-W53"]
    assert column(spark, ["1,234.5", "$5", "(7)", "$(8)", "($9)", "1d", "x", " -3e2 "], P.metric_of) == [1234.5, 5.0, -7.0, -8.0, None, None, None, -300.0]


# -- chunks


def test_chunk_sizes_and_overlap():
    line = " ".join(f"w{i}" for i in range(120))
    assert [n for _, n, _ in chunking.chunk_text(line, 20, 0)] == [20] * 6
    assert [n for _, n, _ in chunking.chunk_text(line, 20, 5)] == [20, 40, 40, 40, 40, 40]
    text = "intro words\n# First / Part\nbody one\n\nbody two\n# Second\nlast"
    assert chunking.chunk_text(text, 100, 10) == [("intro words", 2, []), ("# First / Part\nbody one\nbody two", 8, ["First", "Part"]), ("# Second\nlast", 3, ["Second"])]
    assert chunking.chunk_text("a b. c d. e f.", 4, 0) == [("a b. c d.", 4, []), ("e f.", 2, [])]
    assert chunking.chunk_text(None, 5, 0) == chunking.chunk_text(" \n", 5, 0) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab .#", min_size=1, max_size=40), max_size=12), st.integers(1, 12))
def test_chunks_without_overlap_keep_every_word(lines, size):
    text = "\n".join(lines)
    chunks = chunking.chunk_text(text, size, 0)
    assert " ".join(c for c, _, _ in chunks).split() == text.split()
    for body, n, _ in chunks:
        assert n == len(body.split())
        assert n <= size or body.startswith("#")


def test_chunk_numbers_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, f"d{i}", "line of words\n" * (i % 5)) for i in range(50)], "doc_ord bigint, doc_id string, text string")
    seen = [{(r["chunk_id"], r["pos"]) for r in chunking.numbered(chunking.chunks(rows.repartition(n), 6, 0)).collect()} for n in (1, 7)]
    assert seen[0] == seen[1] and {int(c.split("#")[1]) for c, _ in seen[0]} == set(range(len(seen[0])))


def test_repeated_questions_are_matched_in_one_pass():
    """every rule of a question went through all runs of it that were taken before."""
    import time

    n = 20_000
    began = time.time()
    assert evaluate.match(((i, b"?", b"q") for i in range(n)), ((i, (b"a", b"b"), b"q") for i in range(n))) == {i: i for i in range(n)}
    assert time.time() - began < 5
    assert evaluate.match([(0, "x", "q"), (1, "y", "q"), (2, "x", "q"), (3, "x", "q")], [(7, ["x", "x"], "p"), (8, ["y", "x"], "q"), (9, ["z", "z"], "q")]) == {0: 7, 1: 8, 2: 9}


def test_overlaps_are_compared_where_they_may_begin(spark):
    """every length was compared word by word, and chunks were numbered, by a join, for findings without numbers."""
    from corvane import queries_more

    rng = random.Random(3)
    pairs = [([rng.choice("ab") for _ in range(rng.randrange(9))], [rng.choice("ab") for _ in range(rng.randrange(9))]) for _ in range(200)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r["o"] for r in rows.select("i", T.overlap_of(F.col("a"), F.col("b"), 6).alias("o")).orderBy("i").collect()]
    assert got == [max((k for k in range(1, min(len(a), len(b), 6) + 1) if a[-k:] == b[:k]), default=0) for a, b in pairs]
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "get(a" in plan(rows.select(T.overlap_of(F.col("a"), F.col("b")))) and "Join Inner, (doc_ord" not in plan(queries_more.QUERIES["chunk_findings_overlap"](spark, "/root/testdata/sf0.001"))


def test_chunks_are_passed_on_in_parts(monkeypatch):
    """a task held the chunks of a whole batch for every grid point, and passed them on at once."""
    texts = [f"sentence {i} of words. " * 300 for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_ord": list(range(42)), "doc_id": [f"d{i}" for i in range(42)], "text": texts})
    grid = [(50, 10), (100, 0), (200, 40)]
    for rows, chars in ((100, 1 << 30), (1 << 30, 20_000)):
        monkeypatch.setattr(chunking, "MADE_ROWS", rows)
        monkeypatch.setattr(chunking, "MADE_CHARS", chars)
        parts = list(chunking.chunk_batches(batch, grid))
        assert len(parts) > 10 and all(p.num_rows <= rows and sum(map(len, p.column("text").to_pylist())) < chars + 4000 for p in parts)
        got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
        assert got == [(i, f"d{i}", s, o, pos, *c) for i, t in enumerate(texts) for s, o in grid for pos, c in enumerate(chunking.chunk_text(t, s, o))]


# -- embedding


def test_vectors_agree(spark):
    texts = ["The cat the", "", "x  y\nx"]
    assert np.allclose(column(spark, texts, embed.bow_array), embed.bow(texts)) and embed.bow(texts).sum(1).tolist() == [3, 0, 3]


def test_remote_batches_and_retries():
    assert [len(b) for b in embed.batches_of(["x"] * 130)] == [64, 64, 2]
    assert [len(b) for b in embed.batches_of(["w " * 1000] * 4)] == [2, 2]
    config = Config(embedder=Embedding("openai", "m", "http://h/v1/"), max_retries=2, retry_backoff_ms=10)
    waits, calls = [], []

    def client(statuses):
        def post(url, headers, body, timeout):
            calls.append(url)
            status = statuses.pop(0)
            if status is None:
                raise OSError("down")
            data = [{"embedding": [1.0]} for _ in body["input"]]
            return status, json.dumps({"data": data[: 1 if status == 299 else None]}).encode()

        return embed.Remote(config, "key", post, waits.append)

    assert client([429, None, 200]).embed(["a"]) == [[1.0]] and waits == [0.01, 0.02] and calls[0] == "http://h/v1/embeddings"
    for statuses in ([400], [500, 500, 500], [299]):
        with pytest.raises(RuntimeError):
            client(statuses).embed(["a", "b"])


def test_vector_cache(spark, tmp_path):
    class Counting(embed.BagOfWords):
        dim = 64

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "k int, text string")
    for _ in range(2):
        got = embed.embedded(rows, Counting(), "null", str(tmp_path / "cache")).collect()
        assert len(got) == 3 and {len(r["vector"]) for r in got} == {64}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


# -- retrieval


def slow_score(query, text):
    a, b = embed.bow([query])[0], embed.bow([text])[0]
    size = np.float32(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    similarity = np.float32((a * b).sum() / size) if size else np.float32(0)
    terms = [set(re.findall("[a-z0-9]{2,}", x.lower())) for x in (query, text)]
    share = np.float32(len(terms[0] & terms[1]) / max(len(terms[0]), 1))
    n = len(text.split())
    return float(similarity + min(share * np.float32(0.15), np.float32(0.15)) + np.float32(0.08 if query.lower() in text.lower() else 0) - np.float32(min((n - 800) / 800, 0.3) if n > 800 else 0))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    words = "refund delivery invoice card parcel support price window days photo".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 30, 900]))) for _ in range(40)] + ["", "refund", "refund"]
    asked = ["refund window", "Parcel photo days", "", "nothing of this", "refund"]
    chunks = spark.createDataFrame([(i, f"d{i}", 0, t, len(t.split()), []) for i, t in enumerate(texts)], "doc_ord bigint, doc_id string, pos int, text string, token_count int, heading_path array<string>")
    rows = spark.createDataFrame([(f"q{i}", q, i, []) for i, q in enumerate(asked)], "query_id string, query string, query_ord bigint, expect_docs array<string>")
    return texts, asked, chunks, rows


@pytest.mark.parametrize("block", [5000, 2])
def test_ranking_against_brute_force(small, block):
    texts, asked, chunks, rows = small
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieve.ranked(chunks.repartition(5), rows, 5, block).collect()}
    for q, query in enumerate(asked):
        best = sorted(((-slow_score(query, t), i) for i, t in enumerate(texts)))[:5]
        for rank, (score, _) in enumerate(best, 1):
            assert got[f"q{q}", rank][1] == pytest.approx(-score, abs=2e-6)
    assert len(got) == 25 and got["q4", 1][0] == "d41" and got["q4", 2][0] == "d42"


def test_retrieval_of_nothing(small):
    _, _, chunks, rows = small
    assert retrieve.ranked(chunks.limit(0), rows, 5).count() == 0 and retrieve.ranked(chunks, rows.limit(0), 5).count() == 0


def test_what_a_worker_holds_is_bounded(spark, small):
    """a worker held whole batches, words without limit, and all chunks of equal score."""
    texts, asked, chunks, rows = small
    assert embed.place_of.cache_info().maxsize <= 1 << 16
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 10}) for _ in range(20)]
    assert [t.num_rows for t in retrieve._passes(iter(batches), 1000, 25_000)] == [30] * 6 + [20] and [t.num_rows for t in retrieve._passes(iter(batches), 50)] == [50] * 4
    same = spark.range(3000).select(F.col("id").alias("doc_ord"), F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(0).alias("pos"), F.lit("refund window").alias("text"), F.lit(2).alias("token_count"))
    asks = rows.where("query_ord <= 2")
    blocks = retrieve._query_blocks(asks, 5000)
    made = retrieve._scored(same, blocks, 5, "score", [])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert made.groupBy(F.spark_partition_id(), "query_ord").count().agg(F.max("count")).first()[0] == 5
    assert {(r["query_ord"], r["rank"], r["doc_id"]) for r in retrieve.ranked(same, asks, 5).collect()} == {(q, k, f"d{k - 1}") for q in range(3) for k in range(1, 6)}
    table = pa.Table.from_pylist([r.asDict() for r in chunks.drop("heading_path").collect()])
    score = [list(retrieve._best_of_each(np.zeros(4, int), np.array([1.0, 2.0, 2.0, 2.0]), np.array([0, 9, 1, 5]), k)) for k in (1, 2, 9)]
    assert score == [[2], [2, 3], [2, 3, 1, 0]] and list(retrieve._places(table, ["doc_ord", "pos"])) == list(range(len(texts)))
    assert list(retrieve._places(pa.table({"x": ["b", None, "a"]}), ["x"])) == [2, 0, 1]


# -- diagnostics


@pytest.fixture(scope="module")
def results(spark):
    ranked = spark.createDataFrame(
        [("a", 0, "x", 1, 0.9), ("a", 0, "x", 2, 0.8), ("a", 0, "y", 3, 0.7), ("b", 1, "x", 1, 0.3), ("b", 1, "z", 2, 0.2), ("c", 2, "y", 1, 0.1)],
        "query_id string, query_ord bigint, doc_id string, rank int, score float",
    )
    rows = spark.createDataFrame([("a", "?", ["y"], 0), ("b", "?", ["q"], 1), ("c", "?", [], 2), ("d", "?", ["x"], 3), ("a", "?", ["z", "x"], 4)], "query_id string, query string, expect_docs array<string>, query_ord bigint")
    return ranked, rows


def test_summaries(results):
    ranked, rows = results
    config = Config()
    row = diagnose.sim_summary(ranked, rows, config).first()
    assert (row["queries"], row["low_similarity_queries"], row["no_match_queries"]) == (5, 4, 3)
    assert row["low_similarity_query_ids"] == ["b", "c", "d", "a"] and row["avg_top1_similarity"] == pytest.approx(1.3 / 5)
    assert tuple(diagnose.coverage(ranked, rows, config).first()) == (5, 1, 1, 3)
    assert [(r["doc_id"], r["count"]) for r in diagnose.topk_frequency(ranked, 3).orderBy("first").collect()] == [("x", 2), ("y", 2), ("z", 1)]
    assert diagnose.max_dominant_rate(ranked, rows).first()["rate"] == pytest.approx(0.4)
    assert [r["doc_id"] for r in diagnose.dominant_documents(ranked, rows, config).collect()] == ["x"]


def test_expectations(results):
    ranked, rows = results
    got = {r["query_ord"]: r for r in diagnose.expectation_outcomes(ranked, rows, Config()).collect()}
    assert {k: (r["status"], r["best_rank"]) for k, r in got.items()} == {0: ("PASS", 3), 1: ("FAIL", None), 3: ("FAIL", None), 4: ("PASS", 1)}
    assert got[0]["top_docs"] == ["x", "y"] and [tuple(x) for x in got[4]["expected_ranks"]] == [("x", 1)]
    findings = diagnose.retrieval_findings(ranked, rows, Config()).collect()
    assert [f["code"] for f in findings] == ["DOMINANT_DOCUMENT", "EXPECTATION_MISS", "EXPECTATION_MISS"] and json.loads(findings[0]["data"])["doc"] == "x"


def test_causes(spark, results):
    ranked, rows = results
    chunks = spark.createDataFrame([("x", "same", 900), ("y", "same", 10), ("z", "other", 10)], "doc_id string, text string, token_count int")
    docs = spark.createDataFrame([("x", {"product": "p", "region": "r", "version": "1"}), ("y", None), ("z", {})], "doc_id string, metadata map<string,string>")
    got = {r["doc_id"]: r["causes"] for r in diagnose.dominance_causes(ranked, rows, chunks, docs, Config(dominant_threshold=0.2)).collect()}
    assert got == {"x": ["oversized chunks", "duplicate chunk content"], "y": ["duplicate chunk content", "missing metadata fields"]}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40))
def test_nearest_ranks(spark, values):
    row = diagnose.nearest_ranks(spark.createDataFrame([(v,) for v in values], "v int"), "v", (50, 95)).first()
    at = lambda p: sorted(values)[int(np.floor(np.float32(p / 100) * np.float32(len(values) - 1) + 0.5))]
    assert (row["p50"], row["p95"]) == (at(50), at(95))


def test_chunk_rules(spark):
    body = " ".join(["word"] * 70)
    rows = [(0, "d", 0, body + " end", 1300, ["A"]), (0, "d", 1, "word end. Tail", 10, []), (1, "e", 0, body + " end", 71, ["B"]), (1, "e", 1, "# a\n# b\n# c\n" + body + ".", 76, ["B"])]
    chunks = spark.createDataFrame(rows, "doc_ord bigint, doc_id string, pos int, text string, token_count int, heading_path array<string>")
    codes = [r["code"] for r in diagnose.chunk_findings(chunks, Config(chunk_overlap=0)).collect()]
    assert codes == ["OVERSIZED_CHUNK", "TINY_CHUNK", "MULTI_TOPIC_CHUNK", "SENTENCE_CUT", "DUPLICATE_CHUNK"]
    stats = diagnose.chunk_stats(chunks, spark.range(2), Config()).first()
    assert (stats["documents"], stats["chunks"], stats["large_chunks"], stats["small_chunks"], stats["duplicate_chunks"]) == (2, 4, 1, 1, 1)
    assert {r["code"] for r in diagnose.topic_findings(chunks).collect()} == {"TOPIC_DOMINANCE"}
    none = diagnose.chunk_stats(chunks.limit(0), spark.range(0), Config()).first()
    assert none["chunks"] == none["p95_tokens"] == none["max_tokens"] == 0 and diagnose.chunk_findings(chunks.limit(0), Config()).count() == 0


def test_metadata(spark):
    docs = spark.createDataFrame([("a", {"k": "1"}), ("b", {}), ("c", None)], "doc_id string, metadata map<string,string>")
    got = diagnose.metadata_findings(docs, Config(required_metadata=("k", "l"))).collect()
    assert [(r["severity"], r["code"]) for r in got] == [("High", "MISSING_METADATA"), ("High", "MISSING_METADATA")]
    assert diagnose.metadata_findings(docs, Config(required_metadata=())).count() == 0


# -- audit


def audited(spark, rows, answer, names=("region", "channel", "period", "revenue"), **settings):
    table = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    request, notes = audit.resolve(table, answer, auto=True, **settings)
    return audit.audited(table, request), request, notes


SALES = [("US", "Direct", "old", "100"), ("US", "Direct", "new", "180"), ("EU", "Partner", "old", "90"), ("EU", "Partner", "new", "70"), ("LATAM", "Direct", "old", "40"), ("LATAM", "Direct", "new", "42")]


def test_audit_verdicts(spark):
    wrong, request, _ = audited(spark, SALES, "Revenue rose due to EU growth")
    assert wrong["verdict"] == "INCORRECT" and {i["code"] for i in wrong["issues"]} == {"CONTRADICTION", "MISSING_DRIVER"} and wrong["confidence"] == "HIGH"
    assert (request.metric, request.period_col, request.baseline, request.current, request.group_by) == ("revenue", "period", "old", "new", ("region", "channel"))
    good, _, _ = audited(spark, SALES, "Strong US Direct growth")
    assert good["verdict"] == "SUPPORTED" and good["issues"] == [] and good["alignment_score"] == 1.0 and good["total_delta"] == 62
    risky, _, _ = audited(spark, SALES, "US Direct and LATAM growth")
    assert risky["verdict"] == "RISKY" and [i["code"] for i in risky["issues"]] == ["WEAK_SIGNAL"] and risky["coverage_pct"] == pytest.approx(200 / 3)
    none, _, _ = audited(spark, SALES, "Business is good")
    assert {i["code"] for i in none["issues"]} == {"MISSING_DRIVER", "NO_DATA_CLAIMS"} and none["mentions"] == []
    assert sum(d["contribution_pct"] for d in good["top_drivers"]) == pytest.approx(100)


def test_audit_of_dates(spark):
    rows = [("US", "2026-01-05", "1,000"), ("US", "2026-02-10", "$1,500"), ("EU", "2026-01-09", "(5)"), ("EU", "02/03/2026", "7"), ("EU", "someday", "x")]
    got, request, notes = audited(spark, rows, "US growth", ("region", "date", "amount"), granularity="month", metric="amount", group_by=["region"])
    assert (request.baseline, request.current) == ("2026-01", "2026-02") and got["total_delta"] == 512 and "period granularity: month" in notes
    assert [i["code"] for i in got["issues"]] == ["DATA_QUALITY"]
    with pytest.raises(audit.AuditError):
        audited(spark, [("US", "old", "1"), ("EU", "new", "2")], "x", ("region", "period", "amount"), granularity="month")
    with pytest.raises(Exception):  # noqa: B017, PT011
        audited(spark, [("US", "old", "bad"), ("EU", "new", "2")], "x", ("region", "period", "amount"), metric="amount", group_by=["region"])
    with pytest.raises(audit.AuditError):
        audit.resolve(spark.createDataFrame(SALES, "region string, channel string, period string, revenue string"), "x")


def test_audit_inference():
    assert audit.infer_pair(["b", "Before", "after"]) == ("Before", "after") and audit.infer_pair(["10", "9"]) == ("9", "10") and audit.infer_pair(["q", "p"]) == ("p", "q")
    assert audit.metric_name_score("revenue_usd") == 140 and audit.metric_name_score("click_rate") == -80 and audit.is_period_name("OrderDate")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["p", "q", "r"]), st.integers(-50, 50)), min_size=1, max_size=25))
def test_drivers_add_up(spark, rows):
    table = spark.createDataFrame([(g, p, str(v)) for g, p, v in rows], "g string, p string, v string")
    got = audit.drivers(table, ("g",), "v", "p", "p", "q").collect()
    total = sum(v for _, p, v in rows if p == "q") - sum(v for _, p, v in rows if p == "p")
    assert sum(r["delta"] for r in got) == total
    assert sum(r["contribution_pct"] for r in got) == pytest.approx(100 if total else 0)


# -- runs


def run_of(answer, *docs, question="q"):
    return artifacts.complete({"question": question, "answer": answer, "retrieved_docs": [{"id": i, "text": t, "score": s} for i, t, s in docs]})


def diffed(spark, a, b):
    table = lambda r, n: artifacts.artifact_table(spark, [r]).select(F.struct("*").alias(n))
    return rundiff.diffed(table(a, "baseline").crossJoin(table(b, "current"))).first()


def test_diffs(spark):
    d1, d2 = ("a", "sales figures", 0.9), ("b", "refund policy details window", 0.8)
    same = diffed(spark, run_of("Sales rose", d1), run_of("sales  ROSE", d1))
    assert (same["change_type"], same["root_cause"], same["confidence"]) == ("equivalent", "no_meaningful_change", "high")
    against = diffed(spark, run_of("Sales increased", d1), run_of("Sales declined", d1))
    assert (against["change_type"], against["root_cause"], against["confidence"]) == ("contradictory", "answer_generation_changed", "medium")
    more = diffed(spark, run_of("Refund policy", d1), run_of("Refund policy details window", d2))
    assert (more["change_type"], more["root_cause"], more["confidence"]) == ("more_specific", "retrieval_changed", "high")
    assert [d["id"] for d in more["added_docs"]] == ["b"] and [d["id"] for d in more["removed_docs"]] == ["a"] and more["alignment"]["current_best_doc_id"] == "b"
    shift = diffed(spark, run_of("Sales", d1), run_of("Sales", ("a", "sales figures", 0.5)))
    assert (shift["root_cause"], shift["confidence"]) == ("retrieval_changed_but_answer_stable", "low")
    other = diffed(spark, run_of("x"), run_of("y", question="another"))
    assert other["confidence"] == "low" and other["alignment"] is None
    back = diffed(spark, run_of("Refund policy details window", d2), run_of("Refund policy", d1))
    assert [d["id"] for d in back["added_docs"]] == [d["id"] for d in more["removed_docs"]]


def test_artifacts_are_validated(tmp_path):
    good = {"question": "q", "answer": "a", "retrieved_docs": [{"id": "x", "text": "t"}]}
    assert artifacts.problem(good) is None
    for change in ({"question": " "}, {"answer": ""}, {"retrieved_docs": [{"id": "", "text": "t"}]}, {"retrieved_docs": [{"id": "x", "text": "t"}] * 2}, {"retrieved_docs": [{"id": "x"}]}):
        assert artifacts.problem(good | change)
    for text in ("[]", "{", json.dumps(good | {"answer": ""})):
        (tmp_path / "r.json").write_text(text)
        with pytest.raises(documents.SourceError):
            artifacts.load_artifact(str(tmp_path / "r.json"))


def rules_of(spark, *cases):
    return artifacts.rule_table(spark, list(cases))


def test_evaluation(spark, tmp_path):
    for name, run in {"one": run_of("The refund takes 5 days.", ("d", "The refund takes five days", 1.0)), "two": run_of('{"k": 1}', question="json"), "three": run_of("Unrelated claims about many strange planets here.", ("d", "refund", 1.0), question="ground")}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(run))
    (tmp_path / "noise.json").write_text("{")
    (tmp_path / "other.json").write_text('{"a": 1}')
    runs = artifacts.read_runs(spark, str(tmp_path))
    rules = rules_of(
        spark,
        {"id": "ONE", "question": "?", "expected": {"must_include": ["REFUND"], "must_not_include": ["days"], "min_chars": 100, "max_chars": 5}},
        {"id": "j", "question": " JSON ", "expected": {"json_required_keys": ["k", "l"]}},
        {"id": "g", "question": "ground", "expected": {"grounded": True}},
        {"id": "lost", "question": "nobody asked"},
    )
    report = evaluate.report(rules, runs, "r", "u")
    codes = {c["id"]: [i["code"] for i in c["issues"]] for c in report["cases"]}
    assert codes == {"ONE": ["FORBIDDEN_PHRASE", "ANSWER_TOO_SHORT", "ANSWER_TOO_LONG"], "j": ["MISSING_JSON_KEY"], "g": ["LOW_GROUNDING_OVERLAP", "UNSUPPORTED_CLAIMS"], "lost": ["MISSING_RUN"]}
    assert (report["total_cases"], report["failed_cases"], report["unmatched_runs"]) == (4, 4, [])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"question": "q", "answer": ""}')
    with pytest.raises(documents.SourceError):
        artifacts.read_runs(spark, str(tmp_path / "bad"))


def test_rules_take_runs_greedily():
    rules = [(0, "b", "q"), (1, "x", "q"), (2, "y", "q"), (3, "z", "q")]
    runs = [(0, ["a", "a"], "q"), (1, ["bjson", "b"], "q"), (2, ["c", "c"], "other")]
    assert evaluate.match(rules, runs) == {0: 1, 1: 0}


def summary(queries, weak, none, **tops):
    return {"top1_freq": [{"count": n, "doc_id": d} for d, n in tops.items()], "no_match_queries": none, "low_similarity_queries": weak, "avg_top1_similarity": 0.5, "queries": queries}


def test_simulations_compared(spark):
    one = {"sim_summary": summary(10, 3, 1, b=4, a=4)}
    two = {"retrievals": [{"ranked": [{"chunk_id": "a#1", "score": 0.9}]}, {"ranked": []}, {"ranked": [{"chunk_id": "c#0", "score": 0.3}]}]}
    diff = compare.compared(spark, one, two)
    assert (diff["top1_dominant_doc_before"], diff["queries_after"], diff["weak_after"], diff["no_match_after"], diff["query_count_mismatch"]) == ("a", 3, 2, 1, True)
    assert diff["verdict"] == "NEUTRAL" or diff["verdict"] == "IMPROVED"
    assert [(d["doc_id"], d["delta"]) for d in diff["top1_docs"]] == [("a", -3), ("c", 1), ("b", -4)]
    same = compare.compared(spark, one, one)
    assert same["verdict"] == "NEUTRAL" and same["improved_metrics"] == same["regressed_metrics"] == []
    worse = same | {"weak_after": 9, "no_match_after": 9, "avg_top1_similarity_after": 0.1, "verdict": "REGRESSED", "queries_after": 1, "query_count_mismatch": True, "top1_dominant_rate_after": 0.9}
    for gate in ({"weak": True}, {"no_match": True}, {"similarity": True}, {"regressed": True}, {"mismatch": True}, {"rate_above": 0.5}, {"rate_increases": True}):
        assert compare.gate_failure(worse, **gate) and compare.gate_failure(same, **gate) is None
    with pytest.raises(ValueError, match="0 to 1"):
        compare.gate_failure(same, rate_above=2)


def test_fixes():
    config = Config()
    fine = {"chunks": 10, "small_chunks": 0, "large_chunks": 0, "p95_tokens": 100, "duplicate_chunks": 0}
    good = {"no_match_queries": 0, "low_similarity_queries": 0}
    assert "reduce chunk_size from 400 to 200" in fix.advice(config, fine, good, 0, ("d", 0.5))["first_fix"]
    assert "from 400 to 280" in fix.advice(config, fine | {"large_chunks": 1}, good, 0, None)["first_fix"]
    assert "from 400 to 560" in fix.advice(config, fine | {"small_chunks": 4}, good, 0, None)["first_fix"]
    assert "expectations" in fix.advice(config, fine, good, 2, None)["issue"]
    assert "no match" in fix.advice(config, fine, good | {"no_match_queries": 1}, 0, None)["issue"]
    assert "weakly" in fix.advice(config, fine, good | {"low_similarity_queries": 1}, 0, None)["issue"]
    assert "no larger problem" in fix.advice(config, fine, good, 0, ("d", 0.1))["issue"]
    assert "reduce chunk_overlap" in fix.advice(Config(chunk_size=41, chunk_overlap=40), fine, good, 0, ("d", 0.5))["first_fix"]


def test_grid(spark):
    docs = spark.createDataFrame([(i, f"d{i}", f"refund rules number {i}. " * 30) for i in range(6)], "doc_ord bigint, doc_id string, text string")
    asked = spark.createDataFrame([("q", "refund rules number 3", ["d3"], 0), ("r", "nothing", [], 1)], "query_id string, query string, expect_docs array<string>, query_ord bigint")
    rows = optimize.candidates(docs, asked, Config(), (20, 60), (0, 10)).orderBy("place").collect()
    assert len(rows) == 4 and rows[0]["score"] >= rows[-1]["score"] and {r["documents"] for r in rows} == {6}
    for r in rows:
        one = Config(chunk_size=r["chunk_size"], chunk_overlap=r["chunk_overlap"])
        chunks = chunking.chunks(docs, one.chunk_size, one.chunk_overlap)
        ranked = retrieve.ranked(chunks, asked, one.top_k)
        row = diagnose.sim_summary(ranked, asked, one).first()
        assert r["chunks"] == chunks.count() and r["avg_top1_similarity"] == pytest.approx(row["avg_top1_similarity"]) and r["no_match_queries"] == row["no_match_queries"]
        assert r["expectation_failures"] == diagnose.expectation_outcomes(ranked, asked, one).where("status = 'FAIL'").count()
    assert optimize.grid_of((10, 20), (10,)) == ([(20, 10)], 1)


# -- the command line


def test_simulate_and_gates(run, tmp_path):
    docs, asked = EXAMPLES / "docs", EXAMPLES / "queries_structured.txt"
    code, out, _ = run("simulate", docs, "--queries", asked, "--json", "--artifacts-dir", tmp_path)
    report = json.loads(out)
    assert code == 0 and (report["documents"], report["chunks"], report["passes"], report["fails"]) == (8, 8, 5, 0)
    assert json.loads((tmp_path / "simulation.json").read_text()) == report and report["meta"]["command"] == "simulate"
    assert report["retrievals"][0]["ranked"][0]["rank"] == 1 and len(report["retrievals"][0]["ranked"]) == 5
    code, out, err = run("simulate", docs, "--queries", asked, "--fail-on-dominant", 0.1, "--json")
    assert code == 2 and json.loads(out) and err.startswith("Fail:")
    assert run("simulate", docs, "--queries", asked, "--fail-on-weak", 5)[0] == 0
    assert run("chunks", docs, "--fail-on-weak", 1)[0] == 1 and run("readiness", docs, "--fail-on-weak", 1)[0] == 1
    assert run("simulate", tmp_path / "none", "--queries", asked)[0] == 1


def test_corpus_commands(run, tmp_path):
    docs, asked = EXAMPLES / "docs", EXAMPLES / "queries_structured.txt"
    code, out, _ = run("readiness", docs, "--queries", asked, "--json")
    assert code == 0 and {"chunk_stats", "sim_summary", "coverage", "findings"} <= json.loads(out).keys()
    assert "TINY_CHUNK" in run("chunks", docs)[1]
    assert run("coverage", docs)[0] == 0 and json.loads(run("coverage", docs, "--queries", asked, "--json")[1])["coverage"]["queries"] == 5
    code, out, _ = run("explain", docs, "--query", "refund <b>", "--html-out", tmp_path / "e.html")
    assert code == 0 and "refund" in out and "refund &lt;b&gt;" in (tmp_path / "e.html").read_text()
    assert len(json.loads(run("compare-query", docs, "--query", "refund", "--json")[1])["ranked"]) == 5
    code, out, _ = run("optimize", docs, "--queries", asked, "--chunk-sizes", "50,100", "--chunk-overlaps", "10,60", "--write-config", tmp_path / "best.toml", "--json")
    report = json.loads(out)
    assert code == 0 and (report["considered"], report["skipped"]) == (3, 1) and Config.load(tmp_path / "best.toml").chunk_size == report["best"]["chunk_size"]
    assert "Try first" in run("fix", docs, "--queries", asked)[1]
    assert run("self-test", "--docs", docs, "--queries", asked)[0] == 0
    (tmp_path / "q.txt").write_text("a\trefund\tnowhere.md\n")
    assert run("self-test", "--docs", docs, "--queries", tmp_path / "q.txt")[0] == 2
    assert run("audit", docs, "--queries", asked, "--out", tmp_path / "both")[0] == 0 and {p.name for p in (tmp_path / "both").iterdir()} == {"readiness.json", "simulation.json"}


def test_run_commands(run, tmp_path):
    runs = EXAMPLES / "runs"
    code, out, _ = run("diff", "--baseline", runs / "calls_before.json", "--current", runs / "calls_after.json")
    assert code == 0 and "registry" in out and "Confidence: HIGH" in out
    report = json.loads(run("diff", "--baseline", runs / "calls_before.json", "--current", runs / "calls_before.json", "--format", "json")[1])
    assert report["root_cause"] == "no_meaningful_change"
    code, out, _ = run("eval", "--run", runs, "--rules", EXAMPLES / "rules.yaml", "--json", "--json-out", tmp_path / "eval.json")
    assert code == 0 and (json.loads(out)["passed_cases"], json.loads(out)["failed_cases"]) == (1, 1)
    code, out, _ = run("report", "--run", tmp_path / "eval.json", "--baseline", tmp_path / "eval.json", "--artifacts-dir", tmp_path / "art")
    assert code == 0 and out.startswith("## Summary") and "FORBIDDEN_PHRASE" in out and (tmp_path / "art/report.md").exists()
    assert "<html" in run("report", "--run", runs, "--rules", EXAMPLES / "rules.yaml", "--format", "html", "--html-out", tmp_path / "r.html")[1] and (tmp_path / "r.html").exists()
    assert run("report", "--run", runs / "calls_before.json")[0] == 1
    assert run("save-run", "--out", tmp_path / "s/run.json", "--question", "q", "--answer", "a", "--top-k", 3)[0] == 0
    assert json.loads((tmp_path / "s/run.json").read_text())["context"] == {"model": None, "top_k": 3}
    assert run("save-run", "--out", tmp_path / "x.json", "--question", " ", "--answer", "a")[0] == 1
    (tmp_path / "t.json").write_text(json.dumps({"question": "q", "answer": "a", "chunks": [{"text": "t"}]}))
    assert run("mcp-import", "--in", tmp_path / "t.json", "--out", tmp_path / "i.json")[0] == 0 and json.loads((tmp_path / "i.json").read_text())["retrieved_docs"][0]["id"] == "doc_1"


def test_audit_and_compare_commands(run, tmp_path):
    code, out, _ = run("answer-audit", "--data", EXAMPLES / "sales.csv", "--auto", "--answer", "US Direct growth", "--json")
    assert code == 0 and json.loads(out)["verdict"] == "SUPPORTED"
    assert run("answer-audit", "--data", EXAMPLES / "sales.csv", "--answer", "x")[0] == 1
    sides = []
    for name, weak in (("a", 1), ("b", 2)):
        sides.append(tmp_path / f"{name}.json")
        sides[-1].write_text(json.dumps({"sim_summary": summary(4, weak, 0, d=2)}))
    code, out, _ = run("compare-runs", *sides, "--format", "table")
    assert code == 0 and "REGRESSED" in out
    code, out, err = run("compare", *sides, "--fail-if-weak-increases", "--json")
    assert code == 3 and json.loads(out)["weak_after"] == 2 and "weak" in err
    assert run("compare-sim", *sides, "--fail-if-no-match-increases")[0] == 0
    assert render.score_of(None) == "n/a"
