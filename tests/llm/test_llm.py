"""The training-data operators against brute force, exact round trips and held-out accuracy, and their odd cases."""

from __future__ import annotations

import bisect
import gzip
import itertools
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from corvane.llm import queries as llm_queries
from corvane.llm import classifier, decontam, langid, licenses, neardup, packing, records, rules, shared, urlfilter, warc

SMALL = "/root/testdata/sf0.001"
WORDS = "river stone cloud market garden winter signal copper harbor meadow lantern orchard valley thunder pepper velvet marble candle forest bridge".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], SCHEMA)


ODD = [(1, None, "en"), (2, "", "en"), (3, "one", None), (4, "one", "en"), (4, "one", "en"), (None, "alone here", "fr"), (5, "word " * 60_000, "en"), (6, "x" * 300_000, "en"), (7, "\n\t ", "en"), (8, "ÉÀ ß İstanbul", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns whose names clash with those that the operators use inside.
    clash = ("sig", "node", "key", "piece", "length", "bucket", "n", "word", "hash", "j", "f", "_gone", "predicted", "probability", "keep")
    return table(spark, ODD).select("*", *[F.lit(1).alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .\né", max_size=30), max_size=8))
def test_words_are_hashed_by_content_alone(texts):
    column = pa.array(texts, pa.large_string())
    if not texts:
        return
    hashes, first = shared.hashed(column, 0, len(texts))
    flat = [w for t in texts for w in re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", t)]
    assert len(flat) == len(hashes) == first[-1]
    assert len(set(flat)) == len(set(hashes.tolist()))
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat))


def test_long_texts_hash_as_short_ones_do():
    text = "alpha beta " * 300_000
    hashes, first = shared.hashed(pa.array([text], pa.large_string()), 0, 1)
    assert len(hashes) == 600_000 and len(set(hashes.tolist())) == 2 and first.tolist() == [0, 600_000]
    whole, _ = shared.hashed(pa.array(["alpha beta"], pa.large_string()), 0, 1)
    assert set(whole.tolist()) == set(hashes.tolist())


# -- 1: licences


def reference_value(text):
    """A recursive-descent evaluation, to hold the shunting-yard one against."""
    items = re.findall(r"[()]|[A-Za-z0-9.+:_-]+", text)
    at = 0

    def either():
        nonlocal at
        value = both()
        while at < len(items) and items[at].lower() == "or":
            at += 1
            value = max(value, both())
        return value

    def both():
        nonlocal at
        value = one()
        while at < len(items) and items[at].lower() == "and":
            at += 1
            value = min(value, one())
        return value

    def one():
        nonlocal at
        if items[at] == "(":
            at += 1
            value = either()
            at += 1
        else:
            value = licenses.DEFAULT.level(items[at])
            at += 1
        if at < len(items) and items[at].lower() == "with":
            known = items[at + 1].lower() in licenses.DEFAULT.exceptions
            at += 2
            value = max(value, licenses.REVIEW) if known else value
        return value

    return either()


leaf = st.sampled_from(["MIT", "Apache-2.0", "GPL-3.0-only", "MPL-2.0", "Made-Up-1.0", "GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Other-exception"])
tree = st.recursive(leaf, lambda x: st.tuples(x, st.sampled_from([" AND ", " or ", " OR "]), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})" if len(t[0]) % 2 else f"{t[0]}{t[1]}{t[2]}"), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_shunting_yard_agrees_with_recursive_descent(text):
    assert licenses.evaluate(text)[0] == reference_value(text)


@pytest.mark.parametrize("bad", ["MIT AND", "(MIT", "MIT)", "AND MIT", "MIT Apache-2.0", "", "()", "MIT ; x"])
def test_what_cannot_be_parsed_is_for_review(bad):
    assert licenses.evaluate(bad) == (licenses.REVIEW, ())


def test_scan_of_one_text():
    assert licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 */\ncode") == (["Apache-2.0", "GPL-3.0-only", "MIT"], ["(MIT OR GPL-3.0-only) AND Apache-2.0"], 0, "allow")
    assert licenses.scan("under the GNU General Public\n  License,  version 3.")[0] == ["GPL-3.0-only"]
    assert licenses.scan("Licensed under CC BY-NC 4.0. Released under the MIT License.")[2:] == (2, "deny")
    assert licenses.scan("submit license")[3] == "none" and licenses.scan(None)[3] == "none"


def test_every_tag_of_a_text_counts():
    tag = "SPDX-License-Identifier:"
    assert licenses.scan(f"{tag} MIT */ ... {tag} GPL-3.0-only */") == (["GPL-3.0-only", "MIT"], ["MIT", "GPL-3.0-only"], 0, "deny")
    assert licenses.scan(f"{tag} MIT {tag} Apache-2.0 License-Expression: GPL-2.0-only\nx")[::3] == (["Apache-2.0", "GPL-2.0-only", "MIT"], "deny")
    assert licenses.scan(f"İİ {tag}  MIT OR\tISC */ ẞ {tag} ISC")[1] == ["MIT OR ISC", "ISC"]
    assert licenses.scan(f"{tag} GPL-3.0-only. int main() {{ return 0 }}")[::3] == (["GPL-3.0-only"], "deny")
    assert licenses.scan(f"{tag} MIT int main() {{ return 0 }}") == (["MIT"], ["MIT"], 0, "review")
    assert licenses.scan(f" * {tag}\n *  MIT OR ISC\n")[1:] == (["MIT OR ISC"], 0, "allow")
    assert licenses.scan(f"{tag}\nimport os")[::3] == ([], "review") and licenses.scan(tag)[1] == [""]


def test_bare_ids_count_in_context_alone():
    assert licenses.scan("It is licensed under the\n BSD-3-Clause, see below.") == (["BSD-3-Clause"], ["BSD-3-Clause"], 0, "allow")
    assert licenses.scan('{"license": "GPL-2.0-only OR MIT"}')[0::3] == (["GPL-2.0-only", "MIT"], "allow")
    assert licenses.scan("licensed under the terms of the MIT")[3] == "none" and licenses.scan("MIT GPL-3.0-only Zlib")[3] == "none"
    assert licenses.scan("Available under the Apache License, Version 2.0")[0::3] == (["Apache-2.0"], "allow")


@pytest.mark.parametrize(("text", "licence"), [
    ("This notice may not be removed; the origin of this software must not be misrepresented", "Zlib"), ("under the SIL Open Font License, Version 1.1", "OFL-1.1"), ("Common Development and Distribution License", "CDDL-1.0"),
    ("Server Side Public License", "SSPL-1.0"), ("Business Source License 1.1", "BUSL-1.1"), ("Python Software Foundation License", "PSF-2.0"), ("WTFPL", "WTFPL"), ("Mozilla Public License Version 1.1 (the", "MPL-1.1"),
])
def test_notices(text, licence):
    assert licenses.scan(text)[0] == [licence]


def test_a_vocabulary_of_ones_own(spark):
    own = licenses.Vocabulary({"House-1.0": licenses.ALLOW, "Other": licenses.DENY}, ["House-exception"], {"The  House Licence": "House-1.0"})
    rows = table(spark, [(1, "under the house licence", "en"), (2, "SPDX-License-Identifier: Other WITH House-exception", "en"), (3, "MIT License", "en")])
    assert {r["doc_id"]: (r["licences"], r["verdict"]) for r in licenses.scanned(rows, known=own).collect()} == {1: (["House-1.0"], "allow"), 2: (["Other"], "review"), 3: ([], "none")}


def test_licences_of_a_table_agree_with_plain_search(spark, docs, odd, empty):
    found = {r["doc_id"]: r for r in licenses.scanned(docs).collect()}
    for row in docs.collect():
        flat = " ".join(row["text"].lower().split())
        hit = any(re.search(rf"(?<!\w){re.escape(p)}(?!\w)", flat) for p in licenses.DEFAULT.notices) or any(t in flat for t in licenses.TAGS)
        assert (found[row["doc_id"]]["verdict"] != "none") == hit
    assert licenses.scanned(odd).count() == len(ODD) and licenses.scanned(empty).count() == 0


# -- 2: near duplicates


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute_pairs(frame):
    matrix = np.stack([np.frombuffer(x, np.uint16) for x in frame.sig])
    ids = frame.doc_id.tolist()
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in itertools.combinations(range(len(ids)), 2) if (matrix[i] != matrix[j]).sum() <= neardup.DISTANCE}


def near_copies(rng, n_groups=6, copies=12):
    rows, i = [], 0
    for _ in range(n_groups):
        base = prose(rng, 150).split()
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(999))
            rows.append((i, " ".join(words), "en"))
            i += 1
    return rows + [(i + k, prose(rng, rng.randrange(1, 200)), "en") for k in range(60)]


@pytest.fixture(scope="module")
def copies(spark):
    return table(spark, near_copies(random.Random(5))).cache()


def test_all_pairs_within_the_distance_are_found_once(spark, copies, docs):
    for frame in (copies, docs):
        sigs = neardup.signatures(frame)
        found = [(r["a"], r["b"]) for r in neardup.near_pairs(sigs).collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute_pairs(sigs.toPandas())


def test_groups_are_the_components_of_all_pairs(spark, copies, docs):
    for frame in (copies, docs, copies.repartition(7)):
        sigs = neardup.signatures(frame).toPandas()
        expected = {n: r for n, r in groups_of(brute_pairs(sigs), sigs.doc_id.tolist()).items() if n != r}
        assert {r["doc_id"]: r["duplicate_of"] for r in neardup.near_duplicates(frame).collect()} == expected


@pytest.mark.parametrize("most", [2, 5, 16])
def test_hot_keys_lose_no_link(spark, most):
    """Keys of copies, of unlike texts with a passage in common, and of both, far above what a task may hold."""
    rng = random.Random(12)
    passage = prose(rng, 120)
    rows = near_copies(rng, 2, 40) + [(1000 + i, passage + " " + prose(rng, rng.choice([20, 60, 120])), "en") for i in range(60)]
    frame = table(spark, rows)
    sigs = neardup.signatures(frame).toPandas()
    keys = Counter(k for x in sigs.sig for k in neardup.chunk_keys(np.frombuffer(x, np.uint16)[None, :])[0].tolist())
    assert sum(n > most for n in keys.values()) > 50
    expected = {n: r for n, r in groups_of(brute_pairs(sigs), sigs.doc_id.tolist()).items() if n != r}
    assert {r["doc_id"]: r["duplicate_of"] for r in neardup.near_duplicates(frame, most=most).collect()} == expected


def test_near_duplicates_by_jaccard(spark, docs):
    """Recall of pairs by true similarity, well within the distance, and no pair of unlike texts."""
    shingles = {r["doc_id"]: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for r in docs.collect() if (w := tokens(r["text"]))}
    found = {(r["a"], r["b"]) for r in neardup.near_pairs(neardup.signatures(docs)).collect()}
    alike = {(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if (n := len(shingles[a] & shingles[b])) and n / len(shingles[a] | shingles[b]) >= 0.65}
    assert len(found & alike) >= 0.9 * len(alike)
    assert all(len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) > 0.3 for a, b in found)


def test_forest_and_least_connect_what_pairs_do():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (40, neardup.HASHES)).astype(np.uint16)
    sig[20:] = sig[:20]
    sig[20:, :14] = 9
    pairs = [(i, j) for i, j in itertools.combinations(range(40), 2) if (sig[i] != sig[j]).sum() <= neardup.DISTANCE]
    assert groups_of(neardup.forest(sig), range(40)) == groups_of(pairs, range(40))
    a, b = np.array(pairs).T
    assert neardup.least(a, b, 40).tolist() == list(groups_of(pairs, range(40)).values())


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint").repartition(8)
    assert {(r["node"], r["root"]) for r in neardup.components(edges).collect()} == {(i, 0) for i in range(n + 1)}


def test_near_duplicates_of_odd_rows(odd, empty):
    assert {(r["doc_id"], r["duplicate_of"]) for r in neardup.near_duplicates(odd).collect()} == {(4, 3)}
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.deduplicate(odd).count() == len(ODD) - 2 and neardup.deduplicate(odd).columns == odd.columns


def test_deduplication_goes_by_row(spark):
    a, b = prose(random.Random(5), 60), prose(random.Random(6), 60)
    c, d = prose(random.Random(7), 60), prose(random.Random(8), 60)
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "en"), (None, b, "en"), (None, b, "en"), (7, c, "en"), (7, a, "en"), (None, c, "en"), (8, d, "en"), (None, None, "en"), (None, None, "en")]
    for sent in (neardup.SENT_ROWS, 0):
        got = neardup.deduplicate(table(spark, rows), sent_rows=sent).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == {(1, a): 1, (None, b): 1, (7, c): 1, (8, d): 1, (None, None): 2}


# -- 3: decontamination


def longest_spans(doc, item):
    """Maximal equal runs of SPAN words or more, by brute force."""
    runs = []
    for d in range(-len(item), len(doc)):
        start = None
        for p in range(max(0, d), min(len(doc), len(item) + d) + 1):
            if p < min(len(doc), len(item) + d) and doc[p] == item[p - d]:
                start = p if start is None else start
            else:
                if start is not None and p - start >= decontam.SPAN:
                    runs.append((p - start, start))
                start = None
    return runs


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_spans_against_brute_force(spark, limit):
    rng = random.Random(11)
    items = [prose(rng, rng.randrange(5, 60)) for _ in range(12)] + ["same " * 20, None]
    rows = []
    for i in range(40):
        words = prose(rng, rng.randrange(5, 120)).split()
        item = (items[rng.randrange(12)]).upper().split()
        cut = rng.randrange(0, len(item))
        words[10:10] = item[cut : cut + rng.randrange(3, 40)]
        rows.append((i, ", ".join(words), "en"))
    rows += [(40, "same " * 30, "en"), (41, None, "en"), (42, "", "en")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["spans"], r["longest"], r["start"]) for r in decontam.shared_spans(table(spark, rows), bench, broadcast_bytes=limit).collect()}
    expected = {}
    for (i, text, _), (k, item) in itertools.product(rows, enumerate(items)):
        if runs := longest_spans(tokens(text), tokens(item)):
            best = max(runs, key=lambda x: (x[0], -x[1]))
            expected[i, k] = (len(runs), *best)
    assert got == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=decontam.SPAN, max_size=60), st.lists(st.integers(0, 3), min_size=decontam.SPAN, max_size=60))
def test_texts_that_share_a_span_share_a_fingerprint(a, b):
    def prints(x):
        h, first = shared.hashed(pa.array([" ".join(map(str, x))], pa.large_string()), 0, 1)
        return set(decontam.winnowed(h, first)[0].tolist())

    spans = lambda x: {tuple(x[i : i + decontam.SPAN]) for i in range(len(x) - decontam.SPAN + 1)}
    if spans(a) & spans(b):
        assert prints(a) & prints(b)


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word " * 20), (2, None), (3, "")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.shared_spans(odd, bench).collect()} == {(5, 1)}
    for limit in (0, 1 << 20):
        kept = decontam.decontaminate(odd, bench, broadcast_bytes=limit)
        assert kept.count() == len(ODD) - 1 and kept.columns == odd.columns
    for limit in (0, 1 << 20):
        assert decontam.shared_spans(empty, bench, broadcast_bytes=limit).count() == 0
        assert decontam.shared_spans(odd, bench.limit(0), broadcast_bytes=limit).count() == 0


def test_decontamination_goes_by_row_either_way(spark):
    bench = spark.createDataFrame([(1, "word " * 20)], "item_id bigint, text string")
    leak = "word " * 30
    rows = [(None, leak, "en"), (None, "clean here", "en"), (4, leak, "en"), (4, "clean too", "en"), (4, "clean too", "en"), (5, leak, "en"), (6, None, "en"), (None, None, "en")]
    for limit in (0, 1 << 20):
        got = decontam.decontaminate(table(spark, rows), bench, broadcast_bytes=limit).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == {(None, "clean here"): 1, (4, "clean too"): 2, (6, None): 1, (None, None): 1}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.integers(0, 5)), min_size=1, max_size=25))
def test_filters_of_repeated_and_null_ids_against_brute_force(spark, picked):
    """Decontamination and deduplication go by row, in every branch."""
    rng = random.Random(21)
    base = prose(rng, 60)
    texts = [base, base + " more", prose(rng, 60), "word " * 30, None, ""]
    rows = [(i, texts[k], "en") for i, k in picked]
    frame = table(spark, rows)
    bench = spark.createDataFrame([(1, "word " * 20)], "item_id bigint, text string")
    clean = Counter((i, t) for i, t, _ in rows if t != texts[3])
    for limit in (0, decontam.BROADCAST_BYTES):
        assert Counter((r["doc_id"], r["text"]) for r in decontam.decontaminate(frame, bench, broadcast_bytes=limit).collect()) == clean
    groups = {t: k for k, group in enumerate(([texts[0], texts[1]], [texts[2]], [texts[3]])) for t in group}
    ids = {}
    for i, t, _ in rows:
        if t in groups:
            ids.setdefault(groups[t], []).append((i is None, i or 0))
    for sent in (0, neardup.SENT_ROWS):
        got = neardup.deduplicate(frame, sent_rows=sent).collect()
        kept = [(groups[r["text"]], (r["doc_id"] is None, r["doc_id"] or 0)) for r in got if r["text"] in groups]
        assert sorted(kept) == sorted((g, min(x)) for g, x in ids.items())
        assert Counter(r["text"] for r in got if r["text"] not in groups) == Counter(t for _, t, _ in rows if t not in groups)


# -- 4: classifier


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.scored(docs.repartition(8), labels.where("doc_id % 2 <> 0")).toPandas().merge(labels.toPandas(), on="doc_id").merge(docs.select("doc_id", "n_chars").toPandas(), on="doc_id")
    return got[got.doc_id % 2 == 0]


def test_held_out_accuracy_and_calibration(held_out):
    good = held_out[held_out.quality == 1]
    assert (held_out.keep == (held_out.quality == 1)).mean() > 0.95
    assert good.keep.mean() > 0.99
    loss = -np.log(np.where(held_out.quality == 1, held_out.probability, 1 - held_out.probability).clip(1e-6)).mean()
    assert loss < 0.15


def test_bad_documents_kept_by_length(held_out):
    """Short texts say too little; the shares kept fall with length."""
    bad = held_out[held_out.quality == 0]
    for low, high, most in ((250, 500, 0.6), (500, 1000, 0.3), (1000, 10**9, 0.1)):
        assert bad[(bad.n_chars >= low) & (bad.n_chars < high)].keep.mean() <= most


def test_word_vectors_against_a_plain_loop(spark):
    rng = random.Random(8)
    texts = ["a b ## a", "", "b", None, "c a", *(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(30))) for _ in range(40))]
    words, total, rare = classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    sums, counts = {}, Counter()
    for text in texts:
        h, _ = shared.hashed(shared.as_texts(pa.array([text], pa.string())), 0, 1, symbols=True)
        index = classifier._index(h)
        for i, token in enumerate(h.view(np.int64).tolist()):
            counts[token] += 1
            for j in range(max(0, i - classifier.REACH), min(len(h), i + classifier.REACH + 1)):
                for place, sign in index:
                    sums.setdefault(token, np.zeros(classifier.DIM))[place[j]] += sign[j]
    got = {r["token"]: (r["n"], r["u"]) for r in words.collect()}
    unit = lambda v: np.round(v / max(np.linalg.norm(v), 1e-9) * 32767)
    assert total == sum(counts.values()) and got.keys() == {t for t, n in counts.items() if n >= classifier.MIN_COUNT}
    for token, (n, u) in got.items():
        assert n == counts[token] and (np.array(u) == unit(sums[token])).all()
    assert (rare == unit(sum(v for t, v in sums.items() if counts[t] < classifier.MIN_COUNT))).all()


def test_probabilities_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + (" river stone" if i % 2 else " $$ ## !!"), "en") for i in range(40)] + [(90, "", "en"), (91, "never seen before", "en")]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = classifier.trained(docs, labels)
    net, counts = model.net, {r["token"]: (r["n"], np.array(r["u"])) for r in model.words.collect()}

    def vector(token):
        n, u = counts.get(token, (0, model.rare))
        w = classifier.RARE / (classifier.RARE + n / model.total)
        return np.array([*np.round(u * w), 0 if token in counts else 32767, round(w * 32767)]) / 32767

    hashes = {i: shared.hashed(shared.as_texts(pa.array([t])), 0, 1, symbols=True)[0].view(np.int64).tolist() for i, t, _ in rows}
    every = sum(vector(t) for h in hashes.values() for t in h)
    got = {r["doc_id"]: r["probability"] for r in classifier.scored(docs, labels).collect()}
    for i, h in hashes.items():
        total = sum((vector(t) for t in h), classifier.PRIOR * every / every[-1])
        x = total[:-1] / total[-1]
        x = (np.append(x, np.linalg.norm(x[: classifier.DIM])) - net.mean) / net.scale
        logit = np.maximum(x @ net.w1 + net.b1, 0) @ net.w2 + net.b2
        assert got[i] == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)) if h else 0, abs=1e-6)


def test_sums_passed_on_in_parts_are_the_same(monkeypatch):
    """More tokens than a task adds up at once: run the task's own loop with a small limit."""
    rng = random.Random(1)
    texts = pa.array([prose(rng, 200) for _ in range(30)])
    whole = classifier._added(*map(np.concatenate, zip(*classifier.contexts(texts), strict=True)))
    monkeypatch.setattr(classifier, "_TOGETHER", 80)
    batches = (pa.RecordBatch.from_pydict({"text": texts.slice(i, 3)}) for i in range(0, 30, 3))
    parts = [classifier._sums_of(x) for x in classifier.collected(batches)]
    assert sum(len(x[0]) for x in parts) > len(whole[0])
    again = classifier._added(*(np.concatenate(x) for x in zip(*((t.view(np.uint64), n, v) for t, n, v in parts), strict=True)))
    assert all((a == b).all() for a, b in zip(again, whole, strict=True))


@pytest.mark.parametrize("held", [0, 7, 200])
def test_a_vocabulary_that_is_not_held_whole_gives_the_same(spark, docs, odd, held):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    both = docs.unionByName(odd.select(docs.columns))
    whole = {(r["doc_id"], r["probability"], r["keep"]) for r in classifier.scored(both, labels).collect()}
    assert {(r["doc_id"], r["probability"], r["keep"]) for r in classifier.scored(both, labels, held=held).collect()} == whole
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert rows(classifier.passing(both, labels, held=held)) == rows(classifier.passing(both, labels))


def test_classifier_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (4, 1), (99, 1)], "doc_id bigint, quality int")
    got = classifier.scored(odd, labels).collect()
    assert len(got) == len(ODD) and all((r["probability"] == 0) == (r["doc_id"] in (1, 2, 7)) for r in got)
    assert classifier.scored(empty, labels).count() == 0
    assert classifier.scored(odd, labels.limit(0)).where("keep").count() == len(ODD) - 3
    assert classifier.scored(odd, labels.where("quality = 0")).where("keep").count() == 0
    assert classifier.scored(odd, labels.where("doc_id = 3")).where("keep").count() == len(ODD) - 3
    assert classifier.passing(odd, labels).columns == odd.columns


def test_the_sample_is_of_given_documents_once_each(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 40) if i % 2 else "$$ ## !! " * 20, "en") for i in range(60)] + [(i, " \n", "en") for i in range(1000, 1400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id bigint, quality int")
    net = classifier.trained(table(spark, rows), labels, max_labelled=50).net
    assert net is not None
    again = classifier.trained(table(spark, rows * 3).repartition(3), labels, max_labelled=50).net
    other = classifier.trained(table(spark, rows * 3), labels, max_labelled=50).net
    assert (again.w1 == other.w1).all() and again.temperature == other.temperature


# -- 5: archive


def test_the_query_stores_its_archive(spark):
    before = {p.name for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("archive-*")}
    got = __spark_entry__.queries()["op5_warc"](spark, SMALL)
    (path,) = [p for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("archive-*") if p.name not in before]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert spark.read.parquet(f"{path}/payloads").count() == pages.select(F.coalesce("html", F.lit(""))).distinct().count()
    assert got.where("verified").count() == pages.count()


def test_archive_round_trip(spark, tmp_path):
    rng = random.Random(2)
    parts = []
    for i in range(30):
        body = (prose(rng, 50) if i % 3 else "shared body é").encode() + bytes(rng.randrange(256) for _ in range(20 if i % 3 else 0))
        extra = "" if i % 2 else f"WARC-Payload-Digest: sha256:{__import__('hashlib').sha256(body).hexdigest()}\r\n"
        parts.append(f"WARC/1.1\r\nWARC-Type: resource\r\nX-Odd:   {i}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + warc.CLOSE)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(b"".join(parts[:15]))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[15:]))
    read = warc.read_records(spark, str(tmp_path / "in"))
    warc.write_archive(read, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/payloads")).count() == 21
    for hot in (warc.HOT, 2):
        back = warc.read_archive(spark, str(tmp_path / "out"), hot).collect()
        assert sorted(bytes(r["record"]) for r in back) == sorted(parts) and all(r["verified"] for r in back)
    assert len({r["record_id"] for r in back}) == 30


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=5), st.integers(1, 50), st.booleans())
def test_records_come_out_of_blocks_of_any_size(bodies, size, zipped):
    parts = [(f"WARC/1.1\r\nContent-Length: {len(x)}\r\n\r\n".encode(), x) for x in bodies]
    content = b"".join(gzip.compress(h + x + warc.CLOSE) if zipped else h + x + warc.CLOSE for h, x in parts)
    assert list(warc.split_records(content[i : i + max(size, 2)] for i in range(0, len(content), max(size, 2)))) == parts


def test_archive_of_nothing_of_long_payloads_and_of_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, "v", "")], "page_id bigint, url string, html string")
    pages = pages.select("*", *[F.lit(1).alias(c) for c in ("digest", "header", "payload", "n", "salt", "parts", "record_id")])
    for frame, n in ((pages, 3), (pages.limit(0), 0)):
        records_of = warc.records_of(frame)
        warc.write_archive(records_of, str(tmp_path / str(n)))
        got = warc.read_archive(spark, str(tmp_path / str(n)), 1).collect()
        assert len(got) == n and all(r["verified"] for r in got)
        assert {(r["record_id"], bytes(r["record"])) for r in got} == {(r["record_id"], bytes(r["header"] + r["payload"]) + warc.CLOSE) for r in records_of.collect()}


def test_archive_of_odd_rows(spark):
    false = b"WARC/1.1\r\nWARC-Payload-Digest: sha256:" + b"0" * 64 + b"\r\nContent-Length: 1\r\n\r\n"
    rows = spark.createDataFrame([(1, None, None), (2, false, b"x"), (2, false, b"x"), (None, b"h", b"")], "record_id bigint, header binary, payload binary")
    got = sorted(((r["record_id"] or 0, bytes(r["record"]), r["verified"]) for r in warc.rebuild(warc.headers(rows), warc.payloads(rows)).collect()), key=str)
    assert got == sorted([(0, b"h" + warc.CLOSE, True), (1, warc.CLOSE, True), (2, false + b"x" + warc.CLOSE, False), (2, false + b"x" + warc.CLOSE, False)], key=str)
    pages = spark.createDataFrame([(1, None, None), (None, "u", "h")], "page_id bigint, url string, html string")
    assert warc.records_of(pages).count() == 2
    # A page whose stored digest isn't that of its body.
    wrong = warc.records_of(pages).withColumn("payload", F.when(F.col("record_id") == 1, F.lit(b"other")).otherwise(F.col("payload")))
    assert {r["record_id"]: r["verified"] for r in warc.rebuild(warc.headers(wrong), warc.payloads(wrong)).collect()} == {1: False, None: True}
    with pytest.raises(ValueError):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


# -- 6: quality rules


def test_distance_against_the_definition():
    rng = np.random.default_rng(1)
    p, q = rng.integers(0, 9, (20, 5)), rng.integers(1, 9, (20, 5))
    p[:, 0] += 1
    for a, b, d in zip(p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True), rules.distance(p, q), strict=True):
        kl = lambda x, y: sum(i * np.log2(i / j) for i, j in zip(x, y, strict=True) if i)
        assert d == pytest.approx(np.sqrt((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2))


def test_rules_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["keep"], r["n_words"]) for r in rules.judged(odd).collect()}
    assert {(1, False, 0), (2, False, 0), (7, False, 0), (3, True, 1), (None, True, 2), (8, True, 3)} <= got
    assert rules.judged(empty).count() == 0 and rules.passing(odd).columns == odd.columns
    assert rules.judged(odd.where("text IS NULL")).collect()[0]["keep"] is False


def test_rules_with_given_references_held_or_joined(spark, docs, odd):
    both = docs.unionByName(odd.select(docs.columns))
    known = rules.references(docs)
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(rules.judged(docs, known=known)) == rows(rules.judged(docs))
    held = rules.judged(both, known=known)
    assert rows(rules.judged(both, known=known, held=0)) == rows(held)
    assert rows(rules.judged(odd, held=0)) == rows(rules.judged(odd))
    # The null language isn't in these references: nothing to hold it against.
    assert held.where("doc_id = 3 AND keep AND class_distance IS NULL").count() == 1
    for frame in (both, odd):
        assert rows(rules.passing(frame, known=known, held=0)) == rows(rules.passing(frame, known=known))
    assert rules.passing(odd, held=0).columns == odd.columns
    assert rules.judged(both, known=known.limit(0)).where("class_distance IS NOT NULL").count() == 0


def test_rules_take_a_dirty_language_column(spark):
    rows = [(i, f"some words of {i} " * 80, f"x{i}") for i in range(3000)]
    got = rules.judged(table(spark, rows)).collect()
    assert len(got) == 3000 and all(r["keep"] and r["class_distance"] == r["word_distance"] == 0 for r in got)


def test_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judged(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.5


# -- 7: packing


def best_fit(lengths, capacity):
    free, bins = [], []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, (length, -1))
        room, b = free.pop(at) if at < len(free) else (capacity, len(bins))
        if b == len(bins):
            bins.append(0)
        bins[b] += length
        if room > length:
            bisect.insort(free, (room - length, b))
    return Counter(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_fills_bins_as_best_fit_over_documents_does(lengths):
    slots = Counter()
    filled = Counter()
    taken = set()
    for length, first, after, bin0, offset, a_bin in packing.plan(dict(Counter(lengths)), 50):
        for rank in range(first, after):
            b, at = bin0 + (rank - first) // a_bin, offset + (rank - first) % a_bin * length
            slots[length] += 1
            filled[b] += length
            for place in range(at, at + length):
                assert place < 50 and (b, place) not in taken
                taken.add((b, place))
    assert slots == Counter(lengths)
    assert Counter(filled.values()) == best_fit(lengths, 50)


def test_packing_of_a_table(spark, docs):
    got = packing.packed(docs, capacity=128).toPandas().sort_values(["bin_id", "position"])
    sizes = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    assert got.groupby("doc_id").length.sum().to_dict() == {k: v for k, v in sizes.items() if v}
    assert not got.duplicated(["doc_id", "piece"]).any()
    end = (got.position + got.length).groupby(got.bin_id).shift().fillna(0)
    assert (got.position == end).all() and got.groupby("bin_id").length.sum().max() <= 128
    assert Counter(got.groupby("bin_id").length.sum()) == best_fit(got.length.tolist(), 128)


def test_packing_of_odd_rows(odd, empty):
    got = packing.packed(odd).toPandas()
    assert sorted(got.doc_id.fillna(-1).tolist()) == sorted([3, 4, 4, -1, 6, 8] + [5] * 30) and not got.duplicated(["bin_id", "position"]).any()
    assert packing.packed(empty).count() == 0


# -- 8: language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    got = langid.identified(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).join(docs, "doc_id").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.lang).mean() > 0.95
    assert (got[got.n_chars > 500].predicted == got[got.n_chars > 500].lang).mean() > 0.99


def plain_sizes(text: str, content: dict[str, bytes], level: int = langid.LEVEL) -> dict[str, int]:
    low = text.lower().encode()
    out = {}
    for lang, data in content.items():
        known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False)
        out[lang] = sum(len(made.compress(low[at : at + langid.SEGMENT])) for at in range(0, len(low), langid.SEGMENT))
    return out


def test_the_query_against_plain_zstandard(spark, docs):
    content = langid.dictionaries(docs, folds=2)
    fold = {r["doc_id"]: r["k"] for r in docs.select("doc_id", langid.fold_of(F.col("text"), 2).alias("k")).collect()}
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    # Whole documents of the other fold alone, within the bound.
    for k, known in enumerate(content):
        for lang, data in known.items():
            parts = {t.lower() for i, (t, g) in texts.items() if fold[i] != k and g == lang}
            assert len(data) <= langid.DICTIONARY_BYTES and any(data.startswith(x.encode() + b"\n") for x in parts)
            assert not any(t.encode() + b"\n" in data for t in {t.lower() for i, (t, _) in texts.items() if fold[i] == k and len(t) > 200})
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op8_language_id"](spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, (text, _) in texts.items():
        if not tokens(text):
            assert (got[i]["predicted"], got[i]["size"]) == ("und", None)
            continue
        (best, lang), (second, _) = sorted((n, g) for g, n in plain_sizes(text, content[fold[i]]).items())[:2]
        margin = (second - best) / second
        assert got[i]["size"] == best and got[i]["margin"] == pytest.approx(round(margin, 4))
        assert got[i]["predicted"] == (lang if margin > langid.MARGIN else "und")


def test_language_ties_margins_and_lengths():
    rng = random.Random(3)
    one, other = prose(rng, 400).encode(), "zwölf boxkämpfer jagen viktor quer über den großen sylter deich ".encode() * 60
    judge = lambda content, *texts: langid.Languages(content).judge(pa.array(texts))
    tie = judge({"a": one, "b": one}, "river stone cloud", None, "!!")
    assert tie["predicted"].to_pylist() == ["und"] * 3 and tie["margin"].to_pylist() == [0.0, None, None]
    assert judge({"a": one, "b": other}, prose(rng, 300), "quer über den großen sylter deich jagen")["predicted"].to_pylist() == ["a", "b"]
    assert judge({"a": one}, "anything")["predicted"].to_pylist() == ["a"] and judge({}, "anything")["predicted"].to_pylist() == ["und"]
    # One level at every length: a text is compressed as the sum of its segments.
    text = "a lantern in the harbor " * 3000
    for n in (1023, 1024, 1025, len(text)):
        assert judge({"a": one, "b": other}, text[:n])["size"].to_pylist() == [min(plain_sizes(text[:n], {"a": one, "b": other}).values())]


def test_labels_of_any_number_and_length(spark):
    rows = [(i, f"text number {i} of a dirty label", f"x{i}") for i in range(300)] + [(1000 + i, prose(random.Random(i), 50), "en") for i in range(30)] + [(2000, "lang " * 30_000, "long")] * 2
    (content,) = langid.dictionaries(table(spark, rows), languages=5)
    assert len(content) == 5 and {"en", "long"} < content.keys() and len(content["long"]) == 150_001
    got = langid.identified(table(spark, rows)).collect()
    assert len(got) == len(rows)


def test_language_of_odd_rows(odd, empty, docs):
    got = {r["doc_id"]: r for r in langid.identified(odd, docs).collect()}
    assert got[1]["predicted"] == got[2]["predicted"] == got[7]["predicted"] == "und" and got[1]["size"] is None
    assert langid.identified(empty, docs).count() == 0 and langid.identified(odd, empty).where("predicted <> 'und'").count() == 0


# -- 9: URLs


@pytest.mark.parametrize("size", [urlfilter.FILTER_BYTES, 0])
def test_url_filter_is_exact(spark, size):
    rng = random.Random(4)
    made = lambda i: f"http{'s' * rng.randrange(2)}://{'www.' * rng.randrange(2)}Host{i % 50}.example/p/{i}{rng.choice(['', '/', '/index.html', '?utm_source=x', '#top', '?b=2&a=1', '?a=1&b=2'])}"
    listed = spark.createDataFrame([(made(i),) for i in range(0, 3000, 3)] + [(None,), ("no url",)], "url string")
    pages = spark.createDataFrame([(i, made(i)) for i in range(3000)] + [(-1, None), (-2, "nothing"), (3, "http://host3.example/p/3")], "page_id bigint, url string").select("*", F.lit(1).alias("key"), F.lit(2).alias("block"))
    got = urlfilter.filtered(pages, listed, filter_bytes=size).collect()
    known = {r["c"] for r in listed.select(urlfilter.canonical(F.col("url")).alias("c")).collect()} - {None}
    assert len(got) == 3003 and all(r["blocked"] == (r["canonical"] in known) for r in got)
    assert urlfilter.filtered(pages, listed.limit(0), filter_bytes=size).where("blocked").count() == 0
    assert urlfilter.filtered(pages.limit(0), listed, filter_bytes=size).count() == 0


def test_the_bloom_filter_passes_little_else(spark):
    keys = spark.range(5000).select(F.concat(F.lit("a.example/"), "id").alias("key"))
    held = urlfilter.blocks(keys, 5000)
    others = spark.range(20000).select(F.concat(F.lit("b.example/"), "id").alias("key"))
    number = -(-5000 // urlfilter.A_BLOCK)
    test = lambda rows: rows.withColumn("p", F.pmod(F.xxhash64("key"), F.lit(number))).join(held, F.col("p") == F.col("block")).where(" AND ".join(f"getbit(w{j}, CAST(shiftrightunsigned(xxhash64(7, key), {6 * j}) & 63 AS INT)) = 1" for j in range(8))).count()
    assert test(keys) == 5000 and test(others) < 100


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_list_of_the_query_holds_something_on_any_draw(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    listed = pages.where(F.col("url").rlike(llm_queries.LISTED)).count()
    assert 0 < listed < 0.2 * pages.count()


def test_canonical_forms(spark):
    forms = {"HTTP://User@WWW.Ex.com:80/A/?utm_source=q&b=2&a=1#f": "ex.com/A?a=1&b=2", "https://ex.com:8443/index.html": "ex.com:8443", "//ex.com": "ex.com", "ex.com/a": None, "https://ex.com/x?ref=y": "ex.com/x", "http://[2001:DB8::1]:8080/a/": "[2001:db8::1]:8080/a", "http://e.com/" + "a" * 300_000: "e.com/" + "a" * 300_000}
    got = spark.createDataFrame([(u,) for u in forms], "u string").select("u", urlfilter.canonical(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == forms


# -- 10: records


def slow_crc(data: bytes) -> int:
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    assert slow_crc(b"123456789") == 0xE3069283
    rng = random.Random(9)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 8, 9, 255, 256, 257, 511, 1024, 3001)]
    framed, offsets, sizes, sums = records.frame(parts)
    for part, offset, size, total in zip(parts, offsets, sizes, sums, strict=True):
        crc = slow_crc(part)
        assert int(total) == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
        assert records.unframe(framed[offset : offset + size]) == part
    broken = bytearray(framed)
    broken[int(offsets[-1]) + 20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(broken[int(offsets[-1]) :]))


def test_records_round_trip_in_any_order(spark, docs, tmp_path):
    index = records.write_records(docs.repartition(3), str(tmp_path))
    tokens_of = records.encoding(records.TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = records.read_records(spark, str(tmp_path), index.orderBy(F.xxhash64("doc_id"))).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in index.orderBy(F.xxhash64("doc_id")).collect()]
    assert len(got) == len(texts)
    for row in got:
        assert row["tokens"] == [*tokens_of.encode_ordinary(texts[row["doc_id"]]), records.END]
        assert tokens_of.decode(row["tokens"][:-1]) == texts[row["doc_id"]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "\x1c", "1", "!", "é", ""]), st.sampled_from(" \n\t\u00a0\u3000\x85"), st.integers(990, 1010), st.booleans()), max_size=4), st.sampled_from(["", "word", " x", "\n"]))
def test_long_white_space_gives_the_tokens_of_the_pattern(parts, last):
    text = "".join(word + space * n + " " * more for word, space, n, more in parts) + last
    assert records.tokens_of(text, records.TOKENIZER).tolist() == records.encoding(records.TOKENIZER).encode_ordinary(text)


def test_records_of_very_long_runs(spark, tmp_path):
    texts = [" " * 10_000_000, "\n" * 10_000_000 + "end", "ab" * 5_000_000]
    index = records.write_records(table(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3), str(tmp_path))
    known = records.encoding(records.TOKENIZER)
    for row in index.collect():
        framed = (tmp_path / row["shard"]).read_bytes()[row["offset"] : row["offset"] + row["n_bytes"]]
        assert known.decode(np.frombuffer(records.unframe(framed), "<u2")[:-1].tolist()) == texts[row["doc_id"]]


def test_shards_that_the_index_does_not_name_go(spark, docs, tmp_path):
    records.write_records(docs.repartition(5), str(tmp_path))
    (tmp_path / ".shard-000001.rec.draft").write_bytes(b"left by a lost task")
    index = records.write_records(docs.repartition(2), str(tmp_path))
    left = {p.name for p in tmp_path.iterdir() if p.is_file() and "shard" in p.name and not p.name.endswith(".crc")}
    assert left == {r["shard"] for r in index.select("shard").distinct().collect()} and len(left) == 2
    assert records.read_records(spark, str(tmp_path)).count() == docs.count()


def test_records_of_odd_rows(spark, odd, empty, tmp_path):
    index = records.write_records(odd, str(tmp_path / "odd"))
    got = records.read_records(spark, str(tmp_path / "odd"), index).collect()
    assert len(got) == len(ODD) and all(r["tokens"] == [records.END] for r in got if r["doc_id"] in (1, 2))
    assert records.write_records(empty, str(tmp_path / "none")).count() == 0


# -- queries and the pipeline


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(i) for i in range(1, 11)} and "pipeline" in names


def test_pipeline_against_the_stages_done_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tokens(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = {r["doc_id"] for r in rules.judged(docs).where("keep").collect()}
    kept = docs.where(F.col("doc_id").isin(*judged))
    scored = {r["doc_id"] for r in classifier.scored(kept, spark.read.parquet(f"{SMALL}/labels.parquet")).where("keep").collect()}
    left = kept.where(F.col("doc_id").isin(*scored))
    sigs = neardup.signatures(left).toPandas()
    roots = groups_of(brute_pairs(sigs), sigs.doc_id.tolist())
    spans = lambda w: {tuple(w[i : i + decontam.SPAN]) for i in range(len(w) - decontam.SPAN + 1)}
    leaks = set().union(*map(spans, bench))
    final = {i for i in scored if roots.get(i, i) == i and not spans(tokens(texts[i])) & leaks}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(got.doc_id) == {i for i in final if texts[i].split()}
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(texts[i].split()) for i in final if texts[i].split()}
    assert Counter(got.groupby("bin_id").length.sum()) == best_fit(got.length.tolist(), packing.CAPACITY)


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty):
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    every = Counter((i, t) for i, t, _ in ODD)
    judged = {r["doc_id"] for r in rules.judged(odd).where("keep").collect()}
    scored = {r["doc_id"] for r in classifier.scored(odd, labels).where("keep").collect()}
    assert not judged & {1, 2, 7} and not scored & {1, 2, 7}
    expected = {
        "quality_rules": Counter({x: n for x, n in every.items() if x[0] in judged}),
        "quality_classifier": Counter({x: n for x, n in every.items() if x[0] in scored}),
        # (3, "one") stays for its two copies.
        "near_dedup": Counter({x: n for x, n in every.items() if x[0] != 4}),
        "decontamination": every,
    }
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, SMALL), stage(spark, empty, SMALL)
        assert none.count() == 0
        if name == "best_fit_packing":
            assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {3: 1, 4: 2, None: 2, 5: 60_000, 6: 1, 8: 3}
            continue
        assert out.columns == odd.columns and none.columns == empty.columns
        assert rows(out) == expected[name]
