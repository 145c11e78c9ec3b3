import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabprobe.llm import vector_search
from tabprobe.llm.components import components
from tabprobe.llm.ngram_join import prefix_size, similar_groups
from tabprobe.llm.substring_dedup import without_repeats
from tabprobe.llm.vector_search import nearest


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def smallest_reachable(nodes, links):
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("percent", [75, 40])
def test_similar_groups(documents, prose, percent):
    got = {(r.doc_id, r.n_shingles, r.component_id)
           for r in similar_groups(documents(prose), percent=percent).collect()}
    sets = {i: shingles(t) for i, t in prose if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert links
    low = smallest_reachable(sets, links)
    assert got == {(i, len(sets[i]) if i is not None else 1, low.get(i)) for i, _ in prose}


def test_a_large_group_of_near_copies_and_a_frequent_line(documents):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    line = "this very line is found in nearly all of the documents here"
    rows = []
    for i in range(200):
        own = list(base)
        own[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(200, 400):
        rows.append((i, " ".join(f"u{rng.randrange(5000)}" for _ in range(12)) + " " + line))
    got = {r.doc_id: r.component_id for r in similar_groups(documents(rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in range(a + 1, 400)
             if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == smallest_reachable(sets, links)


@given(st.integers(1, 500), st.integers(1, 100))
def test_prefix_leaves_fewer_columns_than_the_bound_needs(n, percent):
    p = int(prefix_size(np.array([n]), percent)[0])
    assert n - p < math.ceil(n * percent / 100) and p >= 1


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == smallest_reachable(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def without(texts, length):
    count = Counter()
    for t in texts:
        count.update(t[i:i + length] for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = [i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        yield len(t), bytes(b for b, g in zip(t, gone) if not g), len(spans)


@pytest.mark.parametrize("length", [400, 40])
def test_without_repeats(documents, prose, length):
    rows = [r for r in prose if r[0] != 109]
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((i, *w) for (i, _), w in zip(rows, without(texts, length)))
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans))
                  for r in without_repeats(documents(rows), length).collect())
    assert got == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8), st.integers(2, 12))
def test_without_repeats_of_few_letters(documents, texts, length):
    rows = list(enumerate(texts))
    want = Counter((i, *w) for i, w in enumerate(without([t.encode() for t in texts], length)))
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans))
                  for r in without_repeats(documents(rows, 2), length, 3).collect())
    assert got == want


def test_hot_anchors_are_compared_string_by_string(documents, prose, monkeypatch):
    from tabprobe.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", 4)
    rows = [r for r in prose if r[0] != 109]
    for length in (400, 40):
        want = Counter((i, *w) for (i, _), w in zip(
            rows, without([(t or "").encode() for _, t in rows], length)))
        got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans))
                      for r in without_repeats(documents(rows), length).collect())
        assert got == want


def test_parts_of_a_long_text_agree(documents, monkeypatch):
    from tabprobe.llm import substring_dedup

    rng = random.Random(3)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(1, text), (2, "zz" + text[900:2400]), (3, text[:50])]
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 700)
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(substring_dedup.parts_of(np.array([0, 3000]), 100))
    assert len(parts) > 2
    whole = substring_dedup.Anchors(data, np.array([0, 3000]), [(0, 0, 3000)], 100)
    cut = [substring_dedup.Anchors(data, np.array([0, 3000]), p, 100) for p in parts]
    assert set(whole.at) == {x for c in cut for x in c.at + c.shift}
    want = Counter((i, *w) for (i, _), w in zip(rows, without([t.encode() for _, t in rows], 100)))
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans))
                  for r in without_repeats(documents(rows), 100).collect())
    assert got == want


def test_empty_tables(documents, spark):
    assert similar_groups(documents([])).count() == 0
    assert without_repeats(documents([])).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nearest(none, F.col("vec_id") % 2 == 0).count() == 0


def exact(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i)
                   for i, v in vectors.items() if i != q)
        out[q] = d[:k]
    return out


def test_nearest_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 500)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    points = rng.standard_normal((1500, 16)).astype(np.float32).astype(float)
    points[10:40] = points[0]
    vectors = dict(enumerate(points.tolist()))
    bad = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] + [1.0] * 15),
           (9300, [None] + [1.0] * 15), (9400, [1.0, 2.0]), (9500, [float("inf")] + [1.0] * 15),
           (None, [1.0] * 16)]
    table = spark.createDataFrame([*vectors.items(), *bad],
                                  "vec_id long, embedding array<float>").withColumn(
        "rank", F.lit("x")).withColumn("score", F.lit("y"))
    rows = nearest(table, F.col("vec_id") % 100 == 0, 10, most_sample=400).collect()
    want = exact(vectors, range(0, 1500, 100), 10)
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    assert set(found) == set(want)
    hits = sum(len(set(found[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert found[0] == [(0.0, i) for i in range(10, 20)]
    assert all(f == sorted(f) for f in found.values())


def test_nearest_with_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [5.0, 6.0]), (2, [-3.0, 1.0])],
                                  "vec_id long, embedding array<double>")
    rows = nearest(table, F.col("vec_id") == 0, 10).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in rows] == [(1, 2), (2, 1)]
    alone = nearest(table.filter("vec_id = 0"), F.col("vec_id") == 0, 10)
    assert alone.count() == 0


def test_recall_on_the_given_vectors(spark, sf_dir):
    from tabprobe.llm.queries import op4_vector_search

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in table}
    want = exact(vectors, [i for i in vectors if i % 100 == 0], 10)
    rows = op4_vector_search(spark, sf_dir).collect()
    hits = sum((r.score, r.vec_id) in want[r.query_id] for r in rows)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_query_digests(spark, sf_dir):
    from tabprobe.llm.queries import op5_suffix_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = [(d.text or "").encode() for d in docs]
    want = {(d.doc_id, n, n - len(k), s, hashlib.sha256(k).hexdigest())
            for d, (n, k, s) in zip(docs, without(texts, 400))}
    assert {tuple(r) for r in op5_suffix_dedup(spark, sf_dir).collect()} == want
