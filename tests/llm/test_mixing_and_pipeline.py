import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabprobe.llm.mixing import mixed
from tabprobe.llm.queries import WEIGHTS, domain, tokenizer


def shared_out(budget, family):
    """Budgets of siblings {name: (weight, room)}: shares of weight, what is left over anew."""
    given = {name: 0.0 for name in family}
    open_ = {n for n, (w, _) in family.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        weight = sum(family[n][0] for n in open_)
        full = {n for n in open_ if family[n][1] - given[n] <= left * family[n][0] / weight}
        if not full:
            for n in open_:
                given[n] += left * family[n][0] / weight
            break
        for n in full:
            left -= family[n][1] - given[n]
            given[n] = family[n][1]
        open_ -= full
    return given


def copies_of(rows, weights, total, epochs, seed):
    """rows: (doc_id, domain, language, branch, tokens)."""
    room = defaultdict(float)
    for _, d, g, b, n in rows:
        for path in ((d,), (d, g), (d, g, b)):
            room[path] += n * epochs
    budget = {(): float(total)}
    for depth in (1, 2, 3):
        for above in [p for p in budget if len(p) == depth - 1]:
            own = {p: (weights.get(p, 1.0), room[p]) for p in room
                   if len(p) == depth and p[:-1] == above}
            budget |= shared_out(budget[above], own)
    out = {}
    for leaf in {r[1:4] for r in rows}:
        docs = [r for r in rows if r[1:4] == leaf]
        supply, b = sum(r[4] for r in docs), int(np.floor(budget[leaf] + 1e-6))
        whole = min(b // supply, epochs) if supply else 1
        rest = 0 if whole >= epochs else b - whole * supply
        done = 0
        for r in sorted(docs, key=lambda r: hashlib.md5(f"{seed}:{whole}:{r[0]}".encode())
                        .hexdigest()):
            done += r[4]
            out[r[0]] = whole + int(rest > 0 and done <= rest)
    return out


@pytest.mark.parametrize("share,epochs,weights", [
    (1.0, 2, WEIGHTS), (0.3, 1, {}), (5.0, 3, {("web",): 0.0}), (1.4, 4, {("web", "en"): 9.0}),
    (0.0, 2, {}),
])
def test_copies_follow_the_budgets(spark, sf_dir, share, epochs, weights):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))
    ).withColumn("tokens", F.lit("x")).withColumn("copies", F.lit("y"))
    got = mixed(docs, domain(), share=share, weights=weights, epochs=epochs).collect()
    rows = [(r.doc_id, r.domain, r.language, r.branch, r.tokens) for r in got]
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r[4] == len((texts[r[0]] or "").encode().split()) for r in rows)
    total = share * sum(r[4] for r in rows)
    want = copies_of(rows, weights, total, epochs, 17)
    assert {r.doc_id: r.copies for r in got} == want


def test_odd_rows(documents):
    rows = [(1, None, None, None), (2, "", "en", "src1"), (3, "a b c", "en", "src1"),
            (3, "a b c", "en", "src1"), (None, "x y", "fr", "src9"), (5, "w " * 30_000, "fr", "z")]
    got = mixed(documents(rows), domain(), share=1.0).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.domain, r.language, r.branch) for r in got if r.doc_id in (1, 5)} == {
        (1, "none", "none", "none"), (5, "none", "fr", "z")}
    assert {r.copies for r in got if r.doc_id == 1} == {1}
    assert mixed(documents([]), domain()).count() == 0


def test_stages_one_by_one(spark, documents, prose, sf_dir):
    texts = {}
    rows = []
    for number, (i, t) in enumerate(prose):
        rows.append((number, t, ("xx", None)[number % 2], f"src{number % 20}"))
        texts[number] = t
    docs = documents(rows)
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5) and "Jaccard" in names[2]
    steps = [f for _, f in corpus_pipeline.STAGES]

    first = steps[0](spark, docs, sf_dir)
    assert first.columns == columns
    kept = {r.doc_id for r in first.collect()}
    assert kept == {n for n, t in texts.items() if t and any(c.isalpha() for c in t)}

    second = steps[1](spark, first.cache(), sf_dir)
    assert second.columns == columns
    groups = defaultdict(list)
    for n in kept:
        groups["".join(c.lower() if c.isascii() else c for c in texts[n])].append(n)
    kept = {max(g) for g in groups.values()}
    assert {r.doc_id for r in second.collect()} == kept

    third = steps[2](spark, second.cache(), sf_dir)
    assert third.columns == columns
    sets = {}
    for n in kept:
        words = texts[n].encode().lower().split()
        sets[n] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    low = {n: n for n in kept}
    changed = True
    while changed:
        changed = False
        for a in sorted(kept):
            for b in sorted(kept):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) \
                        and low[b] > low[a]:
                    low[b], changed = low[a], True
    kept = {n for n in kept if low[n] == n}
    assert {r.doc_id for r in third.collect()} == kept

    fourth = steps[3](spark, third.cache(), sf_dir)
    assert fourth.columns == columns
    taken = [r.doc_id for r in fourth.collect()]
    assert set(taken) <= kept and len(taken) > len(kept) // 2

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = steps[4](spark, fourth.cache(), sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(len(whole.encode(texts[n]).ids) + 1 for n in taken)


def test_the_whole_pipeline(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    total = defaultdict(int)
    for r in pieces:
        total[r.sequence_id] += r.length
    assert pieces and max(total.values()) <= 2048


def test_an_empty_corpus(spark, documents, sf_dir):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out


def test_children_of_weight_zero_are_no_room(spark):
    from tabprobe.llm.mixing import budgets

    leaves = spark.createDataFrame(
        [("web", "en", "a", 900), ("web", "de", "b", 100), ("books", "en", "c", 1000),
         ("books", "fr", "d", 400)], "domain string, language string, branch string, tokens long")
    weights = {("web",): 5.0, ("books",): 1.0, ("web", "en"): 0.0, ("books", "fr", "d"): 0.0}
    got = {r.branch: r.budget for r in budgets(leaves, 1000, weights, 2).collect()}
    assert got == {"a": 0, "b": 200, "c": 800, "d": 0}
