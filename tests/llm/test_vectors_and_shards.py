import math
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.llm import hard_negatives as hn
from tabprobe.llm import sharding, whitening
from tabprobe.llm.queries import op12_sharding, op13_hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int, x string, block string, n string"
ODD = [(None, [1.0, 2.0, 3.0], 1), (900, None, 1), (901, [1.0, None, 2.0], 1),
       (902, [float("nan"), 1.0, 1.0], 2), (903, [float("inf"), 1.0, 1.0], 2), (904, [], 1),
       (905, [1.0, 2.0], 1), (906, [1.0, 2.0, 3.0], None)]


@pytest.fixture(scope="session")
def vectors(spark):
    """A table of vectors from (vec_id, embedding, label), with columns of clashing names."""

    def make(rows, parts=3):
        return spark.createDataFrame(
            [(*r, "x", "y", "z") for r in rows], VECTORS).repartition(parts)

    return make


def drawn(n, dims, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(dims) * (1 + np.arange(dims))).tolist(),
             int(rng.integers(labels))) for i in range(n)]


# ---- whitening

def fitted(rows):
    x = np.floor(64 * np.array([np.float32(r[1]) for r in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    around = (x * n - sums) / n
    values, axes = np.linalg.eigh(around.T @ around / n)
    return x, n, sums, around, values[::-1], axes[:, ::-1]


def test_whitened_vectors_are_those_of_the_covariance(vectors):
    rows = drawn(400, 7)
    rows += [(5, rows[5][1], 0), (5, rows[5][1], 0)]
    odd = [(None, rows[0][1], 1), *[r for r in ODD if r[0] is not None and r[0] < 906]]
    found = whitening.whitened(vectors([*rows, *odd]), components=5).collect()
    taken = [*rows, odd[0]]
    x, n, sums, around, values, axes = fitted(taken)
    assert len(found) == len(taken) and all(r.n == n for r in found)
    signs = None
    want = {r[0]: (around[i] @ axes[:, :5] / np.sqrt(values[:5]), i) for i, r in enumerate(taken)}
    for r in sorted(found, key=lambda r: (r.vec_id is None, r.vec_id)):
        expected, i = want[r.vec_id]
        got = np.array(r.whitened)
        signs = np.sign(got * expected) if signs is None else signs
        assert got == pytest.approx(signs * expected, abs=1e-9)
        assert r.deviation == Decimal(int(((n * x[i] - sums) ** 2).sum()))
        assert r.explained == pytest.approx((values / values.sum())[:5], rel=1e-10)
        assert r.identity_error < 1e-12
    assert Counter(r.vec_id for r in found)[5] == 3


def test_dependent_and_constant_dimensions_are_no_components(vectors):
    rng = np.random.default_rng(3)
    base = rng.integers(-500, 500, (60, 2)) / 64
    rows = [(i, [a, b, a + b, 2.0, a - b], 0) for i, (a, b) in enumerate(base.tolist())]
    found = whitening.whitened(vectors(rows)).collect()
    assert {len(r.whitened) for r in found} == {2} and found[0].identity_error < 1e-12
    w = np.array([r.whitened for r in found])
    assert np.abs(w.T @ w / 60 - np.eye(2)).max() < 1e-12
    assert sum(found[0].explained) == pytest.approx(1)
    few = whitening.whitened(vectors(drawn(4, 6))).collect()
    assert {len(r.whitened) for r in few} == {3}


def test_nearly_dependent_dimensions_stay_orthogonal(vectors):
    rng = np.random.default_rng(4)
    a = rng.integers(-3_000_000, 3_000_000, 200)
    rows = [(i, [v / 64.0, (v + (i % 3)) / 64.0, float(i)], 0) for i, v in enumerate(a.tolist())]
    found = whitening.whitened(vectors(rows)).collect()
    assert {len(r.whitened) for r in found} == {3} and found[0].identity_error < 1e-4


def test_equal_vectors_one_vector_and_none(vectors):
    same = whitening.whitened(vectors([(i, [1.0, 2.0], 0) for i in range(9)])).collect()
    assert len(same) == 9 and all(
        r.whitened == [] and r.deviation == 0 and r.identity_error == 0 for r in same)
    assert whitening.whitened(vectors([(1, [3.5, -2.0], 0)])).first().whitened == []
    assert whitening.whitened(vectors([])).count() == 0
    assert whitening.whitened(vectors(ODD[1:6])).count() == 0


def test_deviations_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for most, n in ((100, 50), (1 << 40, 1 << 14), (1 << 40, 1 << 30)):
        x = rng.integers(-most, most, (20, 130))
        sums = tuple(int(s) * (n // 20) for s in x.sum(axis=0).astype(object))
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, n, sums) == want


def test_components_beyond_the_limit_count_as_that(vectors):
    found = whitening.whitened(vectors([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0)])).collect()
    assert len(found) == 2 and all(len(r.whitened) == 1 for r in found)


# ---- sharding

def placed(rows, shards):
    """Checks that slots have no gaps and sizes differ by one at most."""
    of = {}
    for r in rows:
        of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in of.values())
    sizes = [len(of.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)


def test_every_row_gets_one_place(documents):
    rows = [(i, "t" * (i % 7), "en", "s") for i in range(500)]
    rows += [(None, None), (None, None), (3, "", None, "s"), (7, "long " * 40_000)]
    rows += [(600, "copy", "en", "s")] * 400
    docs = documents(rows, parts=9).withColumn("shard", F.lit("mine")).withColumn(
        "slot", F.lit(-1)).withColumn("part", F.lit("p")).withColumn("at", F.lit("q"))
    out = sharding.sharded(docs, shards=7, part_rows=20)
    assert set(out.columns) == set(docs.columns)
    found = out.collect()
    placed(found, 7)
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    assert {r.part for r in found} == {"p"} and {r["at"] for r in found} == {"q"}
    joined = sharding.sharded(docs, shards=7, most_cells=0).collect()
    placed(joined, 7)
    again = sharding.sharded(docs, shards=7, part_rows=20).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 1), (3, 5), (24, 3), (25, 1)])
def test_few_rows(documents, n, parts):
    docs = documents([(i, "x") for i in range(n)], parts)
    placed(sharding.sharded(docs, shards=24).collect(), 24)


def test_matrix_sums_to_partitions_and_shards(spark):
    sizes = [0, 1, 1000, 7, 333, 2, 90, 5000, 12, 41, 6, 77, 3]
    counts = spark.createDataFrame(list(enumerate(sizes)), "part long, n long")
    rows = {r.part: r.of_shard for r in sharding.communication_matrix(counts, 24, 3).collect()}
    assert {p: sum(c) for p, c in rows.items()} == dict(enumerate(sizes))
    total = sum(sizes)
    assert [sum(c) for c in zip(*rows.values())] == [(total + 23 - s) // 24 for s in range(24)]
    assert all(c >= 0 for of in rows.values() for c in of)


def chi_squared(seen, chance, draws):
    """Squared deviations over expectations, summed where at least five are expected."""
    return sum((seen.get(x, 0) - draws * p) ** 2 / (draws * p)
               for x, p in chance.items() if draws * p >= 5)


@pytest.mark.parametrize("n, m, k", [(50, 20, 11), (400, 390, 13), (900, 30, 450), (7, 7, 3)])
def test_draws_follow_the_hypergeometric_law(spark, n, m, k):
    draws = 20_000
    one = sharding.hypergeometric(F.lit(n), F.lit(m), F.lit(k), sharding.uniform(n, F.col("id")))
    seen = {r.x: r["count"] for r in spark.range(draws).select(one.alias("x")).groupBy("x")
            .count().collect()}
    chance = {x: math.comb(m, x) * math.comb(n - m, k - x) / math.comb(n, k)
              for x in range(max(0, k + m - n), min(k, m) + 1)}
    assert set(seen) <= set(chance)
    cells = sum(draws * p >= 5 for p in chance.values())
    assert chi_squared(seen, chance, draws) < cells + 5 * math.sqrt(2 * cells) + 5


def test_shards_are_uniform_samples_in_uniform_order(documents):
    """Neighbours by id fall into the same shard, and into order in it, as often as by chance."""
    docs = documents([(i, "x") for i in range(6_000)], parts=6)
    found = sorted(sharding.sharded(docs, shards=4).select("doc_id", "shard", "slot").collect())
    together = sum(a.shard == b.shard for a, b in zip(found, found[1:]))
    assert abs(together - 5_999 / 4) < 5 * math.sqrt(5_999 * 3 / 16)
    rising = [a.slot < b.slot for a, b in zip(found, found[1:]) if a.shard == b.shard]
    assert abs(sum(rising) - len(rising) / 2) < 5 * math.sqrt(len(rising) / 4)
    other = sorted(sharding.sharded(docs, shards=4, seed=99).select("doc_id", "shard").collect())
    assert abs(sum(a.shard == b.shard for a, b in zip(found, other)) - 1_500) < 170


def test_sharded_documents_of_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = op12_sharding(spark, sf_dir)
    rows = found.collect()
    placed(rows, 24)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    import zlib
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                   for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_written_shards_hold_their_rows_in_order(spark, documents, tmp_path):
    docs = documents([(i, "x") for i in range(100)])
    out = sharding.sharded(docs, shards=3)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    placed(back.collect(), 3)
    one = spark.read.parquet(str(tmp_path / "shards" / "shard=1")).coalesce(1)
    slots = [r.slot for r in one.collect()]
    assert sorted(slots) == list(range(len(slots)))


# ---- hard negatives

@pytest.mark.parametrize("m, k, n, leaf", [
    (1, 1, 1, 1), (7, 5, 3, 1), (16, 16, 16, 2), (33, 65, 129, 4), (100, 64, 90, 16), (5, 0, 4, 1)])
def test_products_are_exact(m, k, n, leaf):
    rng = np.random.default_rng(m)
    a, b = (rng.integers(-(1 << 24), 1 << 24, s) for s in ((m, k), (k, n)))
    assert (hn.strassen(a, b, leaf) == a @ b).all()


def test_shares_are_rounded_towards_the_window():
    for score in [*range(-250, 251), 1 << 61, (1 << 61) + 17, -(1 << 61) - 3]:
        one = np.array([score])
        assert hn.share_of(one, 50, True)[0] == -((-50 * score) // 100)
        assert hn.share_of(one, 95, False)[0] == 95 * score // 100


def test_merged_heaps_are_those_of_all_candidates():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 6, (4, 60)), np.sort(rng.integers(0, 40, 60))
    whole, left, right = (hn.Heaps(4, 5) for _ in range(3))
    whole.offer(slice(0, 4), scores, ids)
    left.offer(slice(0, 4), scores[:, :23], ids[:23])
    right.offer(slice(0, 4), scores[:, 23:], ids[23:])
    left.merge(slice(0, 4), right.scores, right.ids)
    assert (left.scores == whole.scores).all() and (left.ids == whole.ids).all()
    for row in range(4):
        best = sorted(zip(-scores[row], ids))[:5]
        assert list(zip(-whole.scores[row], whole.ids[row])) == best


def mined(rows, every):
    """The same by plain loops."""
    dims = 3
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows
            if i is not None and label is not None and v is not None and len(v) == dims
            and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for i, x, label in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, x)), (label, x))
    out = []
    for a, (own, x) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, label)
                        for i, y, label in good if i != a)
        positives = [(s, i) for s, i, label in scored if label == own][:5]
        for place, (s, positive) in enumerate(positives, 1):
            window = [(t, i) for t, i, label in scored if label != own
                      and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, place, positive, rank, i, -s, -t)
                    for rank, (t, i) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"candidates": 40, "anchors": 3}])
def test_mined_rows_are_those_of_plain_loops(vectors, sizes):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-4, 9, 3) / 8).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(20, [1.0, 1.0, 0.5], 2), (41, rows[41][1], rows[41][2])]
    rows += [(400 + i, [0.5, 0.5, 0.5], i % 3) for i in range(120)]
    rows += [*ODD, (910, [0.0, 0.0, 0.0], 1), (920, [0.5, 0.5, 0.5], 77), (930, [1.0, 1.0], 1)]
    found = hn.hard_negatives(vectors(rows), F.col("vec_id") % 10 == 0, **sizes).collect()
    assert sorted(map(tuple, found)) == mined(rows, 10)


def test_one_label_no_positives_and_no_rows(vectors):
    alike = [(i, [1.0, 1.0, 1.0], 1) for i in range(20)]
    assert hn.hard_negatives(vectors(alike), F.col("vec_id") % 5 == 0).count() == 0
    apart = [(i, [1.0, 1.0, 1.0], i) for i in range(20)]
    assert hn.hard_negatives(vectors(apart), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.hard_negatives(vectors([]), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.hard_negatives(vectors(drawn(9, 3)), F.lit(False)).count() == 0
    assert hn.hard_negatives(vectors(ODD[:6]), F.lit(True)).count() == 0
    large = [(i, [3e38 * (-1) ** i, 1.0, 1.0], i % 2) for i in range(6)]
    assert hn.hard_negatives(vectors(large), F.lit(True)).count() == 0


def test_mined_rows_of_the_given_table(spark, sf_dir):
    assert op13_hard_negatives(spark, sf_dir).count() > 0
