"""Hard negatives against brute force, and the walk over the cells."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from alertflow.llm import hard_negatives
from alertflow.llm.hard_negatives import mine, multi_sequence, query_label

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    clean = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        clean.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))

    def first(found, k):
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    out = []
    for n, (i, label, a) in enumerate(clean):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, v)), j, other) for m, (j, other, v) in enumerate(clean) if m != n]
        for p, pid, _ in first([s for s in scored if s[2] == label], 5):
            hard = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, pid, r, s[1], p, s[0]) for r, s in enumerate(first(hard, 10), 1)]
    return sorted(out, key=repr)


def vectors(n, dim, seed, labels=4, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.4
    return [(i, [float(x) for x in v[i]], int(rng.integers(labels))) for i in range(n)]


def found(spark, rows, every=100, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.selectExpr("*", "1 AS q", "2 AS rid", "3 AS cell", "4 AS rank", "5 AS shard", "6 AS anchor")
    out = mine(df, F.col("vec_id") % every == 0, query_label())
    assert out.columns == [c.split()[0] for c in hard_negatives.RESULT.split(", ")]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_brute_force_with_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SEED_ROWS", 40)
    rows = vectors(900, 10, 1)
    rows += [(2000 + i, rows[11][1], i % 3) for i in range(60)]              # equal vectors, ties by id
    rows += [(300, rows[300][1], 1), (100, rows[100][1], rows[100][2])]      # repeated ids, anchors among them
    rows += [(None, rows[20][1], 2), (5000, None, 1), (5001, rows[0][1], None), (5002, [float("nan")] * 10, 1),
             (5003, [1.0, None] * 5, 1), (5004, [float("inf")] * 10, 1), (5100, [], 1), (5200, [0.0] * 10, 2),
             (5300, [1.0, 2.0], 3)]
    assert found(spark, rows, extra=True) == brute(rows)


@pytest.mark.parametrize("block", [2, 16_384])
def test_one_vector_holds_a_third_of_all_rows(spark, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    rows = vectors(400, 6, 2)
    rows += [(1000 + i, rows[9][1], i % 2) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_odd_dimension_large_components_and_few_rows(spark):
    rows = [(i * 50, [random.Random(i).uniform(-9000, 9000) for _ in range(3)], i % 2) for i in range(30)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(100, [1.0], 1)]) == []
    assert found(spark, [(100, [0.0], 1), (1, [0.0], 1), (2, [0.0], 3)]) == brute([(100, [0.0], 1), (1, [0.0], 1), (2, [0.0], 3)])


def test_components_beyond_64_bit_scores_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(100, [1e30], 1), (1, [1.0], 1)])


@pytest.mark.parametrize("n,m", [(1, 1), (1, 7), (5, 9)])
def test_walk_gives_every_cell_once_in_falling_order(n, m):
    rng = np.random.default_rng(n)
    u1, u2 = rng.integers(0, 4, n).astype(float), rng.normal(size=m)
    walk = list(multi_sequence(u1, u2))
    assert sorted((i, j) for i, j, _ in walk) == [(i, j) for i in range(n) for j in range(m)]
    assert all(b == u1[i] + u2[j] for i, j, b in walk)
    assert [b for *_, b in walk] == sorted((b for *_, b in walk), reverse=True)


def test_cells_out_of_reach_are_not_visited(monkeypatch):
    """Two far clusters: the walk of an anchor in one stops before the cells of the other."""
    dim, n = 8, 200
    rng = np.random.default_rng(3)
    q = np.rint(np.concatenate([rng.normal(1000, 5, (n, dim)), rng.normal(-1000, 5, (n, dim))]))
    codes = tuple(np.array([[1000.0] * 4, [-1000.0] * 4]) for _ in range(2))
    index = hard_negatives.Index(dim, codes, False, (np.array([40.0, 40.0]),) * 2)
    import pyarrow as pa
    at = np.repeat([0, hard_negatives.MAX_CODEWORDS + 1], n)
    shard = hard_negatives._Shard(index, pa.table({"cell": at, "q": q.astype(int).tolist(), "vec_id": np.arange(2 * n),
                                                   "rid": np.arange(2 * n), "label": np.zeros(2 * n, int)}))
    best, seen = hard_negatives._Best(5, None), []
    for bound, _, rows in shard.visit(index, q[0]):
        if not best.open_to(bound):
            break
        seen.append(rows)
        best.add(hard_negatives._scored(index, shard, rows, q[0]), shard.ids[rows])
    assert seen == [slice(0, n)]
