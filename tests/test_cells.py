"""Pruned search over cells: equal to all pairs, and cheaper on clustered data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake.operators import cells, vectors


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, m)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)


def brute(q, qids, d, dids, k, exclude_self):
    unit = lambda m: np.divide(m, np.sqrt((m * m).sum(1, keepdims=True)), out=np.zeros_like(m), where=(m * m).sum(1, keepdims=True) > 0)
    s = unit(q) @ unit(d).T
    out = set()
    for i, row in enumerate(s):
        key = np.rint(row * vectors.SCALE).astype(np.int64)
        order = [j for j in np.lexsort((dids, -key)) if not exclude_self or dids[j] != qids[i]][:k]
        out |= {(int(qids[i]), int(dids[j]), r + 1, round(float(row[j]), 6)) for r, j in enumerate(order)}
    return out


def rows_of(df):
    return {(r["query_id"], r["doc_id"], r["rank"], round(r["similarity"], 6)) for r in df.collect()}


def clustered(rng, n, dim, clusters, spread):
    centres = rng.standard_normal((clusters, dim))
    return centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("spread, group_rows", [(0.05, 40), (1.0, 40), (0.05, 10_000)])
def test_cells_equal_all_pairs(spark, spread, group_rows):
    rng = np.random.default_rng(3)
    m = clustered(rng, 700, 12, 9, spread)
    m[:60] = m[0]                                    # one vector on many rows: ties, and a cell of several groups
    m[60:64] = 0.0
    df = frame(spark, m)
    index = cells.build(df.withColumnRenamed("id", "doc_id"), cells=20, sample_rows=200)
    assert int(index.counts.sum()) == 700 and index.counts[-1] == 4
    got = vectors._ranked(cells.topk(df, index, 4, vectors.SCALE, "id", exclude_self=True, group_rows=group_rows, visits=50).drop("compared"), 4)
    assert rows_of(got) == brute(m, np.arange(700), m, np.arange(700), 4, True)


def test_cells_of_other_queries_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    m, q = rng.standard_normal((300, 5)), rng.standard_normal((40, 5))
    q[0] = 0
    index = vectors.prepare_index(frame(spark, [*m, None, None], [*range(300), 900, 901]), "id")
    asked = frame(spark, [*q, None], [*range(1000, 1040), 2000])
    assert rows_of(vectors.exact_topk(asked, index, 3, query_id="id")) == brute(q, np.arange(1000, 1040), m, np.arange(300), 3, False)
    few = vectors.prepare_index(frame(spark, m[:2]), "id")
    assert rows_of(vectors.exact_topk(asked, few, 5, query_id="id")) == brute(q, np.arange(1000, 1040), m[:2], np.arange(2), 5, False)
    none = vectors.prepare_index(frame(spark, m[:1]).limit(0), "id")
    assert vectors.exact_topk(asked, none, 5, query_id="id").collect() == []
    assert vectors.exact_topk(asked.limit(0), index, 5, query_id="id").collect() == []


def test_work_is_below_all_pairs_on_clustered_data(spark):
    rng = np.random.default_rng(5)
    n = 6000
    df = frame(spark, clustered(rng, n, 16, 60, 0.02))
    index = vectors.prepare_index(df, "id")
    work = cells.topk(df, index, 3, vectors.SCALE, "id", exclude_self=True).agg(F.sum("compared")).first()[0]
    assert work < 0.1 * n * n


def test_plan_moves_the_index_once_and_broadcasts_none(spark):
    df = spark.range(50).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("embedding"))
    index = vectors.prepare_index(df, "id")
    plan = cells.topk(df, index, 3, vectors.SCALE, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and plan.count("Exchange") == 1


def test_queries_that_prune_nothing_go_to_few_groups(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.standard_normal((3000, 32)))
    index = vectors.prepare_index(df, "id")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        # groups times copies: a query moves to about eight groups, not to 200
        assert cells.topk(df, index, 3, vectors.SCALE, "id", exclude_self=True).rdd.getNumPartitions() <= 90
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    g = cells.pack_cells(np.array([100, 100, 400]), 200)
    assert cells.copies_of(g, np.array([100, 100, 400]), np.array([10.0, 10.0, 10.0]), 9, 1000).tolist() == [3, 3, 3]
    assert cells.copies_of(g, np.array([100, 100, 400]), np.array([0.0, 9.0, 3000.0]), 1, 1000).tolist() == [1, 1, 3]


def test_comparing_a_batch_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(9)
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    q, x = unit(rng.standard_normal((512, 16))), unit(rng.standard_normal((40_000, 16)))
    x[100:4000] = x[0]
    best = cells.Best(q, np.arange(512), 3, True, vectors.SCALE)
    tracemalloc.start()
    best.add(np.arange(512), np.arange(40_000), x, x.astype(np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20                          # all pairs at once in double precision: 164 MB an array
    got = {(i, j, r, round(s, 6)) for i, j, s, _, r in zip(*(a.tolist() for a in best.rows()))}
    assert got == brute(q, np.arange(512), x, np.arange(40_000), 3, True)


def test_a_large_cell_is_several_groups():
    g = cells.pack_cells(np.array([5, 3, 40, 0, 9, 2, 8]), 10)
    assert g.first.tolist() == [0, 0, 1, 5, 5, 6, 6] and g.parts.tolist() == [1, 1, 4, 1, 1, 1, 1] and g.count == 7
    who, group = cells._visits(np.array([[1, 0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1]], bool), g)
    assert list(zip(who.tolist(), group.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 6)]


def test_bounds_hold():
    rng = np.random.default_rng(7)
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    m, q = unit(rng.standard_normal((500, 6))), unit(rng.standard_normal((50, 6)))
    centres = cells.learn_centres(m, 12)
    own = (m @ centres.T).argmax(1)
    angle = np.arccos(np.clip((m * centres[own]).sum(1), -1, 1))
    radii = np.array([angle[own == c].max(initial=0) for c in range(12)] + [0.0])
    b = cells.bounds(q, centres, radii)
    sims = q @ m.T
    for c in range(12):
        if (own == c).any():
            assert (sims[:, own == c].max(1) <= b[:, c] + cells.SLACK).all()
