"""Exact top-k: every execution strategy gives the same ranked rows."""

from pyspark.sql import functions as F

from supportlake.operators import vectors
from supportlake.sources.tables import table


def test_strategies_agree(spark, sf_small):
    e = table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    out = {}
    for strategy in ("broadcast_index", "broadcast_queries", "blocked"):
        t = vectors.exact_topk(e, e, 3, query_id="vec_id", doc_id="vec_id", exclude_self=True, strategy=strategy)
        out[strategy] = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in t.collect())
    assert out["broadcast_index"] == out["broadcast_queries"] == out["blocked"]
    n = e.count()
    assert len(out["blocked"]) == 3 * n
    assert all(q != d for q, _, d in out["blocked"])


def test_ties_break_by_doc_id_and_threshold_after_topk(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    d = spark.createDataFrame([(10, [1.0, 0.0]), (5, [2.0, 0.0]), (7, [0.0, 1.0]), (3, [0.6, 0.8])],
                              "doc_id long, embedding array<double>")
    t = vectors.exact_topk(q, d, 3)
    got = [(r["doc_id"], r["rank"]) for r in t.orderBy("rank").collect()]
    assert got == [(5, 1), (10, 2), (3, 3)]
    kept = vectors.apply_threshold(t, 0.7).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [5, 10]


def test_blocked_grid_with_many_cells(spark, sf_small, monkeypatch):
    """Force ~20-row blocks so queries and index span many grid cells."""
    e = table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    ref = vectors.exact_topk(e, e, 2, query_id="vec_id", doc_id="vec_id", exclude_self=True, strategy="broadcast_index")
    monkeypatch.setattr(vectors, "BLOCK_ELEMENTS", 400)
    blk = vectors.exact_topk(e, e, 2, query_id="vec_id", doc_id="vec_id", exclude_self=True, strategy="blocked")
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert key(ref) == key(blk)
