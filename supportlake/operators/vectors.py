"""Exact vector search (inner product on L2-normalised vectors).

Exact top-k is O(queries x index) by nature; the work is spread so that no
task ever holds more than one bounded block of each side and only the k best
rows per query leave a task (never all pairs):

* ``index`` side small (size checked): broadcast it, stream the queries with
  ``mapInPandas`` (block matmul per Arrow batch) -> final top-k, no shuffle.
* ``queries`` side small: broadcast the queries, stream the index, keep a
  running top-k per query per partition, then merge k x partitions rows per
  query with a ``row_number`` window.
* neither small: cells with a centre and a radius, of which a query visits
  those that can hold one of its k best (``operators.cells``, unit vectors);
  without normalising, hash both sides into blocks and ``cogroup`` each
  (query block, index block) pair; partial top-k per group, then merge.

An index that is searched again and again (a stream's history) is prepared once
with ``prepare_index``.

Ranking is by similarity (differences below 1e-9, the noise of summation
order, count as ties), then by document id ascending.  The similarity
threshold is applied after the top-k, to the unrounded value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.operators import cells

SCALE = 1_000_000_000      # similarities closer than 1e-9 count as ties
DEFAULT_BROADCAST_BYTES = 64 << 20    # every Python worker holds a copy
BLOCK_ELEMENTS = 8_000_000  # query-rows x index-rows per matmul block

TOPK_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("_skey", T.LongType()),
    T.StructField("rank", T.IntegerType()),
])


# --------------------------------------------------------------------------
# numpy kernel
# --------------------------------------------------------------------------


def _matrix(values, normalize: bool) -> np.ndarray:
    if len(values) == 0:
        return np.zeros((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    if normalize:
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m


def topk_block(qids: np.ndarray, Q: np.ndarray, dids: np.ndarray, D: np.ndarray, k: int,
               exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Top-k of every query row against one index block.

    Returns (qid, did, sim, skey) arrays with up to k entries per query, the
    order key ``skey`` = rounded similarity (higher first), ties by did.
    """
    if len(qids) == 0 or len(dids) == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0), e
    order = np.argsort(dids, kind="stable")
    dids, D = dids[order], D[order]
    S = Q @ D.T
    skey = np.rint(S * SCALE).astype(np.int64)
    valid = np.ones(S.shape, dtype=bool)
    if exclude_self:
        valid &= qids[:, None] != dids[None, :]
    nd = len(dids)
    # composite key: higher skey first, then lower did (position = did order)
    comp = np.where(valid, skey * (nd + 1) + (nd - np.arange(nd))[None, :], np.iinfo(np.int64).min + 1)
    kk = min(k, nd)
    part = np.argpartition(-comp, kk - 1, axis=1)[:, :kk]
    rows = np.repeat(np.arange(len(qids)), kk)
    cols = part.reshape(-1)
    keep = valid[rows, cols]
    rows, cols = rows[keep], cols[keep]
    return qids[rows], dids[cols], S[rows, cols], skey[rows, cols]


def _rows_frame(parts) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "doc_id": pd.Series([], dtype="int64"),
                             "similarity": pd.Series([], dtype="float64"), "_skey": pd.Series([], dtype="int64"),
                             "rank": pd.Series([], dtype="int32")})
    q, d, s, kk = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"query_id": q, "doc_id": d, "similarity": s, "_skey": kk,
                         "rank": np.zeros(len(q), dtype=np.int32)})


def _reduce_topk(df: pd.DataFrame, k: int) -> pd.DataFrame:
    """Keep the k best rows per query, ranked 1..k (ties by lower doc id)."""
    df = df.sort_values(["query_id", "_skey", "doc_id"], ascending=[True, False, True], kind="stable")
    df = df.groupby("query_id", sort=False).head(k).copy()
    df["rank"] = (df.groupby("query_id", sort=False).cumcount() + 1).astype(np.int32)
    return df


# --------------------------------------------------------------------------
# plans
# --------------------------------------------------------------------------


def _prep(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_vec"))


def _rows_matrix(column, normalize: bool) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    if normalize:
        return cells.matrix_of(column)
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rows_batch(best: cells.Best):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(list(map(pa.array, best.rows())), [f.name for f in TOPK_SCHEMA])


def _collect_side(df: DataFrame, normalize: bool):
    """Ids and matrix of a side of checked size in order of the ids, fetched as
    Arrow: what the driver holds is the numbers, not lists of Python floats."""
    got = df.where("_vec is not null").toArrow()
    ids = got["_id"].to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 0))
    m, order = _rows_matrix(got["_vec"], normalize), np.argsort(ids, kind="stable")
    return ids[order], m[order]


def spread_vectors(df: DataFrame) -> DataFrame:
    """Vectors dealt to at least one partition per core.  Comparing them costs
    far more than moving them, and how many partitions a derived frame has is
    not known without running its shuffles."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _side_bytes(df: DataFrame) -> tuple[int, int]:
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vec")).alias("dim")).first()
    n, dim = int(stats["n"] or 0), int(stats["dim"] or 0)
    return n, n * max(dim, 1) * 8


def prepare_index(index: DataFrame, doc_id: str = "doc_id", doc_vec: str = "embedding", **options) -> cells.CellIndex:
    """Cells of an index, written once; give them to ``exact_topk`` as ``index``."""
    return cells.build(index, doc_id, doc_vec, **options)


def exact_topk(queries: DataFrame, index: DataFrame | cells.CellIndex, k: int, *, query_id: str = "query_id",
               query_vec: str = "embedding", doc_id: str = "doc_id", doc_vec: str = "embedding",
               exclude_self: bool = False, normalize: bool = True,
               max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, strategy: str = "auto") -> DataFrame:
    """(query_id, doc_id, similarity, rank) for the k nearest index rows of every query.

    ``strategy``: broadcast_index, broadcast_queries, cells or blocked; auto
    takes the first whose side is small, then cells (blocked if the vectors are
    not to be normalised)."""
    if isinstance(index, cells.CellIndex):
        return _ranked(cells.topk(queries, index, k, SCALE, query_id, query_vec, exclude_self).drop("compared"), k)
    q, d = _prep(queries, query_id, query_vec), _prep(index, doc_id, doc_vec)
    spark = queries.sparkSession
    if strategy == "auto":
        n_d, b_d = _side_bytes(d)
        if b_d <= max_broadcast_bytes:
            strategy = "broadcast_index"
        else:
            n_q, b_q = _side_bytes(q)
            strategy = "broadcast_queries" if b_q <= max_broadcast_bytes else "cells" if normalize else "blocked"
    if strategy == "cells":
        if not normalize:
            raise ValueError("cells hold unit vectors")
        return exact_topk(q, cells.build(d, "_id", "_vec"), k, query_id="_id", query_vec="_vec", exclude_self=exclude_self)

    if strategy == "broadcast_index":
        dids, D = _collect_side(d, normalize)
        bc = spark.sparkContext.broadcast((dids, D))

        def per_query_batch(batches):
            dids_b, D_b = bc.value
            small = D_b.astype(np.float32) if normalize else D_b
            for b in batches:
                for i in range(0, b.num_rows, cells.BATCH):
                    part = b.slice(i, cells.BATCH)
                    best = cells.Best(_rows_matrix(part.column(1), normalize), part.column(0).to_numpy(), k, exclude_self, SCALE, unit=normalize)
                    best.add(np.arange(part.num_rows), dids_b, D_b, small)
                    yield _rows_batch(best)

        # every query lives in exactly one task: its ranked k rows are final,
        # so the only shuffle is the spread of the query side
        return spread_vectors(q.where("_vec is not null")).mapInArrow(per_query_batch, TOPK_SCHEMA).select(
            "query_id", "doc_id", "similarity", "rank", "_skey")

    if strategy == "broadcast_queries":
        qids, Q = _collect_side(q, normalize)
        bc = spark.sparkContext.broadcast((qids, Q))

        def per_index_partition(batches):
            qids_b, Q_b = bc.value
            best = [cells.Best(Q_b[i:i + cells.BATCH], qids_b[i:i + cells.BATCH], k, exclude_self, SCALE, unit=normalize)
                    for i in range(0, len(qids_b), cells.BATCH)]
            for b in batches:
                dids, D = b.column(0).to_numpy(), _rows_matrix(b.column(1), normalize)
                order = np.argsort(dids, kind="stable")
                dids, D = dids[order], D[order]
                small = D.astype(np.float32) if normalize else D
                for x in best:
                    x.add(np.arange(len(x.q)), dids, D, small)
            yield from map(_rows_batch, best)

        cand = spread_vectors(d.where("_vec is not null")).mapInArrow(per_index_partition, TOPK_SCHEMA)
        return _ranked(cand, k, merge=True)

    # blocked: (query block x index block) cells, both bounded
    n_q, _ = _side_bytes(q)
    n_d, _ = _side_bytes(d)
    rows_per_block = max(1, int(math.sqrt(BLOCK_ELEMENTS)))
    qb_n = max(1, math.ceil(n_q / rows_per_block))
    db_n = max(1, math.ceil(n_d / rows_per_block))
    qx = q.withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(qb_n))).withColumn(
        "_db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(db_n - 1).cast("long"))))
    dx = d.withColumn("_db", F.pmod(F.xxhash64("_id"), F.lit(db_n))).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb_n - 1).cast("long"))))

    def per_cell(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        qids = qpdf["_id"].to_numpy(dtype=np.int64)
        dids = dpdf["_id"].to_numpy(dtype=np.int64)
        part = topk_block(qids, _matrix(list(qpdf["_vec"]), normalize), dids,
                          _matrix(list(dpdf["_vec"]), normalize), k, exclude_self)
        return _reduce_topk(_rows_frame([part]), k)

    cand = qx.groupBy("_qb", "_db").cogroup(dx.groupBy("_qb", "_db")).applyInPandas(per_cell, TOPK_SCHEMA)
    return _ranked(cand, k, merge=True)


def _ranked(cand: DataFrame, k: int, merge: bool = True) -> DataFrame:
    """Merge per-task candidates: k x tasks rows per query, partial top-k
    (WindowGroupLimit) before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("_skey"), F.asc("doc_id"))
    out = cand.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "doc_id", "similarity", "rank", "_skey")


def distinct_topk(queries: DataFrame, index: DataFrame, k: int, *, query_id: str = "query_id",
                  query_vec: str = "embedding", doc_id: str = "doc_id", doc_vec: str = "embedding",
                  exclude_self: bool = False, query_owner: str | None = None, doc_owner: str | None = None, **options) -> DataFrame:
    """``exact_topk`` for vectors that repeat a lot (short texts, keyword
    counts): distinct query vectors meet distinct index vectors, then both are
    expanded.  Exact: a vector ranked below k + 1 others (ties by least id) has
    k + 1 documents before any of its own, one of which may be the query.  Of
    the documents of one vector only the k + 1 least ids can be among the best;
    they are cut by a partial top-k, so a hot vector is no large group.

    ``query_owner``, ``doc_owner``: a query does not see documents of its own
    owner (a message and its own replies).  Documents of one owner have one
    vector.  At most k of an owner are kept, and 2k in all, of which k are not
    the query's own."""
    q = queries.select(F.col(query_id).cast("long").alias("_id"), F.col(query_vec).alias("_vec"),
                       (F.col(query_owner) if query_owner else F.lit(None).cast("long")).alias("_owner"))
    d = index.select(F.col(doc_id).cast("long").alias("_id"), F.col(doc_vec).alias("_vec"),
                     (F.col(doc_owner) if doc_owner else F.lit(None).cast("long")).alias("_owner"))
    keep = 2 * k if query_owner else k + 1
    members = d
    if query_owner:
        members = members.withColumn("_n", F.row_number().over(Window.partitionBy("_vec", "_owner").orderBy("_id"))).where(F.col("_n") <= k)
    members = members.withColumn("_n", F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))).where(F.col("_n") <= keep)
    first = members.where("_n = 1").select(F.col("_id").alias("gid"), "_vec")
    members = members.join(first.select(F.col("gid"), F.col("_vec").alias("_gvec")), F.col("_vec") == F.col("_gvec")).select(
        "gid", F.col("_id").alias("doc_id"), F.col("_owner").alias("doc_owner"))
    asked = q.groupBy("_vec").agg(F.min("_id").alias("qid"))
    best = exact_topk(asked, first, k + 1, query_id="qid", query_vec="_vec", doc_id="gid", doc_vec="_vec", **options)
    rank = Window.partitionBy("qid").orderBy(F.desc("_skey"), F.asc("doc_id"))
    found = best.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("gid"), "similarity", "_skey").join(members, "gid")
    found = found.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= keep).select(
        "qid", "doc_id", "doc_owner", "similarity", "_skey", "_n")
    of = q.join(asked.select("qid", F.col("_vec").alias("_avec")), F.col("_vec") == F.col("_avec")).select(
        F.col("_id").alias("query_id"), "_owner", "qid")
    hits = of.join(found, "qid")
    if exclude_self:
        hits = hits.where(F.col("query_id") != F.col("doc_id"))
    if query_owner:
        hits = hits.where(~F.col("_owner").eqNullSafe(F.col("doc_owner")) | F.col("_owner").isNull())
    # at most ``keep`` rows a query, already ranked for its vector
    hits = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("_n", "doc_id", "similarity", "_skey"))), 1, k).alias("h"))
    return hits.select("query_id", F.posexplode("h").alias("rank", "x")).select(
        "query_id", "x.doc_id", "x.similarity", (F.col("rank") + 1).cast("int").alias("rank"), "x._skey")


def apply_threshold(topk: DataFrame, threshold: float) -> DataFrame:
    """Similarity floor after the top-k (fewer than k rows may remain)."""
    return topk.where(F.col("similarity") >= threshold)


def evidence(topk: DataFrame, index_meta: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per query: ordered ARRAY<STRUCT> evidence list (similarity rounded to 4)."""
    j = topk.join(index_meta, topk.doc_id == index_meta[doc_id], "inner")
    item = F.struct(
        F.col("rank"),
        F.col("customer_text").alias("query"),
        F.col("brand_text").alias("resolution"),
        F.round("similarity", 4).alias("similarity"),
        F.col("links"),
        F.col("customer_tweet_id"),
        F.col("brand_tweet_id"),
    )
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_ev"))
    return g.select("query_id", F.transform("_ev", lambda e: e.dropFields("rank")).alias("evidence"))
