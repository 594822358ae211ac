"""Exact top-k by integer inner product: a KD-tree per shard.

Vectors are turned into integers, floor(scale * x).  Each shard of rows builds
a tree by median splits on the widest axis; every node keeps the tight box of
its rows.  A query walks the tree best-first by the largest inner product any
point of a box can have, and stops when no open box can beat its k-th score.
The k-th score found in a query's home shard is propagated: the other shards
start from it and prune against it.  Ties with the k-th score are kept, so the
result is exact, ties to the smaller id.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.mih import usable
from supportlake.llm.shards import SHARD_ROWS, best, over_shards, shard_of, with_keys
from supportlake.session import cut_lineage

SCALE = 1024
LEAF = 128
LONG = 1 << 63               # scaled components are longs
NONE = -LONG                 # no k-th score yet; as a score: at or below the long range
PAIR = "query long, query_id long, row long, vec_id long, score long"


class Tree:
    """Rows (keys, ids, int64 matrix) under median splits; boxes are tight."""

    def __init__(self, keys, ids, x, leaf: int = LEAF):
        import numpy as np

        order = np.lexsort((keys, ids))
        self.keys, self.ids, self.x = keys[order], ids[order], x[order]
        self.low, self.high, self.children, self.rows = [], [], [], []
        stack = [(np.arange(len(ids)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            part = self.x[rows]
            low, high = part.min(0), part.max(0)
            me = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([-1, -1])
            self.rows.append(None)
            if parent >= 0:
                self.children[parent][side] = me
            axis = int((high.astype(float) - low).argmax())
            if len(rows) <= leaf or high[axis] == low[axis]:
                self.rows[me] = np.sort(rows)
                continue
            half = len(rows) // 2
            split = np.argpartition(part[:, axis], half)
            stack.append((rows[split[half:]], me, 1))
            stack.append((rows[split[:half]], me, 0))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high)).max(1)

    def top(self, query, own: int, k: int, floor: int | None):
        """The k best (score, -id, -key) at or above ``floor``, without the row whose key is ``own``."""
        import numpy as np

        # the most that any point of a box can score, for all boxes
        bound = np.maximum(query * self.low, query * self.high).sum(1)
        # boxes where a product could leave int64: Python integers
        exact = query.astype(object)
        wide = self.most > (LONG - 1) // (len(query) * max(1, int(np.abs(query).max())))
        if wide.any():
            bound = bound.astype(object)
            bound[wide] = np.maximum(exact * self.low[wide], exact * self.high[wide]).sum(1)
        best: list[tuple[int, int, int]] = []          # heap of (score, -id, -key): the worst first
        kth = floor
        open_boxes = [(-int(bound[0]), 0)]
        while open_boxes:
            most, node = heapq.heappop(open_boxes)
            if kth is not None and -most < kth:
                break
            rows = self.rows[node]
            if rows is None:
                for c in self.children[node]:
                    if kth is None or bound[c] >= kth:
                        heapq.heappush(open_boxes, (-int(bound[c]), c))
                continue
            score = self.x[rows].astype(object) @ exact if wide[node] else self.x[rows] @ query
            if kth is not None:
                keep = score >= kth
                rows, score = rows[keep], score[keep]
            for s, i, r in zip(score.tolist(), self.ids[rows].tolist(), self.keys[rows].tolist()):
                if r == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i, -r))
                elif (s, -i, -r) > best[0]:
                    heapq.heapreplace(best, (s, -i, -r))
            if len(best) == k:
                kth = best[0][0] if kth is None else max(kth, best[0][0])
        return best


def in_range(score: int) -> int:
    """A score above the long range is among the best of all shards, so it
    raises at once; one below may still fall to others and becomes NONE."""
    if score >= LONG:
        raise OverflowError(f"the inner product {score} is not a long; use a smaller scale")
    return max(score, NONE)


def _answer(k: int):
    def answer(tree, key, vec_id, v, floor):
        return [(key, vec_id, -r, -i, in_range(s)) for s, i, r in tree.top(v, key, k, None if floor == NONE else floor)]

    return answer


def search(rows: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE, id_col: str = "vec_id",
           vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every``, the k other rows with the largest integer inner product.

    Defined cases: vectors that are null, hold null or non-finite numbers, lack
    an id, or have a scaled component that is not a long (2**63 or more) take no
    part (zero vectors do); vectors meet those of their own length; a score of
    the result that is not a long raises; ties go to the smaller id; rows that
    repeat an id are rows of their own, and only the query's own row is left
    out; fewer than k others: all of them; an empty table gives an empty one;
    other columns are not looked at."""
    ok = usable(rows, id_col, vec_col)
    ok = with_keys(ok.where(F.forall("v", lambda x: F.abs(x) * scale < float(LONG))).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")))
    shards, queries = max(1, -(-ok.count() // shard_rows)), ok.where(F.col("vec_id") % every == 0)
    meet = lambda q: over_shards(q, ok, shards, Tree, _answer(k), PAIR, "bigint")
    found = cut_lineage(meet(queries.withColumn("shard", shard_of(shards)).withColumn("extra", F.lit(NONE))))
    if shards > 1:
        kth = best(found, k).where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("score").alias("extra"))
        away = (queries.join(kth, "key", "left").withColumn("extra", F.coalesce("extra", F.lit(NONE)))
                .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != shard_of(shards)))
        found = found.unionByName(meet(away))
    score = F.when(F.col("score") == NONE, F.raise_error(F.lit("an inner product is not a long; use a smaller scale")).cast("long")).otherwise(
        F.col("score"))
    return best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))


def oracle_sql(every: int = 100, k: int = 10, scale: int = SCALE) -> str:
    """The same rows by comparing every query with every row in DuckDB."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""
