"""Approximate nearest neighbours by cosine: multi-index hashing.

* Codes: unit vectors are turned by a learned rotation (principal axes, then
  alternating quantisation and orthogonal Procrustes steps) and further
  rotations of it, and the signs are the bits.  Rotations are learned on a
  bounded sample (``sample`` rows, least hashes of the id).
* Index: codes are cut into substrings of ``SUB`` bits and every shard of rows
  keeps, per substring, its rows sorted by value.
* Tables: where the values within reach outnumber those that occur, the ones
  that occur are walked instead.
* Search: a code within radius ``r`` of the query differs in at most
  ``r // substrings`` bits of one of its substrings (pigeonhole; sharper for
  the substrings after the remainder).  Probing those values in each table
  retrieves every code within the radius; codes are checked, and the float
  vectors of those within it are ranked by exact cosine.
* Radius: on the sample it is set so that the stated share of true
  neighbours lies within it (sample neighbours lie farther than those among
  all rows, so the share is a lower bound).  A query that finds fewer than k
  rows is answered exactly from all rows, in a second pass.

Every row is indexed, once: rows are dealt to shards by hash, every shard is one
task that its queries stream through, and the best of the shards are merged by a
top-k per query.  Vectors of a length other than most are compared with all of
their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.shards import SHARD_ROWS, best, over_shards, with_keys
from supportlake.session import cut_lineage

SAMPLE = 8_000
SAMPLE_QUERIES = 400
CODE_BITS = 256
SUB = 16
SHARE = 0.995                # of the sample's true neighbours within the radius
SEED = 7


@dataclass(frozen=True)
class Hash:
    dim: int
    planes: object           # float64 (dim, CODE_BITS)
    radius: int


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): array<double> without nulls or non-finite numbers, with an id."""
    v = F.col(vec_col).cast("array<double>")
    ok = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return ok


def common_length(rows: DataFrame) -> int:
    best = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(best["n"]) if best else 0


def learn(sample, k: int, seed: int = SEED, rounds: int = 25, share: float = SHARE) -> Hash:
    """Rotations and radius from a (rows, dim) array of unit vectors."""
    import numpy as np

    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    blocks = []
    for _ in range(-(-CODE_BITS // dim)):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        low = sample @ axes
        for _ in range(rounds):                        # ITQ: B = sign(VR), R from the SVD of B'V
            b = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(low.T @ b)
            turn = u @ w
        blocks.append(axes @ turn)
    planes = np.concatenate(blocks, 1)[:, :CODE_BITS]
    radius = CODE_BITS
    if len(sample) > 1:
        q = sample[:SAMPLE_QUERIES]
        sims = q @ sample.T
        sims[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        codes = codes_of(sample, planes)
        d = np.bitwise_count(codes[:len(q), None, :] ^ codes[near]).sum(2)
        radius = int(np.quantile(d, share, method="higher"))
    return Hash(dim, planes, radius)


def codes_of(unit, planes):
    """(rows, CODE_BITS / 64) of uint64."""
    import numpy as np

    return np.ascontiguousarray(np.packbits(unit @ planes >= 0, axis=1, bitorder="little")).view("<u8")


def fit(rows: DataFrame, k: int, sample: int = SAMPLE) -> Hash:
    """From at most ``sample`` rows of ``rows`` (vec_id, v), those with the least hash of the id."""
    import numpy as np

    dim = common_length(rows)                          # the most frequent, least on ties
    got = (rows.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow())
    if not dim or not got.num_rows:
        return Hash(dim, np.zeros((max(dim, 1), CODE_BITS)), CODE_BITS)
    return learn(_unit(np.array(got["v"].to_pylist(), float)), k)


def _unit(x):
    import numpy as np

    top = np.abs(x).max(1, keepdims=True)              # vectors of any size, without overflow
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


class Shard:
    """Multi-index over one shard's codes."""

    def __init__(self, codes):
        import numpy as np

        self.codes = codes
        self.subs = codes.view("<u2").reshape(len(codes), -1)
        self.order = [np.argsort(self.subs[:, s], kind="stable") for s in range(self.subs.shape[1])]
        # where each value begins in the sorted order: 2**SUB + 1 places per table
        self.begin = [np.searchsorted(self.subs[o, s], np.arange((1 << SUB) + 1)) for s, o in enumerate(self.order)]
        self.occurring = [np.flatnonzero(np.diff(b)).astype(np.uint16) for b in self.begin]

    def within(self, code, radius: int):
        """Every row whose code is at most ``radius`` bits from ``code``."""
        import numpy as np

        tables = self.subs.shape[1]
        near, more = divmod(radius, tables)
        values = code.view("<u2")
        seen = np.zeros(len(self.codes), bool)
        for s in range(tables):
            reach = near if s <= more else near - 1     # pigeonhole over the substrings
            if reach < 0:
                continue
            probes, own = _ball(reach), self.occurring[s]
            probes = own[np.bitwise_count(own ^ values[s]) <= reach] if len(own) < len(probes) else probes ^ values[s]
            a, b = self.begin[s][probes], self.begin[s][probes.astype(np.int64) + 1]
            hit = b > a
            a, n = a[hit], (b - a)[hit]
            if len(n):
                place = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                seen[self.order[s][place]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


_BALLS: dict[int, object] = {}


def _ball(reach: int):
    """All SUB-bit masks of at most ``reach`` bits."""
    import numpy as np

    if reach not in _BALLS:
        all_masks = np.arange(1 << SUB, dtype=np.uint16)
        _BALLS[reach] = all_masks[np.bitwise_count(all_masks) <= reach]
    return _BALLS[reach]


PAIR = "query long, query_id long, row long, vec_id long, score double"


class Index:
    """Rows of one shard and length; without codes if that length was not learned."""

    def __init__(self, keys, ids, x, h: Hash):
        self.keys, self.ids, self.x, self.unit = keys, ids, x, _unit(x)
        self.shard = Shard(codes_of(self.unit, h.planes)) if x.shape[1] == h.dim else None


def _answer(shared, k: int):
    def answer(index, key, vec_id, v, exact):
        import numpy as np

        h = shared.value
        unit = _unit(v[None])[0]
        if exact or index.shard is None:
            found = np.arange(len(index.x))
        else:
            found = index.shard.within(codes_of(unit[None], h.planes)[0], h.radius)
        found = found[index.keys[found] != key]
        score = _cosine(v, index.x[found], unit, index.unit[found])
        top = np.lexsort((index.keys[found], index.ids[found], -score))[:k]
        return [(key, vec_id, *x) for x in zip(index.keys[found][top].tolist(), index.ids[found][top].tolist(), score[top].tolist())]

    return answer


def _cosine(q, x, uq, ux):
    """Dot product over the product of the norms, in double precision on the
    given numbers; on the scaled ones where that over- or underflows."""
    import numpy as np

    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        size = np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1))
        s = (x * q).sum(1) / size
    odd = ~np.isfinite(s) | (size < 1e-280)
    return np.where(odd, (ux * uq).sum(1), s) if odd.any() else s


def search(rows: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, id_col: str = "vec_id",
           vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every``, its k nearest of all other rows found by the index.

    Defined cases: vectors that are null, zero, hold null or non-finite numbers
    or lack an id take no part; vectors meet those of their own length; ties go
    to the smaller id; rows that repeat an id are rows of their own, and only
    the query's own row is left out; fewer than k others: all of them; an empty
    table gives an empty one; other columns are not looked at."""
    spark = rows.sparkSession
    ok = with_keys(usable(rows, id_col, vec_col).where(F.exists("v", lambda x: x != 0)))
    h = fit(ok, k, sample)
    n, learned = ok.count(), ok.where(F.size("v") == h.dim).count()
    shards = max(1, -(-n // shard_rows))
    shared = spark.sparkContext.broadcast(h)
    build = lambda keys, ids, x: Index(keys, ids, x, shared.value)
    # every shard is searched by every query
    meet = lambda q: over_shards(q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))),
                                 ok, shards, build, _answer(shared, k), PAIR, "double")
    queries = ok.where(F.col("vec_id") % every == 0)
    first = cut_lineage(meet(queries.withColumn("extra", F.lit(0))))
    found = first.groupBy(F.col("query").alias("key")).agg(F.count("*").alias("found"))
    short = cut_lineage(queries.where(F.size("v") == h.dim).join(found, "key", "left").where(
        F.coalesce("found", F.lit(0)) < min(k, max(learned - 1, 0))).select("key", "vec_id", "v", F.lit(1).alias("extra")))
    if short.head(1):
        first = first.join(short.select(F.col("key").alias("query")), "query", "left_anti").unionByName(meet(short))
    return best(first, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
