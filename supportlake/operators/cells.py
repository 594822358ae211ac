"""Exact top-k over dense vectors, pruned by cells.

* Cells: centres are learned on a bounded sample; every index vector belongs
  to the cell of its nearest centre, and a cell's radius is the largest angle
  between its centre and one of its vectors.
* Bound: no vector of a cell is closer to a query than the angle to the centre
  less the radius.  The k-th best of the sample is a floor for the k-th best of
  all, so a query visits only the cells whose bound reaches its floor.
* Search: cells are packed into groups of bounded size (a large cell is several
  groups), a group is a partition, and its vectors come before the queries that
  visit it.  There a query takes the cells in order of bound and stops at the
  first that cannot reach its k-th score so far.  Only the k best of a query
  and group leave a task.

Every index vector is shuffled once, a query once for every group it visits.
A group that many queries visit is copied and they are dealt to the copies.
Nothing but the sample, the centres and one number per cell and group reaches
the driver.  The result does not depend on the sample: a bad one prunes less.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.session import cut_lineage

SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20      # of the sample's numbers
SAMPLE_QUERIES = 512         # on which the visits of groups are estimated
MOST_CELLS = 1024
ROUNDS = 6                   # of k-means on the sample
GROUP_BYTES = 96 << 20       # of a group's numbers
VISITS = 262_144             # queries that one copy of a group answers
TASKS = 3                    # searches for every core
BATCH = 512                  # queries answered together
BLOCK = 1 << 21              # pairs compared at once
EXACT = 1 << 15              # pairs whose similarity is made in double precision at once
SLACK = 1e-6                 # angles are exact to about 1e-8
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class CellIndex:
    """``rows``: (cell, _id, _vec), vectors as they came, written once.  Cell
    number ``len(centres)`` holds the zero vectors."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray


def matrix_of(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of unit rows (zero
    rows stay zero)."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    m = flat.reshape(n, -1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _vec) of the rows with a vector; float components stay floats,
    which move at half the size."""
    kind = df.schema[vec_col].dataType.simpleString() if vec_col in df.columns else ""
    return df.select(F.col(id_col).cast("long").alias("_id"),
                     F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("_vec")).where("_vec is not null")


def learn_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means on the sphere, begun from rows spread over the sample."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def build(index: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", cells: int | None = None,
          sample_rows: int = SAMPLE_ROWS) -> CellIndex:
    """Cells of ``index``; rows without a vector are left out.  ``cells``: how
    many, by default the root of the number of rows, MOST_CELLS at most."""
    rows = _vectors(index, id_col, vec_col)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("_vec")).alias("dim")).first()
    n, dim = stats["n"], stats["dim"] or 1
    take = max(1, min(sample_rows, SAMPLE_BYTES // (8 * max(dim, 1))))
    got = rows.orderBy(F.xxhash64("_id"), "_id").limit(take).toArrow()
    ids, sample = got["_id"].to_numpy(), matrix_of(got["_vec"]) if got.num_rows else np.zeros((0, dim))
    some = sample[(sample != 0).any(1)]
    centres = learn_centres(some, min(MOST_CELLS, cells or int(n ** 0.5))) if len(some) else np.zeros((0, dim))
    shared = index.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            m, own = matrix_of(b.column(1)), shared.value
            cell, angle = np.full(len(m), len(own), np.int32), np.zeros(len(m))
            if len(own) and len(m):
                sims = m @ own.T
                some = (m != 0).any(1)
                cell[some] = sims.argmax(1)[some]
                angle[some] = np.arccos(np.clip(sims.max(1), -1, 1))[some]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), b.column(0), b.column(1)], ["cell", "angle", "_id", "_vec"])

    kind = rows.schema["_vec"].dataType.simpleString()
    table = cut_lineage(rows.mapInArrow(assign, f"cell int, angle double, _id long, _vec {kind}"))
    counts, radii = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1)
    for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():      # a row per cell
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return CellIndex(table.drop("angle"), centres, radii, counts, ids, sample)


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The largest similarity that each query can have with a vector of each cell."""
    out = np.zeros((len(q), len(radii)))
    if len(centres):
        angle = np.arccos(np.clip(q @ centres.T, -1, 1)) - radii[:-1]
        out[:, :-1] = np.cos(np.maximum(angle, 0))
        out[~(q != 0).any(1)] = 0
    return out


def screen_error(dim: int) -> float:
    """How far a similarity of unit vectors in single precision may be off."""
    return (dim + 8) * 2.0 ** -23


def floors(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    """No more than the k-th best similarity of each query with the sample: none smaller can be among the k best."""
    out = np.full(len(q), -np.inf)
    if len(ids) < k + exclude_self or not len(q):
        return out
    small, step = sample.astype(np.float32), max(1, BLOCK // len(ids))
    for a in range(0, len(q), step):
        sims = q[a:a + step].astype(np.float32) @ small.T
        if exclude_self:
            sims[qids[a:a + step, None] == ids[None, :]] = -np.inf
        out[a:a + step] = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k] - screen_error(q.shape[1])
    return out


@dataclass(frozen=True)
class Groups:
    """Cell c is the groups from first[c] on, parts[c] of them."""

    first: np.ndarray
    parts: np.ndarray
    count: int


def pack_cells(counts: np.ndarray, rows: int) -> Groups:
    """Neighbouring cells fill groups of about ``rows`` vectors; a larger cell is several groups of its own."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, held = 0, 0
    for c, n in enumerate(counts.tolist()):
        if n > rows:
            group += held > 0
            first[c], parts[c] = group, -(-n // rows)
            group, held = group + int(parts[c]), 0
        else:
            if held + n > rows:
                group, held = group + 1, 0
            first[c] = group
            held += n
    return Groups(first, parts, group + 1 if held or not group else group)


def _visits(allowed: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """(query, group) of the cells that queries are allowed to visit, each pair once."""
    q, c = np.nonzero(allowed)
    n = groups.parts[c]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique(np.repeat(q, n) * groups.count + np.repeat(groups.first[c], n) + nth)
    return pairs // groups.count, pairs % groups.count


class Best:
    """The k best of each query among the vectors added so far; ties go to the
    smaller id.  Unit vectors are compared in single precision; the similarity
    of the pairs that may be among the best is made in double precision.
    ``least``: no smaller similarity can be among a query's k best."""

    def __init__(self, q: np.ndarray, qids: np.ndarray, k: int, exclude_self: bool, scale: int, floor: np.ndarray | None = None,
                 unit: bool = True):
        self.q, self.qids, self.k, self.exclude_self, self.scale = q, qids, k, exclude_self, scale
        self.small = q.astype(np.float32) if unit else q
        self.error = (screen_error(q.shape[1]) if unit else 0.0) + 2 / scale
        self.least = np.full(len(q), -np.inf) if floor is None else floor.copy()
        self.key, self.id, self.sim = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64), np.zeros((len(q), k))

    def add(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray, small: np.ndarray) -> None:
        """Compares the queries in places ``at`` with vectors in order of their
        ids (``small``: in the precision of the screening)."""
        step = max(1, BLOCK // max(len(at), 1))
        for a in range(0, len(ids) if len(at) else 0, step):
            self._add(at, ids[a:a + step], x[a:a + step], small[a:a + step])

    def _add(self, at, ids, x, small) -> None:
        near = (self.small[at] if len(at) < len(self.q) else self.small) @ small.T
        if self.exclude_self:
            low, high = np.searchsorted(ids, self.qids[at]), np.searchsorted(ids, self.qids[at], "right")
            for i in np.flatnonzero(low < high).tolist():
                near[i, low[i]:high[i]] = -np.inf
        cut = self.least[at] - self.error
        new = np.flatnonzero(np.isneginf(cut))
        if len(new) and len(ids) > self.k:
            cut[new] = np.partition(near[new], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * self.error
        least = np.finfo(near.dtype).min
        cut = np.nextafter(np.maximum(cut, least).astype(near.dtype), least)
        found = np.flatnonzero(near >= cut[:, None])
        if not len(found):
            return
        row, col = at[found // len(ids)], found % len(ids)
        sim = np.concatenate([np.einsum("ij,ij->i", self.q[row[a:a + EXACT]], x[col[a:a + EXACT]]) for a in range(0, len(row), EXACT)])
        some = np.unique(row)
        held, place = np.nonzero(self.key[some] != NONE)
        held = some[held]
        rows = np.concatenate([held, row])
        ids = np.concatenate([self.id[held, place], ids[col]])
        sims = np.concatenate([self.sim[held, place], sim])
        keys = np.concatenate([self.key[held, place], np.rint(sim * self.scale).astype(np.int64)])
        order = np.lexsort((ids, -keys, rows))
        rows = rows[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < self.k
        rows, nth, order = rows[keep], nth[keep], order[keep]
        self.key[rows, nth], self.id[rows, nth], self.sim[rows, nth] = keys[order], ids[order], sims[order]
        full = some[self.key[some, self.k - 1] != NONE]
        self.least[full] = np.maximum(self.least[full], self.sim[full, self.k - 1])

    def rows(self):
        """(query, id, similarity, order key, rank), best first."""
        row, nth = np.nonzero(self.key != NONE)
        return self.qids[row], self.id[row, nth], self.sim[row, nth], self.key[row, nth], (nth + 1).astype(np.int32)


def best_of(q: np.ndarray, qids: np.ndarray, floor: np.ndarray, bound: np.ndarray, cells: dict, k: int, exclude_self: bool, scale: int):
    """The k best of a group for a batch of queries: (query ids, ids,
    similarities, order keys, pairs compared).  ``cells``: cell -> (ids, vectors,
    the same in single precision); a query leaves a cell out once its bound is
    below the query's floor or k-th score so far."""
    best = Best(q, qids, k, exclude_self, scale, floor)
    compared = 0
    for c in sorted(cells, key=lambda c: -bound[:, c].max()):
        at = np.flatnonzero(bound[:, c] >= best.least - SLACK)
        compared += len(at) * len(cells[c][0])
        best.add(at, *cells[c])
    return *best.rows()[:4], compared


def copies_of(groups: Groups, counts: np.ndarray, asked: np.ndarray, tasks: int, visits: int) -> np.ndarray:
    """Copies of each group, which share the ``asked`` queries that visit it: in
    proportion to its pairs, ``tasks`` in all, and ``visits`` queries a copy at most."""
    size = np.zeros(groups.count)
    for first, parts, n in zip(groups.first.tolist(), groups.parts.tolist(), counts.tolist()):
        size[first:first + parts] += n / parts
    pairs = size * asked
    even = tasks * pairs / max(pairs.sum(), 1.0)
    return np.maximum(1, np.maximum(np.ceil(asked / visits), np.minimum(np.rint(even), asked))).astype(np.int64)


def topk(queries: DataFrame, index: CellIndex, k: int, scale: int, query_id: str = "query_id", query_vec: str = "embedding",
         exclude_self: bool = False, group_rows: int | None = None, visits: int = VISITS) -> DataFrame:
    """(query_id, doc_id, similarity, _skey, compared): for every query the k
    best of each group it visits, the k best of all among them.  ``compared``
    is the number of pairs that were compared for the query's batch, on its
    first row."""
    spark = queries.sparkSession
    sc = spark.sparkContext
    q = _vectors(queries, query_id, query_vec)
    kind = "array<float>" if q.schema["_vec"].dataType == index.rows.schema["_vec"].dataType else "array<double>"
    kind = kind if q.schema["_vec"].dataType.simpleString() == kind else "array<double>"
    q, rows = q.withColumn("_vec", F.col("_vec").cast(kind)), index.rows.withColumn("_vec", F.col("_vec").cast(kind))
    total, asked = int(index.counts.sum()), q.count()
    tasks = max(TASKS * sc.defaultParallelism, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a query moves once for every group, a vector once for every copy of its group: with
    # ``tasks`` searches in all, the fewest rows move where both are alike
    wanted = max(1, min(tasks, round((tasks * total / max(asked, 1)) ** 0.5)))
    most = max(1, GROUP_BYTES // (8 * max(index.sample.shape[1], 1)))
    groups = pack_cells(index.counts, group_rows or max(1, min(most, -(-total // wanted))))
    # how many queries visit a group, as far as a few of them tell
    some = q.orderBy(F.xxhash64("_id", F.lit("visits"))).limit(SAMPLE_QUERIES).toArrow()
    copies = np.ones(groups.count, np.int64)
    if some.num_rows:
        m, ids = matrix_of(some["_vec"]), some["_id"].to_numpy()
        near = bounds(m, index.centres, index.radii) >= floors(ids, m, index.sample_ids, index.sample, k, exclude_self)[:, None] - SLACK
        share = np.bincount(_visits(near & (index.counts > 0), groups)[1], minlength=groups.count) / len(m)
        copies = copies_of(groups, index.counts, share * asked, tasks, visits)
    slot_of = np.r_[0, np.cumsum(copies)]
    shared = sc.broadcast((index.centres, index.radii, index.counts, index.sample_ids, index.sample, groups, copies, slot_of))

    def deal(batches):
        """Queries, once for every group they visit."""
        import pyarrow as pa

        centres, radii, counts, ids, sample, groups, copies, slot_of = shared.value
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                m, own = matrix_of(part.column(1)), part.column(0).to_numpy()
                floor = floors(own, m, ids, sample, k, exclude_self)
                who, group = _visits((bounds(m, centres, radii) >= floor[:, None] - SLACK) & (counts > 0), groups)
                slot = slot_of[group] + own[who] % copies[group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.astype(np.int32)), pa.array(np.ones(len(who), np.int32)), pa.array(np.zeros(len(who), np.int32)),
                     pa.array(own[who]), part.column(1).take(pa.array(who)), pa.array(floor[who])], ["slot", "kind", "cell", "_id", "_vec", "floor"])

    def place(batches):
        """Index vectors, once for every copy of their group."""
        import pyarrow as pa

        _, _, _, _, _, groups, copies, slot_of = shared.value
        for b in batches:
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            group = groups.first[cell] + ids % groups.parts[cell]
            n = copies[group]
            who = np.repeat(np.arange(len(ids)), n)
            slot = np.repeat(slot_of[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), pa.array(np.zeros(len(who), np.int32)), b.column(0).take(take), b.column(1).take(take),
                 b.column(2).take(take), pa.array(np.full(len(who), -np.inf))], ["slot", "kind", "cell", "_id", "_vec", "floor"])

    def search(batches):
        import pyarrow as pa

        centres, radii = shared.value[:2]
        now, held, cells = None, [], None
        for b in batches:
            slot, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = (np.flatnonzero(np.diff(slot) | np.diff(kind)) + 1).tolist()
            for x, y in zip([0, *edges], [*edges, len(slot)]):
                if y <= x:
                    continue
                if slot[x] != now:
                    now, held, cells = slot[x], [], None
                part = b.slice(x, y - x)
                if kind[x] == 0:
                    held.append(part)
                    continue
                if cells is None:
                    cells = {}
                    if held:
                        t = pa.Table.from_batches(held)
                        held = []
                        own, ids, m = t["cell"].to_numpy(), t["_id"].to_numpy(), matrix_of(t["_vec"])
                        del t
                        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                        cells = {int(own[a]): (ids[a:z], m[a:z], m[a:z].astype(np.float32)) for a, z in zip(cuts, cuts[1:])}
                    held = []
                for a in range(0, y - x, BATCH):
                    some = part.slice(a, BATCH)
                    m = matrix_of(some.column(4))
                    qid, did, sim, key, compared = best_of(m, some.column(3).to_numpy(), some.column(5).to_numpy(), bounds(m, centres, radii),
                                                           cells, k, exclude_self, scale)
                    work = np.zeros(len(qid), np.int64)
                    work[:1] = compared
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, (qid, did, sim, key, work))),
                                                     ["query_id", "doc_id", "similarity", "_skey", "compared"])

    schema = f"slot int, kind int, cell int, _id long, _vec {kind}, floor double"
    both = rows.mapInArrow(place, schema).unionByName(q.mapInArrow(deal, schema))
    return (both.repartitionById(int(slot_of[-1]), F.col("slot")).sortWithinPartitions("slot", "kind", "cell", "_id")
            .mapInArrow(search, "query_id long, doc_id long, similarity double, _skey long, compared long"))
