"""Search of queries against rows that are dealt to shards.

A shard is one task.  Its rows come first and become an index once; the
queries dealt to it follow as a stream of batches, so a task holds one shard's
rows and one batch of queries, however many queries there are.  Vectors meet
vectors of their own length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from supportlake.session import cut_lineage

SHARD_ROWS = 16_384
BATCH = 1024                 # queries answered together


def with_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, a number for every row (rows that repeat an id
    are rows of their own), written once."""
    return cut_lineage(rows.withColumn("key", F.monotonically_increasing_id()))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def over_shards(queries: DataFrame, rows: DataFrame, shards: int, index, answer, pairs: str, number: str) -> DataFrame:
    """``queries`` (shard, key, vec_id, v, extra) against ``rows`` (key,
    vec_id, v).  ``index(keys, ids, vectors)`` is built per shard and length
    of vectors, ``answer(index, key, vec_id, vector, extra)`` gives the result
    rows of one query, of schema ``pairs`` (longs and doubles); ``number``:
    the type of the vectors' numbers."""

    def search(batches):
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in pairs.split(", ")]
        kinds = [pa.float64() if c.split()[1] == "double" else pa.int64() for c in pairs.split(", ")]

        def vectors(column):
            """Lists of one length as matrices: [(places, matrix)]."""
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(size) - size
            return [(own, flat[at[own][:, None] + np.arange(n)]) for n in np.unique(size) for own in [np.flatnonzero(size == n)]]

        held, built, now = [], None, None
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(shard) | np.diff(kind)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
                if y <= x:
                    continue
                part = b.slice(x, y - x)
                if shard[x] != now:
                    now, held, built = shard[x], [], None
                if kind[x] == 0:
                    held.append(part)
                    continue
                if built is None:
                    built = {}
                    if held:
                        t = pa.Table.from_batches(held)
                        keys, ids = t.column(2).to_numpy(), t.column(3).to_numpy()
                        built = {m.shape[1]: index(keys[own], ids[own], m) for own, m in vectors(t.column(4))}
                    held = []
                for a in range(0, y - x, BATCH):
                    some = part.slice(a, BATCH)
                    keys, ids, extra = some.column(2).to_numpy(), some.column(3).to_numpy(), some.column(5).to_numpy()
                    out = []
                    for own, m in vectors(some.column(4)):
                        if (found := built.get(m.shape[1])) is not None:
                            for i, v in zip(own.tolist(), m):
                                out += answer(found, int(keys[i]), int(ids[i]), v, int(extra[i]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    own = lambda df, kind, extra: df.select(
        "shard", F.lit(kind).alias("kind"), "key", "vec_id", F.col("v").cast(f"array<{number}>").alias("v"), extra.alias("extra"))
    both = own(rows.withColumn("shard", shard_of(shards)), 0, F.lit(0).cast("long")).unionByName(own(queries, 1, F.col("extra").cast("long")))
    return both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(search, pairs)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of every query row with their rank, ties to the smaller
    vec_id, then in the order the rows were read."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
