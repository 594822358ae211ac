"""Connected components of an edge table, by min-label star contraction.

Each round rewires every node to the smallest node it sees (first over larger
neighbours, then over smaller ones); components end as stars.  Only min
aggregates and joins are used, so a hub with many edges is pre-aggregated and
its join side can be split; no neighbour list is ever gathered.  Each round is
written to the shared checkpoint folder, so plans stay short and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.session import cut_lineage


def _rewire(both: DataFrame, side: DataFrame) -> DataFrame:
    """``both``: (u, v) seen by u; min per u, then the (u, v) of ``side`` meet it."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return side.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: (u, v) of any orderable type, either direction, repeats and
    loops allowed; rows with a null end are ignored.  Returns (node, component)
    for every node of an edge between different nodes; the component is its
    smallest node.  An empty table gives an empty one."""
    e = (edges.where(F.col("u") != F.col("v"))
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = cut_lineage(e)
    seen = None
    for _ in range(max_rounds):
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        # large star: every larger neighbour moves to the least node u sees
        large = (_rewire(e.unionByName(turned), turned)
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # its edges run from larger to smaller again; every smaller neighbour (and u) moves to the least one
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        met = _rewire(low, low)
        small = (met.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = cut_lineage(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (now["n"], now["h"]):
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = (now["n"], now["h"])
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
