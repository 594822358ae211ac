"""Average ranks with ties over any number of distinct values.

Values are counted, dealt to ranges by Spark's range partitioning and numbered
within their range; how many rows stand in the ranges before is a sum per range
and group.  So no task orders more than one range of distinct values, and a hot
value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.session import cut_lineage


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, count: str | None = None, out: str = "rank",
                  ranges: int | None = None) -> DataFrame:
    """(by..., value, out): the average rank of each distinct value within its
    group: rows below + (ties + 1) / 2.  ``count``: a column that says how many
    rows each row stands for.  Null values have no rank."""
    by = list(by)
    weight = F.sum(count) if count else F.count(F.lit(1))
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(weight.alias("_c"))
    dealt = cut_lineage(counted.repartitionByRange(n, *by, value).withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_c").alias("_all")).select(
        *by, "_range", F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = dealt.withColumn("_upto", F.sum("_c").over(within))
    joined = numbered.join(sums, [*by, "_range"])
    return joined.select(*by, value, (F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))


def rank_correlation(rows: DataFrame, by: Sequence[str], x: str, y: str, ranges: int | None = None) -> DataFrame:
    """(by..., n, pearson, spearman) of two columns; rows without both are left
    out.  Constant columns give null."""
    by = list(by)
    pairs = cut_lineage(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n")))
    ranked = (pairs.join(average_ranks(pairs, by, "_x", "_n", "_rx", ranges), [*by, "_x"])
              .join(average_ranks(pairs, by, "_y", "_n", "_ry", ranges), [*by, "_y"]))
    total = F.sum("_n")
    means = ranked.groupBy(*by).agg(total.alias("n"), *[(F.sum(F.col("_n") * F.col(v)) / total).alias(f"m{v}") for v in ("_x", "_y", "_rx", "_ry")])
    centred = ranked.join(F.broadcast(means), by) if by else ranked.crossJoin(F.broadcast(means))     # one row per group
    off = {v: F.col(v) - F.col(f"m{v}") for v in ("_x", "_y", "_rx", "_ry")}

    def corr(a: str, b: str) -> Column:
        s = lambda p, q: F.sum(F.col("_n") * off[p] * off[q])
        return F.try_divide(s(a, b), F.sqrt(s(a, a) * s(b, b)))

    return centred.groupBy(*by).agg(F.first("n").alias("n"), corr("_x", "_y").alias("pearson"), corr("_rx", "_ry").alias("spearman"))
