"""Equality joins in which one key may hold a third of the rows.

``facts`` has one row per key and the number of rows that meet it.  Keys with
more than 1 / HOT of all rows are hot; there are fewer than HOT of them, so
their list is broadcast.  The rows of a hot key are dealt to SALTS parts, for
which its one row of facts is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.session import cut_lineage

HOT = 1024
SALTS = 256


def join_dealt(rows: DataFrame, facts: DataFrame, key: str, total: int, dealt_by: Column, how: str = "inner",
               count: str = "n") -> DataFrame:
    """``rows`` joined with ``facts`` (key, count, ...) on ``key``; ``total``
    is the number of rows, ``dealt_by`` a hash that spreads the rows of a key.
    The count column is not returned."""
    hot = cut_lineage(facts.where(F.col(count) * HOT > total).select(key))
    known = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))          # fewer than HOT rows
    salted = rows.join(known, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(dealt_by, F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = facts.drop(count).join(known, key, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")
