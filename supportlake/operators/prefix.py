"""The first n rows by key, for any n.

``orderBy.limit(n)`` brings n rows into one task.  Here the n-th smallest key
is found from counts: the key range is cut into equal buckets, the bucket that
holds the n-th key is cut again, until one key is left.  Each pass reads the
key column alone and leaves a count per bucket; then the rows come by a filter
on the key, which reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def nth_key(keys: DataFrame, key: str, n: int, buckets: int = BUCKETS) -> tuple[int, int] | None:
    """(t, m): of the n smallest keys all but m are below t and m are t; None
    if there are at most n.  ``key`` is a whole number; nulls do not count."""
    k = F.col(key).cast("decimal(20,0)")
    keys = keys.where(F.col(key).isNotNull())
    stats = keys.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if stats["n"] <= n:
        return None
    low, high, need = int(stats["low"]), int(stats["high"]), n
    while low < high:
        width = -(-(high - low + 1) // buckets)
        at = F.expr(f"CAST((CAST(`{key}` AS DECIMAL(20,0)) - CAST('{low}' AS DECIMAL(20,0))) div CAST('{width}' AS DECIMAL(20,0)) AS INT)")
        counts = dict(keys.where(k.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)"))
                                 & F.col(key).between(low, high)).groupBy(at.alias("b")).count().collect())      # at most ``buckets`` rows
        for b in sorted(counts):
            if need <= counts[b]:
                break
            need -= counts[b]
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low, need


def first_rows(df: DataFrame, n: int, key: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest ``key`` (rows without one
    never).  Of rows with the last key those with the least hash of the whole
    row, of equal rows any.  ``keys``: a table of the same keys that is cheaper
    to read more than once."""
    if n <= 0:
        return df.limit(0)
    found = nth_key(df.select(key) if keys is None else keys, key, n, buckets)
    if found is None:
        return df.where(F.col(key).isNotNull())
    last, tied = found
    below = df.where(F.col(key) < last)
    at = df.where(F.col(key) == last)
    if at.select(key).limit(tied + 1).count() <= tied:
        return df.where(F.col(key) <= last)
    name = "_row_hash"
    hashed = at.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    if key == name:                      # the rows of one hash
        return below.unionByName(at.limit(tied))
    return below.unionByName(first_rows(hashed, tied, name, buckets=buckets).drop(name))
