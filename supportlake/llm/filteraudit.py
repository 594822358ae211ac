"""Audit of how document filters interact, over sorted posting lists.

Every filter of a part has the sorted list of the ids that fail it.  What is
left after any order of filters follows from the sizes of unions of lists, and
what only one filter catches from differences; both are found by galloping
k-way merges over id ranges, and the sizes of the ranges are summed.

Rows with one id, one part and the same failures are one entry with a count,
so an id that repeats is as cheap as any.  Entries are dealt by ranges of
(part, id) and sorted; a task reads them in order and merges the lists of at
most BLOCK entries at a time, whatever the size of a part.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from supportlake.llm.spread import join_dealt
from supportlake.session import cut_lineage

FILTERS = "ABCDE"
BLOCK = 1 << 16
ALL = 1 << len(FILTERS)                  # code of a part's total among its unions, which have their bits
ALONE = ALL + 1                          # and, with the filter's number added, of a filter's own failures
SUMS = "part string, code int, docs long, good long, toxic long"


def gallop(ids: list[int], at: int, bound: int) -> int:
    """The first place from ``at`` on whose id is not below ``bound``."""
    step, low, n = 1, at, len(ids)
    while at < n and ids[at] < bound:
        low, at, step = at + 1, at + step, step * 2
    return bisect_left(ids, bound, low, min(at, n))


def union_runs(lists: list[list[int]]):
    """The union of sorted lists as runs (list, from, to), each id in one run."""
    at = [0] * len(lists)
    live = [k for k, x in enumerate(lists) if x]
    while len(live) > 1:
        first = min(live, key=lambda k: lists[k][at[k]])
        own, i = lists[first], at[first]
        bound = min(lists[k][at[k]] for k in live if k != first)
        if own[i] == bound:              # several lists hold it: one run of one id, all of them move on
            yield first, i, i + 1
            for k in live:
                if lists[k][at[k]] == bound:
                    at[k] += 1
        else:
            at[first] = gallop(own, i, bound)
            yield first, i, at[first]
        live = [k for k in live if at[k] < len(lists[k])]
    for k in live:
        yield k, at[k], len(lists[k])


def difference_runs(own: list[int], others: list[list[int]]):
    """The ids of ``own`` that no other list holds, as runs (from, to)."""
    at, i = [0] * len(others), 0
    while i < len(own):
        bound = None
        for k, x in enumerate(others):
            at[k] = gallop(x, at[k], own[i])
            if at[k] < len(x) and (bound is None or x[at[k]] < bound):
                bound = x[at[k]]
        stop = len(own) if bound is None else gallop(own, i, bound)
        if stop > i:
            yield i, stop
        i = stop
        if i < len(own) and own[i] == bound:
            i += 1


def block_sums(mask, weights) -> dict[int, list[int]]:
    """Sums of every weight over the unions, the total and each filter's own
    failures, by code, for one id range.  ``mask``: failures per entry, in
    order of ids; ``weights``: arrays beside it."""
    import numpy as np

    lists, cums = [], []
    for f in range(len(FILTERS)):
        ids = np.flatnonzero(mask >> f & 1)
        lists.append(ids.tolist())
        cums.append([np.r_[0, np.cumsum(w[ids])].tolist() for w in weights])
    out = {ALL: [int(w.sum()) for w in weights]}
    for subset in range(1, ALL):
        some = [f for f in range(len(FILTERS)) if subset >> f & 1]
        total = [0] * len(weights)
        for k, a, b in union_runs([lists[f] for f in some]):
            for j, cum in enumerate(cums[some[k]]):
                total[j] += cum[b] - cum[a]
        out[subset] = total
    for f in range(len(FILTERS)):
        total = [0] * len(weights)
        for a, b in difference_runs(lists[f], lists[:f] + lists[f + 1:]):
            for j, cum in enumerate(cums[f]):
                total[j] += cum[b] - cum[a]
        out[ALONE + f] = total
    return out


def _sum_ranges(batches):
    """Batches of (part, mask, n, good, toxic) in order of (part, id) -> SUMS,
    one row per part and code of what this task holds."""
    import numpy as np
    import pyarrow as pa

    sums: dict[int, list[int]] = {}
    held, rows, now = [], 0, None

    def merge():
        nonlocal held, rows
        if held:
            mask, n, good, toxic = (np.concatenate(c) for c in zip(*held))
            for code, more in block_sums(mask, [n, n * good, n * toxic]).items():
                sums[code] = [a + b for a, b in zip(sums.get(code, [0, 0, 0]), more)]
        held, rows = [], 0

    def part_rows():
        merge()
        codes = sorted(sums)
        out = pa.RecordBatch.from_arrays([pa.array([now] * len(codes), pa.string()), pa.array(codes, pa.int32()), *[
            pa.array([sums[c][j] for c in codes], pa.int64()) for j in range(3)]], ["part", "code", "docs", "good", "toxic"])
        sums.clear()
        return out

    for b in batches:
        parts = b.column(0).to_pylist()
        cols = [b.column(i).to_numpy() for i in range(1, 5)]
        at = 0
        while at < len(parts):
            if parts[at] != now:
                if now is not None:
                    yield part_rows()
                now = parts[at]
            stop = at                    # a part's rows stand together: find its end, but no more than the block takes
            most = min(len(parts), at + BLOCK - rows)
            while stop < most and parts[stop] == now:
                stop += 1
            held.append([c[at:stop] for c in cols])
            rows += stop - at
            at = stop
            if rows >= BLOCK:
                merge()
    if now is not None:
        yield part_rows()


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a whole text (null: empty) fails."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
             100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]")]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def entries(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, doc_id, mask, n, good, toxic): all five filters, rows with equal
    part, id and mask as one with a count."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
        failures(F.col("text")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    # texts that stand under several ids, with the least of them
    copies = cut_lineage(rows.where("doc_id is not null").groupBy("digest").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    met = join_dealt(rows, copies, "digest", rows.count(), F.xxhash64("doc_id"), "left")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    entry = (met.select("part", "doc_id", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))
             .groupBy("part", "doc_id", "mask").agg(F.count("*").alias("n")))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy(
        "doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entry.join(known, "doc_id", "left").select("part", "doc_id", "mask", "n", zero("good"), zero("toxic"))


def union_sums(entry: DataFrame) -> DataFrame:
    """SUMS of every part."""
    spark = entry.sparkSession
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["part", "doc_id", "mask"]
    dealt = cut_lineage(entry).repartitionByRange(p, *key).sortWithinPartitions(*key)
    each = dealt.select("part", "mask", "n", "good", "toxic").mapInArrow(_sum_ranges, SUMS)
    return each.groupBy("part", "code").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley): one row per part, order of the five
    filters and step.

    ``docs``: (doc_id, text, lang), ``labels``: (doc_id, quality, toxic).

    Defined cases: a null text is empty, a null lang is part '' (with the rows
    whose lang is empty); rows that repeat an id each count and do not fail E by
    one another; rows with a null id neither fail E nor make others fail, and
    have no labels; an id with several labels is good or toxic if one of them
    says so; labels without a document do not count; a table without documents
    gives no rows; other columns are not looked at."""
    sums = union_sums(entries(docs, labels)).groupBy("part").agg(F.map_from_entries(F.collect_list(
        F.struct("code", F.struct("docs", "good", "toxic")))).alias("of"))                # 37 codes
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    rows = sums.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    number = lambda letter: F.ascii(letter) - ord(FILTERS[0])
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), number(x)).cast("int"))
    upto = lambda n: F.aggregate(F.slice(bits, 1, n), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumns({"before": upto(F.col("step") - 1), "after": upto(F.col("step")),
                             "filter": number(F.substr("filter_order", F.col("step"), F.lit(1)))})
    at = lambda code, what: F.coalesce(F.element_at("of", code)[what], F.lit(0).cast("long"))
    union = lambda code, what: F.when(code == 0, F.lit(0).cast("long")).otherwise(at(code, what))
    gained = lambda what: union(F.col("after"), what) - union(F.col("before"), what)
    own = F.pow(F.lit(2), F.col("filter")).cast("int")
    rows = rows.select(
        "part", "filter_order", "step", "filter", (at(F.lit(ALL), "docs") - at(F.col("after"), "docs")).alias("kept"),
        gained("docs").alias("removed"), (at(own, "docs") - gained("docs")).alias("redundant"),
        at(F.lit(ALONE) + F.col("filter"), "docs").alias("unique_fails"), gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"))
    # 120 rows per part and filter
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def oracle_sql() -> str:
    """The same rows as one DuckDB statement over ``documents`` and ``labels``."""
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + (100 * len(list_distinct(w)) < 50 * len(w))::INT * 2 + (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT * 4
    + regexp_matches(t, '[#$%&*|]')::INT * 8 + coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT * 16 AS mask
  FROM d LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
f(c, bit) AS (VALUES {letters}),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step::INT AS step, bits[step]::INT AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN x ELSE 0 END) AS toxic_lost FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
