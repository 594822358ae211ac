"""Distributed ranks, prefixes of any length, hashed vectors, p-values and the
slots for a batch encoder, against plain Python."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake.functions.encoders import encoder_udf
from supportlake.operators import agreement, hashed, prefix, ranks


def plain_ranks(values):
    order = sorted(values)
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}


@pytest.mark.parametrize("ranges", [1, 7])
def test_average_ranks(spark, ranges):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], float(v)) for i, v in enumerate(rng.integers(0, 60, 500))] + [("a", 7.0)] * 300 + [("c", 1.5), ("c", None)]
    got = {(r["g"], r["v"]): r["rank"] for r in ranks.average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ranges=ranges).collect()}
    assert got == {(g, v): r for g in "abc" for v, r in plain_ranks([x for k, x in rows if k == g and x is not None]).items()}


def test_no_task_orders_all_values(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("g"), F.rand(3).alias("v"))
    counted = rows.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count()
    assert counted.agg(F.max("count")).first()[0] < 20_000 / 4
    plan = ranks.average_ranks(rows, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "SinglePartition" not in plan


def test_rank_correlation_and_agreement_of_continuous_scores(spark):
    rng = np.random.default_rng(2)
    h = rng.random(300).round(3) * 5
    rows = [("d", float(a), float(b)) for a, b in zip(h, (h + rng.random(300)).round(3))]
    df = spark.createDataFrame(rows, "dimension string, h double, l double")
    r = ranks.rank_correlation(df, ["dimension"], "h", "l").first()
    hr, lr = (plain_ranks([x[i] for x in rows]) for i in (1, 2))
    want = np.corrcoef([hr[x[1]] for x in rows], [lr[x[2]] for x in rows])[0, 1]
    assert r["n"] == 300 and r["spearman"] == pytest.approx(want, abs=1e-12)
    assert r["pearson"] == pytest.approx(np.corrcoef(h, [x[2] for x in rows])[0, 1], abs=1e-12)
    a, b = (agreement.agreement(df, continuous=c).first().asDict() for c in (True, False))
    assert {k for k in a if a[k] != b[k] and not abs(float(a[k]) - float(b[k])) < 2e-4} == set()      # sums run in another order
    constant = spark.createDataFrame([("d", 1.0, 2.0), ("d", 1.0, 3.0)], df.schema)
    assert ranks.rank_correlation(constant, ["dimension"], "h", "l").first()["spearman"] is None


@pytest.mark.parametrize("buckets", [4, 4096])
def test_first_rows(spark, buckets):
    rng = np.random.default_rng(3)
    keys = [*rng.integers(-(1 << 62), 1 << 62, 300).tolist(), *range(50), *([5] * 40), -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)] + [(None, -1)] * 3, "k long, i long").repartition(5)
    for n in (0, 1, 17, 160, 200, len(keys) - 1, len(keys), 5000):
        got = prefix.first_rows(df, n, "k", buckets=buckets).collect()
        assert sorted(r["k"] for r in got) == sorted(keys)[:n]
        assert len({r["i"] for r in got}) == len(got)
    same = spark.createDataFrame([(1, 1)] * 100, "k long, i long")
    assert prefix.first_rows(same, 30, "k").count() == 30
    plan = prefix.first_rows(df.where("k <> 5"), 200, "k")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_hashed_vectors(spark):
    texts = ["The cat sat on the mat, the CAT", None, "", "a b c", "Ünïcödé words über alles", "mat cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    enc = hashed.fit(df, "text", 32)
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32
    words = [[w for w in re.findall(r"\w{2,}", (t or "").lower())] for t in texts]
    df_of = {b: sum(b in {bucket(w) for w in ws} for ws in words) for b in range(32)}
    idf = [math.log((1 + len(texts)) / (1 + df_of[b])) + 1 for b in range(32)]
    assert enc.idf == pytest.approx(idf)
    for r in enc.with_vector(df, "text").collect():
        v = np.zeros(32)
        for w in words[r["id"]]:
            v[bucket(w)] += idf[bucket(w)]
        size = np.sqrt((v * v).sum())
        assert r["embedding"] == pytest.approx((v / size if size else v).tolist())
    other = spark.createDataFrame([(9, "mat never seen")], "id long, text string")       # a text of another corpus
    assert enc.entries(other, "text", ["id"]).count() == len({bucket(w) for w in ("mat", "never", "seen")})
    none = hashed.fit(df.limit(0), "text", 32)
    assert none.with_vector(df.limit(0), "text").collect() == []


def test_encoder_slot(spark):
    loads = spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], float)

    df = spark.createDataFrame([(i, None if i == 3 else "a" * i) for i in range(40)], "id long, text string").coalesce(2)
    got = {r["id"]: r["v"] for r in df.select("id", encoder_udf(make)(F.col("text")).alias("v")).collect()}
    assert got == {i: [0.0, 0.0] if i == 3 else [float(i), float(i)] for i in range(40)} and loads.value <= 4


def t_tail(t, df):
    """Two-sided tail of the t distribution by Simpson's rule."""
    ln = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    f = lambda x: math.exp(ln - (df + 1) / 2 * math.log1p(x * x / df))
    n, h = 20_000, t / 20_000
    inner = f(0) + f(t) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))
    return 1 - 2 * inner * h / 3


def test_p_values_are_native_and_right(spark):
    cases = [(0.5, 10), (-0.5, 10), (0.01, 40), (0.928, 30), (0.2, 1000), (0.03, 5000), (0.999, 4), (0.3, 3)]
    df = spark.createDataFrame([(r, n) for r, n in cases] + [(1.0, 10), (None, 10), (0.4, 2), (0.0, 12)], "r double, n long")
    out = df.withColumn("p", agreement.corr_p_value(F.col("r"), F.col("n")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = [x["p"] for x in out.collect()]
    for (r, n), p in zip(cases, got):
        assert p == pytest.approx(t_tail(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=1e-9), (r, n)
    assert got[8] == 0.0 and math.isnan(got[9]) and math.isnan(got[10]) and got[11] == pytest.approx(1.0)
    g = spark.range(1, 60).select("id", agreement.ln_gamma(F.col("id") / 4.0).alias("g")).collect()
    assert all(x["g"] == pytest.approx(math.lgamma(x["id"] / 4), abs=1e-12) for x in g)
