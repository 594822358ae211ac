"""Rater agreement per dimension: Pearson, Spearman, Cohen's kappa on three
tiers, MAE, disagreement rate, means.

Input is a long table (dimension, h, l).  Everything is one aggregation per
dimension plus, for Spearman, average ranks computed from per-value counts
(a hot value is one row of the count table, never a group in one task).  The
two-sided p-values need the regularised incomplete beta function: a continued
fraction, folded over a series column in the JVM, a row per dimension.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.operators.ranks import average_ranks


def tier(score: Column) -> Column:
    return (F.when(score >= fixed.TIER_EXCELLENT, F.lit(fixed.TIERS[0]))
            .when(score >= fixed.TIER_ACCEPTABLE, F.lit(fixed.TIERS[1]))
            .otherwise(F.lit(fixed.TIERS[2])))


# ---- regularised incomplete beta (continued fraction, modified Lentz) -----

FRACTION_STEPS = 1000        # two to a term; the fold stands still once it has converged
_TINY, _EPS = 1e-300, 1e-15


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8."""
    y = x + 8.0
    terms = {1: 12.0, 3: -360.0, 5: 1260.0, 7: -1680.0, 9: 1188.0}
    series = sum((1 / (c * F.pow(y, F.lit(k))) for k, c in terms.items()), F.lit(0.0))
    below = F.log(x)
    for i in range(1, 8):
        below = below + F.log(x + float(i))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _fraction(a: Column, b: Column, x: Column) -> Column:
    away = lambda v: F.when(F.abs(v) > _TINY, v).otherwise(F.lit(_TINY))

    def step(s: Column, j: Column) -> Column:
        m = F.floor((j + 1) / 2).cast("double")
        factor = F.when(j % 2 == 1, -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))).otherwise(
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        # j = 1 begins the fraction: it stands over d and leaves c at one
        c = F.when(j == 1, F.lit(1.0)).otherwise(away(1.0 + factor / s["c"]))
        d = 1.0 / away(1.0 + factor * s["d"])
        grown = F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"),
                         ((j % 2 == 1) & (j > 1) & (F.abs(d * c - 1.0) < _EPS)).alias("done"))
        return F.when(s["done"], s).otherwise(grown)

    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: s["h"])


def betainc_reg(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a)
            .otherwise(1.0 - front * _fraction(b, a, 1.0 - x) / b))


def corr_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation coefficient under the t distribution with
    n - 2 degrees of freedom (NaN without one, or for a null coefficient)."""
    df = (n - 2).cast("double")
    t2 = r * r * df / (1.0 - r * r)
    return (F.when(r.isNull() | F.isnan(r) | (df <= 0), F.lit(float("nan"))).when(F.abs(r) >= 1, F.lit(0.0))
            .otherwise(betainc_reg(df / 2.0, F.lit(0.5), df / (df + t2))))


# ---- the agreement table ---------------------------------------------------

def _avg_ranks(counts: DataFrame, col: str) -> DataFrame:
    """(dimension, value, avg_rank): rank = values below + (ties + 1) / 2."""
    vc = counts.groupBy("dimension", F.col(col).alias("v")).agg(F.sum("c").alias("c"))
    w = Window.partitionBy("dimension").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return vc.select("dimension", F.col("v").alias(col), (F.sum("c").over(w) - (F.col("c") - 1) / 2.0).alias(f"r_{col}"))


def agreement(long: DataFrame, continuous: bool = False) -> DataFrame:
    """One row per dimension with the agreement fields.  ``continuous``: scores
    have more distinct values than one task should order, so their ranks are
    found by ranges; the result is the same.

    The rows are counted per (dimension, h, l) once; ranks and every statistic
    come from that table, weighted by the counts.  Rows without both scores
    are left out."""
    c = long.where(F.col("h").isNotNull() & F.col("l").isNotNull()).groupBy("dimension", "h", "l").agg(
        F.count(F.lit(1)).alias("c"))
    ranked = (lambda v: average_ranks(c, ["dimension"], v, "c", f"r_{v}")) if continuous else (lambda v: _avg_ranks(c, v))
    x = c.join(ranked("h"), ["dimension", "h"]).join(ranked("l"), ["dimension", "l"])
    th, tl = tier(F.col("h")), tier(F.col("l"))
    close = F.abs(F.col("h") - F.col("l")) <= fixed.ALLCLOSE_ATOL + fixed.ALLCLOSE_RTOL * F.abs(F.col("l"))
    of = Window.partitionBy("dimension")
    total = F.sum("c").over(of)
    mean = lambda v: F.sum(F.col("c") * v).over(of) / total
    # centred first, so that the sums of squares do not cancel
    x = x.select("*", total.alias("n"), *[mean(F.col(v)).alias(f"m_{v}") for v in ("h", "l", "r_h", "r_l")])
    off = {v: F.col(v) - F.col(f"m_{v}") for v in ("h", "l", "r_h", "r_l")}
    avg = lambda v: F.sum(F.col("c") * v) / F.first("n")
    a = x.groupBy("dimension").agg(
        F.first("n").alias("n"), F.first("m_h").alias("mh"), F.first("m_l").alias("ml"),
        *[F.sqrt(avg(off[v] * off[v])).alias(n) for v, n in (("h", "sh"), ("l", "sl"), ("r_h", "srh"), ("r_l", "srl"))],
        avg(off["h"] * off["l"]).alias("cov"), avg(off["r_h"] * off["r_l"]).alias("rcov"),
        F.bool_and(close).alias("allclose"),
        avg(F.abs(F.col("h") - F.col("l"))).alias("mae"),
        avg((F.abs(F.col("h") - F.col("l")) >= fixed.DISAGREEMENT_GAP).cast("double")).alias("disagree"),
        avg((th == tl).cast("double")).alias("po"),
        F.bool_and(th == tl).alias("same_tiers"),
        *[avg((th == t).cast("double")).alias(f"ph_{i}") for i, t in enumerate(fixed.TIERS)],
        *[avg((tl == t).cast("double")).alias(f"pl_{i}") for i, t in enumerate(fixed.TIERS)],
    )
    gate = (F.col("sh") > fixed.MIN_STD) & (F.col("sl") > fixed.MIN_STD) & (F.col("n") >= 3)
    r = F.try_divide(F.col("cov"), F.col("sh") * F.col("sl"))
    rho = F.try_divide(F.col("rcov"), F.col("srh") * F.col("srl"))
    pe = sum((F.col(f"ph_{i}") * F.col(f"pl_{i}") for i in range(1, len(fixed.TIERS))),
             F.col("ph_0") * F.col("pl_0"))
    kappa = F.try_divide(F.col("po") - pe, 1.0 - pe)
    const = F.when(F.col("allclose"), F.lit("1.000*")).otherwise(F.lit("N/A"))
    const_p = F.when(F.col("allclose"), F.lit(0.0)).otherwise(F.lit(1.0))
    b = a.select("*", gate.alias("gate"), r.alias("r"), rho.alias("rho"), kappa.alias("kappa"))
    return b.select(
        "dimension",
        F.col("n").alias("sample_size"),
        F.when(F.col("gate"), F.format_number("r", 3)).otherwise(const).alias("pearson_r"),
        F.when(F.col("gate"), F.round(corr_p_value(F.col("r"), F.col("n")), 6)).otherwise(const_p).alias("pearson_p_value"),
        F.when(F.col("gate"), F.format_number("rho", 3)).otherwise(const).alias("spearman_rho"),
        F.when(F.col("gate"), F.round(corr_p_value(F.col("rho"), F.col("n")), 6)).otherwise(const_p).alias("spearman_p_value"),
        F.when(F.col("kappa").isNull() | F.isnan("kappa"),
               F.when(F.col("same_tiers"), F.lit("1.000*")).otherwise(F.lit("0.000")))
        .otherwise(F.format_number("kappa", 3)).alias("cohens_kappa"),
        F.round("mae", 4).alias("mean_absolute_error"),
        F.round("disagree", 4).alias("disagreement_rate"),
        F.round("mh", 2).alias("human_mean"),
        F.round("ml", 2).alias("llm_mean"),
    )


def unpivot_scores(df: DataFrame, human_prefix: str = "human_", judge_col: str = "score",
                   dims=tuple(fixed.JUDGE_DIMENSIONS) + ("average_score",)) -> DataFrame:
    """(dimension, h, l) long table from wide human columns + a judge struct."""
    items = [F.struct(F.lit(d).alias("dimension"), F.col(f"{human_prefix}{d}").cast("double").alias("h"),
                      F.col(judge_col).getField(d).cast("double").alias("l")) for d in dims]
    return df.select(F.inline(F.array(*items)))


def dimension_label(c: str = "dimension") -> Column:
    return tx.title_label(c)
