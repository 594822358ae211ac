"""Penalised logistic regression in DuckDB SQL, for the oracles of the fitted
heads: accelerated gradient descent as a recursive query.  The loss is strictly
convex in what predictions depend on, so any solver that converges gives the
same probabilities."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, from its polynomial."""
    bits = "list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, {0})"
    byte = bits.format("xor(c, x)")
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, x: {byte}, 4294967295::BIGINT), 4294967295)"


def fit_cte(name: str, train: str, classes: str, reg: str, steps: int, step: float, beta: float) -> str:
    """CTEs ``{name}_fit`` (one row, ``w``: per class the weights and then the
    intercept, and ``f``: the number of features) from ``train`` (i from 1 on, y
    from 0 on, w summing to one, x DOUBLE[])."""
    return f"""{name}_f AS (SELECT max(len(x))::INTEGER AS f, ({classes})::INTEGER AS k, ({reg})::DOUBLE AS reg FROM {train}),
{name}_x AS (SELECT j, list(x[j] ORDER BY i) AS col FROM {train}, {name}_f, unnest(range(1, f + 1)) u(j) GROUP BY j),
{name}_c AS (SELECT unnest(range(k))::INTEGER AS c, f, reg FROM {name}_f),
{name}_walk(n, w, v) AS (
  SELECT 0, list_resize([]::DOUBLE[], (f + 1) * k, 0.0::DOUBLE), list_resize([]::DOUBLE[], (f + 1) * k, 0.0::DOUBLE) FROM {name}_f
  UNION ALL (
    WITH s AS (SELECT n, w, v, list_transform(list_zip(w, v), lambda z: z[1] + {beta} * z[2]) AS y FROM {name}_walk WHERE n < {steps}),
    z AS (SELECT t.i, c, t.w, (t.y = c)::INTEGER AS own, list_inner_product(s.y[c * (f + 1) + 1:c * (f + 1) + f], t.x) + s.y[(c + 1) * (f + 1)] AS z
          FROM s, {train} t, {name}_c),
    e AS (SELECT i, c, w, own, exp(z - max(z) OVER (PARTITION BY i)) AS e FROM z),
    g AS (SELECT i, c, w * (e / sum(e) OVER (PARTITION BY i) - own) AS g FROM e),
    r AS (SELECT c, list(g ORDER BY i) AS g, sum(g) AS all_g FROM g GROUP BY c),
    d AS (SELECT r.c * (f + 1) + j AS place, list_inner_product(r.g, q.col) + reg * s.y[r.c * (f + 1) + j] AS d
            FROM r, {name}_x q, {name}_f, s UNION ALL SELECT (r.c + 1) * (f + 1), all_g FROM r, {name}_f),
    l AS (SELECT list(d ORDER BY place) AS d FROM d),
    m AS (SELECT n, w, list_transform(list_zip(v, d), lambda z: {beta} * z[1] - {step} * z[2]) AS v FROM s, l)
    SELECT n + 1, list_transform(list_zip(w, v), lambda z: z[1] + z[2]), v FROM m)),
{name}_fit AS (SELECT w, f, k FROM {name}_walk, {name}_f WHERE n = {steps})"""


def predict_cte(name: str, rows: str) -> str:
    """CTE ``{name}_pred`` (id, c, p): the most probable class of each of
    ``rows`` (id, x) and its probability."""
    return f"""{name}_z AS (SELECT id, c, list_inner_product(w[c * (f + 1) + 1:c * (f + 1) + f], x) + w[(c + 1) * (f + 1)] AS z
  FROM {name}_fit, {rows}, unnest(range(k)) u(c)),
{name}_e AS (SELECT id, c, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM {name}_z),
{name}_p AS (SELECT id, c, e / sum(e) OVER (PARTITION BY id) AS p FROM {name}_e),
{name}_pred AS (SELECT id, arg_max(c, p) AS c, max(p) AS p FROM {name}_p GROUP BY id)"""
