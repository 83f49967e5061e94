"""Pieces of SQL text for the oracle: special functions written out as series."""

from __future__ import annotations


def lerp(x: str, nodes) -> str:
    out = f"CASE WHEN {x} <= {float(nodes[0][0])!r} THEN CAST({float(nodes[0][1])!r} AS DOUBLE)"
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:]):
        out += f" WHEN {x} <= {float(x1)!r} THEN CAST({float(y0)!r} AS DOUBLE) + ({x} - {float(x0)!r}) / CAST({float(x1 - x0)!r} AS DOUBLE) * {float(y1 - y0)!r}"
    return out + f" ELSE CAST({float(nodes[-1][1])!r} AS DOUBLE) END"


def gammainc(a: str, x: str) -> str:
    return (
        f"list_sum(list_transform(range(0, CAST(ceil(greatest({x} - {a}, 0) + 12 * sqrt({x} + {a}) + 60) AS BIGINT)), "
        f"lambda j: exp(({a} + j) * ln({x}) - ({x}) - lgamma({a} + j + 1))))"
    )


def betainc(a: str, b: str, x: str, terms: int = 600) -> str:
    """I_x(a, b) for x not near one."""
    return (
        f"(pow(1 - ({x}), {b}) * list_sum(list_transform(range(0, {terms}), "
        f"lambda j: exp(({a} + j) * ln({x}) + lgamma({a} + {b} + j) - lgamma({b}) - lgamma({a} + 1 + j)))))"
    )


def normal_two_sided(z: str) -> str:
    return f"(CASE WHEN {z} = 0 THEN 1.0 ELSE 1 - {gammainc('0.5', f'(({z}) * ({z}) / 2)')} END)"


def normal_cdf(z: str) -> str:
    half = gammainc("0.5", f"(({z}) * ({z}) / 2)")
    return f"(CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 0 THEN 0.5 + 0.5 * {half} ELSE 0.5 - 0.5 * {half} END)"


def t_two_sided(t: str, df: str) -> str:
    x = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    return f"(CASE WHEN {t} = 0 THEN 1.0 ELSE 1 - {betainc('0.5', f'(({df}) / 2.0)', x)} END)"


def f_upper(f: str, d1: str, d2: str) -> str:
    x = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    return f"(1 - {betainc(f'(({d1}) / 2.0)', f'(({d2}) / 2.0)', x, 2000)})"


def pearson3(rel: str, out: str = "p3z") -> str:
    """CTEs giving ``z`` for the distinct (p, cs) of ``rel``; p is an exceedance probability."""
    a = "a"
    return f"""{out}_in AS (SELECT DISTINCT p, cs, 4 / (cs * cs) AS a,
        CASE WHEN cs > 0 THEN 1 - p ELSE p END AS q FROM {rel} WHERE cs IS NOT NULL AND cs <> 0),
    {out}_it AS (SELECT p, cs, a, q, CAST(0 AS DOUBLE) AS lo, a + 40 * sqrt(a) + 40 AS hi, 0 AS k FROM {out}_in
        UNION ALL SELECT p, cs, a, q,
          CASE WHEN {gammainc(a, '((lo + hi) / 2)')} < q THEN (lo + hi) / 2 ELSE lo END,
          CASE WHEN {gammainc(a, '((lo + hi) / 2)')} < q THEN hi ELSE (lo + hi) / 2 END, k + 1
        FROM {out}_it WHERE k < 60),
    {out} AS (SELECT p, cs, sign(cs) * ((lo + hi) / 2 - a) / sqrt(a) AS z FROM {out}_it WHERE k = 60)"""


def normal_ppf(rel: str, out: str = "nz") -> str:
    """CTEs giving ``z`` for the distinct cumulative probabilities ``q`` of ``rel``."""
    return f"""{out}_it AS (SELECT DISTINCT q, CAST(-10 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS k FROM {rel}
        UNION ALL SELECT q,
          CASE WHEN {normal_cdf('((lo + hi) / 2)')} < q THEN (lo + hi) / 2 ELSE lo END,
          CASE WHEN {normal_cdf('((lo + hi) / 2)')} < q THEN hi ELSE (lo + hi) / 2 END, k + 1
        FROM {out}_it WHERE k < 60),
    {out} AS (SELECT q, (lo + hi) / 2 AS z FROM {out}_it WHERE k = 60)"""
