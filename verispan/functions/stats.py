"""Distribution functions as SQL expressions, for engines without incomplete beta or error functions.

The two-sided p-value of Student's t is a ratio of two integrals of cos^(df - 1); with Gauss-Legendre
nodes inlined as literals it stays inside one projection, in Spark and in DuckDB alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 64


@lru_cache
def _nodes() -> tuple[tuple[float, ...], tuple[float, ...]]:
    x, w = np.polynomial.legendre.leggauss(NODES)
    return tuple(x.tolist()), tuple(w.tolist())


def _sum(body, dialect: str) -> str:
    """The weighted sum over the nodes of ``body(x)``."""
    x, w = _nodes()
    if dialect == "spark":
        xs, ws = (f"array({','.join(f'{v!r}D' for v in y)})" for y in (x, w))
        return f"aggregate(arrays_zip({xs}, {ws}), 0D, (a, n) -> a + n['1'] * ({body("n['0']")}))"
    pairs = ",".join(f"{{'x': {a!r}::DOUBLE, 'w': {b!r}::DOUBLE}}" for a, b in zip(x, w))
    return f"list_sum(list_transform([{pairs}], lambda gl_node: gl_node.w * ({body('gl_node.x')})))"


def t_pvalue_sql(t: str, df: str, dialect: str = "duckdb") -> str:
    """Two-sided p-value of Student's t with real ``df >= 1``."""
    theta = f"atan(abs({t}) / sqrt({df}))"

    def wide(a: str, b: str) -> str:  # integral of cos^(df-1) from a to b
        return f"(({b}) - ({a})) / 2 * {_sum(lambda x: f'power(greatest(cos((({a}) + ({b})) / 2 + (({b}) - ({a})) / 2 * {x}), 0), ({df}) - 1)', dialect)}"

    def low(s: str) -> str:  # theta = pi/2 - s^3, smooth at the end for small df
        v = lambda x: f"(({s}) / 2 * (1 + {x}))"
        return f"({s}) / 2 * {_sum(lambda x: f'power(greatest(sin(power({v(x)}, 3)), 0), ({df}) - 1) * 3 * power({v(x)}, 2)', dialect)}"

    big = f"({wide(theta, f'least(pi() / 2, {theta} + 12 / sqrt({df}))')}) / ({wide('0', f'least(pi() / 2, 12 / sqrt({df}))')})"
    small = f"({low(f'cbrt(pi() / 2 - {theta})')}) / ({low('cbrt(pi() / 2)')})"
    return f"case when ({t}) is null or ({df}) is null then null when ({df}) < 3 then least(1.0, {small}) else least(1.0, {big}) end"


def normal_pvalue_sql(z: str, dialect: str = "duckdb") -> str:
    """Two-sided p-value of a standard normal statistic."""
    inner = _sum(lambda x: f"exp(-power(abs({z}) + 6 + 6 * {x}, 2) / 2)", dialect)
    return f"case when ({z}) is null then null else least(1.0, 12 / sqrt(2 * pi()) * {inner}) end"


def t_pvalue(t: str, df: str) -> Column:
    """``t_pvalue_sql`` over columns named ``t`` and ``df``."""
    return F.expr(t_pvalue_sql(t, df, "spark"))


def normal_pvalue(z: str) -> Column:
    return F.expr(normal_pvalue_sql(z, "spark"))


TIE = "1.00000000001"


def rounded(df, *cols: str, digits: int = 6):
    """Doubles rounded for comparison; a value within 1e-11 of a tie goes away from zero, whatever the order of its sum was."""
    return df.withColumns({c: F.round(F.col(c).cast("double") * F.lit(float(TIE)), digits) for c in cols})


def rounded_sql(sql: str) -> str:
    """``round(x, 6)`` of a statement with the same treatment of ties."""
    out, i = "", 0
    while (k := sql.find("round(", i)) >= 0:
        depth, j = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = sql[k + 6 : j - 1]
        if inner.endswith(", 6"):
            inner = f"cast(({rounded_sql(inner[:-3])}) as double) * {TIE}::double, 6"
        out += sql[i:k] + "round(" + inner + ")"
        i = j
    return out + sql[i:]
