"""Statistical kernels that SQL expressions cannot state: exact rank distributions, robust regression,
random intercepts, negative-binomial counts and t quantiles.

Each runs over the units of one stratum (a feature within a run), which is bounded by the design of
an experiment, not by the size of the table. numpy is all they need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispan.functions.stats import normal_pvalue
from verispan.operators import contrasts


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), vectorised."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if not np.any(np.abs(d * c - 1) > 1e-15):  # further factors are 1 but for rounding
                break
        out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(turn, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(level: float, df: np.ndarray) -> np.ndarray:
    """The t beyond which (1 - level) of the two-sided probability lies, by bisection on log t."""
    df = np.asarray(df, float)
    low, high = np.full(df.shape, -20.0), np.full(df.shape, 40.0)
    for _ in range(90):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):  # no number lies between
            break
        up = t_two_sided(np.exp(mid), df) > 1 - level
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.exp((low + high) / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def t_margin(df: pd.Series) -> pd.Series:
    """The 95 % two-sided t quantile of each number of degrees of freedom; null stays null."""
    out = pd.Series(np.nan, index=df.index)
    ok = df.notna() & (df > 0)
    if ok.any():
        values, where = np.unique(df[ok].to_numpy(float), return_inverse=True)
        out[ok] = t_quantile(0.95, values)[where]
    return out


def with_interval(rows: DataFrame, effect: str = "effect", statistic: str = "statistic", df: str = "df", error: Column | None = None) -> DataFrame:
    """``ci_low`` and ``ci_high`` of tested rows: effect -+ t quantile times the standard error.

    The error is that of a Welch contrast from the moments of its sides unless ``error`` gives it; an
    effect of zero, whose statistic is zero, has an interval like any other.
    """
    if error is None:
        error = F.sqrt(F.try_divide("var_test", "n_test") + F.try_divide("var_reference", "n_reference"))
    margin = F.when(F.col(statistic).isNotNull(), error) * t_margin(F.col(df))
    return rows.withColumns({"ci_low": F.col(effect) - margin, "ci_high": F.col(effect) + margin})


def u_counts(n: int, m: int) -> tuple[int, ...]:
    """How many arrangements of n and m ranks give each U, exactly."""
    row = [1]
    # generating function: product over i of (1 - q^(m+i)) / (1 - q^i)
    size = n * m + 1
    row = [1] + [0] * (size - 1)
    for i in range(1, n + 1):
        k = m + i
        for j in range(size - 1, k - 1, -1):
            row[j] -= row[j - k]
        for j in range(i, size):
            row[j] += row[j - i]
    return tuple(row)


@lru_cache(512)
def u_pvalues(n: int, m: int) -> np.ndarray:
    """The exact two-sided p of each U of n and m values without ties."""
    tails = list(accumulate(reversed(u_counts(n, m))))[::-1]
    whole, top = math.comb(n + m, n), n * m
    return np.array([min(1.0, 2 * tails[max(u, top - u)] / whole) for u in range(top + 1)])


def rank_pvalue(n: int, m: int, u: float, ties: float, most: int) -> float:
    """Two-sided p of U: exact if a side has at most 8 values and no value (``most`` equal ones) is tied, else normal with tie (``ties``: sum of t^3 - t) and continuity correction."""
    if min(n, m) <= 8 and most == 1:
        return float(u_pvalues(n, m)[int(u)])
    k = n + m
    sd = math.sqrt(max(0.0, n * m / 12 * (k + 1 - ties / (k * (k - 1)))))
    z = max(0.0, abs(u - n * m / 2) - 0.5) / sd if sd else 0.0
    return min(1.0, normal_two_sided(z)) if sd else 1.0


@F.pandas_udf(T.DoubleType())
def rank_pvalues(n: pd.Series, m: pd.Series, u: pd.Series, ties: pd.Series, most: pd.Series) -> pd.Series:
    """``rank_pvalue`` of each row, computed once per distinct row of a batch; null stays null."""
    out = pd.Series(np.nan, index=u.index)
    ok = u.notna()
    if ok.any():
        rows, where = np.unique(np.column_stack([c[ok].to_numpy(float) for c in (n, m, u, ties, most)]), axis=0, return_inverse=True)
        out[ok] = np.array([rank_pvalue(int(a), int(b), v, t, int(k)) for a, b, v, t, k in rows])[where.reshape(-1)]
    return out


@lru_cache(64)
def w_counts(n: int) -> tuple[int, ...]:
    """How many sign patterns of n ranks give each positive rank sum, exactly."""
    row = [1]
    for i in range(1, n + 1):
        new = row + [0] * i
        for j, v in enumerate(row):
            new[j + i] += v
        row = new
    return tuple(row)


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inv, count = np.unique(x, return_inverse=True, return_counts=True)
    end = np.cumsum(count)
    return (end - (count - 1) / 2)[inv]


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(U of x, two-sided p, rank-biserial) of two samples by ``rank_pvalue``."""
    n, m = len(x), len(y)
    both = np.concatenate([x, y])
    u = average_ranks(both)[:n].sum() - n * (n + 1) / 2
    ties = np.unique(both, return_counts=True)[1]
    return u, rank_pvalue(n, m, u, float((ties**3 - ties).sum()), int(ties.max())), 2 * u / (n * m) - 1


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """(smaller rank sum, two-sided p) of paired differences, zeros dropped: exact up to 50 without ties or zeros, else normal with tie correction."""
    live = d[d != 0]
    n = len(live)
    if n == 0:
        return 0.0, 1.0
    r = average_ranks(np.abs(live))
    plus = r[live > 0].sum()
    w = min(plus, n * (n + 1) / 2 - plus)
    ties = np.unique(np.abs(live), return_counts=True)[1]
    if n <= 50 and n == len(d) and ties.max() == 1:
        return w, min(1.0, 2 * sum(w_counts(n)[: int(w) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    return w, normal_two_sided((w - n * (n + 1) / 4) / sd) if sd else 1.0


def ols_hc3(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(coefficients, standard errors robust to heteroscedasticity, HC3); None unless rank is full and rows exceed columns by two."""
    n, p = x.shape
    if n <= p + 1 or np.linalg.matrix_rank(x) < p:
        return None
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    lever = np.einsum("ij,jk,ik->i", x, inv, x)
    if np.any(lever > 1 - 1e-12):
        return None
    meat = (x * (e / (1 - lever))[:, None] ** 2).T @ x
    return beta, np.sqrt(np.diag(inv @ meat @ inv))


def random_intercept(x: np.ndarray, y: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fixed effects, standard errors) of a random-intercept model by REML, profiled over the variance ratio."""
    n, p = x.shape
    _, inv, size = np.unique(unit, return_inverse=True, return_counts=True)
    sx = np.zeros((len(size), p))
    np.add.at(sx, inv, x)
    sy = np.bincount(inv, y, len(size))

    def fit(ratio: float):
        w = ratio / (1 + ratio * size)
        xx = x.T @ x - (sx * w[:, None]).T @ sx
        xy = x.T @ y - sx.T @ (w * sy)
        beta = np.linalg.solve(xx, xy)
        r = y - x @ beta
        sr = np.bincount(inv, r, len(size))
        s2 = (r @ r - (w * sr**2).sum()) / (n - p)
        value = (n - p) * math.log(max(s2, 1e-300)) + np.log1p(ratio * size).sum() + np.linalg.slogdet(xx)[1]
        return value, beta, np.sqrt(np.diag(np.linalg.inv(xx)) * s2)

    grid = np.concatenate(([0.0], np.exp(np.linspace(-12, 12, 49))))
    i = int(np.argmin([fit(g)[0] for g in grid]))
    a, b = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    gold = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - gold * (b - a), a + gold * (b - a)
        if fit(c)[0] < fit(d)[0]:
            b = d
        else:
            a = c
    best = min((grid[i], (a + b) / 2), key=lambda g: fit(g)[0])
    return fit(best)[1:]


def size_factors(counts: np.ndarray) -> np.ndarray:
    """Median-of-ratios size factors of genes x samples; genes with a zero are no reference."""
    live = (counts > 0).all(axis=1)
    if not live.any():
        raise ValueError("every gene has a zero: no size factors")
    logs = np.log(counts[live])
    return np.exp(np.median(logs - logs.mean(axis=1, keepdims=True), axis=0))


def negative_binomial(y: np.ndarray, x: np.ndarray, size: np.ndarray, dispersion: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients on the natural log, standard errors, dispersion) of a log-link GLM by iterated weighted least squares.

    The dispersion is the maximum of the adjusted profile likelihood over a fixed log grid.
    """

    def fit(alpha: float):
        mu = np.maximum(y / size, 0.1) * size
        beta = np.zeros(x.shape[1])
        for _ in range(100):
            w = mu / (1 + alpha * mu)
            z = np.log(mu / size) + (y - mu) / mu
            new = np.linalg.solve((x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), (x * w[:, None]).T @ z)
            new = np.clip(new, -30, 30)
            mu = np.maximum(size * np.exp(x @ new), 1e-8)
            if np.max(np.abs(new - beta)) < 1e-8:
                beta = new
                break
            beta = new
        info = (x * (mu / (1 + alpha * mu))[:, None]).T @ x
        r = 1 / alpha
        ll = sum(math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) for v in y) + (r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum()
        return ll - 0.5 * np.linalg.slogdet(info)[1], beta, np.sqrt(np.diag(np.linalg.inv(info)))

    if dispersion is None:
        grid = np.exp(np.linspace(math.log(1e-6), math.log(20), 40))
        dispersion = float(grid[int(np.argmax([fit(a)[0] for a in grid]))])
    _, beta, se = fit(dispersion)
    return beta, se, dispersion


def design(batch: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Intercept, the tested column, and indicator columns of all batches but the first."""
    levels = sorted({b for b in batch if b is not None})
    cols = [np.ones(len(batch)), extra] + [(np.array([b == k for b in batch])).astype(float) for k in levels[1:]]
    return np.column_stack(cols)


def rank_tests(units: DataFrame, strata: Sequence[str], group: str, test: str, reference: str, value: str = "value") -> DataFrame:
    """Mann-Whitney per stratum with the exact distribution where it applies.

    Ranks, U and ties are windows and aggregates; Python only sees one row per stratum and gives its
    p, once per distinct sizes, U and ties of a batch. A stratum without values of one side has no U and no p.
    """
    rows = units.filter(F.col(value).isNotNull() & F.col(group).isin(test, reference)).select(*strata, F.col(group).alias("__g"), (F.col(value).cast("double") + F.lit(0.0)).alias("__v"))  # -0.0 is 0.0
    ranked = contrasts.average_ranks(rows, strata, "__v", "__r")
    is_test = F.col("__g") == test
    levels = ranked.groupBy(*strata, "__v").agg(F.count("*").alias("__t"), F.count_if(is_test).alias("__a"), F.sum(F.when(is_test, F.col("__r"))).alias("__rs"))
    out = levels.groupBy(*strata).agg(
        F.sum("__a").alias("n_test"), F.sum(F.col("__t") - F.col("__a")).alias("n_reference"), F.sum("__rs").alias("__rs"), F.sum(F.col("__t").cast("double") ** 3 - F.col("__t")).alias("__ties"), F.max("__t").alias("__most")
    )
    n, m = F.col("n_test"), F.col("n_reference")
    out = out.withColumn("u", F.when((n > 0) & (m > 0), F.col("__rs") - n * (n + 1) / 2))
    out = out.withColumns({"rank_biserial": F.try_divide(2 * F.col("u"), n * m) - 1, "p_value": rank_pvalues("n_test", "n_reference", "u", "__ties", "__most")})
    return out.select(*strata, "n_test", "n_reference", "u", "rank_biserial", "p_value")


def signed_rank_tests(pairs: DataFrame, strata: Sequence[str], difference: str) -> DataFrame:
    """Wilcoxon signed rank of paired differences per stratum."""
    kinds = dict(pairs.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = wilcoxon(pdf["__d"].to_numpy(float))
        return pd.DataFrame([(*key, len(pdf), w, p)], columns=[*strata, "n", "w", "p_value"])

    rows = pairs.filter(F.col(difference).isNotNull()).select(*strata, F.col(difference).alias("__d"))
    return rows.groupBy(*strata).applyInPandas(run, ", ".join(f"`{s}` {kinds[s]}" for s in strata) + ", n long, w double, p_value double")


def adjusted_contrast(units: DataFrame, strata: Sequence[str], group: str, test: str, reference: str, batch: str, value: str = "value") -> DataFrame:
    """Group effect adjusted for batch by least squares with HC3 errors and a normal p, per stratum.

    The batch is absorbed by centring within it, and everything the estimate and its robust error
    need are moments of (stratum, batch, group), so a stratum may hold any share of all rows and any
    number of batches. Rows without a batch count to the first one.
    """
    live = units.filter(F.col(value).isNotNull() & F.col(group).isin(test, reference))
    m = live.groupBy(*strata, F.col(batch).cast("string").alias("__b"), (F.col(group) == test).cast("double").alias("__x")).agg(F.count("*").alias("__n"), F.avg(value).alias("__y"), F.var_pop(value).alias("__v"))
    whole = W.partitionBy(*strata)
    m = m.withColumn("__b", F.coalesce("__b", F.min("__b").over(whole)))
    inside = W.partitionBy(*strata, "__b")
    m = m.withColumn("__nb", F.sum("__n").over(inside))
    m = m.withColumns({"__xt": F.col("__x") - F.sum(F.col("__n") * F.col("__x")).over(inside) / F.col("__nb"), "__yb": F.sum(F.col("__n") * F.col("__y")).over(inside) / F.col("__nb")})
    m = m.withColumns({"__sxx": F.sum(F.col("__n") * F.col("__xt") ** 2).over(whole), "__sxy": F.sum(F.col("__n") * F.col("__xt") * (F.col("__y") - F.col("__yb"))).over(whole)})
    m = m.withColumns({"__beta": F.try_divide("__sxy", "__sxx"), "__h": 1 / F.col("__nb") + F.try_divide(F.col("__xt") ** 2, F.col("__sxx"))})
    off = F.col("__y") - F.col("__yb") - F.col("__beta") * F.col("__xt")
    m = m.withColumn("__meat", F.try_divide(F.col("__xt") ** 2 * F.col("__n") * (F.col("__v") + off**2), (1 - F.col("__h")) ** 2))
    out = m.groupBy(*strata).agg(
        F.sum("__n").alias("n"), F.greatest(F.countDistinct("__b"), F.lit(1)).alias("__batches"), F.max("__h").alias("__h"), F.max("__beta").alias("__beta"), F.max("__sxx").alias("__sxx"), F.sqrt(F.sum("__meat")).alias("__meat")
    )
    out = out.withColumn("__se", F.try_divide("__meat", "__sxx"))
    ok = F.coalesce((F.col("n") > F.col("__batches") + 2) & (F.col("__sxx") > 1e-9) & (F.col("__h") <= 1 - 1e-12) & (F.col("__se") > 0), F.lit(False))
    out = out.select(*strata, "n", F.when(ok, F.col("__beta")).alias("effect"), F.when(ok, F.col("__se")).alias("standard_error"), F.when(ok, "tested").otherwise("not_estimable").alias("status"))
    out = out.withColumn("__z", F.try_divide("effect", "standard_error")).withColumn("p_value", normal_pvalue("__z"))
    return out.select(*strata, "n", "effect", "standard_error", "p_value", "status")


def mixed_trend(units: DataFrame, strata: Sequence[str], unit: str, time: str, batch: str | None = None, value: str = "value") -> DataFrame:
    """Slope over time per stratum: random intercepts where units repeat, else least squares with HC3; at least 4 units and 3 times."""
    kinds = dict(units.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__u", "__t", "__v"])
        n_units, n_times = pdf["__u"].nunique(), pdf["__t"].nunique()
        row = (None, None, None, "descriptive_small_n")
        if n_units >= 4 and n_times >= 3:
            x = design(pdf["__b"].to_numpy(object), pdf["__t"].to_numpy(float))
            y = pdf["__v"].to_numpy(float)
            repeated = len(pdf) > n_units
            try:
                got = random_intercept(x, y, pdf["__u"].to_numpy(str)) if repeated and len(pdf) > x.shape[1] and np.linalg.matrix_rank(x) == x.shape[1] else ols_hc3(x, y)
            except np.linalg.LinAlgError:
                got = None
            row = (None, None, None, "not_estimable") if got is None or not got[1][1] > 0 else (got[0][1], got[1][1], normal_two_sided(got[0][1] / got[1][1]), "mixed_model" if repeated else "ols_hc3")
        return pd.DataFrame([(*key, n_units, n_times, *row)], columns=[*strata, "units", "times", "slope", "standard_error", "p_value", "method"])

    live = units.dropna(subset=[*strata, unit, time, value])
    rows = live.select(*strata, F.col(unit).cast("string").alias("__u"), F.col(time).cast("double").alias("__t"), (F.col(batch).cast("string") if batch else F.lit("")).alias("__b"), F.col(value).alias("__v"))
    return rows.groupBy(*strata).applyInPandas(run, ", ".join(f"`{s}` {kinds[s]}" for s in strata) + ", units long, times long, slope double, standard_error double, p_value double, method string")


def count_contrasts(counts: DataFrame, gene: str, sample: str, group: str, test: str, reference: str, count: str = "value", min_total: int = 10, min_genes: int = 1) -> DataFrame:
    """Negative-binomial log2 fold change per gene over a complete gene x sample matrix.

    Refuses gaps, non-integral or negative counts, empty libraries and fewer than ``min_genes`` genes of at least ``min_total``. Size factors come from one
    aggregate over genes (median of ratios per sample), so only one gene's samples meet in a task.
    Estimates are maximum likelihood with the dispersion of each gene; nothing is shrunken.
    """
    live = counts.filter(F.col(group).isin(test, reference)).select(F.col(gene).alias("gene"), F.col(sample).alias("sample"), F.col(group).alias("g"), F.col(count).cast("double").alias("y"))
    shape = live.agg(F.countDistinct("gene").alias("genes"), F.countDistinct("sample").alias("samples"), F.count("y").alias("n"), F.count("*").alias("rows"), F.count_if((F.col("y") < 0) | (F.col("y") != F.floor("y"))).alias("bad")).first()
    if shape["bad"] or shape["n"] != shape["rows"] or shape["rows"] != shape["genes"] * shape["samples"]:
        raise ValueError("counts must be a complete matrix of non-negative integers")
    logs = live.groupBy("gene").agg(F.min("y").alias("low"), F.avg(F.log(F.greatest("y", F.lit(1.0)))).alias("center")).filter("low > 0")
    ratios = live.join(logs.select("gene", "center"), "gene").groupBy("sample").agg(F.exp(F.median(F.log("y") - F.col("center"))).alias("size"))
    if ratios.count() != shape["samples"]:
        raise ValueError("every gene has a zero: no size factors")
    totals = live.groupBy("gene").agg(F.sum("y").alias("t")).filter(F.col("t") >= min_total)
    if totals.limit(min_genes).count() < min_genes:
        raise ValueError(f"fewer than {min_genes} genes with enough counts")
    rows = live.join(totals.select("gene"), "gene", "left_semi").join(ratios, "sample")
    kind = dict(live.dtypes)["gene"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), (pdf["g"] == test).to_numpy(float)])
        try:
            beta, se, alpha = negative_binomial(pdf["y"].to_numpy(float), x, pdf["size"].to_numpy(float))
            row = (beta[1] / math.log(2), se[1] / math.log(2), normal_two_sided(beta[1] / se[1]), alpha, "tested")
        except (np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
            row = (None, None, None, None, "not_estimable")
        return pd.DataFrame([(*key, *row)], columns=["gene", "log2fc", "standard_error", "p_value", "dispersion", "status"])

    return rows.groupBy("gene").applyInPandas(run, f"gene {kind}, log2fc double, standard_error double, p_value double, dispersion double, status string")
