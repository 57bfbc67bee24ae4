"""Factor regression: standalone fits by moments, and joint least squares by a tall-skinny QR."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.stats import correlation, slope


def standalone(series: DataFrame, factors: tuple[str, ...], portfolio: str = "r") -> DataFrame:
    """factor, n_obs, beta, alpha, correlation, r_squared: one fit with intercept for each factor."""
    long = series.select(
        portfolio, F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors))).alias("f"),
    ).select(portfolio, "f.*")
    a = long.groupBy("factor").agg(
        F.count("*").alias("n_obs"), slope("x", portfolio).alias("beta"), F.avg("x").alias("mx"), F.avg(portfolio).alias("my"),
        correlation("x", portfolio).alias("correlation"),
    )
    return a.select(
        "factor", "n_obs", "beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), "correlation",
        (F.col("correlation") * F.col("correlation")).alias("r_squared"),
    )


def _triangles(rows: DataFrame, columns: list[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The triangle of a QR of the centred and scaled columns: by partition, then by 32 partitions of triangles, then of those."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} double" for n in names)

    def reduce(shift: np.ndarray, by: np.ndarray):
        def triangle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = np.zeros((0, len(names)))
            for b in batches:
                r = np.linalg.qr(np.vstack([r, (b.to_numpy(float) - shift) / by]), mode="r")
            yield pd.DataFrame(r, columns=names)

        return triangle

    first = rows.select(*columns).mapInPandas(reduce(mean, scale), schema)
    second = first.repartition(32).mapInPandas(reduce(np.zeros(len(names)), np.ones(len(names))), schema)
    return np.linalg.qr(np.vstack([np.zeros((0, len(names))), second.toPandas().to_numpy()]), mode="r")


def pivoted(r: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Householder QR of all columns but the last, that of the largest remaining norm first: order, triangle, and the last column turned alike."""
    a, k = r.copy(), r.shape[1] - 1
    order = list(range(k))
    for j in range(min(a.shape[0], k)):
        best = j + int(np.argmax(np.linalg.norm(a[j:, j:k], axis=0)))
        a[:, [j, best]], order[j], order[best] = a[:, [best, j]], order[best], order[j]
        v = a[j:, j].copy()
        alpha = np.linalg.norm(v)
        if alpha == 0:
            break
        v[0] += np.copysign(alpha, v[0])
        a[j:, j:] -= np.outer(v, 2 * (v @ a[j:, j:]) / (v @ v))
    return order, a[:, :k], a[:, k]


def design_fit(series: DataFrame, factors: tuple[str, ...], portfolio: str = "r") -> dict:
    """The joint fit with intercept as a small dictionary: coefficients (or None), status, rank, tolerance, constant factors, n.

    Factors are centred and brought to unit norm; those that never change are constant and count as zero. The rank is
    that of the pivots of a column-pivoted QR above ``max(n, k) * epsilon`` times the largest, and one for the intercept. Fewer
    rows than coefficients are ``insufficient_observations``, a lower rank is ``rank_deficient``; as many rows as coefficients fit.
    """
    k, columns = len(factors), [*factors, portfolio]
    each = [(F.avg(c).alias(f"m_{c}"), F.var_samp(c).alias(f"v_{c}"), (F.min(c) == F.max(c)).alias(f"c_{c}")) for c in columns]
    stats = series.agg(F.count("*").alias("n"), *(x for e in each for x in e)).first().asDict()
    n, mean = stats["n"], np.array([stats[f"m_{c}"] or 0.0 for c in columns])
    constant = [c for c in factors if stats[f"c_{c}"]]
    norm = np.array([0.0 if c in constant else ((stats[f"v_{c}"] or 0.0) * max(n - 1, 0)) ** 0.5 for c in factors])
    out = {"coefficients": None, "n": n, "rank": 1, "tolerance": 0.0, "constant_factors": constant, "status": "ok"}
    if n:
        r = _triangles(series, columns, mean, np.append(np.where(norm > 0, norm, 1.0), 1.0))
        r[:, :k][:, norm == 0] = 0.0
        order, triangle, turned = pivoted(r)
        pivots = np.abs(np.diagonal(triangle))
        out["tolerance"] = float(max(n, k) * np.finfo(float).eps * (pivots[0] if len(pivots) else 0.0))
        out["rank"] = 1 + int((pivots > out["tolerance"]).sum())
    if n < k + 1:
        out["status"] = "insufficient_observations"
    elif out["rank"] < k + 1:
        out["status"] = "rank_deficient"
    else:
        b = np.zeros(k)
        b[order] = np.linalg.solve(triangle[:k, :k], turned[:k]) / norm[order]
        out["coefficients"] = [float(mean[k] - mean[:k] @ b), *map(float, b)]
    return out


def joint_ols(series: DataFrame, factors: tuple[str, ...], portfolio: str = "r") -> DataFrame:
    """term, coefficient, status of the joint fit with intercept (``design_fit``).

    Rows meet in triangles of at most k + 1 rows a partition, which keeps the conditioning of the data; normal
    equations would square it.
    """
    fit = design_fit(series, factors, portfolio)
    values = fit["coefficients"] or [None] * (len(factors) + 1)
    return series.sparkSession.createDataFrame(
        [(t, c, fit["status"]) for t, c in zip(["intercept", *factors], values, strict=True)],
        "term string, coefficient double, status string",
    )


def design(series: DataFrame, factors: tuple[str, ...], portfolio: str = "r") -> DataFrame:
    """status, n_obs, rank, n_constant, constant_factors of a design: one row."""
    f = design_fit(series, factors, portfolio)
    row = (f["status"], f["n"], f["rank"], len(f["constant_factors"]), ",".join(f["constant_factors"]))
    return series.sparkSession.createDataFrame([row], "status string, n_obs long, rank int, n_constant int, constant_factors string")


def fitted(series: DataFrame, factors: tuple[str, ...], coefficients: DataFrame, portfolio: str = "r") -> DataFrame:
    """``series`` with ``fitted`` and ``residual`` of a joint fit; null where the fit has no coefficients."""
    c = {r["term"]: r["coefficient"] for r in coefficients.collect()}  # one row for each factor and the intercept
    value = F.lit(c["intercept"]).cast("double")
    for f in factors:
        value = value + F.lit(c[f]).cast("double") * F.col(f)
    return series.withColumn("fitted", value).withColumn("residual", F.col(portfolio) - F.col("fitted"))


def fit_summary(fit: DataFrame, factors: tuple[str, ...], periods: float, portfolio: str = "r") -> DataFrame:
    """metric, value, unit, n_obs, status of a table of ``fitted``: sizes, r_squared, sse, idiosyncratic volatility.

    Volatility of the residuals is over n - k - 1 degrees of freedom, annual.
    """
    k, n = len(factors), F.col("n")
    a = fit.agg(
        F.count("*").alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("sse"),
        (F.var_samp(portfolio) * (F.count("*") - 1)).alias("sst"), F.count("fitted").alias("known"),
    ).withColumn("df", n - k - 1)
    none = F.when(F.col("known") < n, "no_fit")
    idio = F.when(F.col("df") > 0, F.sqrt(F.col("sse") * float(periods) / F.nullif("df", F.lit(0))))
    rows = [
        ("n_obs", n, "intervals", F.lit("ok")), ("n_factors", F.lit(k), "count", F.lit("ok")), (
            "residual_df", F.col("df"), "count", F.lit("ok"),
        ),
        ("r_squared", 1 - F.try_divide("sse", "sst"), "fraction", none.when(F.col("sst") == 0, "constant_dependent").otherwise("ok")),
        ("sse", F.col("sse"), "fraction^2", none.otherwise("ok")),
        (
            "annualized_idiosyncratic_volatility", idio, "fraction/sqrt(year)",
            none.when(F.col("df") <= 0, "insufficient_residual_degrees_of_freedom").otherwise("ok"),
        ),
    ]
    structs = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(u).alias("unit"), n.alias("n_obs"), s.alias("status")) for m, v, u, s in rows]
    return a.select(F.explode(F.array(*structs)).alias("m")).select("m.*")


def series_correlations(series: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """series, other_series, correlation, n_obs, status of all pairs of columns, from one pass over the rows."""
    pairs = [(x, y) for x in columns for y in columns]
    a = series.agg(F.count("*").alias("n"), *(correlation(x, y).alias(f"c{k}") for k, (x, y) in enumerate(pairs)))
    few = F.when(F.col("n") < 2, "insufficient_samples")
    rows = [
        F.struct(
            F.lit(x).alias("series"), F.lit(y).alias("other_series"), F.col(f"c{k}").alias("correlation"), F.col("n").alias("n_obs"),
            few.when(F.col(f"c{k}").isNull(), "zero_volatility").otherwise("ok").alias("status"),
        )
        for k, (x, y) in enumerate(pairs)
    ]
    return a.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def excess(series: DataFrame, columns: tuple[str, ...], risk_free: str = "rf") -> DataFrame:
    """``series`` with the risk-free return taken from the given (total-return) columns; others are as supplied."""
    return series.withColumns({c: F.col(c) - F.col(risk_free) for c in columns})
