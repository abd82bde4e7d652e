"""Small statistics: aggregates run on Spark, a handful of numbers is finished on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_tail(d: float, n: int, m: int) -> float:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov statistic."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-9:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def bin_index(x: Column, edges: list[float], closed: str = "left") -> Column:
    """Index of the bin that holds x, null outside. closed left: [a, b); right: (a, b], the lowest edge included."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        a, b = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        inside = (x >= a) & (x < b) if closed == "left" else ((x >= a) if i == 0 else (x > a)) & (x <= b)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def ols(df: DataFrame, y: str, xs: list[str]) -> np.ndarray:
    """Coefficients (intercept first) of y on xs, from sums of products made on Spark."""
    names = [F.lit(1.0), *(F.col(x) for x in xs)]
    cells = [F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i] + [F.sum(a * F.col(y)).alias(f"b{i}") for i, a in enumerate(names)]
    got = df.agg(*cells).first()
    k = len(names)
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.solve(a, np.array([got[f"b{i}"] for i in range(k)], float))


def signed_rank(df: DataFrame, keys: list[str], d: str, digits: int | None = None) -> DataFrame:
    """keys, n, w_plus, z of the Wilcoxon signed-rank test of d, by keys; zeros and missing values dropped, ties ranked by their mean, normal approximation. With digits, d is rounded first: what is equal but for the order of a sum must tie."""
    df = df if digits is None else df.withColumn(d, F.round(d, digits))
    rows = df.where(F.col(d).isNotNull() & ~F.isnan(d) & (F.col(d) != 0)).withColumn("__a", F.abs(d))
    order = Window.partitionBy(*keys).orderBy("__a")
    tie = Window.partitionBy(*keys, "__a")
    ranked = rows.withColumn("__r", F.rank().over(order) + (F.count(F.lit(1)).over(tie) - 1) / 2)
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(d) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24
    return out.withColumn("z", (F.col("w_plus") - mean) / F.sqrt(var))


def ks_statistic(df: DataFrame, x: str, group: str) -> DataFrame:
    """One row: n_a, n_b, ks, the largest distance of the two groups' (0 and 1) cumulative distributions of x."""
    edges = sorted(set(df.approxQuantile(x, [k / 64 for k in range(1, 64)], 0.01)))
    part = F.lit(0)
    for e in edges:
        part = part + (F.col(x) > e).cast("int")
    by_x = df.groupBy(x, part.alias("__p")).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("b"))
    total = df.agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("n_a"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("n_b"))
    # sums up to each value: inside ranges of values, and of whole ranges before, of which there are at most 64
    run = Window.partitionBy("__p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = by_x.groupBy("__p").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb")).select("__p", F.coalesce(F.sum("pa").over(earlier), F.lit(0)).alias("pa"), F.coalesce(F.sum("pb").over(earlier), F.lit(0)).alias("pb"))
    gap = by_x.join(F.broadcast(before), "__p").withColumn("ca", F.sum("a").over(run) + F.col("pa")).withColumn("cb", F.sum("b").over(run) + F.col("pb")).crossJoin(F.broadcast(total))
    return gap.groupBy("n_a", "n_b").agg(F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("ks"))


def ks_test(df: DataFrame, x: str, group: str) -> DataFrame:
    """ks_statistic with p, its asymptotic tail."""
    r = ks_statistic(df, x, group).first()
    rows = [] if r is None else [(r.n_a, r.n_b, float(r.ks), kolmogorov_tail(float(r.ks), r.n_a, r.n_b) if r.n_a and r.n_b else None)]
    return df.sparkSession.createDataFrame(rows, "n_a long, n_b long, ks double, p double")
