"""Transition kernels over latent bins, as rows (dyn, i, j, p). Their size is a parameter of the model, not of the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def move_kernel(spark: SparkSession, n: int, variance: float) -> DataFrame:
    """i, j, p with p proportional to exp(-(i - j)^2 / variance^2), rows summing to 1."""
    a = spark.range(n).select(F.col("id").alias("i"))
    b = spark.range(n).select(F.col("id").alias("j"))
    raw = a.join(b, F.lit(True)).withColumn("w", F.exp(-((F.col("i") - F.col("j")) ** 2) / F.lit(float(variance) ** 2)))
    return raw.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("p"))


def jump_kernel(spark: SparkSession, n: int) -> DataFrame:
    """i, j, p with all p equal."""
    a = spark.range(n).select(F.col("id").alias("i"))
    return a.join(spark.range(n).select(F.col("id").alias("j")), F.lit(True)).withColumn("p", F.lit(1.0 / n))


def product_kernel(a: DataFrame, n_b: int, b: DataFrame) -> DataFrame:
    """Kernel over pairs (row-major) from two independent ones."""
    pairs = a.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("p").alias("ap")).join(b.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("p").alias("bp")), F.lit(True))
    return pairs.select((F.col("ai") * n_b + F.col("bi")).alias("i"), (F.col("aj") * n_b + F.col("bj")).alias("j"), (F.col("ap") * F.col("bp")).alias("p"))


def isolated_kernel(spark: SparkSession, n: int, lengthscale: float, to_isolated: float) -> DataFrame:
    """Latent 0 stands apart: others reach it with `to_isolated` and it reaches all others alike; the rest move by exp(-d^2 / (2 l^2))."""
    a = spark.range(n).select(F.col("id").alias("i"))
    pairs = a.join(spark.range(n).select(F.col("id").alias("j")), F.lit(True))
    inner = (F.col("i") > 0) & (F.col("j") > 0)
    raw = pairs.withColumn("w", F.when(inner, F.exp(-0.5 * ((F.col("i") - F.col("j")) / float(lengthscale)) ** 2)).otherwise(0.0))
    total = F.sum("w").over(Window.partitionBy("i"))
    p = F.when(inner, (1 - to_isolated) * F.col("w") / total).when((F.col("i") == 0) & (F.col("j") == 0), 1 - to_isolated).when(F.col("i") == 0, F.lit(to_isolated / (n - 1))).otherwise(F.lit(to_isolated))
    return raw.select("i", "j", p.alias("p"))


def label_grid_kernel(grid: DataFrame, dims: list[tuple[str, float | None]]) -> DataFrame:
    """i, j, p between the bins of a grid (maze, flat_idx, coordinates): within a maze the product of a Gaussian for each (coordinate, deviation), rows made to sum to 1, none between mazes.

    A coordinate that both bins lack doesn't count; without a deviation only equal coordinates meet. Leave bins out of the grid to restrict the
    kernel to valid ones; a row that would be zero stays where it is.
    """
    side = lambda s: grid.select("maze", F.col("flat_idx").alias(s), *(F.col(c).alias(f"{c}_{s}") for c, _ in dims))
    w = F.lit(1.0)
    for c, std in dims:
        d = F.col(f"{c}_i") - F.col(f"{c}_j")
        both = F.col(f"{c}_i").isNull() & F.col(f"{c}_j").isNull()
        w = w * F.when(both, 1.0).otherwise(F.coalesce(F.exp(-0.5 * (d / std) ** 2) if std else (d == 0).cast("double"), F.lit(0.0)))
    pairs = side("i").join(side("j"), "maze").withColumn("w", w)  # a maze's bins are the model's
    total = F.sum("w").over(Window.partitionBy("i"))
    same = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return pairs.select("i", "j", F.when(total > 0, F.col("w") / total).otherwise(same).alias("p"))


def stacked_kernels(kernels: list[DataFrame], n: int) -> DataFrame:
    """dyn, i, j, p of several kernels and a uniform one behind them; rows of zeros become the identity."""
    spark = kernels[0].sparkSession
    out = None
    for d, k in enumerate([*kernels, jump_kernel(spark, n)]):
        total = F.sum("p").over(Window.partitionBy("i"))
        same = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
        x = k.select(F.lit(d).alias("dyn"), "i", "j", F.when(total > 0, F.col("p") / total).otherwise(same).alias("p"))
        out = x if out is None else out.unionByName(x)
    return out


def staying(n: int, p_stay: float) -> np.ndarray:
    """Matrix between n dynamics: p_stay on the diagonal, the rest shared equally."""
    if n == 1:
        return np.ones((1, 1))
    return np.where(np.eye(n, dtype=bool), p_stay, (1 - p_stay) / (n - 1))


def switching(p_to_jump: float, p_to_move: float) -> np.ndarray:
    """Matrix between moving and jumping."""
    return np.array([[1 - p_to_jump, p_to_jump], [p_to_move, 1 - p_to_move]])


def as_arrays(kernel: DataFrame, n: int) -> np.ndarray:
    """(dyn, n, n) from rows; bounded by the model's size."""
    rows = kernel.collect() if "dyn" in kernel.columns else kernel.withColumn("dyn", F.lit(0)).collect()
    out = np.zeros((1 + max((r.dyn for r in rows), default=0), n, n))
    for r in rows:
        out[r.dyn, r.i, r.j] = r.p
    total = out.sum(2, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), np.eye(n)[None])
