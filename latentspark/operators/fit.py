"""Fitting the tuning of a latent model: weighted statistics on Spark, small solves, an EM loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentspark.functions.seeds import uniform
from latentspark.sources.shared import passing

from . import decode
from .structure import Kernel


def weighted_stats(posterior: DataFrame, counts: DataFrame, keys: list[str], gain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(latent, unit, a: sum of p n) and (latent, b: sum of p, times the bin's gain if given). Only counts above zero are joined."""
    a = posterior.join(counts.where("n > 0"), [*keys, "bin"]).groupBy("latent", "unit").agg(F.sum(F.col("p") * F.col("n")).alias("a"))
    weighted = posterior.join(gain, [*keys, "bin"]).withColumn("p", F.col("p") * F.col("gain")) if gain is not None else posterior
    return a, weighted.groupBy("latent").agg(F.sum("p").alias("b"))


def empirical_tuning(a: DataFrame, b: DataFrame, units: DataFrame, eps: float = 1e-12) -> DataFrame:
    """latent, unit, rate = a / (b + eps); units that were never seen with a latent have rate 0."""
    frame = b.join(F.broadcast(units.select("unit").distinct()), F.lit(True))
    return frame.join(a, ["latent", "unit"], "left").select("latent", "unit", (F.coalesce("a", F.lit(0.0)) / (F.col("b") + eps)).alias("rate"))


def map_posterior(posterior: DataFrame, keys: list[str]) -> DataFrame:
    """posterior with p 1 for the most probable latent of each bin, the least of several, and 0 for others."""
    best = F.row_number().over(Window.partitionBy(*keys, "bin").orderBy(F.desc("p"), "latent")) == 1
    return posterior.withColumn("p", best.cast("double"))


def tuning_basis_nd(kernels: list[np.ndarray], explained: float = 0.999, bias: bool = True) -> np.ndarray:
    """The basis of a grid of several dimensions (row-major latents): the Kronecker product of each dimension's basis without its constant, and one constant column."""
    out = np.ones((1, 1))
    for k in kernels:
        out = np.kron(out, tuning_basis(k, explained, False))
    return np.column_stack([np.ones(len(out)), out]) if bias else out


def tuning_basis(kernel: np.ndarray, explained: float = 0.999, bias: bool = True) -> np.ndarray:
    """(latent, column): left singular vectors up to the explained share of singular mass, scaled by the fourth root, and a constant column."""
    u, s, _ = np.linalg.svd(kernel)
    keep = int(np.searchsorted(np.cumsum(s) / s.sum(), explained)) + 1
    out = u[:, :keep] * s[:keep] ** 0.25
    return np.column_stack([np.ones(len(kernel)), out]) if bias else out


def rbf(n: int, lengthscale: float) -> np.ndarray:
    d = np.subtract.outer(np.arange(n), np.arange(n))
    return np.exp(-0.5 * (d / lengthscale) ** 2)


def gaussian_m_step(basis: np.ndarray, a: np.ndarray, b: np.ndarray, noise: float, prior: float) -> np.ndarray:
    """(latent, unit) rates: ridge solution of (B' T B / noise^2 + I / prior^2) w = B' A / noise^2."""
    left = basis.T @ (basis * b[:, None]) / noise**2 + np.eye(basis.shape[1]) / prior**2
    return basis @ np.linalg.solve(left, basis.T @ a / noise**2)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def poisson_unit(basis: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float, rounds: int = 100, rough: float = 0.0) -> np.ndarray:
    """Weights of one unit: least -sum(a ln f - f b) + |w|^2 / (2 prior^2) + rough |second differences of basis w|^2 / 2, f = softplus(basis w), by damped Newton steps with Fisher curvature."""
    w = np.zeros(basis.shape[1])
    bent = np.diff(basis, 2, axis=0) if rough else np.zeros((0, basis.shape[1]))
    ridge = np.eye(len(w)) / prior**2 + rough * bent.T @ bent
    w[0] = np.log(np.expm1(max(a.sum() / max(b.sum(), 1e-12), 1e-6)))

    def loss(w: np.ndarray) -> float:
        f = softplus(basis @ w) + 1e-20
        return float(-(a * np.log(f) - f * b).sum() + w @ ridge @ w / 2)

    now = loss(w)
    for _ in range(rounds):
        x = basis @ w
        f, s = softplus(x) + 1e-20, 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        grad = basis.T @ ((b - a / f) * s) + ridge @ w
        step = np.linalg.solve(basis.T @ (basis * (b * s * s / f)[:, None]) + ridge, grad)
        size = 1.0
        while size > 1e-8 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-8:
            break
        w, gain, now = w - size * step, now - new, new
        if gain < 1e-10 * max(1.0, abs(now)):
            break
    return w


def poisson_m_step(a: DataFrame, b: DataFrame, units: DataFrame, basis: np.ndarray, prior: float, rough: float = 0.0) -> DataFrame:
    """latent, unit, rate: one convex problem for each unit, dealt to the executors."""
    latents = len(basis)
    total = np.zeros(latents)
    for r in b.collect():  # a row for each latent
        total[r.latent] = r.b
    frame = units.select("unit").distinct().join(a, "unit", "left")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        weight = np.zeros(latents)
        seen = g.dropna(subset=["latent"])
        weight[seen["latent"].astype(int)] = seen["a"]
        rate = softplus(basis @ poisson_unit(basis, weight, total, prior, rough=rough))
        return pd.DataFrame({"latent": np.arange(latents), "unit": g["unit"].iloc[0], "rate": rate})

    kind = units.schema["unit"].dataType.simpleString()
    return frame.groupBy("unit").applyInPandas(solve, f"latent long, unit {kind}, rate double")


def init_random(bins: DataFrame, keys: list[str], latents: int, seed: int = 0) -> DataFrame:
    """keys, bin, latent, p: hashed numbers, summing to 1 in a bin."""
    rows = bins.select(*keys, "bin").withColumn("latent", F.explode(F.sequence(F.lit(0), F.lit(latents - 1))))
    u = uniform(F.lit(str(seed)), *(F.col(k).cast("string") for k in [*keys, "bin", "latent"]))
    return rows.withColumn("__u", u).withColumn("p", F.col("__u") / F.sum("__u").over(Window.partitionBy(*keys, "bin"))).drop("__u")


def init_labels(labels: DataFrame, keys: list[str], latents: int, low: float, high: float, noise: float = 1e-3, seed: int = 0) -> DataFrame:
    """keys, bin, latent, p from a label: its bin of `latents` equal ones between low and high, with a little noise; uniform where it lies outside or is missing."""
    at = F.floor((F.col("label") - low) / (high - low) * latents)
    rows = labels.withColumn("__at", F.when(F.col("label").between(low, high), F.least(at, F.lit(latents - 1)))).withColumn("latent", F.explode(F.sequence(F.lit(0), F.lit(latents - 1))))
    u = uniform(F.lit(str(seed)), *(F.col(k).cast("string") for k in [*keys, "bin", "latent"]))
    raw = F.when(F.col("__at").isNull(), 1.0).otherwise((F.col("__at") == F.col("latent")).cast("double") + noise * u)
    return rows.withColumn("__u", raw).withColumn("p", F.col("__u") / F.sum("__u").over(Window.partitionBy(*keys, "bin"))).select(*keys, "bin", "latent", "p")


def init_pca(counts: DataFrame, units: list, keys: list[str], latents: int) -> DataFrame:
    """keys, bin, latent, p: softmax of the z-scored leading components of square-rooted counts."""
    wide = counts.groupBy(*keys, "bin").pivot("unit", units).agg(F.sum("n")).na.fill(0)
    vectors = wide.select(*keys, "bin", array_to_vector(F.array(*(F.sqrt(F.col(f"`{u}`").cast("double")) for u in units))).alias("x"))
    k = min(latents, len(units))
    scores = PCA(k=k, inputCol="x", outputCol="s").fit(vectors).transform(vectors).select(*keys, "bin", F.posexplode(vector_to_array("s")).alias("latent", "s"))
    w = Window.partitionBy("latent")
    z = scores.withColumn("z", F.coalesce((F.col("s") - F.avg("s").over(w)) / F.nullif(F.stddev_pop("s").over(w), F.lit(0.0)), F.lit(0.0)))
    row = Window.partitionBy(*keys, "bin")
    return z.withColumn("__e", F.exp(F.col("z") - F.max("z").over(row))).withColumn("p", F.col("__e") / F.sum("__e").over(row)).select(*keys, "bin", "latent", "p")


def long_posterior(decoded: DataFrame, keys: list[str], column: str = "p_latent") -> DataFrame:
    return decoded.select(*keys, "bin", F.posexplode(column).alias("latent", "p"))


def dense_counts(counts: DataFrame, units: list, keys: list[str]) -> DataFrame:
    """keys, bin, lf (the sum of ln n! of its counts), y: the counts of all units of a bin as one array, in the order of `units`."""
    known = F.map_from_entries(F.collect_list(F.struct("unit", F.col("n").cast("double"))))
    rows = counts.groupBy(*keys, "bin").agg(known.alias("__m"), F.sum(decode.log_factorial("n")).alias("lf"))
    return rows.select(*keys, "bin", "lf", F.transform(F.array(*(F.lit(u) for u in units)), lambda u: F.coalesce(F.try_element_at("__m", u), F.lit(0.0))).alias("y"))


def _sums(p: np.ndarray, y: np.ndarray, step: float) -> pd.DataFrame:
    return pd.DataFrame({"latent": np.arange(p.shape[1]), "a": list(p.T @ y), "b": p.sum(0), "step": [step] + [0.0] * (p.shape[1] - 1)})


SUMS = "latent long, a array<double>, b double, step double"


def _model_sums(parts: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(latent, unit) sums of p n, sums of p, and the log marginal, from parts of all tasks: added up by latent on Spark, a row for each latent comes back."""

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"latent": [g["latent"].iloc[0]], "a": [np.sum(g["a"].to_list(), axis=0)], "b": [g["b"].sum()], "step": [g["step"].sum()]})

    rows = sorted(parts.groupBy("latent").applyInPandas(add, SUMS).collect(), key=lambda r: r.latent)
    return np.array([r.a for r in rows]), np.array([r.b for r in rows]), sum(r.step for r in rows)


def posterior_sums(dense: DataFrame, posterior: DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of p n and of p from a posterior (keys, bin, latent, p): matrix products of Arrow batches."""
    rows = posterior.groupBy(*keys, "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("latent", "p"))), lambda x: x["p"]).alias("p"))

    def products(batches):
        for g in batches:
            if len(g):
                yield _sums(np.stack(g["p"].to_numpy()), np.stack(g["y"].to_numpy()), 0.0)

    a, b, _ = _model_sums(dense.join(rows, [*keys, "bin"]).select("p", "y").mapInPandas(products, SUMS))
    return a, b


def rates_of(spark: SparkSession, a: np.ndarray, b: np.ndarray, basis: np.ndarray, prior: float, noise: float | None = None, rough: float = 0.0) -> np.ndarray:
    """(latent, unit) rates of the M-step: the Gaussian one with `noise`, else a Poisson problem for each unit, dealt to the executors."""
    if noise is not None:
        return np.maximum(gaussian_m_step(basis, a, b, noise, prior), 0.0)

    def solve(batches):
        for g in batches:
            yield pd.DataFrame({"ix": g["ix"], "rate": [softplus(basis @ poisson_unit(basis, np.asarray(x), b, prior, rough=rough)) for x in g["a"]]})

    problems = spark.createDataFrame(pd.DataFrame({"ix": np.arange(a.shape[1]), "a": [x.tolist() for x in a.T]}), "ix long, a array<double>").repartition(spark.sparkContext.defaultParallelism)
    return np.array([r.rate for r in sorted(problems.mapInPandas(solve, "ix long, rate array<double>").collect(), key=lambda r: r.ix)]).T  # the model


def _e_step(rates: np.ndarray, kernels: np.ndarray | list[Kernel], switch: np.ndarray, dt: float):
    def decode_sums(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        y = np.stack(g["y"].to_numpy())
        got = decode.forward_backward(decode.loglik_matrix(y, rates, dt, 1.0, constant=g["lf"].to_numpy()), kernels, switch)
        return _sums(got["smooth"].sum(1), y, float(got["step"].sum()))

    return decode_sums


def fit_em(spark: SparkSession, counts: DataFrame, posterior: DataFrame, kernels: np.ndarray | list[Kernel], switch: np.ndarray, basis: np.ndarray, keys: list[str], rounds: int, prior: float = 1.0, dt: float = 1.0, noise: float | None = None, rough: float = 0.0, save_every: int | None = None, kept: list | None = None) -> tuple[DataFrame, list[float]]:
    """(tuning, log marginal of each round): M-step first, from the initial posterior, then E-step.

    Counts become one array for each bin, saved in the shared folder while the loop runs. In a round each group of keys is
    decoded in one task, which returns sums of the size of the model, so posteriors never leave it; the driver holds only the tuning.
    noise: a Gaussian M-step with that deviation instead of the Poisson one; rough: its roughness penalty. Every save_every rounds the tuning is appended to `kept` as (round, DataFrame).
    """
    units = sorted(r.unit for r in counts.select("unit").distinct().collect())  # the model's
    kind = counts.schema["unit"].dataType.simpleString()
    table = lambda r: spark.createDataFrame([(i, u, float(r[i, j])) for i in range(len(r)) for j, u in enumerate(units)], f"latent long, unit {kind}, rate double")
    history, rates = [], None
    with passing(spark) as save:
        dense = save(dense_counts(counts, units, keys))
        a, b = posterior_sums(dense, posterior, keys)
        for k in range(rounds):
            rates = rates_of(spark, a, b, basis, prior, noise, rough) / dt
            a, b, total = _model_sums(dense.groupBy(*keys).applyInPandas(_e_step(rates, kernels, switch, dt), SUMS))
            history.append(total)
            if save_every and kept is not None and (k + 1) % save_every == 0:
                kept.append((k + 1, table(rates)))
    return table(rates), history


def hyperparameter_grid(spark: SparkSession, ranges: dict[str, list]) -> DataFrame:
    """All combinations of the listed values, with config, their number in order of the columns."""
    out = None
    for name, values in ranges.items():
        x = spark.createDataFrame([(v,) for v in values], [name])
        out = x if out is None else out.crossJoin(x)  # a parameter grid
    return out.withColumn("config", F.row_number().over(Window.orderBy(*ranges)) - 1)


def split_contiguous(bins: DataFrame, keys: list[str], test_share: float = 0.2) -> DataFrame:
    """bins with part: the last share of each series is `test`."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy("bin"))
    return bins.withColumn("part", F.when(place > F.floor(F.count(F.lit(1)).over(w) * (1 - test_share)), "test").otherwise("train"))


def chain_agreement(tunings: DataFrame, posteriors: DataFrame) -> DataFrame:
    """a, b, tuning_rmse (relative to a's root mean square), total_variation, map_disagreement of each pair of chains. tunings: chain, latent, unit, rate; posteriors: chain, bin, latent, p."""
    ta, tb = (tunings.select(F.col("chain").alias(s), "latent", "unit", F.col("rate").alias(f"r{s}")) for s in "ab")
    rmse = ta.join(tb, ["latent", "unit"]).where("a < b").groupBy("a", "b").agg((F.sqrt(F.avg((F.col("ra") - F.col("rb")) ** 2)) / F.sqrt(F.avg(F.col("ra") ** 2))).alias("tuning_rmse"))
    pa, pb = (posteriors.select(F.col("chain").alias(s), "bin", "latent", F.col("p").alias(f"p{s}")) for s in "ab")
    by_bin = pa.join(pb, ["bin", "latent"]).where("a < b").groupBy("a", "b", "bin").agg((F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2).alias("tv"), F.max_by("latent", F.struct("pa", -F.col("latent"))).alias("ma"), F.max_by("latent", F.struct("pb", -F.col("latent"))).alias("mb"))
    return by_bin.groupBy("a", "b").agg(F.avg("tv").alias("total_variation"), F.avg((F.col("ma") != F.col("mb")).cast("double")).alias("map_disagreement")).join(rmse, ["a", "b"])
