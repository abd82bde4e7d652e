"""Choosing and refining models: refits by label, test marginals, selection over a grid, regressions of clusters on timing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentspark.sources.shared import passing, saved

from . import blocks, decode, fit, kernels, transitions


def iterative_label_refit(spark: SparkSession, counts: DataFrame, start: DataFrame, n: int, std: float, rounds: int, keys: list[str]) -> tuple[DataFrame, list[float]]:
    """(tuning, log marginals): decode with a moving kernel, refit as the smoothed ratio of weighted statistics, again and again. start: latent, unit, rate.

    A round decodes each group of keys once; its task returns the sums of the model's size that the refit needs.
    """
    units = sorted(r.unit for r in counts.select("unit").distinct().collect())  # the model's
    first = decode.Model.of(start, [], np.ones((1, 1)), latents=n)
    at, rates = {u: i for i, u in enumerate(first.units)}, np.zeros((n, len(units)))
    for i, u in enumerate(units):
        if u in at:
            rates[:, i] = first.rates[:, at[u]]
    smooth, _ = _smoothing(n, std)
    smooth /= smooth.sum(1, keepdims=True)
    move, one, history = kernels.as_arrays(kernels.move_kernel(spark, n, std), n), np.ones((1, 1)), []
    with passing(spark) as save:
        dense = save(fit.dense_counts(counts, units, keys))
        for _ in range(rounds):
            a, b, total = fit._model_sums(dense.groupBy(*keys).applyInPandas(fit._e_step(rates, move, one, 1.0), fit.SUMS))
            history.append(total)
            seconds = (smooth @ b)[:, None]
            rates = np.divide(smooth @ a, seconds, out=np.zeros_like(a), where=seconds > 0)
    kind = counts.schema["unit"].dataType.simpleString()
    return spark.createDataFrame([(i, u, float(rates[i, j])) for i in range(n) for j, u in enumerate(units)], f"latent long, unit {kind}, rate double"), history


def log_marginal_history(counts: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """version, log_marginal (naive Bayes over all bins) of each saved tuning: version, latent, unit, rate."""
    m = versions.withColumn("m", F.col("rate") + decode.TINY)
    base = m.groupBy("version", "latent").agg(F.sum("m").alias("total"))
    seen = counts.where("n > 0").withColumn("__f", decode.log_factorial("n")).join(F.broadcast(m.select("version", "unit", "latent", F.log("m").alias("lm"))), "unit").groupBy("version", *keys, "bin", "latent").agg(F.sum(F.col("n") * F.col("lm") - F.col("__f")).alias("s"))
    frame = counts.select(*keys, "bin").distinct().join(F.broadcast(base), F.lit(True))
    ll = frame.join(seen, ["version", *keys, "bin", "latent"], "left").select("version", *keys, "bin", "latent", (F.coalesce("s", F.lit(0.0)) - F.col("total")).alias("ll"))
    return decode.naive_bayes(ll, ["version", *keys]).select("version", *keys, "bin", "log_marginal").distinct().groupBy("version").agg(F.sum("log_marginal").alias("log_marginal"))


def _start(size: int, latents: int, *seed) -> np.ndarray:
    """(time, latent) random probabilities, drawn by the seed."""
    post = np.random.default_rng(zlib.crc32("|".join(map(str, seed)).encode())).random((size, latents))
    return post / post.sum(1, keepdims=True)


def _smoothing(latents: int, lengthscale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian weights between latents, and the stacked kernels of moving and jumping."""
    d = np.subtract.outer(np.arange(latents), np.arange(latents))
    move = np.exp(-((d / lengthscale) ** 2.0))
    return np.exp(-0.5 * (d / lengthscale) ** 2), np.stack([move / move.sum(1, keepdims=True), np.full((latents, latents), 1 / latents)])


@dataclass(frozen=True)
class Job:
    """One fit: a configuration, a repeat (its random start), and the configuration's numbers."""

    config: int
    repeat: int
    latents: int
    lengthscale: float
    prior: float
    rough: float

    @property
    def basis(self) -> np.ndarray:
        return fit.tuning_basis(fit.rbf(self.latents, self.lengthscale))

    @property
    def dynamics(self) -> tuple[np.ndarray, np.ndarray]:
        return _smoothing(self.latents, self.lengthscale)[1], kernels.switching(0.02, 0.02)

    @staticmethod
    def all(grid: DataFrame, repeats: int) -> list[Job]:
        """Of a grid (config, latents, lengthscale, and prior and rough if it has them)."""
        rows = [r.asDict() for r in grid.collect()]
        return [Job(int(r["config"]), k, int(r["latents"]), float(r["lengthscale"]), float(r.get("prior") or 1.0), float(r.get("rough") or 0.0)) for r in rows for k in range(repeats)]


def fit_grid(dense: DataFrame, jobs: list[Job], keys: list[str], rounds: int) -> dict[tuple[int, int], np.ndarray]:
    """Rates (latent, unit) by (config, repeat): each job fitted by EM with the penalised M-step, all jobs together.

    dense: fit.dense_counts, saved. A round is two steps: a task takes a group of keys (a session) through all jobs and returns sums of the models' size; and
    the M-steps of all jobs are one convex problem for each (config, repeat, unit), dealt over the executors. Only models are collected.
    """
    spark, rates = dense.sparkSession, {}

    def sums_by(held):
        def sums(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("bin")
            y, lf, own, out = np.stack(g["y"].to_numpy()), g["lf"].to_numpy(), tuple(g[k].iloc[0] for k in keys), []
            for job in jobs:
                now = held.value.get((job.config, job.repeat))
                if now is None:
                    post = _start(len(y), job.latents, job.config, job.repeat, *own)
                else:
                    post = decode.forward_backward(decode.loglik_matrix(y, now, 1.0, 1.0, constant=lf), *job.dynamics)["smooth"].sum(1)
                a, b = post.T @ y, post.sum(0)
                out += [(job.config, job.repeat, i, a[i].tolist(), float(b[i])) for i in range(job.latents)]
            return pd.DataFrame(out, columns=["config", "repeat", "latent", "a", "b"])

        return sums

    known = {(j.config, j.repeat): j for j in jobs}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases = {k: j.basis for k, j in known.items()}
        for g in batches:
            out = []
            for r in g.itertuples(index=False):
                job = known[r.config, r.repeat]
                w = fit.poisson_unit(bases[r.config, r.repeat], np.asarray(r.a, float), np.asarray(r.b, float), job.prior, rough=job.rough)
                out.append((r.config, r.repeat, r.ix, fit.softplus(bases[r.config, r.repeat] @ w).tolist()))
            yield pd.DataFrame(out, columns=["config", "repeat", "ix", "rate"])

    for _ in range(rounds):
        parts = dense.groupBy(*keys).applyInPandas(sums_by(spark.sparkContext.broadcast(rates)), "config int, repeat int, latent int, a array<double>, b double")
        by_unit = parts.select("config", "repeat", "latent", "b", F.posexplode("a").alias("ix", "a")).groupBy("config", "repeat", "ix", "latent").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        ordered = F.array_sort(F.collect_list(F.struct("latent", "a", "b")))
        problems = by_unit.groupBy("config", "repeat", "ix").agg(ordered.alias("__p")).select("config", "repeat", "ix", F.col("__p.a").alias("a"), F.col("__p.b").alias("b"))
        rows = problems.mapInPandas(solve, "config int, repeat int, ix int, rate array<double>").collect()  # the models
        rates = {k: np.zeros((j.latents, 1 + max(r.ix for r in rows))) for k, j in known.items()}
        for r in rows:
            rates[r.config, r["repeat"]][:, r.ix] = r.rate
    return rates


def kept_latents(latents: int, share: float, repeat: int, draw: int) -> list[int]:
    """A random share of the latents, the same for every group of keys."""
    return sorted(np.random.default_rng([repeat, draw]).permutation(latents)[: max(1, int(round(share * latents)))].tolist())


def model_selection(spark: SparkSession, train: DataFrame, test: DataFrame, grid: DataFrame, keys: list[str], repeats: int, rounds: int, downsample: float, downsample_repeats: int = 3) -> DataFrame:
    """config, repeat, test_marginal, downsampled (mean log marginal of the test bins decoded with a random share of the latents, others masked), mean and std of downsampled over the configuration's repeats, best: the configuration of the largest mean.

    train, test: keys, bin, unit, n; grid as Job.all reads it. Held-out bins are decoded by the fitted model with its dynamics, a group of keys in a task; counts don't pass through the driver.
    """
    units, jobs = sorted(r.unit for r in train.select("unit").distinct().collect()), Job.all(grid, repeats)
    with passing(spark) as save:
        held = spark.sparkContext.broadcast(fit_grid(save(fit.dense_counts(train, units, keys)), jobs, keys, rounds))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        _, z = decode._group_counts(g, units)
        out = []
        for job in jobs:
            rates, (kernel, switch) = held.value[job.config, job.repeat], job.dynamics
            ll = decode.loglik_matrix(z, rates, 1.0, 1.0)

            def marginal(valid: list[int] | None) -> float:
                some = ll.copy()
                if valid is not None:
                    some[:, np.setdiff1d(np.arange(job.latents), valid)] = -np.inf
                return float(decode.forward(some, kernel, switch, start=decode.uniform_start(len(kernel), job.latents, valid))[1].sum())

            down = float(np.mean([marginal(kept_latents(job.latents, downsample, job.repeat, d)) for d in range(downsample_repeats)]))
            out.append((job.config, job.repeat, marginal(None), down))
        return pd.DataFrame(out, columns=["config", "repeat", "test_marginal", "downsampled"])

    by_group = test.groupBy(*keys).applyInPandas(run, "config int, repeat int, test_marginal double, downsampled double")
    got = by_group.groupBy("config", "repeat").agg(F.sum("test_marginal").alias("test_marginal"), F.sum("downsampled").alias("downsampled"))
    one = Window.partitionBy("config")  # a row for each fit
    with_means = got.withColumns({"mean": F.avg("downsampled").over(one), "std": F.stddev_samp("downsampled").over(one)})
    return with_means.withColumn("best", F.dense_rank().over(Window.orderBy(F.desc("mean"), "config")) == 1)


class Proximal:
    """Accelerated proximal steps of several L1 multinomial logits over the same standardised rows: least mean log loss + strength |coefficients|."""

    def __init__(self, moments: np.ndarray, n: int, fits: int, kinds: int, strength: float):
        """moments: z'z of the rows z, whose last column is 1."""
        self.n, self.strength, self.t = n, strength, 1.0
        self.size = 2.0 / max(np.linalg.eigvalsh(moments)[-1] / n, 1e-12)
        self.w = np.zeros((fits, len(moments), kinds))
        self.ahead = self.w
        self.moving = np.ones(fits, bool)

    def step(self, slopes: np.ndarray) -> None:
        """slopes: `log_loss_slopes` of all rows at `ahead`. A fit that no longer moves stays."""
        new = self.ahead - self.size * slopes / self.n
        new[:, :-1] = np.sign(new[:, :-1]) * np.maximum(np.abs(new[:, :-1]) - self.size * self.strength, 0)
        new[~self.moving] = self.w[~self.moving]
        later = (1 + np.sqrt(1 + 4 * self.t * self.t)) / 2
        self.ahead = new + (self.t - 1) / later * (new - self.w)
        self.moving &= np.abs(new - self.w).max(axis=(1, 2)) >= 1e-9
        self.w, self.t = new, later


def standardised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Columns less their mean by their spread (0 without one), and a column of ones."""
    return np.column_stack([np.where(spread > 0, (x - mean) / np.where(spread > 0, spread, 1), 0.0), np.ones(len(x))])


def log_loss_slopes(z: np.ndarray, labels: list[np.ndarray], w: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Slopes of the summed log loss of each fit's labels at its coefficients; those of fits that don't move stay 0."""
    out = np.zeros_like(w)
    for f in np.flatnonzero(moving):
        e = z @ w[f]
        e = np.exp(e - e.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        e[np.arange(len(z)), labels[f]] -= 1
        out[f] = z.T @ e
    return out


def multinomial_l1(x: np.ndarray, y: np.ndarray, kinds: int, strength: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(scores by kind, coefficients by kind with the intercepts last) for standardised columns of x."""
    w, z = _fitted(x, [y], kinds, strength, rounds)
    return z @ w[0], w[0]


def _fitted(x: np.ndarray, labels: list[np.ndarray], kinds: int, strength: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    z = standardised(x, x.mean(0), x.std(0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1]))
    fits = Proximal(z.T @ z, len(z), len(labels), kinds, strength)
    for _ in range(rounds):
        fits.step(log_loss_slopes(z, labels, fits.ahead, fits.moving))
        if not fits.moving.any():
            break
    return fits.w, z


def permuted(at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of `at` in a permutation of 0 .. n - 1 drawn by the seed: a keyed network of eight rounds over halves of the bits, walked until it falls below n. Any part of it can be had alone."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, out = np.uint64((1 << int(half)) - 1), at.astype(np.uint64)
    odd = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)  # odd multipliers of a well-known mixer
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in range(8):
            m = (right + np.uint64(seed)) * odd[0] + np.uint64((k + 1) * int(odd[1]) % 2**64)
            m = (m ^ (m >> np.uint64(30))) * odd[1]
            m = (m ^ (m >> np.uint64(27))) * odd[2]
            left, right = right, left ^ ((m ^ (m >> np.uint64(31))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _labels(at: np.ndarray, y: np.ndarray, sizes: np.ndarray, names: str, n_shuffles: int) -> list[np.ndarray]:
    """The labels of rows `at` of a group, and those in each shuffle: a permuted row takes the label that its place has among all labels in order, so only their counts are needed."""
    ends = np.cumsum(sizes)
    return [y, *(np.searchsorted(ends, permuted(at, int(ends[-1]), zlib.crc32(f"{names}{s}".encode())), "right") for s in range(1, n_shuffles + 1))]


def label_logit(rows: DataFrame, label: str, features: list[str], n_shuffles: int, strength: float = 0.01, keys: list[str] | None = None, order: str = "event_bin", one_task: int = 200_000, rounds: int = 400) -> DataFrame:
    """keys, shuffle, accuracy of an L1 multinomial logit of the label on standardised features, a model for each group of keys; shuffle 0 is observed, in others the labels are permuted by a hashed draw. Rows with a null in label, features or order don't count.

    No row is copied: a group of at most `one_task` rows is a task that fits all its shuffles; of larger groups, a round is one pass over their saved rows in which tasks sum the slopes of all shuffles,
    and only the models (one for each shuffle of such a group) come to the driver. Both take the same steps. Rows of a group are numbered by `order`, which should tell them apart.
    """
    keys = keys or []
    fs = [f"__f{i}" for i in range(len(features))]
    plain = rows.na.drop(subset=[label, *features, order]).select(*keys, F.col(order).alias("__o"), F.col(label).alias("__l"), *(F.col(f).cast("double").alias(c) for f, c in zip(features, fs, strict=True)))
    counted = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = saved(counted.where(F.col("__n") > one_task))
    names = lambda r: "".join(f"{r[k]}|" for k in keys)

    def fitted(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__o", kind="stable")
        kinds, y, sizes = np.unique(g["__l"].to_numpy(), return_inverse=True, return_counts=True)
        labels = _labels(np.arange(len(g)), y, sizes, names(g.iloc[0]), n_shuffles)
        w, z = _fitted(g[fs].to_numpy(float), labels, len(kinds), strength, rounds)
        hit = [float(((z @ w[s]).argmax(1) == labels[s]).mean()) for s in range(n_shuffles + 1)]
        return pd.DataFrame({k: [g[k].iloc[0]] * len(hit) for k in keys} | {"shuffle": range(len(hit)), "accuracy": hit})

    fields = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys) + "shuffle int, accuracy double"
    if large.isEmpty():
        return plain.groupBy(*keys).applyInPandas(fitted, fields)
    same = F.lit(True)
    for k in keys:
        same = same & plain[k].eqNullSafe(large[k])
    big = _large_logits(plain.join(F.broadcast(large), same, "left_semi"), keys, fs, n_shuffles, strength, rounds, fields)  # each stands for over one_task rows
    small = plain.join(F.broadcast(large), same, "left_anti")
    return small.groupBy(*keys).applyInPandas(fitted, fields).unionByName(big)


def _large_logits(plain: DataFrame, keys: list[str], fs: list[str], n_shuffles: int, strength: float, rounds: int, fields: str) -> DataFrame:
    """label_logit of groups that are too large for a task."""
    spark, fits = plain.sparkSession, n_shuffles + 1
    group = F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"}) if keys else F.lit("")
    with passing(spark) as save:
        numbered = save(blocks.row_numbers(plain.withColumn("__g", group), ["__g"], "__o", "__i"))
        stats = {r["__g"]: r for r in numbered.groupBy("__g").agg(*(F.first(k).alias(k) for k in keys), *(F.avg(c).alias(f"__m{c}") for c in fs), *(F.stddev_samp(c).alias(f"__s{c}") for c in fs)).collect()}
        kinds: dict[str, list] = {}
        for r in numbered.groupBy("__g", "__l").count().orderBy("__g", "__l").collect():
            kinds.setdefault(r["__g"], []).append((r["__l"], r["count"]))

        def each(batches, use):
            """use(group, rows z, labels of each fit, start of the group's sums) over a task's rows, then its sums."""
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for g, part in batch.groupby("__g"):
                    r, known = stats[g], kinds[g]
                    z = standardised(part[fs].to_numpy(float), np.array([r[f"__m{c}"] for c in fs]), np.array([r[f"__s{c}"] or 0.0 for c in fs]))
                    y = np.searchsorted(np.array([k for k, _ in known]), part["__l"].to_numpy())
                    labels = _labels(part["__i"].to_numpy(), y, np.array([n for _, n in known]), "".join(f"{r[k]}|" for k in keys), n_shuffles)
                    got = use(g, z, labels)
                    sums[g] = sums[g] + got if g in sums else got
            yield pd.DataFrame([(g, s.ravel().tolist()) for g, s in sums.items()], columns=["g", "v"])

        def summed(use) -> dict[str, np.ndarray]:
            parts = numbered.mapInPandas(lambda batches: each(batches, use), "g string, v array<double>").select("g", F.posexplode("v").alias("ix", "v"))
            by_group = parts.groupBy("g", "ix").agg(F.sum("v").alias("v")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("ix", "v"))).alias("v"))
            return {r.g: np.array([x.v for x in r.v]) for r in by_group.collect()}  # the size of the models

        d = len(fs) + 1
        moments = summed(lambda g, z, labels: z.T @ z)
        models = {g: Proximal(m.reshape(d, d), sum(n for _, n in kinds[g]), fits, len(kinds[g]), strength) for g, m in moments.items()}
        for _ in range(rounds):
            now = spark.sparkContext.broadcast({g: (m.ahead, m.moving) for g, m in models.items()})
            for g, v in summed(lambda g, z, labels, now=now: log_loss_slopes(z, labels, *now.value[g])).items():
                models[g].step(v.reshape(models[g].w.shape))
            now.unpersist()
            if not any(m.moving.any() for m in models.values()):
                break
        last = spark.sparkContext.broadcast({g: m.w for g, m in models.items()})
        hits = summed(lambda g, z, labels: np.array([float(((z @ last.value[g][f]).argmax(1) == labels[f]).sum()) for f in range(fits)]))
    return spark.createDataFrame([(*(stats[g][k] for k in keys), f, float(h / models[g].n)) for g, v in hits.items() for f, h in enumerate(v)], fields)


def logit_test(accuracies: DataFrame, keys: list[str], quantile: float = 0.95) -> DataFrame:
    """keys, observed, limit (quantile of the permuted ones), significant."""
    got = accuracies.groupBy(*keys).agg(F.max(F.when(F.col("shuffle") == 0, F.col("accuracy"))).alias("observed"), F.percentile(F.when(F.col("shuffle") > 0, F.col("accuracy")), quantile).alias("limit"))
    return got.withColumn("significant", F.col("observed") > F.col("limit"))


def clean_transition_decode(counts: DataFrame, posterior: DataFrame, seen: DataFrame, latents: int, betas: list[float], keys: list[str]) -> DataFrame:
    """decode_hmm under the tuning of a posterior and the Gibbs kernel of its latents' distances at the beta nearest to the transitions seen (i, j, p)."""
    rates = fit.empirical_tuning(*fit.weighted_stats(posterior, counts, keys), counts)
    distance = transitions.tuning_distance(rates)
    beta = transitions.select_beta(distance, seen, betas).first().beta
    return decode.decode_hmm(counts, decode.Model.of(rates, kernels.as_arrays(transitions.gibbs_transitions(distance, beta), latents), np.ones((1, 1))), keys)
