"""Decoding: likelihoods of count vectors, naive Bayes on columns, and a switching hidden Markov model for each group.

Counts come as rows (keys, bin, unit, n); a tuning as rows (latent, unit, rate), the rate being counts in a bin. The tuning and the
kernels are the model: their size is a parameter, and they travel with the tasks.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.sources.shared import passing, saved

from .structure import Kernel, Steps

TINY = 1e-20


def log_factorial(n: str):
    """ln n! of a whole-number column."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.col(n).cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))


def poisson_loglik(counts: DataFrame, tuning: DataFrame, keys: list[str], dt: float = 1.0, gain: float = 1.0) -> DataFrame:
    """keys, bin, latent, ll: sum over units of y ln(m) - m - ln y!, m = rate dt gain + TINY.

    Only counts above zero are joined: the sum of all m is made once for each latent.
    """
    m = tuning.withColumn("m", F.col("rate") * dt * gain + TINY)
    base = F.broadcast(m.groupBy("latent").agg(F.sum("m").alias("total")))
    known = counts.join(F.broadcast(m.select("unit").distinct()), "unit", "left_semi")
    present = known.where("n > 0").withColumn("__f", log_factorial("n"))
    seen = present.join(F.broadcast(m.select("unit", "latent", F.log("m").alias("lm"))), "unit").groupBy(*keys, "bin", "latent").agg(F.sum(F.col("n") * F.col("lm") - F.col("__f")).alias("s"))
    frame = counts.select(*keys, "bin").distinct().join(base, F.lit(True))
    return frame.join(seen, [*keys, "bin", "latent"], "left").select(*keys, "bin", "latent", (F.coalesce("s", F.lit(0.0)) - F.col("total")).alias("ll"))


def poisson_loglik_varying(counts: DataFrame, tuning: DataFrame, keys: list[str], gain: float = 1.0) -> DataFrame:
    """keys, bin, latent, ll with a bin width of each row's own: counts has a column dt, and a row for each unit that counts in its bin, zeros too; masked units have none."""
    m = F.col("rate") * F.col("dt") * gain + TINY
    rows = counts.withColumn("__f", F.when(F.col("n") > 0, log_factorial("n")).otherwise(0.0)).join(F.broadcast(tuning), "unit")
    return rows.groupBy(*keys, "bin", "latent").agg(F.sum(F.col("n") * F.log(m) - m - F.col("__f")).alias("ll"))


def gaussian_loglik(counts: DataFrame, tuning: DataFrame, keys: list[str], std: float, dt: float = 1.0) -> DataFrame:
    """keys, bin, latent, ll: sum over units of the normal log density of n around rate dt. counts holds a row for each unit."""
    constant = 0.5 * float(np.log(2 * np.pi * std * std))
    d = F.col("n") - F.col("rate") * dt
    return counts.join(F.broadcast(tuning), "unit").groupBy(*keys, "bin", "latent").agg(F.sum(-0.5 * d * d / (std * std) - constant).alias("ll"))


def naive_bayes(loglik: DataFrame, keys: list[str]) -> DataFrame:
    """loglik with p (posterior under equal priors) and log_marginal of its bin, the log of the summed likelihoods."""
    w = Window.partitionBy(*keys, "bin")
    top = loglik.withColumn("__m", F.max("ll").over(w))
    total = top.withColumn("log_marginal", F.col("__m") + F.log(F.sum(F.exp(F.col("ll") - F.col("__m"))).over(w)))
    return total.withColumn("p", F.exp(F.col("ll") - F.col("log_marginal"))).drop("__m")


def map_latent(posterior: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, map_latent, p: the most probable latent, the least of several."""
    return posterior.groupBy(*keys, "bin").agg(F.max_by("latent", F.struct("p", -F.col("latent"))).alias("map_latent"), F.max("p").alias("p"))


def entropy(posterior: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, entropy in nats, 0 ln 0 being 0."""
    return posterior.groupBy(*keys, "bin").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"))


def expected_rate(posterior: DataFrame, tuning: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, unit, rate: the tuning averaged by the posterior."""
    return posterior.join(F.broadcast(tuning), "latent").groupBy(*keys, "bin", "unit").agg(F.sum(F.col("p") * F.col("rate")).alias("rate"))


def gain_per_bin(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, gain: all counts by all expected counts."""
    y = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("y"))
    m = expected.groupBy(*keys, "bin").agg(F.sum("rate").alias("m"))
    return y.join(m, [*keys, "bin"]).select(*keys, "bin", (F.col("y") / F.col("m")).alias("gain"))


def high_probability_bins(posterior: DataFrame, keys: list[str], above: float | None = None, quantile: float | None = None) -> DataFrame:
    """Latents of each bin with p above a value, or the bin's own quantile; at least the most probable one."""
    w = Window.partitionBy(*keys, "bin")
    limit = F.lit(above) if above is not None else F.percentile("p", quantile).over(w)
    best = F.row_number().over(w.orderBy(F.desc("p"), "latent")) == 1
    return posterior.withColumns({"__l": limit, "__b": best}).where((F.col("p") > F.col("__l")) | F.col("__b")).drop("__l", "__b")


# ---- hidden Markov model -------------------------------------------------------------------------------------------


class Model:
    """rates (latent, unit), kernels (an array (dyn, latent, latent), or a structure.Kernel for each dynamics), switch (dyn, dyn): what travels with the tasks."""

    def __init__(self, units: list, rates: np.ndarray, kernels: np.ndarray | list[Kernel], switch: np.ndarray) -> None:
        self.units, self.rates, self.kernels, self.switch = units, rates, kernels, switch

    @staticmethod
    def of(tuning: DataFrame, kernels: np.ndarray | list[Kernel], switch: np.ndarray, latents: int | None = None) -> Model:
        """From rows (latent, unit, rate); latents: how many there are, where the last ones have no rows."""
        rows = tuning.collect()
        units = sorted({r.unit for r in rows})
        at = {u: i for i, u in enumerate(units)}
        rates = np.zeros((latents or 1 + max((r.latent for r in rows), default=-1), len(units)))
        for r in rows:
            rates[r.latent, at[r.unit]] = r.rate or 0.0
        return Model(units, rates, kernels, switch)


def log_factorials(y: np.ndarray) -> np.ndarray:
    """ln y! of every element: looked up where all are small whole numbers, else by their different values."""
    whole = y.astype(np.int64)
    if y.size and (whole == y).all() and 0 <= whole.min() and whole.max() < 1 << 16:
        return np.array([lgamma(v + 1) for v in range(int(whole.max()) + 1)])[whole]
    kinds, at = np.unique(y, return_inverse=True)
    return np.array([lgamma(v + 1) for v in kinds.tolist()])[at].reshape(y.shape)


def loglik_matrix(y: np.ndarray, rates: np.ndarray, dt: float, gain: float | np.ndarray, valid: list[int] | None = None, constant: np.ndarray | None = None) -> np.ndarray:
    """(time, latent) Poisson log likelihood. gain: a number, or one for each row of y; valid: latents that count, others are impossible; constant: the sums of ln y! of the rows, where they are known."""
    m = rates * dt + TINY if np.ndim(gain) else rates * dt * gain + TINY
    ll = y @ np.log(m).T - (log_factorials(y).sum(1) if constant is None else constant)[:, None]
    if np.ndim(gain):
        g = np.asarray(gain, float)[:, None]
        ll += y.sum(1)[:, None] * np.log(g + TINY) - g * m.sum(1)
    else:
        ll -= m.sum(1)
    if valid is not None:
        ll[:, np.setdiff1d(np.arange(len(rates)), valid)] = -np.inf
    return ll


def uniform_start(dyn: int, size: int, valid: list[int] | None = None) -> np.ndarray:
    """Every dynamics and valid latent alike."""
    start = np.zeros((dyn, size))
    start[:, np.arange(size) if valid is None else valid] = 1.0
    return start / start.sum()


def forward(ll: np.ndarray, kernels: np.ndarray | list[Kernel] | Steps, switch: np.ndarray | None = None, scale: float = 1.0, prior_power: float = 1.0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter of a switching model: causal (time, dyn, latent) and step, the log predictive of each row.

    ll is (time, latent). The start (uniform by default) passes a transition before the first likelihood; the prediction is
    switch first, then the latent kernel of the new dynamics. scale multiplies the likelihood, prior_power the log prediction.
    """
    steps = kernels if isinstance(kernels, Steps) else Steps(kernels, switch)
    n, size = ll.shape
    top = ll.max(1) if n else np.zeros(0)
    like = np.exp(scale * (ll - top[:, None]))
    causal, step = np.empty((n, steps.dyn, size)), np.empty(n)
    now = uniform_start(steps.dyn, size) if start is None else start
    if steps.joint is not None and prior_power == 1.0:  # the same on flat states
        flat, wide, now = causal.reshape(n, -1), np.tile(like, (1, steps.dyn)), np.ravel(now)
        for t in range(n):
            now = (now @ steps.joint) * wide[t]
            step[t] = total = now.sum()
            now /= total
            flat[t] = now
        return causal, np.log(step) + scale * top
    for t in range(n):
        prior = steps.ahead(now)
        if prior_power != 1.0:
            prior = prior**prior_power
            prior /= prior.sum()
        now = prior * like[t]
        total = now.sum()
        now /= total
        step[t] = total
        causal[t] = now
    return causal, np.log(step) + scale * top


def backward(causal: np.ndarray, kernels: np.ndarray | list[Kernel] | Steps, switch: np.ndarray | None = None, prior_power: float = 1.0, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoother: smooth (time, dyn, latent), and for each row but the last its ratio of the next row's smooth to what was predicted for it. after: the smooth row behind the last one, where a longer series goes on."""
    steps = kernels if isinstance(kernels, Steps) else Steps(kernels, switch)
    n = len(causal)
    smooth, ratio = causal.copy(), np.zeros_like(causal)
    for b in range(n, 0, -4096):  # predictions of many rows at once
        a = max(0, b - 4096)
        predicted = steps.ahead(causal[a:b])
        if prior_power != 1.0:
            predicted = predicted**prior_power
            predicted /= predicted.sum((1, 2), keepdims=True)
        share = np.divide(1.0, predicted, out=np.zeros_like(predicted), where=predicted > 0)
        if steps.joint is not None:  # the same on flat states
            s, r, c, share = (x.reshape(len(x), -1) for x in (smooth, ratio, causal, share))
            for t in range(b - 1, a - 1, -1):
                if t + 1 == n and after is None:
                    continue
                r[t] = now = (s[t + 1] if t + 1 < n else np.ravel(after)) * share[t - a]
                now = c[t] * (now @ steps.joint_back)
                s[t] = now / max(now.sum(), 1e-300)
            continue
        for t in range(b - 1, a - 1, -1):
            later = smooth[t + 1] if t + 1 < n else after
            if later is None:
                continue
            ratio[t] = later * share[t - a]
            now = causal[t] * steps.behind(ratio[t])
            smooth[t] = now / max(now.sum(), 1e-300)
    return smooth, ratio


def forward_backward(ll: np.ndarray, kernels: np.ndarray | list[Kernel] | Steps, switch: np.ndarray | None = None, scale: float = 1.0, prior_power: float = 1.0, start: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """causal and smooth (time, dyn, latent), step (log predictive of each row), ratio as backward gives it."""
    steps = kernels if isinstance(kernels, Steps) else Steps(kernels, switch)
    causal, step = forward(ll, steps, None, scale, prior_power, start)
    smooth, ratio = backward(causal, steps, None, prior_power)
    return {"causal": causal, "smooth": smooth, "step": step, "ratio": ratio}


def joint_sums(causal: np.ndarray, ratio: np.ndarray, kernels: np.ndarray, switch: np.ndarray, what: str) -> np.ndarray:
    """Expected transitions summed over all steps: `latent` (i, j), `dynamics` (d, e), or `full` (d, i, e, j)."""
    kernels = np.stack([k.dense() if isinstance(k, Kernel) else k for k in kernels])
    dyn, size = len(kernels), kernels.shape[1]
    shape = {"latent": (size, size), "dynamics": (dyn, dyn), "full": (dyn, size, dyn, size)}[what]
    total = np.zeros(shape)
    for c, r in zip(causal[:-1], ratio[:-1], strict=True):
        onward = np.matmul(kernels, r[:, :, None])[:, :, 0]  # e, i
        by_dynamics = switch * (c @ onward.T)
        mass = max(by_dynamics.sum(), 1e-300)
        if what == "dynamics":
            total += by_dynamics / mass
        elif what == "latent":
            total += ((switch.T @ c)[:, :, None] * kernels * r[:, None, :]).sum(0) / mass
        else:
            total += np.einsum("di,de,eij,ej->diej", c, switch, kernels, r, optimize=True) / mass
    return total


def _group_counts(rows: pd.DataFrame, units: list) -> tuple[np.ndarray, np.ndarray]:
    at = {u: i for i, u in enumerate(units)}
    bins, row = np.unique(rows["bin"].to_numpy(), return_inverse=True)
    y = np.zeros((len(bins), len(units)))
    column = rows["unit"].map(at)
    good = column.notna().to_numpy()
    np.add.at(y, (row[good], column[good].astype(int).to_numpy()), rows["n"].to_numpy(float)[good])
    return bins, y


def decode_hmm(counts: DataFrame, model: Model, keys: list[str], dt: float = 1.0, gain: float = 1.0, scale: float = 1.0, prior_power: float = 1.0, valid: list[int] | None = None) -> DataFrame:
    """keys, bin, p_latent, p_dyn, causal_latent (arrays), step: the model decoded for each group of keys by itself (a session, or an event).

    valid: the latents that count; all others have probability zero, and the start is uniform over the valid ones. Without any latent that counts there are no rows.
    """
    units, rates, kernels, switch = model.units, model.rates, model.kernels, model.switch
    schema = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys) + ", bin long, p_latent array<double>, p_dyn array<double>, causal_latent array<double>, step double"
    if not len(rates) or valid is not None and not len(valid):
        return counts.sparkSession.createDataFrame([], schema)

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        bins, y = _group_counts(rows, units)
        steps = Steps(kernels, switch)
        got = forward_backward(loglik_matrix(y, rates, dt, gain, valid), steps, None, scale, prior_power, uniform_start(steps.dyn, steps.size, valid))
        out = {k: [rows[k].iloc[0]] * len(bins) for k in keys}
        return pd.DataFrame(out | {"bin": bins, "p_latent": list(got["smooth"].sum(1)), "p_dyn": list(got["smooth"].sum(2)), "causal_latent": list(got["causal"].sum(1)), "step": got["step"]})

    return counts.groupBy(*keys).applyInPandas(decode, schema)


def decode_in_chunks(counts: DataFrame, model: Model, keys: list[str], chunk: int, dt: float = 1.0, gain: float = 1.0, scale: float = 1.0, prior_power: float = 1.0, valid: list[int] | None = None) -> DataFrame:
    """What decode_hmm gives, a chunk of bins of each group at a time, for series that don't fit a task.

    Counts are written once, laid out by chunk, so each chunk reads its own files alone. A table of the last state of every group goes along:
    the filter of a chunk starts from it, the smoother from the first state behind, however many chunks a group has no bin in. A
    chunk is a job over all groups, and its rows are saved; only the number of chunks is known here. The result stays until the application ends.
    """
    spark = counts.sparkSession
    units, rates, kernels, switch = model.units, model.rates, model.kernels, model.switch
    dyn, size = len(kernels), rates.shape[0]
    fields = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    state = f"{fields}, state array<double>"

    def ahead(rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*keys, "bin", "causal", "step"])
        bins, y = _group_counts(rows, units)
        start = np.array(carry["state"].iloc[0]).reshape(dyn, size) if len(carry) else uniform_start(dyn, size, valid)
        causal, step = forward(loglik_matrix(y, rates, dt, gain, valid), kernels, switch, scale, prior_power, start)
        return pd.DataFrame({k: [rows[k].iloc[0]] * len(bins) for k in keys} | {"bin": bins, "causal": list(causal.reshape(len(bins), -1)), "step": step})

    def back(rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*keys, "bin", "smooth", "causal", "step"])
        rows = rows.sort_values("bin")
        causal = np.stack(rows["causal"].to_numpy()).reshape(len(rows), dyn, size)
        smooth, _ = backward(causal, kernels, switch, prior_power, np.array(carry["state"].iloc[0]).reshape(dyn, size) if len(carry) else None)
        return pd.DataFrame({k: rows[k] for k in keys} | {"bin": rows["bin"], "smooth": list(smooth.reshape(len(rows), -1)), "causal": rows["causal"], "step": rows["step"]})

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    upto = lambda of, x: F.transform(F.sequence(F.lit(0), F.lit(of - 1)), x)
    by_latent = lambda c: upto(size, lambda i: total(upto(dyn, lambda d: F.get(c, d * size + i))))
    by_dyn = lambda c: upto(dyn, lambda d: total(F.slice(c, d * size + 1, size)))
    with passing(spark) as save:
        begins = counts.groupBy(*keys).agg(F.min("bin").alias("__first"))
        placed = counts.join(begins, keys).withColumn("__chunk", F.floor((F.col("bin") - F.col("__first")) / chunk).cast("int")).select(*keys, "bin", "unit", "n", "__chunk")
        placed = save(placed.repartition("__chunk", *keys), ["__chunk"])
        chunks = sorted(r[0] for r in placed.select("__chunk").distinct().collect())
        of_chunk = lambda t, k: t.where(F.col("__chunk") == k)

        def carried(carry: DataFrame, new: DataFrame) -> DataFrame:
            """The state of each group of the chunk just done, and of those that it had no bin of."""
            return save(new.unionByName(carry.join(new.select(*keys), keys, "left_anti")))

        none = spark.createDataFrame([], state)
        filtered, carry = [], none
        for k in chunks:
            filtered.append(save(of_chunk(placed, k).groupBy(*keys).cogroup(carry.groupBy(*keys)).applyInPandas(ahead, f"{fields}, bin long, causal array<double>, step double")))
            carry = carried(carry, filtered[-1].groupBy(*keys).agg(F.max_by("causal", "bin").alias("state")))
        out, carry = spark.createDataFrame([], f"{fields}, bin long, smooth array<double>, causal array<double>, step double"), none
        for got in reversed(filtered):
            part = save(got.groupBy(*keys).cogroup(carry.groupBy(*keys)).applyInPandas(back, f"{fields}, bin long, smooth array<double>, causal array<double>, step double"))
            carry = carried(carry, part.groupBy(*keys).agg(F.min_by("smooth", "bin").alias("state")))
            out = out.unionByName(part)
        return saved(out.select(*keys, "bin", by_latent(F.col("smooth")).alias("p_latent"), by_dyn(F.col("smooth")).alias("p_dyn"), by_latent(F.col("causal")).alias("causal_latent"), "step"))


def event_marginals(counts: DataFrame, models: dict[str, Model], keys: list[str], dt: float = 1.0, gain: float = 1.0, prior_power: float = 1.0) -> DataFrame:
    """keys, kernel, log_marginal, probability: each event under each named model in one pass, and the softmax over the models."""
    plain = {k: (m.units, m.rates, m.kernels, m.switch) for k, m in models.items()}

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, (units, rates, kernels, switch) in plain.items():
            _, y = _group_counts(rows, units)
            _, step = forward(loglik_matrix(y, rates, dt, gain), kernels, switch, prior_power=prior_power)
            out.append({k: rows[k].iloc[0] for k in keys} | {"kernel": name, "log_marginal": float(step.sum())})
        return pd.DataFrame(out)

    fields = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    found = counts.groupBy(*keys).applyInPandas(decode, f"{fields}, kernel string, log_marginal double")
    w = Window.partitionBy(*keys)
    e = F.exp(F.col("log_marginal") - F.max("log_marginal").over(w))
    return found.withColumn("__e", e).withColumn("probability", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def posterior_transitions(counts: DataFrame, model: Model, keys: list[str], dt: float = 1.0, what: str = "latent") -> DataFrame:
    """i, j, joint, conditional: expected transitions summed over all groups, and by row; each group sends one matrix.

    what: between latents, between dynamics, or `full`: between pairs of them, dynamics times the number of latents plus latent.
    """
    units, rates, kernels, switch = model.units, model.rates, model.kernels, model.switch

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        _, y = _group_counts(rows, units)
        got = forward_backward(loglik_matrix(y, rates, dt, 1.0), kernels, switch)
        joint = joint_sums(got["causal"], got["ratio"], kernels, switch, what)
        if what == "full":
            joint = joint.reshape(joint.shape[0] * joint.shape[1], -1)
        i, j = np.nonzero(joint)
        return pd.DataFrame({"i": i, "j": j, "w": joint[i, j]})

    sums = counts.groupBy(*keys).applyInPandas(decode, "i long, j long, w double").groupBy("i", "j").agg(F.sum("w").alias("w"))
    return sums.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("joint"), (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("conditional"))  # a row for each pair of states


def split_posterior(decoded: DataFrame, grid: DataFrame, keys: list[str], maze: str | None = None) -> DataFrame:
    """keys, bin, flat_idx, p and the grid's coordinates of the latents of one maze, or all: the columns of a decoded array that a grid (maze, flat_idx, coordinates) names."""
    mine = grid.where(F.col("maze") == maze) if maze is not None else grid
    return decoded.select(*keys, "bin", F.posexplode("p_latent").alias("flat_idx", "p")).join(F.broadcast(mine), "flat_idx")  # the grid is the model's


def map_position(decoded: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, flat_idx, p and the grid's maze and coordinates of the most probable latent of each bin over all mazes, the first of several: the winning maze and the place in it."""
    best = F.array_position("p_latent", F.array_max("p_latent")).cast("int")
    return decoded.select(*keys, "bin", (best - 1).alias("flat_idx"), F.array_max("p_latent").alias("p")).join(F.broadcast(grid), "flat_idx")


def expected_position(decoded: DataFrame, grid: DataFrame, keys: list[str], coordinate: str, maze: str | None = None) -> DataFrame:
    """keys, bin, the coordinate averaged by the posterior over the latents that have it, within a maze or all."""
    rows = split_posterior(decoded, grid, keys, maze).where(F.col(coordinate).isNotNull())
    return rows.groupBy(*keys, "bin").agg((F.sum(F.col("p") * F.col(coordinate)) / F.sum("p")).alias(coordinate))


def decode_multi_kernel(counts: DataFrame, tuning: DataFrame, kernels: np.ndarray, p_stay: float, keys: list[str], dt: float = 1.0) -> DataFrame:
    """keys, dyn, mean: each event under one model that switches between several kernels, and the mean probability of each kernel over its bins."""
    n = len(kernels)
    switch = np.where(np.eye(n, dtype=bool), p_stay, (1 - p_stay) / max(1, n - 1)) if n > 1 else np.ones((1, 1))
    decoded = decode_hmm(counts, Model.of(tuning, kernels, switch), keys, dt)
    return decoded.select(*keys, F.posexplode("p_dyn").alias("dyn", "p")).groupBy(*keys, "dyn").agg(F.avg("p").alias("mean"))
