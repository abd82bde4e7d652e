"""Shuffled and simulated nulls, and tests of decoding against them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.seeds import drawn_shift, hash_number, permuted_rank, uniform

from . import decode


def circular_shuffle(counts: DataFrame, n_shuffles: int, keys: list[str], least: int = 0) -> DataFrame:
    """keys, shuffle, bin, unit, n: each unit rolled over the bins 0..n - 1 of its group by a hashed shift of its own."""
    size = counts.groupBy(*keys).agg((F.max("bin") + 1).alias("__n"))
    copies = counts.join(size, keys).withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles))))
    seed = [F.col("shuffle").cast("string"), *(F.col(k).cast("string") for k in keys), F.col("unit").cast("string")]
    return copies.select(*keys, "shuffle", F.pmod(F.col("bin") + drawn_shift(F.col("__n"), *seed, least=least), F.col("__n")).alias("bin"), "unit", "n")


def unit_shuffle(counts: DataFrame, n_shuffles: int, keys: list[str]) -> DataFrame:
    """keys, shuffle, bin, unit, n: units of each group and shuffle permuted."""
    units = counts.select(*keys, "unit").distinct().withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles))))
    place = units.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "shuffle").orderBy("unit")))
    seed = [F.col("shuffle").cast("string"), *(F.col(k).cast("string") for k in keys)]
    drawn = units.withColumn("__r", permuted_rank([*keys, "shuffle"], "unit", *seed)).select(*keys, "shuffle", "__r", F.col("unit").alias("__to"))
    mapping = place.join(drawn, [*keys, "shuffle", "__r"]).drop("__r")
    return counts.join(mapping, [*keys, "unit"]).select(*keys, "shuffle", "bin", F.col("__to").alias("unit"), "n")


def pre_post_posterior(posterior: DataFrame, keys: list[str], pre, post) -> DataFrame:
    """keys, latent, pre, post, diff: mean posterior over the bins where each test holds."""
    mean = lambda test: F.avg(F.when(test, F.col("p")))
    return posterior.groupBy(*keys, "latent").agg(mean(pre).alias("pre"), mean(post).alias("post")).withColumn("diff", F.col("post") - F.col("pre"))


def pre_post_circular_null(counts: DataFrame, tuning: DataFrame, n_shuffles: int, keys: list[str], pre, post, least: int = 0, dt: float = 1.0) -> DataFrame:
    """keys, shuffle, latent, pre, post, diff of pre_post_posterior with each unit rolled by a hashed shift of its own."""
    by = [*keys, "shuffle"]
    rolled = circular_shuffle(counts, n_shuffles, keys, least)
    return pre_post_posterior(decode.naive_bayes(decode.poisson_loglik(rolled, tuning, by, dt), by), by, pre, post)


def relabel_pre_post(rows: DataFrame, n_shuffles: int, value: str, by: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, shuffle, by, diff (post - pre mean) with the labels `epoch` (pre, post) of the bins of keys permuted; shuffle 0 is as observed. rows: keys, bin, epoch, by, value."""
    keys = keys or []
    bins = rows.select(*keys, "bin", "epoch").distinct()
    copies = bins.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles))))
    n_pre = F.sum((F.col("epoch") == "pre").cast("int")).over(Window.partitionBy(*keys, "shuffle"))
    drawn = F.when(F.col("shuffle") == 0, F.when(F.col("epoch") == "pre", 0).otherwise(F.lit(2147483647))).otherwise(permuted_rank([*keys, "shuffle"], "bin", F.col("shuffle").cast("string"), *(F.col(k).cast("string") for k in keys)))
    named = copies.withColumns({"__n": n_pre, "__r": drawn}).select(*keys, "bin", "shuffle", F.when(F.col("__r") <= F.col("__n"), "pre").otherwise("post").alias("as"))
    mean = lambda k: F.avg(F.when(F.col("as") == k, F.col(value)))
    return rows.drop("epoch").join(named, [*keys, "bin"]).groupBy(*keys, "shuffle", *by).agg((mean("post") - mean("pre")).alias("diff"))


def poisson_draw(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The smallest k whose Poisson distribution reaches u, by summing upwards."""
    k, p = np.zeros(len(mean), np.int64), np.exp(-mean)
    total, open_ = p.copy(), np.ones(len(mean), bool)
    while (open_ := open_ & (total < u)).any():
        k[open_] += 1
        p[open_] *= mean[open_] / k[open_]
        total[open_] += p[open_]
        open_ &= p > 0
    return k


def poisson_surrogate(counts: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """keys, repeat, bin, unit, n: counts drawn with each unit's mean count in its group, for the same bins."""
    w = Window.partitionBy(*keys, "unit")
    u = uniform(F.col("repeat").cast("string"), *(F.col(k).cast("string") for k in keys), F.col("bin").cast("string"), F.col("unit").cast("string"))
    rows = counts.withColumn("__m", F.avg("n").over(w)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("__u", u)

    @F.pandas_udf("long")
    def draw(mean: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(poisson_draw(mean.to_numpy(float), u.to_numpy(float)))

    return rows.select(*keys, "repeat", "bin", "unit", draw("__m", "__u").alias("n"))


def max_then_mean(rows: DataFrame, by: list[str], event: str, value: str) -> DataFrame:
    """by, mean over events of the largest value in each event."""
    return rows.groupBy(*by, event).agg(F.max(value).alias("__m")).groupBy(*by).agg(F.avg("__m").alias("mean"))


def bin_significance(observed: DataFrame, shuffled: DataFrame, value: str, keys: list[str], quantile: float = 0.975) -> DataFrame:
    """keys, bin, value, limit, significant."""
    limit = shuffled.groupBy(*keys, "bin").agg(F.percentile(value, quantile).alias("limit"))
    return observed.join(limit, [*keys, "bin"]).select(*keys, "bin", value, "limit", (F.col(value) > F.col("limit")).alias("significant"))


def event_log_marginal(counts: DataFrame, tuning: DataFrame, keys: list[str], dt: float = 1.0, gain: float = 1.0) -> DataFrame:
    """keys, log_marginal: naive Bayes summed over the bins of each group."""
    nb = decode.naive_bayes(decode.poisson_loglik(counts, tuning, keys, dt, gain), keys)
    return nb.select(*keys, "bin", "log_marginal").distinct().groupBy(*keys).agg(F.sum("log_marginal").alias("log_marginal"))


def shuffle_test(counts: DataFrame, tuning: DataFrame, keys: list[str], n_shuffles: int, dt: float = 1.0, gain: float = 1.0, quantile: float = 0.95) -> DataFrame:
    """keys, observed, unit_limit, circular_limit, significant: the summed log marginal of each event against the quantile of both nulls. counts must hold events only."""
    observed = event_log_marginal(counts, tuning, keys, dt, gain).withColumnRenamed("log_marginal", "observed")
    out = observed
    for name, null in (("unit", unit_shuffle(counts, n_shuffles, keys)), ("circular", circular_shuffle(counts, n_shuffles, keys))):
        m = event_log_marginal(null, tuning, [*keys, "shuffle"], dt, gain)
        out = out.join(m.groupBy(*keys).agg(F.percentile("log_marginal", quantile).alias(f"{name}_limit")), keys)
    return out.withColumn("significant", (F.col("observed") > F.col("unit_limit")) & (F.col("observed") > F.col("circular_limit")))


def consecutive(tuning: DataFrame) -> DataFrame:
    """tuning with its latents numbered from 0 without gaps, where some were left out; for what doesn't depend on a latent's number. A row for each latent is ranked."""
    order = tuning.select("latent").distinct().withColumn("__n", F.row_number().over(Window.orderBy("latent")) - 1)
    return tuning.join(order, "latent").withColumn("latent", F.col("__n").cast("long")).drop("__n")


def event_nulls(counts: DataFrame, tuning: DataFrame, keys: list[str], n_shuffles: int, gains: list[float], dt: float = 1.0) -> DataFrame:
    """keys, gain, kind (observed, unit, circular), shuffle, log_marginal, made inside each event's group: only one number for each leaves it.

    Draws are the hashes of unit_shuffle and circular_shuffle, so these are the same nulls as theirs. Bins count from 0.
    Marginals are rounded to nine digits: a null that is the observed event again must tie with it, however its sum was ordered. A tuning without latents gives no rows.
    """
    rows = tuning.collect()  # the model
    schema = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys) + ", gain double, kind string, shuffle int, log_marginal double"
    if not rows:
        return counts.sparkSession.createDataFrame([], schema)
    units = sorted({r.unit for r in rows})
    rates = np.zeros((1 + max(r.latent for r in rows), len(units)))
    for r in rows:
        rates[r.latent, units.index(r.unit)] = r.rate or 0.0

    has = (rates > 0).astype(float)
    logs, total = np.log(np.where(rates > 0, rates * dt, decode.TINY)), (rates * dt).sum(1)

    def test(g: pd.DataFrame) -> pd.DataFrame:
        bins, y = decode._group_counts(g, units)
        own = "|".join(str(g[k].iloc[0]) for k in keys)
        n = int(bins.max()) + 1
        if n > len(bins):  # bins without rows are bins without counts
            whole = np.zeros((n, y.shape[1]))
            whole[bins.astype(int)] = y
            y = whole
        tries = [("observed", 0, y)]
        for s in range(1, n_shuffles + 1):
            draw = np.array([int(hashlib.md5(f"{s}|{own}|{u}".encode()).hexdigest()[:8], 16) for u in units])
            moved = np.empty_like(y)
            moved[:, np.lexsort((np.arange(len(units)), draw))] = y
            tries.append(("unit", s, moved))
            tries.append(("circular", s, np.take_along_axis(y, (np.arange(n)[:, None] - draw % n) % n, 0)))
        out = []
        for kind, s, x in tries:
            # the products serve all gains: ln(rate dt gain) is ln(rate dt) + ln(gain) where there is a rate, and stays ln(TINY) elsewhere
            base, seen, constant = x @ logs.T, x @ has.T, decode.log_factorials(x).sum(1)[:, None]
            for gain in gains:
                ll = base + np.log(gain) * seen - constant - total * gain
                top = ll.max(1, keepdims=True)
                out.append((gain, kind, s, round(float((top[:, 0] + np.log(np.exp(ll - top).sum(1))).sum()), 9)))
        return pd.DataFrame({k: g[k].iloc[0] for k in keys} | {"gain": o[0], "kind": o[1], "shuffle": o[2], "log_marginal": o[3]} for o in out)

    return counts.groupBy(*keys).applyInPandas(test, schema)


def tested_events(nulls: DataFrame, keys: list[str], quantile: float = 0.95) -> DataFrame:
    """keys, observed, unit_limit, circular_limit, significant from event_nulls of one gain: above the quantile of both nulls."""
    of = lambda k: F.when(F.col("kind") == k, F.col("log_marginal"))
    limits = nulls.groupBy(*keys).agg(F.max(of("observed")).alias("observed"), F.percentile(of("unit"), quantile).alias("unit_limit"), F.percentile(of("circular"), quantile).alias("circular_limit"))
    return limits.withColumn("significant", (F.col("observed") > F.col("unit_limit")) & (F.col("observed") > F.col("circular_limit")))


def null_quantiles(nulls: DataFrame, keys: list[str], levels: int = 41) -> DataFrame:
    """keys, kind, level (0 to levels - 1), value: evenly spaced quantiles of both nulls of each event."""
    at = F.array(*(F.lit(k / (levels - 1)) for k in range(levels)))
    return nulls.where("kind != 'observed'").groupBy(*keys, "kind").agg(F.percentile("log_marginal", at).alias("__q")).select(*keys, "kind", F.posexplode("__q").alias("level", "value"))


def significant_fractions(tests: DataFrame, by: list[str]) -> DataFrame:
    """by, n, and the fractions of events above the unit null, the circular one, and both."""
    share = lambda c: F.avg((F.col("observed") > c).cast("double"))
    return tests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("unit_limit")).alias("unit"), share(F.col("circular_limit")).alias("circular"), share(F.greatest("unit_limit", "circular_limit")).alias("both"))


def significant_bins(rows: DataFrame, tests: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, bin, ...) with `significant` of their event; bins outside events, with missing keys or without a test, are dropped."""
    return rows.join(tests.select(*keys, "significant"), keys)


def gain_sweep(nulls: DataFrame, keys: list[str], train_share: float = 0.5, quantile: float = 0.95, least_gains: int = 7) -> DataFrame:
    """gain, train, test (fractions of significant events), kept, best, from event_nulls over several gains.

    Events are split by hash. The sweep stops after two falls in a row of the test fraction once least_gains were tried; `kept` says
    which gains come before the stop, best is the kept one with the largest test fraction, the least of several.
    """
    null = nulls.where("kind != 'observed'").groupBy(*keys, "gain", "kind").agg(F.percentile("log_marginal", quantile).alias("limit"))
    limits = null.groupBy(*keys, "gain").agg(F.max("limit").alias("limit"))
    seen = nulls.where("kind = 'observed'").join(limits, [*keys, "gain"]).withColumn("hit", (F.col("log_marginal") > F.col("limit")).cast("double"))
    split = F.when(hash_number(F.lit("split"), *(F.col(k).cast("string") for k in keys)) < train_share * 2**32, "train").otherwise("test")
    by_gain = seen.withColumn("part", split).groupBy("gain").agg(F.avg(F.when(F.col("part") == "train", F.col("hit"))).alias("train"), F.avg(F.when(F.col("part") == "test", F.col("hit"))).alias("test"))
    w = Window.orderBy("gain")  # a row for each gain
    fall = (F.col("test") < F.lag("test").over(w)) & (F.lag("test").over(w) < F.lag("test", 2).over(w)) & (F.row_number().over(w) >= least_gains)
    kept = by_gain.withColumn("__fall", F.coalesce(fall, F.lit(False))).withColumn("kept", F.coalesce(F.max(F.col("__fall").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0).drop("__fall")
    best = F.row_number().over(Window.orderBy(F.desc("kept"), F.desc("test"), "gain")) == 1
    return kept.withColumn("best", best)
