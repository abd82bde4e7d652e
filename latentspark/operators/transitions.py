"""Transition matrices from posteriors, labels and distances; choice of an inverse temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.seeds import permuted_rank


def normalised(pairs: DataFrame, keys: list[str], weight: str = "c") -> DataFrame:
    """pairs with p: the weight by its row's sum; a row of zeros stays zero."""
    total = F.sum(weight).over(Window.partitionBy(*keys, "i"))
    return pairs.withColumn("p", F.when(total > 0, F.col(weight) / total).otherwise(0.0))


def expected_transitions(posterior: DataFrame, keys: list[str], episode: list[str]) -> DataFrame:
    """keys, i, j, c, p: sum over steps of p(t - 1, i) p(t, j), no step across episodes; rows where every p is zero are kept as zeros.

    posterior: keys, episode, bin, latent (from 0), p. A bin is one array beside the one before it; a task adds up products of whole batches and
    returns a matrix for each key, so what is shuffled after it doesn't grow with the bins.
    """
    top = posterior.agg(F.max("latent")).first()[0]
    size = 0 if top is None else int(top) + 1  # the model's
    held = F.map_from_entries(F.collect_list(F.struct(F.col("latent").cast("int").alias("l"), "p")))
    rows = posterior.groupBy(*keys, *episode, "bin").agg(held.alias("__m"))
    dense = rows.withColumn("__p", F.transform(F.sequence(F.lit(0), F.lit(max(0, size - 1))), lambda l: F.coalesce(F.try_element_at("__m", l), F.lit(0.0))))
    steps = dense.withColumn("__b", F.lag("__p").over(Window.partitionBy(*keys, *episode).orderBy("bin"))).where("__b is not null").select(*keys, "__b", "__p")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for g in batches:
            for key, part in g.groupby(keys, dropna=False) if keys else [((), g)]:
                c = np.stack(part["__b"].to_numpy()).T @ np.stack(part["__p"].to_numpy())
                total[key if isinstance(key, tuple) else (key,)] = total.get(key if isinstance(key, tuple) else (key,), 0.0) + c
        for key, c in total.items():
            i, j = np.indices(c.shape)
            yield pd.DataFrame({k: [v] * c.size for k, v in zip(keys, key, strict=True)} | {"i": i.ravel(), "j": j.ravel(), "c": c.ravel()})

    kinds = "".join(f"{k} {posterior.schema[k].dataType.simpleString()}, " for k in keys)
    return normalised(steps.mapInPandas(products, f"{kinds}i long, j long, c double").groupBy(*keys, "i", "j").agg(F.sum("c").alias("c")), keys)


def transition_mass(transitions: DataFrame, posterior: DataFrame, keys: list[str], episode: list[str]) -> DataFrame:
    """keys, i, n_steps, mass: the steps inside episodes, and the weight of each row of expected_transitions."""
    bins = posterior.select(*keys, *episode, "bin").distinct().groupBy(*keys, *episode).agg((F.count(F.lit(1)) - 1).alias("s"))
    steps = bins.groupBy(*keys).agg(F.sum("s").alias("n_steps"))
    return transitions.groupBy(*keys, "i").agg(F.sum("c").alias("mass")).join(steps, keys)


def label_transitions(labels: DataFrame, keys: list[str], mode: str = "frame", exclude: list[str] | None = None, smoothing: float = 0.0, order: str = "bin") -> DataFrame:
    """keys, i, j, c, p of adjacent labels after excluded ones are removed; mode `segment` counts changes only. Every pair of labels that occur (by keys) has a row."""
    kept = labels.where(~F.col("label").isin(exclude)) if exclude else labels
    w = Window.partitionBy(*keys).orderBy(order)
    steps = kept.withColumn("__b", F.lag("label").over(w))
    if mode == "segment":
        runs = steps.where(F.col("__b").isNull() | (F.col("__b") != F.col("label")))
        steps = runs.withColumn("__b", F.lag("label").over(w))
    counted = steps.where("__b is not null").groupBy(*keys, F.col("__b").alias("i"), F.col("label").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    names = kept.select(*keys, F.col("label").alias("i")).distinct()
    frame = names.join(names.withColumnRenamed("i", "j"), keys) if keys else names.join(names.withColumnRenamed("i", "j"), F.lit(True))
    filled = frame.join(counted, [*keys, "i", "j"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(smoothing)).drop("n")
    return normalised(filled, keys)


def transition_shuffle_test(labels: DataFrame, n_shuffles: int, quantile: float, keys: list[str], **more) -> DataFrame:
    """keys, i, j, p, limit (quantile of p under permuted labels), significant."""
    observed = label_transitions(labels, keys, **more).select(*keys, "i", "j", "p")
    copies = labels.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles))))
    place = copies.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "shuffle").orderBy("bin")))
    drawn = copies.withColumn("__r", permuted_rank([*keys, "shuffle"], "bin", F.col("shuffle").cast("string"))).select(*keys, "shuffle", "__r", F.col("label").alias("__l"))
    permuted = place.join(drawn, [*keys, "shuffle", "__r"]).select(*keys, "shuffle", "bin", F.col("__l").alias("label"))
    null = label_transitions(permuted, [*keys, "shuffle"], **more).groupBy(*keys, "i", "j").agg(F.percentile("p", quantile).alias("limit"))
    return observed.join(null, [*keys, "i", "j"]).withColumn("significant", F.col("p") > F.col("limit"))


def tuning_distance(tuning: DataFrame) -> DataFrame:
    """i, j, d: absolute difference of the total rates of each pair of latents. A latent table with itself, the model's size."""
    total = tuning.groupBy("latent").agg(F.sum("rate").alias("r"))
    a, b = total.select(F.col("latent").alias("i"), F.col("r").alias("a")), total.select(F.col("latent").alias("j"), F.col("r").alias("b"))
    return a.join(b, F.lit(True)).select("i", "j", F.abs(F.col("a") - F.col("b")).alias("d"))


def gibbs_transitions(distances: DataFrame, beta: float) -> DataFrame:
    """i, j, p proportional to exp(-beta d), rows summing to 1."""
    w = Window.partitionBy("i")
    e = F.exp(-beta * (F.col("d") - F.min("d").over(w)))
    return distances.withColumn("__e", e).select("i", "j", (F.col("__e") / F.sum("__e").over(w)).alias("p"))


def select_beta(distances: DataFrame, target: DataFrame, betas: list[float]) -> DataFrame:
    """beta, loss: cross entropy of each target row (i, j, p) with the softmax of -beta d, summed over rows; best first."""
    w = Window.partitionBy("beta", "i")
    x = distances.withColumn("beta", F.explode(F.array(*(F.lit(float(b)) for b in betas)))).withColumn("__x", -F.col("beta") * F.col("d"))
    top = x.withColumn("__m", F.max("__x").over(w))
    logp = top.withColumn("lp", F.col("__x") - F.col("__m") - F.log(F.sum(F.exp(F.col("__x") - F.col("__m"))).over(w)))
    return logp.join(target.select("i", "j", F.col("p").alias("q")), ["i", "j"]).groupBy("beta").agg((-F.sum(F.col("q") * F.col("lp"))).alias("loss")).orderBy("loss", "beta")


def weighted_quantile(df: DataFrame, x: str, weight: str, q: float, keys: list[str]) -> DataFrame:
    """keys, value: the smallest x with at least q of all weight up to it."""
    by_x = df.groupBy(*keys, x).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    run = by_x.withColumns({"__c": F.sum("__w").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum("__w").over(w)})
    return run.where(F.col("__c") >= q * F.col("__t")).groupBy(*keys).agg(F.min(x).alias("value"))


def match_step(distances: DataFrame, joint: DataFrame, betas: list[float], q: float) -> DataFrame:
    """beta, loss: squared difference of the mean off-diagonal step under the joint and under each Gibbs kernel, both up to the joint's weighted q-quantile of distance."""
    steps = distances.join(joint.select("i", "j", F.col("p").alias("w")), ["i", "j"]).where("i != j")
    limit = weighted_quantile(steps, "d", "w", q, []).first()
    bulk = F.col("d") <= (limit.value * (1 + 1e-9) if limit else float("inf"))  # distances are made again, so the last digit may differ
    seen = steps.where(bulk).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("step")).first().step
    rows = steps.groupBy("i").agg(F.sum("w").alias("row_w"))
    x = distances.where("i != j").where(bulk).withColumn("beta", F.explode(F.array(*(F.lit(float(b)) for b in betas))))
    model = x.withColumn("e", F.exp(-F.col("beta") * F.col("d"))).groupBy("beta", "i").agg((F.sum(F.col("e") * F.col("d")) / F.sum("e")).alias("step")).join(rows, "i")
    return model.groupBy("beta").agg(F.pow(F.sum(F.col("row_w") * F.col("step")) / F.sum("row_w") - F.lit(seen), F.lit(2)).alias("loss")).orderBy("loss", "beta")
