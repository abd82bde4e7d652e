"""A feature around events: tables on a relative grid, nulls by jitter, tests."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.seeds import uniform
from latentspark.functions.stats import bin_index, normal_tail, signed_rank


def peri_event(series: DataFrame, events: DataFrame, reach: int, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """keys, carry, event_bin, rel, y: the series (keys, bin, value) at -reach..reach bins around each event (keys, event_bin). Events nearer than reach to an end of the series are dropped. An equality join of exploded offsets."""
    carry = carry or []
    ends = series.groupBy(*keys).agg(F.min("bin").alias("__lo"), F.max("bin").alias("__hi"))
    inside = events.join(ends, keys).where((F.col("event_bin") - reach >= F.col("__lo")) & (F.col("event_bin") + reach <= F.col("__hi")))
    asked = inside.select(*keys, *carry, "event_bin", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("rel")).withColumn("bin", F.col("event_bin") + F.col("rel"))
    return asked.join(series.select(*keys, "bin", F.col("value").alias("y")), [*keys, "bin"]).drop("bin")


def zscore_within_event(table: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "event_bin")
    return table.withColumn("z", F.when(F.stddev_pop("y").over(w) > 0, (F.col("y") - F.avg("y").over(w)) / F.stddev_pop("y").over(w)))


def peri_event_shuffle(series: DataFrame, events: DataFrame, reach: int, n_shuffles: int, least: int, most: int, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """keys, carry, shuffle, rel, mean over events that are all moved by one hashed shift of least..most bins, around the ends."""
    ends = series.groupBy(*keys).agg(F.min("bin").alias("__lo"), F.max("bin").alias("__hi"))
    shift = F.floor(uniform(F.col("shuffle").cast("string")) * (most - least + 1)).cast("long") + least
    moved = events.join(ends, keys).withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles)))).withColumn("event_bin", F.col("__lo") + F.pmod(F.col("event_bin") + shift - F.col("__lo"), F.col("__hi") - F.col("__lo") + 1)).drop("__lo", "__hi")
    carry = carry or []
    return peri_event(series, moved, reach, keys, [*carry, "shuffle"]).groupBy(*keys, *carry, "shuffle", "rel").agg(F.avg("y").alias("mean"))


def pre_post(table: DataFrame, keys: list[str], window: int, include_zero: bool = False) -> DataFrame:
    """keys, event_bin, pre, post, diff: means over rel in (-window, 0) and (0, window); with include_zero [-window, 0) and [0, window]."""
    r = F.col("rel")
    pre = (r >= -window) & (r < 0) if include_zero else (r > -window) & (r < 0)
    post = (r >= 0) & (r <= window) if include_zero else (r > 0) & (r < window)
    return table.groupBy(*keys, "event_bin").agg(F.avg(F.when(pre, F.col("y"))).alias("pre"), F.avg(F.when(post, F.col("y"))).alias("post")).withColumn("diff", F.col("post") - F.col("pre"))


def pre_post_test(table: DataFrame, keys: list[str], window: int, digits: int | None = None) -> DataFrame:
    """keys, n, w_plus, z (Wilcoxon), median, effect (mean by sample deviation) of post - pre."""
    d = pre_post(table, keys, window)
    size = d.groupBy(*keys).agg(F.percentile("diff", 0.5).alias("median"), (F.avg("diff") / F.stddev_samp("diff")).alias("effect"))
    return signed_rank(d, keys, "diff", digits).join(size, keys)


def pre_post_correlation(table: DataFrame, keys: list[str], window: int) -> DataFrame:
    """keys, r_pre, r_post: Pearson correlation of y with time over rel in (-window, 0) and (0, window)."""
    r = F.col("rel")
    side = lambda t: F.corr(F.when(t, r.cast("double")), F.when(t, F.col("y")))
    return table.groupBy(*keys).agg(side((r > -window) & (r < 0)).alias("r_pre"), side((r > 0) & (r < window)).alias("r_post"))


def event_triggered_suite(features: DataFrame, events: DataFrame, reach: int, n_shuffles: int, keys: list[str], least: int = 1, most: int = 10) -> dict[str, DataFrame]:
    """Every feature (keys, feature, bin, value) around every kind of event (keys, event_kind, event_bin) in one job: table, tests, correlation, slopes, shuffled and null, by keys, feature and event_kind."""
    by, pairs = [*keys, "feature"], [*keys, "feature", "event_kind"]
    asked = events.join(features.select(*by).distinct(), keys)
    table = peri_event(features, asked, reach, by, ["event_kind"])
    shuffled = peri_event_shuffle(features, asked.withColumn("event_kind", F.col("event_kind")), reach, n_shuffles, least, most, by, ["event_kind"])
    return {"table": table, "tests": pre_post_test(table, pairs, reach, 9), "correlation": pre_post_correlation(table, pairs, reach), "slopes": pre_post_slopes(table, pairs), "shuffled": shuffled, "null": pre_post_vs_shuffle(table, shuffled, pairs, reach)}


def bootstrap_band(table: DataFrame, by: list[str], y: str, order: str, repeats: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, mean, low, high: quantiles of the mean of y over samples with replacement of a group's rows, drawn by hash."""
    rows = table.where(F.col(y).isNotNull()).withColumns({"__r": F.row_number().over(Window.partitionBy(*by).orderBy(order)), "__n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    u = uniform(F.col("repeat").cast("string"), *(F.col(k).cast("string") for k in by), F.col("__r").cast("string"))
    drawn = rows.select(*by, "__r", "__n", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).withColumn("__r", (F.floor(u * F.col("__n")) + 1).cast("int"))
    means = drawn.select(*by, "repeat", "__r").join(rows.select(*by, "__r", F.col(y).alias("__y")), [*by, "__r"]).groupBy(*by, "repeat").agg(F.avg("__y").alias("m"))
    band = means.groupBy(*by).agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))
    return rows.groupBy(*by).agg(F.avg(y).alias("mean")).join(band, by)


def pre_post_vs_shuffle(table: DataFrame, shuffled: DataFrame, keys: list[str], window: int) -> DataFrame:
    """keys, observed (median diff), p: the share of shuffles whose diff the observed one reaches."""
    seen = pre_post(table, keys, window, True).groupBy(*keys).agg(F.percentile("diff", 0.5).alias("observed"))
    null = pre_post(shuffled.withColumnRenamed("mean", "y").withColumn("event_bin", F.col("shuffle")), keys, window, True).select(*keys, F.col("diff").alias("null"))
    return seen.join(null, keys).groupBy(*keys, "observed").agg(F.avg((F.col("observed") >= F.col("null")).cast("double")).alias("p"))


def pre_post_slopes(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (-1 before, 1 after), slope, intercept of y over rel z-scored within its side."""
    sided = table.where("rel != 0").withColumn("side", F.signum("rel").cast("int"))
    w = Window.partitionBy(*keys, "side")
    z = sided.withColumn("tz", (F.col("rel") - F.avg("rel").over(w)) / F.stddev_pop("rel").over(w))
    return z.groupBy(*keys, "side").agg(F.regr_slope("y", "tz").alias("slope"), F.regr_intercept("y", "tz").alias("intercept"))


def robust_regression(rows: DataFrame, y: str, xs: list[str], keys: list[str], cluster: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """keys, term, n, coef, se, z, p, low, high of a least-squares line of y on xs (and an intercept) for each key, all keys in one job.

    Errors are robust: by the scores of clusters (columns that name one inside its key), or HC1 by single rows. Tails are the normal ones. Products and scores are sums on Spark; each key's
    small matrices are solved in a task. A key whose terms can't be told apart has null numbers. A row without y or some x is left out.
    """
    names, k = ["intercept", *xs], len(xs) + 1
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    known = rows.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    for c in xs:
        known = known.where(F.col(c).isNotNull())
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    group = keys or ["all_"]
    known = known if keys else known.withColumn("all_", F.lit(0))
    fields = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in group)
    sums = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x[i] * x[j]) for i, j in upper)).alias("xx"), F.array(*(F.sum(a * F.col(y)) for a in x)).alias("xy"))

    def square(flat: np.ndarray) -> np.ndarray:
        out = np.zeros((k, k))
        for (i, j), v in zip(upper, flat, strict=True):
            out[i, j] = out[j, i] = v
        return out

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            b = [np.linalg.solve(a, np.array(v)).tolist() if np.linalg.matrix_rank(a := square(m)) == k else None for m, v in zip(g["xx"], g["xy"], strict=True)]
            yield pd.DataFrame({c: g[c] for c in group} | {"n": g["n"], "xx": g["xx"], "b": b})

    fitted = sums.mapInPandas(solve, f"{fields}, n long, xx array<double>, b array<double>")
    residual = F.col(y) - sum((F.col("b")[i] * a for i, a in enumerate(x)), F.lit(0.0))
    scored = known.join(fitted.select(*group, "b"), group).select(*group, *(c for c in cluster or [] if c not in group), *((a * residual).alias(f"__s{i}") for i, a in enumerate(x)))
    if cluster is not None:
        scored = scored.groupBy(*dict.fromkeys([*group, *cluster])).agg(*(F.sum(f"__s{i}").alias(f"__s{i}") for i in range(k)))
    meat = scored.groupBy(*group).agg(F.count(F.lit(1)).alias("g"), F.array(*(F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i, j in upper)).alias("mm"))
    clustered, wide = cluster is not None, NormalDist().inv_cdf(0.5 + level / 2)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                own = [getattr(r, c) for c in group]
                if r.b is None:
                    out += [(*own, t, r.n, *(None,) * 6) for t in names]
                    continue
                inv, n, g = np.linalg.inv(square(r.xx)), r.n, r.g
                scale = (g / max(1, g - 1)) * ((n - 1) / max(1, n - k)) if clustered else n / max(1, n - k)
                se = np.sqrt(np.maximum(np.diag(inv @ square(r.mm) @ inv) * scale, 0.0))
                out += [(*own, t, n, c, s, c / s if s > 0 else None, normal_tail(c / s) if s > 0 else None, c - wide * s, c + wide * s) for t, c, s in zip(names, r.b, se.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=[*group, "term", "n", "coef", "se", "z", "p", "low", "high"])

    done = fitted.join(meat, group).mapInPandas(finish, f"{fields}, term string, n long, coef double, se double, z double, p double, low double, high double")
    return done if keys else done.drop("all_")


def interaction_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a peri-event table with post (after the event), tz (rel z-scored within its side of its key) and txp, their product."""
    sided = table.where("rel != 0").withColumn("post", (F.col("rel") > 0).cast("double"))
    by = [*keys, "post"]
    known = sided.groupBy(*by).agg(F.avg("rel").alias("__m"), F.stddev_pop("rel").alias("__s"))
    return sided.join(F.broadcast(known) if not keys else known, by).withColumn("tz", (F.col("rel") - F.col("__m")) / F.col("__s")).withColumn("txp", F.col("tz") * F.col("post")).drop("__m", "__s")


def pre_post_interaction(table: DataFrame, cluster: list[str] | None, keys: list[str] | None = None) -> DataFrame:
    """keys, term, n, coef, se, z, p, low, high of y ~ time within side * post, with cluster-robust errors, or HC1 ones without clusters: one model for each key, or one for all rows."""
    return robust_regression(interaction_rows(table, keys or []), "y", ["tz", "post", "txp"], keys or [], cluster)


def cluster_kmeans(table: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """keys, event_bin, cluster of each event's row of y in order of rel."""
    rows = table.groupBy(*keys, "event_bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel", "y"))), lambda s: s["y"]).alias("y"))
    vectors = rows.withColumn("features", array_to_vector("y"))
    return KMeans(k=k, seed=seed).fit(vectors).transform(vectors).select(*keys, "event_bin", F.col("prediction").alias("cluster"))


def cluster_means(table: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """cluster, rel, n, mean of y over the events (keys, event_bin) of each cluster."""
    return table.join(clusters.select(*keys, "event_bin", "cluster"), [*keys, "event_bin"]).groupBy("cluster", "rel").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))


def cluster_quantile(table: DataFrame, keys: list[str], low: int, high: int, tiles: int) -> DataFrame:
    """keys, event_bin, m (mean over rel in [low, high]), cluster: its right-closed quantile bin."""
    m = table.where((F.col("rel") >= low) & (F.col("rel") <= high)).groupBy(*keys, "event_bin").agg(F.avg("y").alias("m"))
    edges = m.agg(F.percentile("m", F.array(*(F.lit(i / tiles) for i in range(tiles + 1)))).alias("e")).first().e  # tiles + 1 numbers
    return m.withColumn("cluster", bin_index(F.col("m"), edges, "right") if edges else F.lit(None).cast("int"))


def mean_error_band(table: DataFrame, by: list[str], y: str) -> DataFrame:
    """by, n, mean, std (population), sem (sample), low, high (2.5 and 97.5 %)."""
    return table.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("sem"), F.percentile(y, 0.025).alias("low"), F.percentile(y, 0.975).alias("high"))


def null_threshold(null: DataFrame, observed: DataFrame, value: str, alpha: float, keys: list[str]) -> DataFrame:
    """keys, observed value, low, high (alpha and 1 - alpha quantiles of the null), outside.

    A value within a billionth of a limit is at it: a null that is the observed mean again must not be left by the order of its sum.
    """
    limits = null.groupBy(*keys).agg(F.percentile(value, alpha).alias("low"), F.percentile(value, 1 - alpha).alias("high"))
    near = lambda c: F.abs(F.col(c)) * 1e-9
    return observed.join(limits, keys).withColumn("outside", (F.col(value) < F.col("low") - near("low")) | (F.col(value) > F.col("high") + near("high")))


def gather_sessions(shuffles: DataFrame, observed: DataFrame, session: str, keys: list[str]) -> DataFrame:
    """observed (session, keys, mean) with `aligned`: less the session's shuffle mean, plus the mean of all sessions' shuffle means."""
    own = shuffles.groupBy(session, *keys).agg(F.avg("mean").alias("__s"))
    grand = own.groupBy(*keys).agg(F.avg("__s").alias("__g"))
    return observed.join(own, [session, *keys]).join(grand, keys).withColumn("aligned", F.col("mean") - (F.col("__s") - F.col("__g"))).drop("__s", "__g")
