"""Distances between vectors against lags and labels, with regressions and permutation tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.seeds import permuted_rank
from latentspark.functions.stats import bin_index, ols

from .signals import vector_distance


#: Places in a block of pairwise_distance at most.
PLACES = 128


def pairwise_distance(vectors: DataFrame, vector: str, metric: str, order: str, keys: list[str], max_lag: int, carry: list[str] | None = None) -> DataFrame:
    """keys, i, j, lag, d of rows i < j at most max_lag places apart in order, and carried columns of both (c_i, c_j).

    Places are dealt into blocks of about max_lag, PLACES at most, and blocks that reach each other are joined by equality: a vector is copied once for each block
    that it meets, not for each place. The work is rows times max_lag; all pairs of n rows are max_lag = n - 1.
    """
    carry = carry or []
    size = max(1, min(max_lag + 1, PLACES))
    reach = -(-max_lag // size)
    every = Window.partitionBy(*keys)
    placed = vectors.withColumns({"__r": F.row_number().over(every.orderBy(order)), "__n": F.count(F.lit(1)).over(every)})
    placed = placed.withColumns({"__k": F.floor((F.col("__r") - 1) / size).cast("long"), "__last": F.floor((F.col("__n") - 1) / size).cast("long")})
    ahead = F.sequence(F.col("__k"), F.least(F.col("__k") + reach, F.col("__last")))
    back = F.sequence(F.greatest(F.col("__k") - reach, F.lit(0)), F.col("__k"))
    a = placed.select(*keys, F.col("__k").alias("__ka"), F.explode(ahead).alias("__kb"), F.col("__r").alias("i"), F.col(vector).alias("__a"), *(F.col(c).alias(f"{c}_i") for c in carry))
    b = placed.select(*keys, F.explode(back).alias("__ka"), F.col("__k").alias("__kb"), F.col("__r").alias("j"), F.col(vector).alias("__v"), *(F.col(c).alias(f"{c}_j") for c in carry))
    lag = F.col("j") - F.col("i")
    pairs = a.join(b, [*keys, "__ka", "__kb"]).where((lag > 0) & (lag <= max_lag)).withColumns({"lag": lag, "d": vector_distance(F.col("__a"), F.col("__v"), metric)})
    return pairs.select(*keys, "i", "j", "lag", *(f"{c}_i" for c in carry), *(f"{c}_j" for c in carry), "d")


def distance_by_lag(pairs: DataFrame, lag: str = "lag") -> DataFrame:
    """lag, n, mean, std (sample), sem."""
    return pairs.groupBy(lag).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std")).withColumn("sem", F.col("std") / F.sqrt("n"))


def distance_by_label(pairs: DataFrame, a: str, b: str, edges: list[float] | None = None) -> DataFrame:
    """Statistics by |difference of labels|: by value, or by right-closed bins, the lowest edge included."""
    x = F.abs(F.col(a) - F.col(b)).cast("double")
    key = bin_index(x, edges, "right") if edges else x
    return distance_by_lag(pairs.withColumn("label_lag", key).where("label_lag is not null"), "label_lag")


def bin_edges(df: DataFrame, x: str, bins: int, how: str = "uniform") -> list[float]:
    """bins + 1 edges over the values of x: evenly spaced, or its quantiles; equal edges are one. A row comes back, of so many numbers."""
    known = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    if how == "uniform":
        r = known.agg(F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("b")).first()
        edges = [] if r.a is None else [r.a + (r.b - r.a) * k / bins for k in range(bins + 1)]
    else:
        edges = known.agg(F.percentile(x, F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("e")).first().e or []
    return sorted(set(edges))


def distance_by_label_bins(pairs: DataFrame, a: str, b: str, bins: int, direct: int = 50) -> DataFrame:
    """distance_by_label by value if there are at most `direct` different label differences, else by quantile bins, right-closed and the lowest edge included."""
    lag = F.abs(F.col(a) - F.col(b)).cast("double")
    few = pairs.select(lag.alias("x")).where("x is not null").distinct().limit(direct + 1).count() <= direct
    return distance_by_label(pairs, a, b, None if few else bin_edges(pairs.select(lag.alias("x")), "x", bins, "quantile"))


def bin_stats_auto(df: DataFrame, x: str, y: str, bins: int, how: str = "uniform") -> DataFrame:
    """bin_stats over uniform or quantile bins of x; the last bin holds the largest value."""
    edges = bin_edges(df, x, bins, how)
    top = edges[-1:]
    last = [math.nextafter(v, math.inf) for v in top]
    out = bin_stats(df, x, y, edges[:-1] + last)
    return out.withColumn("right", F.when(F.col("right") == F.lit(last[0]), F.lit(top[0])).otherwise(F.col("right"))) if last else out


def feature_vs_label_distance(points: DataFrame, intervals: DataFrame, features: list[str], n_shuffles: int, keys: list[str]) -> DataFrame:
    """kind, feature, keys, slope, p: means of each feature in the intervals of each kind (keys, kind, interval_id, start, end), their distances regressed on how many intervals lie between them, against permuted intervals. One job for all features and kinds."""
    from .intervals import interval_join

    held = interval_join(points, intervals.select(*keys, "kind", "interval_id", "start", "end"), keys)
    means = held.groupBy("kind", *keys, "interval_id", "start").agg(*(F.avg(f).alias(f) for f in features)).unpivot(["kind", *keys, "interval_id", "start"], features, "feature", "value").where("value is not null")
    by = ["kind", "feature", *keys]
    placed = means.withColumns({"i": F.row_number().over(Window.partitionBy(*by).orderBy("start", "interval_id")), "x": F.array("value")})
    most = placed.agg(F.max("i")).first()[0] or 1  # intervals of one kind
    pairs = pairwise_distance(placed.drop("i"), "x", "euclidean", "start", by, max(1, most - 1))
    return distance_label_shuffle_test(pairs, placed.select(*by, "i", F.col("i").cast("double").alias("label")), n_shuffles, by)


def wasserstein1(a, b, widths: list[float], normalize: bool = False):
    """Sum of width times |difference of the cumulative sums| of two array columns, in one pass over the bins."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = lambda x: F.transform(x, lambda v: v / total(x)) if normalize else x
    w = F.array(*(F.lit(float(v)) for v in widths))
    steps = F.zip_with(F.zip_with(share(a), share(b), lambda p, q: p - q), w, lambda d, v: F.struct(d.alias("d"), v.alias("w")))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("t"))
    return F.aggregate(steps, zero, lambda s, x: F.struct((s["c"] + x["d"]).alias("c"), (s["t"] + F.abs(s["c"] + x["d"]) * x["w"]).alias("t")), lambda s: s["t"])


def bin_stats(df: DataFrame, x: str, y: str, edges: list[float], z: float = 1.96) -> DataFrame:
    """bin, left, right, n, mean, std (0 when n = 1), low, high (null when n < 2) of half-open bins, empty ones kept."""
    spark = df.sparkSession
    frame = spark.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(len(edges) - 1)], "bin int, left double, right double")
    got = df.withColumn("bin", bin_index(F.col(x), edges)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"))
    sem = F.when(F.col("n") > 1, F.col("std") / F.sqrt("n"))
    return frame.join(got, "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "low": F.col("mean") - z * sem, "high": F.col("mean") + z * sem})


def distance_label_ols(pairs: DataFrame, label_lag: str, above: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, slope, intercept, r, r2 of distance on the label lag, or on whether it is above a threshold."""
    x = (F.col(label_lag) > above).cast("double") if above is not None else F.col(label_lag).cast("double")
    p = pairs.withColumn("__x", x)
    agg = [F.regr_slope("d", "__x").alias("slope"), F.regr_intercept("d", "__x").alias("intercept"), F.corr("d", "__x").alias("r"), F.regr_r2("d", "__x").alias("r2")]
    return p.groupBy(*keys).agg(*agg) if keys else p.agg(*agg)


def distance_label_time_ols(pairs: DataFrame, label_lag: str, time_lag: str) -> list[float]:
    """Intercept and slopes of distance on label lag and time lag."""
    return ols(pairs, "d", [label_lag, time_lag]).tolist()


def residualize(df: DataFrame, y: str, t: str, keys: list[str], name: str) -> DataFrame:
    """df with y less its line over t, by keys."""
    line = df.groupBy(*keys).agg(F.regr_slope(y, t).alias("__s"), F.regr_intercept(y, t).alias("__i"))
    joined = df.join(line, keys) if keys else df.join(F.broadcast(line), F.lit(True))
    return joined.withColumn(name, F.col(y) - F.col("__i") - F.col("__s") * F.col(t)).drop("__s", "__i")


#: Pairs of a series that a task takes at once.
PAIRS = 1 << 18


def shuffled_sums(pairs: DataFrame, labels: DataFrame, n_shuffles: int, keys: list[str] | None = None, edges: list[float] | None = None) -> DataFrame:
    """keys, shuffle (0: as seen), bin, n, sx, sxx, sy, sxy: sums over pairs of x, the |difference of labels|, and y, the distance, in bins [a, b) of x, or all in bin 0.

    pairs: keys, i, j, d; labels: keys, i, label, i from 1 within keys. Permuting rows and columns of the distances is permuting the labels: the labels of all shuffles are
    one array of arrays for each key, and meet its pairs in blocks. A task adds up a block at a time, so it holds PAIRS pairs or so however many blocks it has; rows are as many as shuffles times bins of each block.
    """
    keys = keys or []
    copies = labels.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles))))
    seed = [F.col("shuffle").cast("string"), *(F.col(k).cast("string") for k in keys)]
    drawn = F.when(F.col("shuffle") == 0, F.row_number().over(Window.partitionBy(*keys, "shuffle").orderBy("i"))).otherwise(permuted_rank([*keys, "shuffle"], "i", *seed))
    in_order = lambda a, b: F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: x[b])
    moved = copies.select(*keys, "shuffle", drawn.alias("__r"), F.col("label").cast("double").alias("label")).groupBy(*keys, "shuffle").agg(in_order("__r", "label").alias("__l"))
    known = moved.groupBy(*keys).agg(in_order("shuffle", "__l").alias("__l"))
    many = pairs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("long").alias("__b"))
    by_key = lambda x, y: x.join(y, keys) if keys else x.join(F.broadcast(y), F.lit(True))
    dealt = by_key(pairs.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d")), many).withColumn("__k", F.pmod(F.xxhash64("i", "j"), "__b")).drop("__b")
    met = by_key(known, many).select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)).alias("__of"), "__l")
    cut = np.array(edges, float) if edges else None
    names = [*keys, "shuffle", "bin", "n", "sx", "sxx", "sy", "sxy"]

    def add(block: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(held):
            i, j, d = block["i"].to_numpy() - 1, block["j"].to_numpy() - 1, block["d"].to_numpy(float)
            for s, one in enumerate(held["__l"].iloc[0]):
                one = np.asarray(one, float)
                x = np.abs(one[i] - one[j])
                at = np.searchsorted(cut, x, "right") - 1 if cut is not None else np.zeros(len(x), np.int64)
                good = (at >= 0) & (at < (len(cut) - 1 if cut is not None else 1))
                at, x, y = at[good], x[good], d[good]
                size = len(cut) - 1 if cut is not None else 1
                sums = [np.bincount(at, w, size) for w in (None, x, x * x, y, x * y)]
                out += [(s, b, int(sums[0][b]), *(float(v[b]) for v in sums[1:])) for b in np.flatnonzero(sums[0]).tolist()]
        return pd.DataFrame([(*(block[k].iloc[0] for k in keys), *o) for o in out], columns=names)

    fields = "".join(f"{k} {pairs.schema[k].dataType.simpleString()}, " for k in keys)
    parts = dealt.groupBy(*keys, "__k").cogroup(met.groupBy(*(f"__of_{k}" for k in keys), "__of")).applyInPandas(add, f"{fields}shuffle int, bin int, n long, sx double, sxx double, sy double, sxy double")
    return parts.groupBy(*keys, "shuffle", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sy", "sxy")))


def distance_label_shuffle_test(pairs: DataFrame, labels: DataFrame, n_shuffles: int, keys: list[str] | None = None) -> DataFrame:
    """keys, slope, p of distance on |difference of labels|: p = (1 + shuffles with as large a slope) / (n + 1), from shuffled_sums."""
    keys = keys or []
    line = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.lit(0.0))
    slopes = shuffled_sums(pairs, labels, n_shuffles, keys).select(*keys, "shuffle", F.round(line, 12).alias("slope"))
    seen = slopes.where("shuffle = 0").select(*keys, F.col("slope").alias("seen"))
    null = slopes.where("shuffle > 0").join(seen, keys or F.lit(True))
    return null.groupBy(*keys, "seen").agg(((1 + F.sum((F.abs("slope") >= F.abs("seen")).cast("int"))) / (F.count(F.lit(1)) + 1)).alias("p")).withColumnRenamed("seen", "slope")


def distance_label_bin_null(pairs: DataFrame, labels: DataFrame, edges: list[float], n_shuffles: int, keys: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """keys, bin, n, mean of the distances in bins [a, b) of |difference of labels|, with mean, low and high of the shuffles' means of that bin (the middle `level` of them)."""
    keys = keys or []
    means = shuffled_sums(pairs, labels, n_shuffles, keys, edges).select(*keys, "shuffle", "bin", "n", (F.col("sy") / F.col("n")).alias("mean"))
    tail = (1 - level) / 2
    null = means.where("shuffle > 0").groupBy(*keys, "bin").agg(F.avg("mean").alias("null_mean"), F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))
    return means.where("shuffle = 0").drop("shuffle").join(null, [*keys, "bin"], "left")


def resample_trajectories(rows: DataFrame, points: int) -> DataFrame:
    """traj, feature, point, value: each trajectory (traj, step, feature, value) stretched to [0, 1] and interpolated at `points` places; missing values are left out."""
    from .intervals import interpolate_to

    w = Window.partitionBy("traj")
    timed = rows.withColumn("t", F.coalesce((F.col("step") - F.min("step").over(w)) / F.nullif(F.max("step").over(w) - F.min("step").over(w), F.lit(0)), F.lit(0.0)))
    known = timed.where(F.col("value").isNotNull() & ~F.isnan("value"))
    grid = known.select("traj", "feature").distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("t", F.col("point") / F.lit(float(points - 1)))
    return interpolate_to(known.select("traj", "feature", "t", "value"), grid, "value", ["traj", "feature"]).join(grid, ["traj", "feature", "t"]).select("traj", "feature", "point", "value")


def mean_trajectory(resampled: DataFrame) -> DataFrame:
    """feature, point, mean, std (population) over trajectories of resampled ones."""
    return resampled.groupBy("feature", "point").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def mean_distance_matrix(resampled: DataFrame, points: int) -> DataFrame:
    """p, q, mean, std (population) over trajectories of the Euclidean distance between points p <= q."""
    a = resampled.select("traj", "feature", F.col("point").alias("p"), F.col("value").alias("va")).withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(points - 1))))
    b = resampled.select("traj", "feature", F.col("point").alias("q"), F.col("value").alias("vb"))
    d = a.join(b, ["traj", "feature", "q"]).groupBy("traj", "p", "q").agg(F.sqrt(F.sum((F.col("va") - F.col("vb")) ** 2)).alias("d"))
    return d.groupBy("p", "q").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
