"""Smoothing, derivatives, normalisation and burst detection on regular series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.sources.shared import saved

from . import blocks as B
from . import intervals as I


def gaussian_weights(std: float, cut: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) in bins, cut at `cut` standard deviations."""
    reach = max(1, int(math.ceil(cut * std)))
    return [(k, math.exp(-0.5 * (k / std) ** 2)) for k in range(-reach, reach + 1)]


def gaussian_smooth(series: DataFrame, value: str, std: float, keys: list[str], at: str = "bin", name: str | None = None) -> DataFrame:
    """series with `name`: the Gaussian mean over neighbouring rows, renormalised at the ends. Rows of keys are regular, in order of `at`."""
    weights = gaussian_weights(std)
    dealt, w, own = B.halo(series, keys, at, max(k for k, _ in weights))
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, g in weights:
        x = F.col(value) if k == 0 else F.lag(value, -k).over(w)
        total, weight = total + F.coalesce(x * g, F.lit(0.0)), weight + F.when(x.isNotNull(), g).otherwise(0.0)
    return dealt.withColumn("__smooth", total / weight).where(own).withColumn(name or value, F.col("__smooth")).drop("__smooth", "__row", "__at")


def derivative(series: DataFrame, value: str, keys: list[str], t: str = "t", name: str = "slope") -> DataFrame:
    """Central differences over time, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(t)
    here = F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v"))
    with_both = series.withColumns({"__a": F.coalesce(F.lag(here).over(w), here), "__b": F.coalesce(F.lead(here).over(w), here)})
    return with_both.withColumn(name, F.when(F.col("__b.t") != F.col("__a.t"), (F.col("__b.v") - F.col("__a.v")) / (F.col("__b.t") - F.col("__a.t")))).drop("__a", "__b")


def zscore_with_baseline(series: DataFrame, value: str, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """series with z: mean and population deviation of the rows inside the baseline intervals, of all rows where there are none."""
    stats = lambda x, p: x.groupBy(*keys).agg(F.avg(value).alias(f"{p}m"), F.stddev_pop(value).alias(f"{p}s"))
    inside = stats(I.restrict(series, baseline, keys), "b")
    joined = series.join(stats(series, "a"), keys).join(inside, keys, "left")
    z = (F.col(value) - F.coalesce("bm", "am")) / F.coalesce("bs", "as")
    return joined.withColumn("z", F.when(F.coalesce("bs", "as") > 0, z)).drop("am", "as", "bm", "bs")


def population_rate(spikes: DataFrame, epochs: DataFrame, dt: float, keys: list[str]) -> DataFrame:
    """keys, interval_id, bin, t, n: spikes of all units in each bin of the epochs, zeros kept."""
    pooled = spikes.withColumn("unit", F.lit("all"))
    counts = I.count_in_bins(pooled, epochs, dt, keys, epochs.select(*keys).distinct().withColumn("unit", F.lit("all")))
    times = epochs.select(*keys, "interval_id", F.col("start").alias("__start"))
    return counts.join(times, [*keys, "interval_id"]).withColumn("t", F.col("__start") + (F.col("bin") + 0.5) * dt).select(*keys, "interval_id", "bin", "t", "n")


def detect_bursts(spikes: DataFrame, epochs: DataFrame, dt: float, std: float, keys: list[str], z_peak: float = 3.0, shortest: float = 0.05, longest: float = 0.5, baseline: DataFrame | None = None) -> DataFrame:
    """keys, start, end, n (bins), peak: runs of z > 0 that reach z_peak and last from shortest to longest, both included.

    Rate over fine bins, smoothed by std bins, z-scored on the baseline (all of it by default). The rate is saved before and after smoothing, as each
    is read several times: one plan of all steps outgrows the driver.
    """
    rate = saved(population_rate(spikes, epochs, dt, keys))
    smooth = saved(gaussian_smooth(rate, "n", std, [*keys, "interval_id"], name="rate"))
    z = zscore_with_baseline(smooth, "rate", baseline if baseline is not None else epochs, keys)
    found = I.runs(z, F.col("z") > 0, [*keys, "interval_id"], aggregates=[F.max("z").alias("peak")])
    length = F.col("end") - F.col("start")
    return found.where((F.col("peak") > z_peak) & (length >= shortest - 1e-9) & (length <= longest + 1e-9))


def ramp_onsets(series: DataFrame, value: str, window: int, std: float, height: float, keys: list[str], at: str = "bin", detrend: float | None = None) -> DataFrame:
    """Rows where the smoothed forward slope of the z-scored signal peaks at `height` or more: slope over `window` rows, the last value repeated at the end; plateaus count once, at their first row."""
    known = series.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    s = series.join(known, keys).withColumn("__z", (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")
    if detrend:
        s = gaussian_smooth(s, "__z", detrend, keys, at, "__low").withColumn("__z", F.col("__z") - F.col("__low")).drop("__low")
    s = s.join(s.groupBy(*keys).agg(F.max_by("__z", at).alias("__last")), keys)
    dealt, w, own = B.halo(s, keys, at, window)
    slope = (F.coalesce(F.lead("__z", window).over(w), F.col("__last")) - F.col("__z")) / window
    s = dealt.withColumn("__slope", slope).where(own).drop("__row", "__at", "__last", "__z")
    dealt, w, own = B.halo(gaussian_smooth(s, "__slope", std, keys, at, "slope"), keys, at, 1)
    peak = (F.col("slope") > F.lag("slope").over(w)) & (F.col("slope") >= F.lead("slope").over(w)) & (F.col("slope") >= height)
    return dealt.withColumn("__p", peak).where(own & F.col("__p")).drop("__p", "__row", "__at", "__slope")


def angular_velocity(series: DataFrame, keys: list[str], least_speed: float = 1e-6) -> DataFrame:
    """(vx ay - vy ax) / (vx^2 + vy^2) from columns x, y; null at speeds up to least_speed."""
    s = series
    for a, b in (("x", "vx"), ("y", "vy"), ("vx", "ax"), ("vy", "ay")):
        s = derivative(s, a, keys, name=b)
    speed2 = F.col("vx") ** 2 + F.col("vy") ** 2
    return s.withColumn("omega", F.when(speed2 > least_speed**2, (F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")) / speed2))


def vector_distance(a, b, metric: str):
    """Euclidean, cityblock, cosine, correlation or jensenshannon distance of two array columns, another metric is an error. Cosine and correlation: 0 if both are zero, 2 if one is. Jensen-Shannon: the root of the divergence in nats of the arrays as shares, null without mass."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "euclidean":
        d = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
        return F.sqrt(dot(d, d))
    if metric == "cityblock":
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    if metric == "correlation":
        centred = lambda x: F.transform(x, lambda v: v.cast("double") - F.aggregate(x, F.lit(0.0), lambda s, u: s + u.cast("double")) / F.size(x))
        a, b = centred(a), centred(b)
    if metric == "jensenshannon":
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
        share = lambda x: F.transform(x, lambda v: v.cast("double") / total(x))
        half = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.when(u > 0, u * F.log(2 * u / (u + v))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
        p, q = share(a), share(b)
        return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest((half(p, q) + half(q, p)) / 2, F.lit(0.0))))
    if metric not in ("cosine", "correlation"):
        raise ValueError(f"unknown metric: {metric}")
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 2.0).otherwise(1 - dot(a, b) / (na * nb))


def consecutive_distance(vectors: DataFrame, vector: str, metric: str, keys: list[str], order: list[str]) -> DataFrame:
    """vectors with `distance` to the row before, null for the first."""
    before = F.lag(vector).over(Window.partitionBy(*keys).orderBy(*order))
    return vectors.withColumn("__b", before).withColumn("distance", F.when(F.col("__b").isNotNull(), vector_distance(F.col(vector), F.col("__b"), metric))).drop("__b")


def consecutive_in_ranges(vectors: DataFrame, vector: str, metric: str, at: str, width: int) -> DataFrame:
    """vectors with `distance` to the row before in order of a whole-number column, null for the first, for one series that is too long for a task: lags inside ranges of `width` numbers, and the first row of a range against the last row of the range before."""
    ranged = vectors.withColumn("__g", F.floor(F.col(at) / width))
    w = Window.partitionBy("__g").orderBy(at)
    ends = vectors.groupBy(F.floor(F.col(at) / width).alias("__g")).agg(F.max_by(vector, at).alias("__e"))
    before = ends.withColumn("__f", F.lag("__e").over(Window.orderBy("__g"))).select("__g", "__f")  # a row for each range
    with_before = ranged.withColumn("__l", F.lag(vector).over(w)).withColumn("__r", F.row_number().over(w)).join(before, "__g", "left")
    b = F.when(F.col("__r") == 1, F.col("__f")).otherwise(F.col("__l"))
    return with_before.withColumn("__b", b).withColumn("distance", F.when(F.col("__b").isNotNull(), vector_distance(F.col(vector), F.col("__b"), metric))).drop("__g", "__f", "__l", "__r", "__b")


def population_mean_rate(bins: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """keys, t, rate: the mean count over units of each time bin (keys, t, unit, n) by the median distance of bins."""
    mean = bins.groupBy(*keys, t).agg(F.avg("n").alias("__m"))
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    width = mean.withColumn("__d", gap).groupBy(*keys).agg(F.percentile("__d", 0.5).alias("__w"))
    return mean.join(width, keys).select(*keys, t, (F.col("__m") / F.col("__w")).alias("rate"))


def feature_table(counts: DataFrame, keys: list[str], jump: DataFrame | None = None, signal: DataFrame | None = None) -> DataFrame:
    """keys, bin, value, feature: mean count of a bin (`rate`), cosine distance of successive count vectors (`distance`), and, where given, a probability of jumping and a signal (keys, bin, value)."""
    wide = counts.groupBy(*keys, "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "n"))), lambda x: x["n"].cast("double")).alias("v"))
    out = counts.groupBy(*keys, "bin").agg(F.avg("n").alias("value")).withColumn("feature", F.lit("rate"))
    step = consecutive_distance(wide, "v", "cosine", keys, ["bin"]).where("distance is not null")
    out = out.unionByName(step.select(*keys, "bin", F.col("distance").alias("value"), F.lit("distance").alias("feature")))
    for name, more in (("jump", jump), ("signal", signal)):
        if more is not None:
            out = out.unionByName(more.select(*keys, "bin", F.col("value").cast("double").alias("value"), F.lit(name).alias("feature")))
    return out


def normalize_units(counts: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """counts with `norm`: n by the unit's largest, or its z-score with the population deviation."""
    w = Window.partitionBy(*keys, "unit")
    value = F.col("n") / F.max("n").over(w) if how == "max" else (F.col("n") - F.avg("n").over(w)) / F.stddev_pop("n").over(w)
    return counts.withColumn("norm", value)
