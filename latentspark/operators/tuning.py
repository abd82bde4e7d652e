"""Expected counts per label bin: grids, occupancy, smoothing, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def infer_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, categorical: whether all finite values are whole numbers (false without any)."""
    ok = [F.coalesce(F.bool_and(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c) == F.floor(c))), F.lit(False)).alias(c) for c in columns]
    return df.agg(*ok).unpivot([], columns, "column", "categorical")


def label_grid(df: DataFrame, column: str, size: float, categorical: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """edge_ix, edge: edges low, low + size, ... up to high; bounds default to the least and largest value, widened by half a bin if categorical."""
    half = size / 2 if categorical else 0.0
    lo = F.lit(low) if low is not None else F.min(column) - half
    hi = F.lit(high) if high is not None else F.max(column) + half
    bounds = df.where(F.col(column).isNotNull() & ~F.isnan(column)).agg(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") + 1e-9 - F.col("lo")) / size).cast("long"))
    return bounds.select("lo", F.explode(steps).alias("edge_ix")).select("edge_ix", (F.col("lo") + F.col("edge_ix") * size).alias("edge"))


def digitize(x: Column, low: float, size: float, bins: int) -> Column:
    """Bin of x: values below the first edge go to bin 0, above the last one to the last; missing values have none."""
    raw = F.floor((x - low) / size).cast("long")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)))


def flat_index(dims: list[tuple[Column, int]]) -> Column:
    """Row-major index of several bins."""
    out = F.lit(0).cast("long")
    for ix, size in dims:
        out = out * size + ix
    return out


def align_labels(labels: DataFrame, bins: DataFrame, numeric: list[str], categorical: list[str], keys: list[str]) -> DataFrame:
    """bins (keys, t, ...) with the labels (keys, t, ...) at their times, all columns in one pass: numeric ones linear between the samples around, the end samples
    beyond them; categorical ones, text or numbers, from the nearest sample, the earlier of two as near. Of samples at one time the least counts."""
    line = lambda c: F.when(F.col("bt").isNull(), F.col(f"av.{c}")).when(F.col("at").isNull() | (F.col("at") == F.col("bt")), F.col(f"bv.{c}")).otherwise(F.col(f"bv.{c}") + (F.col(f"av.{c}") - F.col(f"bv.{c}")) * (F.col("t") - F.col("bt")) / (F.col("at") - F.col("bt")))
    early = F.col("bt").isNotNull() & (F.col("at").isNull() | (F.col("t") - F.col("bt") <= F.col("at") - F.col("t")))
    near = lambda c: F.when(early, F.col(f"bv.{c}")).otherwise(F.col(f"av.{c}"))
    around = intervals.neighbours(labels.select(*keys, "t", F.struct(*(F.col(c).alias(c) for c in [*numeric, *categorical])).alias("__label")), bins, "__label", keys)
    found = around.select(*keys, "t", *(line(c).alias(c) for c in numeric), *(near(c).alias(c) for c in categorical))
    return bins.join(found, [*keys, "t"])


def occupancy(bins: DataFrame, flat: str, dt: float) -> DataFrame:
    """flat, seconds of the label bins."""
    return bins.where(F.col(flat).isNotNull()).groupBy(flat).agg((F.count(F.lit(1)) * F.lit(dt)).alias("seconds"))


def median_step(times: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Median distance of consecutive times, by keys."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    return times.withColumn("__d", gap).groupBy(*keys).agg(F.percentile("__d", 0.5).alias("dt"))


def counts_by_bin(counts: DataFrame, labels: DataFrame, on: list[str], flat: str) -> DataFrame:
    """flat, unit, n: counts summed over the time bins of each label bin."""
    return counts.join(labels.select(*on, flat).where(F.col(flat).isNotNull()), on).groupBy(flat, "unit").agg(F.sum("n").alias("n"))


def smoothing_kernel(grid: DataFrame, index: str, dims: list[tuple[str, float | None]]) -> DataFrame:
    """i, j, w: for each bin i weights over bins j, the product of a row-normalised Gaussian for each (column, deviation); no deviation means only equal coordinates."""
    a = grid.select(F.col(index).alias("i"), *(F.col(c).alias(f"{c}_i") for c, _ in dims))
    b = grid.select(F.col(index).alias("j"), *(F.col(c).alias(f"{c}_j") for c, _ in dims))
    pairs = a.join(b, F.lit(True))  # a grid with itself: its size is a parameter
    w = F.lit(1.0)
    for c, std in dims:
        d = F.col(f"{c}_i") - F.col(f"{c}_j")
        w = w * (F.exp(-0.5 * (d / std) ** 2) if std else F.when(d == 0, 1.0).otherwise(0.0))
    raw = pairs.withColumn("w", w)
    return raw.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i"))).select("i", "j", "w")


def tuning_by_label(counts: DataFrame, seconds: DataFrame, flat: str, kernel: DataFrame | None = None, least_seconds: float | None = None) -> DataFrame:
    """flat, unit, rate: smoothed counts by smoothed seconds; null where the raw seconds are below least_seconds or the rate isn't finite. counts: flat, unit, n; seconds: flat, seconds."""
    units = counts.select("unit").distinct()
    frame = seconds.join(F.broadcast(units), F.lit(True)).join(counts, [flat, "unit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if kernel is None:
        rates = frame.withColumns({"num": F.col("n").cast("double"), "den": F.col("seconds")})
    else:
        k = kernel.withColumnRenamed("j", flat)
        sums = frame.join(k, flat).groupBy("i", "unit").agg(F.sum(F.col("w") * F.col("n")).alias("num"), F.sum(F.col("w") * F.col("seconds")).alias("den"))
        rates = sums.withColumnRenamed("i", flat).join(seconds, flat)
    good = F.col("den") > 0
    if least_seconds is not None:
        good = good & (F.col("seconds") >= least_seconds)
    return rates.select(flat, "unit", F.when(good, F.col("num") / F.col("den")).alias("rate"))


def valid_bins(tuning: DataFrame, flat: str) -> DataFrame:
    """flat bins where every unit has a rate."""
    return tuning.groupBy(flat).agg(F.bool_and(F.col("rate").isNotNull()).alias("valid"))


def grid_maps(grids: dict[str, DataFrame], index: str = "ix") -> DataFrame:
    """maze, flat_idx and the coordinates of several grids one after another, in order of name; coordinates that a maze lacks are null."""
    out, order = None, Window.partitionBy("maze").orderBy(index)
    for name in sorted(grids):
        g = grids[name].withColumn("maze", F.lit(name)).withColumn("local", F.row_number().over(order) - 1)
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    sizes = out.groupBy("maze").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(Window.orderBy("maze").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.join(F.broadcast(before), "maze").withColumn("flat_idx", F.col("__o") + F.col("local")).drop("__n", "__o", "local")


def sort_units_by_peak(tuning: DataFrame, latent: str = "latent") -> DataFrame:
    """unit, peak (latent of its largest rate, the least of several), position in order of peak and unit."""
    peak = tuning.groupBy("unit").agg(F.max_by(latent, F.struct("rate", -F.col(latent))).alias("peak"))
    return peak.withColumn("position", F.row_number().over(Window.orderBy("peak", "unit")))


def posterior_weighted_average(posterior: DataFrame, feature: str, latent: str = "latent", p: str = "p") -> DataFrame:
    """latent, mean of the feature weighted by the probability."""
    return posterior.groupBy(latent).agg((F.sum(F.col(p) * F.col(feature)) / F.sum(p)).alias("mean"))


def variance_from_std(df: DataFrame, std: str, name: str = "variance") -> DataFrame:
    """df with the square of a deviation; missing stays missing."""
    return df.withColumn(name, F.col(std) ** 2)
