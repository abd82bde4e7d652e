"""Segments of a decoded event: continuous runs, where they break, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def continuous_segments(rows: DataFrame, p: str, threshold: float, least_bins: int, keys: list[str]) -> DataFrame:
    """rows inside runs of p > threshold of at least least_bins bins, with segment (numbered by time in its keys)."""
    w = Window.partitionBy(*keys).orderBy("bin")
    inside = F.coalesce(F.col(p) > threshold, F.lit(False))
    flagged = rows.withColumn("__in", inside).withColumn("__b", (F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))).cast("int"))
    return long_enough(flagged.withColumn("segment", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__in").drop("__in", "__b"), least_bins, keys)


def long_enough(rows: DataFrame, least_bins: int, keys: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "segment"))).where(F.col("__n") >= least_bins).drop("__n")


def _step(columns: list[str], w) -> Column:
    """The distance from the row before: over the coordinates that either row has, null where only one of the two has one, or none has any."""
    squares, known = F.lit(0.0), F.lit(False)
    for c in columns:
        x, before = (F.when(~F.isnan(v.cast("double")), v.cast("double")) for v in (F.col(c), F.lag(c).over(w)))
        lacking = x.isNull() & before.isNull() if len(columns) > 1 else F.lit(False)
        squares, known = squares + F.when(lacking, 0.0).otherwise((x - before) ** 2), known | ~lacking
    return F.when(known, F.sqrt(squares))


def split_segments(rows: DataFrame, position: str | list[str], most_step: float, least_bins: int, keys: list[str], maze: str | None = None) -> DataFrame:
    """rows with segments broken where the maze changes, then where a step (of one coordinate, or several) is above most_step or missing; short parts are dropped after each."""
    columns = [position] if isinstance(position, str) else position

    def broken(x: DataFrame, test) -> DataFrame:
        w = Window.partitionBy(*keys, "segment").orderBy("bin")
        marked = x.withColumn("__b", F.coalesce(test(w), F.lit(False)).cast("int"))
        part = marked.withColumn("__p", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        again = part.withColumn("segment", F.dense_rank().over(Window.partitionBy(*keys).orderBy("segment", "__p"))).drop("__b", "__p")
        return long_enough(again, least_bins, keys)

    if maze:
        rows = broken(rows, lambda w: F.col(maze) != F.lag(maze).over(w))
    first = lambda w: F.row_number().over(w) == 1
    return broken(rows, lambda w: ~first(w) & F.coalesce(_step(columns, w) > most_step, F.lit(True)))


def segment_metrics(rows: DataFrame, position: str | list[str], dt: float, keys: list[str], discard_step: float | None = None) -> DataFrame:
    """keys, segment, n_bins, path, displacement (largest from the start), span, speed (mean step by dt) of positions of one or several coordinates; steps above discard_step don't count; one bin gives zeros.

    span: the range of one coordinate, the largest distance of two bins of several. A coordinate that a segment lacks in every bin doesn't count.
    """
    columns = [position] if isinstance(position, str) else position
    w = Window.partitionBy(*keys, "segment").orderBy("bin")
    step = _step(columns, w)
    kept = F.when(step <= discard_step, step) if discard_step is not None else step
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    away = F.lit(0.0)
    for c in columns:
        away = away + (F.coalesce((F.col(c) - F.first(c).over(every)) ** 2, F.lit(0.0)) if len(columns) > 1 else (F.col(c) - F.first(c).over(every)) ** 2)
    s = rows.withColumns({"__s": kept, "__d": F.sqrt(away)})
    span = (F.max(columns[0]) - F.min(columns[0])) if len(columns) == 1 else F.lit(None).cast("double")
    out = s.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("__s"), F.lit(0.0)).alias("path"), F.max("__d").alias("displacement"),
        span.alias("span"), (F.coalesce(F.avg("__s"), F.lit(0.0)) / dt).alias("speed"),
    )
    if len(columns) == 1:
        return out
    wide = segment_span_2d(rows, keys, columns)
    return out.drop("span").join(wide, [*keys, "segment"]).select(*keys, "segment", "n_bins", "path", "displacement", "span", "speed")


def segment_span_2d(rows: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """keys, segment, span: the largest distance of two bins of a segment by its coordinates (x, y). A segment is part of one event, so it is short."""
    columns = columns or ["x", "y"]
    held = rows.groupBy(*keys, "segment").agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).alias("__p"))
    square = lambda a, b: sum((F.coalesce((a[i] - b[i]) ** 2, F.lit(0.0)) for i in range(len(columns))), F.lit(0.0))
    far = F.array_max(F.transform("__p", lambda a: F.array_max(F.transform("__p", lambda b: square(a, b)))))
    return held.select(*keys, "segment", F.sqrt(far).alias("span"))


def event_metrics(events: DataFrame, metrics: DataFrame, dt: float, keys: list[str]) -> DataFrame:
    """events (keys, n_bins) with duration, n_segments, median and max segment length, totals and medians of the metrics, fraction of continuous bins, list of lengths; events without segments have zeros and an empty list."""
    m = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.percentile("n_bins", 0.5).alias("median_length"), F.max("n_bins").alias("max_length"), F.sum("n_bins").alias("continuous_bins"),
        F.sum("path").alias("total_path"), F.percentile("path", 0.5).alias("median_path"), F.max("displacement").alias("max_displacement"), F.percentile("speed", 0.5).alias("median_speed"),
        F.transform(F.array_sort(F.collect_list(F.struct("segment", "n_bins"))), lambda s: s["n_bins"]).alias("lengths"),
    )
    joined = events.join(m, keys, "left")
    numbers = ["n_segments", "median_length", "max_length", "continuous_bins", "total_path", "median_path", "max_displacement", "median_speed"]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers} | {"lengths": F.coalesce("lengths", F.array().cast("array<bigint>"))})
    return filled.withColumns({"duration": F.col("n_bins") * dt, "fraction_continuous": F.when(F.col("n_bins") > 0, F.col("continuous_bins") / F.col("n_bins")).otherwise(0.0)})


def metrics_summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.sum("n_segments").alias("total_segments"), F.percentile("n_segments", 0.5).alias("median_segments"), F.percentile("total_path", 0.5).alias("median_path"), F.percentile("max_displacement", 0.5).alias("median_displacement"))


def best_events(windows: DataFrame, metrics: DataFrame, tests: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Significant events with their window and metrics, those with the largest displacement, at most `most`."""
    return windows.join(metrics, keys).join(tests, keys).where("significant").orderBy(F.desc("max_displacement"), *keys).limit(most)
