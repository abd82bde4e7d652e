"""Position on a maze: distance to reference points, epochs off the track, at rest and moving, and transitions between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I
from . import places, transitions


def sample_reference_points(position: DataFrame, digits: int = 0) -> DataFrame:
    """lin, x, y: medians of position at each rounded linear position. As many rows as the maze has places."""
    return position.groupBy(F.round("lin", digits).alias("lin")).agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))


def points_along_edges(edges: DataFrame, step: float) -> DataFrame:
    """x, y every `step` along straight edges (x0, y0, x1, y1), ends included."""
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    n = F.greatest(F.ceil(length / step).cast("int"), F.lit(1))
    at = edges.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n")))).withColumn("__f", F.col("__k") / F.col("__n"))
    return at.select((F.col("x0") + F.col("__f") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("__f") * (F.col("y1") - F.col("y0"))).alias("y")).distinct()


def distance_to_points(position: DataFrame, points: DataFrame, ids: list[str], cell: float | None = None) -> DataFrame:
    """ids, away: the distance of x, y to the nearest reference point, through cells (`places`); any number of points will do."""
    return places.nearest_point(position.select(*ids, "x", "y"), points, cell=cell).select(*ids, "away")


def offtrack_candidates(series: DataFrame, keys: list[str], low: float, high: float, turn: float, close: float, order: list[str] | None = None) -> DataFrame:
    """keys, start, end, peak, turn, gap and the gates passed, of runs with away > low: away reaches high, |omega| exceeds turn, and start and end lie within `close`. series: t, x, y, away, omega."""
    ends = [F.max("away").alias("peak"), F.max(F.abs("omega")).alias("turn"), F.min_by(F.struct("x", "y"), "t").alias("__a"), F.max_by(F.struct("x", "y"), "t").alias("__b")]
    found = I.runs(series, F.col("away") > low, keys, aggregates=ends, order=order)
    gap = F.sqrt((F.col("__a.x") - F.col("__b.x")) ** 2 + (F.col("__a.y") - F.col("__b.y")) ** 2)
    gates = {"far": F.col("peak") > high, "turned": F.coalesce(F.col("turn") > turn, F.lit(False)), "returned": F.col("gap") <= close}
    return found.withColumn("gap", gap).withColumns(gates).withColumn("offtrack", F.col("far") & F.col("turned") & F.col("returned")).drop("__a", "__b")


def behaviour_epochs(series: DataFrame, offtrack: DataFrame, keys: list[str], slow: float = 2.5, fast: float = 5.0, order: list[str] | None = None) -> DataFrame:
    """keys, name, start, end: immobility (speed < slow), locomotion (speed > fast, less what is off track) and offtrack."""
    rest = I.threshold_runs(series, "speed", slow, "below", keys, order=order)
    moving = I.set_operation(I.threshold_runs(series, "speed", fast, "above", keys, order=order).select(*keys, "start", "end"), offtrack.select(*keys, "start", "end"), "diff", keys)
    named = lambda x, n: x.select(*keys, F.lit(n).alias("name"), "start", "end")
    return named(rest, "immobility").unionByName(named(moving, "locomotion")).unionByName(named(offtrack, "offtrack"))


def behaviour_transitions(labels: DataFrame, keys: list[str], unknown: str = "unknown") -> DataFrame:
    """i, j, c, p of adjacent known labels over all series."""
    pooled = transitions.label_transitions(labels, keys, "frame", [unknown]).groupBy("i", "j").agg(F.sum("c").alias("c"))
    return transitions.normalised(pooled, [])


def matrix_power(p: np.ndarray, power: float) -> np.ndarray:
    """A real power of a row-stochastic matrix by its eigenvalues; negative rounding is cut and rows made to sum to 1."""
    values, v = np.linalg.eig(p)
    out = np.clip((v @ np.diag(values.astype(complex) ** power) @ np.linalg.inv(v)).real, 0, None)
    return out / out.sum(1, keepdims=True)


def jump_segments(series: DataFrame, keys: list[str], p: str, threshold: float, gap: float) -> DataFrame:
    """keys, start, end, jump: runs of p > threshold, close ones joined, and what lies between them."""
    ends = series.groupBy(*keys).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    jumps = I.merge_close(I.threshold_runs(series, p, threshold, "above", keys), gap, keys).select(*keys, "start", "end")
    rest = I.set_operation(ends, jumps, "diff", keys)
    return jumps.withColumn("jump", F.lit(True)).unionByName(rest.withColumn("jump", F.lit(False)))


def median_in_segments(series: DataFrame, segments: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, start, end, median of value in each segment that isn't a jump."""
    calm = segments.where("not jump").select(*keys, "start", "end")
    return I.interval_join(series.select(*keys, "t", value), calm, keys).groupBy(*keys, "start", "end").agg(F.percentile(value, 0.5).alias("median"))


def consensus_by_window(table: DataFrame, widest: int) -> DataFrame:
    """window, fraction of events (event_bin, rel, y) with any y > 0 within +-window."""
    wide = table.withColumn("window", F.explode(F.sequence(F.lit(1), F.lit(widest))))
    hit = wide.groupBy("window", "session", "event_bin").agg(F.max(F.when(F.abs("rel") <= F.col("window"), (F.col("y") > 0).cast("int")).otherwise(0)).alias("h"))
    return hit.groupBy("window").agg(F.avg(F.col("h").cast("double")).alias("fraction"))


def rolled_consensus(series: DataFrame, events: DataFrame, widest: int, n_shuffles: int, keys: list[str]) -> DataFrame:
    """shuffle, window, fraction of consensus_by_window when each series (keys, bin, value) is rolled by a hashed shift of its own."""
    from latentspark.functions.seeds import drawn_shift

    from .perievent import peri_event

    size = series.groupBy(*keys).agg((F.max("bin") + 1).alias("__n"))
    copies = series.join(size, keys).withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles))))
    shift = drawn_shift(F.col("__n"), F.col("shuffle").cast("string"), *(F.col(k).cast("string") for k in keys))
    rolled = copies.select(*keys, "shuffle", F.pmod(F.col("bin") + shift, F.col("__n")).alias("bin"), "value")
    table = peri_event(rolled, events.join(rolled.select(*keys, "shuffle").distinct(), keys), widest, [*keys, "shuffle"])
    wide = table.withColumn("window", F.explode(F.sequence(F.lit(1), F.lit(widest))))
    hit = wide.groupBy("window", "shuffle", *keys, "event_bin").agg(F.max(F.when(F.abs("rel") <= F.col("window"), (F.col("y") > 0).cast("int")).otherwise(0)).alias("h"))
    return hit.groupBy("shuffle", "window").agg(F.avg(F.col("h").cast("double")).alias("fraction"))


def previous_state(series: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return series.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy("event_bin")))
