"""Replay on several mazes at once: one latent space of all their bins, decoded with a kernel that is kept as blocks of products."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators import decode, intervals, kernels, nulls, segments, signals, tuning
from latentspark.operators.structure import Blocks, Kernel, LowRank, Product, SameRows, moving
from latentspark.sources.shared import saved


@dataclass(frozen=True)
class Axis:
    """A coordinate of a maze: bins of `size` from `low` on, and the deviation of the smoothing in the coordinate's own unit."""

    name: str
    low: float
    size: float
    bins: int
    std: float

    def centre(self, k: int) -> float:
        return self.low + (k + 0.5) * self.size


@dataclass(frozen=True)
class Maze:
    name: str
    axes: tuple[Axis, ...]

    @property
    def size(self) -> int:
        return int(np.prod([a.bins for a in self.axes]))


@dataclass(frozen=True)
class Mazes:
    """Latents of all mazes one after another, in the order given, each maze's bins in row-major order."""

    mazes: tuple[Maze, ...]

    @property
    def coordinates(self) -> list[str]:
        return list(dict.fromkeys(a.name for m in self.mazes for a in m.axes))

    @property
    def offsets(self) -> list[int]:
        return np.cumsum([0, *(m.size for m in self.mazes)]).tolist()

    def grid(self, spark: SparkSession) -> DataFrame:
        """maze, flat_idx and every coordinate; null where a maze lacks one."""
        rows = []
        for m, first in zip(self.mazes, self.offsets, strict=False):
            for k, at in enumerate(product(*(range(a.bins) for a in m.axes))):
                here = {a.name: a.centre(i) for a, i in zip(m.axes, at, strict=True)}
                rows.append((m.name, first + k, *(here.get(c) for c in self.coordinates)))
        return spark.createDataFrame(rows, ", ".join(["maze string", "flat_idx long", *(f"{c} double" for c in self.coordinates)]))

    def flat(self, maze: str = "maze") -> Column:
        """The latent of a row with a maze and its coordinates; null in an unknown maze or without a coordinate."""
        out = F.lit(None).cast("long")
        for m, first in zip(self.mazes, self.offsets, strict=False):
            at = tuning.flat_index([(tuning.digitize(F.col(a.name), a.low, a.size, a.bins), a.bins) for a in m.axes])
            out = F.when(F.col(maze) == m.name, first + at).otherwise(out)
        return out

    def smoothing(self, spark: SparkSession) -> DataFrame:
        """i, j, w: each maze smoothed by its own deviations, nothing between mazes."""
        out = None
        for m in self.mazes:
            part = self.grid(spark).where(F.col("maze") == m.name)
            k = kernels.label_grid_kernel(part, [(a.name, a.std) for a in m.axes]).select("i", "j", F.col("p").alias("w"))
            out = k if out is None else out.unionByName(k)
        return out

    def moves(self, variance: float) -> Kernel:
        """Steps of exp(-d^2 / variance^2) in bins along each axis, no step between mazes."""
        along = lambda a: LowRank.of(moving(a.bins, variance))
        return Blocks([Product([along(a) for a in m.axes]) if len(m.axes) > 1 else along(m.axes[0]) for m in self.mazes])

    def dynamics(self, variance: float) -> list[Kernel]:
        """Moving within a maze, and jumping to any bin of any maze."""
        return [self.moves(variance), SameRows(self.offsets[-1])]


def maze_tuning(spikes: DataFrame, position: DataFrame, epochs: DataFrame, mazes: Mazes, dt: float, keys: list[str], least_seconds: float | None = None) -> DataFrame:
    """latent, unit, rate (counts in a second) over the bins of all mazes; null where too little time was spent. position: keys, t, maze, coordinates; what happens between two samples belongs to the nearer one.

    Counts and places are saved on the way: each is read several times, and one plan of all of it outgrows the driver.
    """
    spark = spikes.sparkSession
    counts = saved(intervals.count_in_bins(spikes, epochs, dt, keys))
    centres = intervals.bins_of(epochs.select(*keys, "interval_id", "start", "end"), dt).select(*keys, "interval_id", "bin", "t")
    placed = saved(tuning.align_labels(position, centres, [], ["maze", *mazes.coordinates], keys).withColumn("latent", mazes.flat()).where("latent is not null").select(*keys, "interval_id", "bin", "latent"))
    seconds = tuning.occupancy(placed, "latent", dt)
    summed = tuning.counts_by_bin(counts, placed, [*keys, "interval_id", "bin"], "latent")
    return tuning.tuning_by_label(summed, seconds, "latent", mazes.smoothing(spark), least_seconds)


def state_fractions(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dyn, fraction: the mean probability of each dynamics over an event's bins."""
    return decoded.select(*keys, F.posexplode("p_dyn").alias("dyn", "p")).groupBy(*keys, "dyn").agg(F.avg("p").alias("fraction"))


def main_maze(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, maze, maze_fraction: the maze that most bins of an event are decoded in, the first by name of several, and its share of the bins."""
    by = rows.groupBy(*keys, "maze").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(*keys).agg(F.min_by("maze", F.struct(-F.col("n"), "maze")).alias("maze"), (F.max("n") / F.sum("n")).alias("maze_fraction"))


def replay_on_mazes(
    spikes: DataFrame, position: DataFrame, epochs: DataFrame, keys: list[str], mazes: Mazes, *, tuning_dt: float, burst_dt: float, burst_std: float, z_peak: float, shortest: float, longest: float, event_dt: float,
    n_shuffles: int, gains: list[float], offtrack: DataFrame | None = None, least_seconds: float | None = None, variance: float = 1.0, continuous: float = 0.8, least_bins: int = 2, most_step: float = 10.0,
) -> dict[str, DataFrame]:
    """Supervised replay over several mazes: tuning by the bins of all of them, bursts, shuffle tests for each gain, events decoded over all mazes at the best gain, segments and their metrics.

    offtrack: intervals (keys, start, end) that are left out of the epochs of the tuning. Latents without a rate in some unit take no part in decoding. Segments
    break where the most probable maze changes, and at steps of more than most_step. `events` has a row for each burst. Where no latent takes part
    (no full bin of tuning_dt lies on the track), bursts have no segments, and what comes from tests and decoding is null.
    """
    spark, k = spikes.sparkSession, [*keys, "interval_id"]
    on = epochs.select(*keys, "start", "end")
    if offtrack is not None:
        on = intervals.set_operation(on, offtrack.select(*keys, "start", "end"), "diff", keys)
    on = saved(on.withColumn("interval_id", F.xxhash64(*keys, "start")))
    rates = saved(maze_tuning(spikes, position, on, mazes, tuning_dt, keys, least_seconds))
    valid = sorted(r.latent for r in tuning.valid_bins(rates, "latent").where("valid").collect())  # the grid's
    rates = rates.where(F.col("latent").isin(valid))
    bursts = signals.detect_bursts(spikes, epochs, burst_dt, burst_std, keys, z_peak, shortest, longest)
    half = burst_dt / 2
    windows = saved(bursts.select(*keys, (F.col("start") - half).alias("start"), (F.col("end") + half).alias("end"), "peak").withColumn("interval_id", F.xxhash64(*keys, "start")))  # several jobs begin with them
    units = rates.select("unit").distinct()
    counts = saved(intervals.count_in_bins(spikes, windows, event_dt, keys, windows.select(*keys).distinct().join(F.broadcast(units), F.lit(True)), block=intervals.fitting_block(windows)))
    per_bin = rates.withColumn("rate", F.col("rate") * event_dt)
    null = saved(nulls.event_nulls(counts, nulls.consecutive(per_bin), k, n_shuffles, gains))
    sweep = nulls.gain_sweep(null, k)
    best = sweep.where("best").select("gain").first()  # one number
    gain = best.gain if best else gains[0]
    tests = nulls.tested_events(null.where(F.col("gain") == gain), k)
    model = decode.Model.of(per_bin, mazes.dynamics(variance), kernels.switching(0.02, 0.02), latents=mazes.offsets[-1])
    decoded = saved(decode.decode_hmm(counts, model, k, gain=gain, valid=valid))
    where = decode.map_position(decoded, mazes.grid(spark), k)
    rows = where.join(decoded.select(*k, "bin", F.element_at("p_dyn", 1).alias("p_continuous")), [*k, "bin"])
    axes = mazes.coordinates
    parts = segments.split_segments(segments.continuous_segments(rows, "p_continuous", continuous, least_bins, k), axes, most_step, least_bins, k, maze="maze")
    metrics = segments.segment_metrics(parts, axes, event_dt, k)
    summary = segments.event_metrics(intervals.bins_in(windows, event_dt, keys), metrics, event_dt, k)
    fractions = state_fractions(decoded, k)
    named = fractions.groupBy(*k).agg(*(F.max(F.when(F.col("dyn") == d, F.col("fraction"))).alias(n) for d, n in enumerate(("p_move", "p_jump"))))
    events = windows.join(summary, k).join(tests, k, "left").join(main_maze(where, k), k, "left").join(named, k, "left")
    return {"tuning": rates, "windows": windows, "counts": counts, "sweep": sweep, "tests": tests, "decoded": decoded, "positions": rows, "segments": parts, "metrics": metrics, "fractions": fractions, "events": events}
