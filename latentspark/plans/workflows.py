"""The three end-to-end jobs, put together from the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators import decode, fit, intervals, kernels, nulls, perievent, segments, signals, tuning
from latentspark.sources.shared import saved


def label_tuning(spikes: DataFrame, labels: DataFrame, epochs: DataFrame, dt: float, low: float, size: float, bins: int, std: float | None, keys: list[str], least_seconds: float | None = None) -> DataFrame:
    """latent, unit, rate (counts in a second) by a label (keys, t, label): counts in bins of dt in the epochs, labels interpolated at their centres."""
    counts = intervals.count_in_bins(spikes, epochs, dt, keys)
    centres = intervals.bins_of(epochs.select(*keys, "interval_id", "start", "end"), dt)
    at = intervals.interpolate_to(labels, centres.select(*keys, "t"), "label", keys)
    placed = centres.join(at, [*keys, "t"]).withColumn("latent", tuning.digitize(F.col("label"), low, size, bins)).where("latent is not null").select(*keys, "interval_id", "bin", "latent")
    seconds = tuning.occupancy(placed, "latent", dt)
    summed = tuning.counts_by_bin(counts, placed, [*keys, "interval_id", "bin"], "latent")
    kernel = None
    if std:
        grid = seconds.select("latent", (low + (F.col("latent") + 0.5) * size).alias("x"))
        kernel = tuning.smoothing_kernel(grid, "latent", [("x", std)])
    return tuning.tuning_by_label(summed, seconds, "latent", kernel, least_seconds)


def replay_supervised(spikes: DataFrame, labels: DataFrame, epochs: DataFrame, keys: list[str], *, tuning_dt: float, low: float, size: float, bins: int, std: float, burst_dt: float, burst_std: float, z_peak: float, shortest: float, longest: float, event_dt: float, n_shuffles: int, gains: list[float]) -> dict[str, DataFrame]:
    """Tuning by label, bursts, shuffle tests for each gain, decoding and segment metrics: one row for each burst in `events`, without tests (null) and segments where no latent has a rate."""
    spark = spikes.sparkSession
    rates = label_tuning(spikes, labels, epochs, tuning_dt, low, size, bins, std, keys).where("rate is not null")
    bursts = signals.detect_bursts(spikes, epochs, burst_dt, burst_std, keys, z_peak, shortest, longest)
    half = burst_dt / 2
    windows = bursts.select(*keys, (F.col("start") - half).alias("start"), (F.col("end") + half).alias("end"), "peak").withColumn("interval_id", F.xxhash64(*keys, "start"))
    windows = saved(windows)  # several jobs below begin with them
    units = rates.select("unit").distinct()
    counts = intervals.count_in_bins(spikes, windows, event_dt, keys, windows.select(*keys).distinct().join(F.broadcast(units), F.lit(True)), block=intervals.fitting_block(windows))
    per_bin = rates.withColumn("rate", F.col("rate") * event_dt)
    null = saved(nulls.event_nulls(counts, per_bin, [*keys, "interval_id"], n_shuffles, gains))  # the sweep, the limits and the tests read it
    sweep = nulls.gain_sweep(null, [*keys, "interval_id"])
    best = sweep.where("best").select("gain")
    limits = null.join(F.broadcast(best), "gain").groupBy(*keys, "interval_id").agg(F.max(F.when(F.col("kind") == "observed", F.col("log_marginal"))).alias("observed"), F.percentile(F.when(F.col("kind") == "unit", F.col("log_marginal")), 0.95).alias("unit_limit"), F.percentile(F.when(F.col("kind") == "circular", F.col("log_marginal")), 0.95).alias("circular_limit"))
    tests = limits.withColumn("significant", F.col("observed") > F.greatest("unit_limit", "circular_limit"))
    move = kernels.as_arrays(kernels.stacked_kernels([kernels.move_kernel(spark, bins, 2.0)], bins), bins)
    model = decode.Model.of(per_bin, move, kernels.switching(0.02, 0.02))
    decoded = decode.decode_hmm(counts, model, [*keys, "interval_id"])
    k = [*keys, "interval_id"]
    where = F.array_position("p_latent", F.array_max("p_latent")) - 1
    rows = decoded.select(*k, "bin", F.element_at("p_dyn", 1).alias("p_continuous"), (low + (where + 0.5) * size).alias("position"))
    parts = segments.split_segments(segments.continuous_segments(rows, "p_continuous", 0.8, 2, k), "position", 10 * size, 2, k)
    metrics = segments.event_metrics(intervals.bins_in(windows, event_dt, keys), segments.segment_metrics(parts, "position", event_dt, k), event_dt, k)
    return {"tuning": rates, "windows": windows, "sweep": sweep, "tests": tests, "metrics": metrics, "events": windows.join(metrics, k).join(tests, k, "left")}


def replay_unsupervised(spark: SparkSession, counts: DataFrame, event_counts: DataFrame, keys: list[str], event: str, latents: int, rounds: int, seed: int = 0) -> dict[str, DataFrame | list[float]]:
    """A latent model fitted by EM to counts, then events decoded under a moving and a jumping kernel each, with the probability of either."""
    move = kernels.as_arrays(kernels.move_kernel(spark, latents, 2.0), latents)
    jump = kernels.as_arrays(kernels.jump_kernel(spark, latents), latents)
    both = np.concatenate([move, jump])
    start = fit.init_random(counts.select(*keys, "bin").distinct(), keys, latents, seed)
    rates, history = fit.fit_em(spark, counts, start, both, kernels.switching(0.02, 0.02), fit.tuning_basis(fit.rbf(latents, 2.0)), keys, rounds)
    one = np.ones((1, 1))
    models = {"move": decode.Model.of(rates, move, one), "jump": decode.Model.of(rates, jump, one)}
    return {"tuning": rates, "history": history, "events": decode.event_marginals(event_counts, models, [*keys, event])}


def event_triggered(series: DataFrame, value: str, keys: list[str], *, window: int, std: float, height: float, reach: int, n_shuffles: int) -> dict[str, DataFrame]:
    """Ramp onsets of a regular signal (keys, bin, value), the signal around them, jittered nulls and tests."""
    onsets = signals.ramp_onsets(series, value, window, std, height, keys).select(*keys, F.col("bin").alias("event_bin"))
    feature = series.select(*keys, "bin", F.col(value).alias("value"))
    table = perievent.peri_event(feature, onsets, reach, keys)
    shuffled = perievent.peri_event_shuffle(feature, onsets, reach, n_shuffles, 1, 10, keys)
    return {"onsets": onsets, "table": table, "shuffled": shuffled, "tests": perievent.pre_post_test(table, keys, reach), "null": perievent.pre_post_vs_shuffle(table, shuffled, keys, reach)}
