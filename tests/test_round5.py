"""Faults found in the fourth round: tables that leave the model without latents."""

import numpy as np

from latentspark.operators import decode, intervals, kernels, nulls
from latentspark.operators.structure import SameRows
from latentspark.plans import mazes, workflows

KEYS = ["session"]
ONE = mazes.Mazes((mazes.Maze("arm", (mazes.Axis("x", 0.0, 1.0, 4, 1.0),)),))


def _bursts(spark):
    """Spikes of two units over 400 s, three bursts among them, and one epoch."""
    rng = np.random.default_rng(0)
    at = [*(rng.random(400) * 400), *(t + x for t in (100.0, 200.0, 300.0) for x in rng.random(120) * 2)]
    spikes = spark.createDataFrame([("s", f"u{k % 2}", float(t)) for k, t in enumerate(at)], "session string, unit string, t double")
    return spikes, spark.createDataFrame([("s", 0, 0.0, 400.0)], "session string, interval_id int, start double, end double")


def test_mazes_without_a_full_bin_on_the_track_keep_a_row_for_each_burst(spark):
    spikes, epochs = _bursts(spark)
    position = spark.createDataFrame([("s", float(t), "arm", float(t % 4)) for t in range(400)], "session string, t double, maze string, x double")
    off = spark.createDataFrame([("s", t + 0.9, t + 1.0) for t in range(400)], "session string, start double, end double")  # 0.9 s on the track, then off it
    got = mazes.replay_on_mazes(spikes, position, epochs, KEYS, ONE, tuning_dt=1.0, burst_dt=0.5, burst_std=1.0, z_peak=3.0, shortest=1.0, longest=10.0, event_dt=0.5, n_shuffles=3, gains=[1.0, 2.0], offtrack=off)
    rows = sorted(got["events"].collect(), key=lambda r: r.start)
    assert [round(r.start / 100) for r in rows] == [1, 2, 3]
    for r in rows:
        assert r.n_bins == round((r.end - r.start) / 0.5) and r.n_segments == 0 and r.total_path == 0 and r.lengths == []
        assert (r.observed, r.unit_limit, r.circular_limit, r.significant, r.maze, r.maze_fraction, r.p_move, r.p_jump) == (None,) * 8
    assert all(got[k].count() == 0 for k in ("tuning", "sweep", "tests", "decoded", "positions", "segments", "metrics", "fractions"))


def test_replay_by_a_label_that_is_never_known_keeps_a_row_for_each_burst(spark):
    spikes, epochs = _bursts(spark)
    labels = spark.createDataFrame([("s", 5.0, None)], "session string, t double, label double")
    got = workflows.replay_supervised(spikes, labels, epochs, KEYS, tuning_dt=1.0, low=0.0, size=1.0, bins=4, std=1.0, burst_dt=0.5, burst_std=1.0, z_peak=3.0, shortest=1.0, longest=10.0, event_dt=0.5, n_shuffles=3, gains=[1.0, 2.0])
    rows = got["events"].collect()
    assert len(rows) == 3 and all(r.n_bins > 0 and r.n_segments == 0 and r.observed is None and r.significant is None for r in rows)


def test_no_latents_no_rows(spark):
    counts = spark.createDataFrame([("s", 0, "a", 1)], "session string, bin long, unit string, n long")
    none = spark.createDataFrame([], "latent long, unit string, rate double")
    assert nulls.event_nulls(counts, none, KEYS, 2, [1.0]).collect() == []
    model = decode.Model.of(none, [SameRows(3)], np.ones((1, 1)), latents=3)
    assert decode.decode_hmm(counts, model, KEYS, valid=[]).collect() == []
    assert decode.decode_hmm(counts, decode.Model.of(none, kernels.as_arrays(kernels.move_kernel(spark, 3, 1.0), 3), np.ones((1, 1))), KEYS).collect() == []


def test_full_bins_of_intervals(spark):
    rows = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 0.0, 0.9), ("s", 2, 5.0, 5.0), ("s", 3, 0.0, 0.3)], "session string, interval_id int, start double, end double")
    assert {r.interval_id: r.n_bins for r in intervals.bins_in(rows, 0.1, KEYS).collect()} == {0: 10, 1: 9, 2: 0, 3: 3}
    assert {r.interval_id: r["count"] for r in intervals.bins_of(rows, 0.1).groupBy("interval_id").count().collect()} == {0: 10, 1: 9, 3: 3}
