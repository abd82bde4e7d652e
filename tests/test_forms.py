"""Forms of operators that no query runs, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.functions import stats
from latentspark.operators import behaviour, decode, distances, fit, intervals, segments, signals, transitions, tuning
from latentspark.sources import tables

KEYS = ["session"]


def test_session_tables_are_read_with_their_schemas(spark, tmp_path):
    spikes = spark.createDataFrame([("a", "u", 1.0), ("b", "v", 2.5)], tables.SCHEMAS["spikes"])
    spikes.write.parquet(f"{tmp_path}/spikes.parquet")
    spark.createDataFrame([("a", "u", True)], tables.SCHEMAS["units"]).write.parquet(f"{tmp_path}/units.parquet")
    spikes.write.option("header", True).csv(f"{tmp_path}/spikes.csv")
    got = tables.load_session_tables(spark, str(tmp_path), ["spikes", "units"])
    assert sorted(got["spikes"].collect()) == sorted(spikes.collect()) and got["units"].first().is_pyr is True
    assert sorted(tables.load_session_tables(spark, str(tmp_path), ["spikes"], "csv")["spikes"].collect()) == sorted(spikes.collect())


def test_starts_from_labels(spark):
    labels = spark.createDataFrame([("a", b, v) for b, v in enumerate((0.0, 4.9, 5.0, 10.0, 11.0, None))], "session string, bin long, label double")
    got = {}
    for r in fit.init_labels(labels, KEYS, 2, 0.0, 10.0, 1e-3).collect():
        got.setdefault(r.bin, {})[r.latent] = r.p
    assert all(abs(sum(p.values()) - 1) < 1e-12 for p in got.values())
    assert [max(got[b], key=got[b].get) for b in range(4)] == [0, 0, 1, 1] and min(max(p.values()) for b, p in got.items() if b < 4) > 0.99
    assert got[4] == got[5] == {0: 0.5, 1: 0.5}


def test_best_events_are_significant_and_go_furthest(spark):
    k = ["session", "interval_id"]
    ids = spark.createDataFrame([("a", i) for i in range(6)], "session string, interval_id int")
    metrics = ids.withColumn("max_displacement", F.expr("array(3d, 9d, 5d, 5d, 8d, 1d)[interval_id]"))
    tests = ids.withColumn("significant", F.col("interval_id") != 1)
    got = segments.best_events(ids.withColumn("start", F.lit(0.0)), metrics, tests, k, 3).collect()
    assert [r.interval_id for r in got] == [4, 2, 3]


def test_points_along_edges(spark):
    edges = spark.createDataFrame([(0.0, 0.0, 3.0, 0.0), (3.0, 0.0, 3.0, 0.5), (1.0, 1.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    got = {(round(r.x, 6), round(r.y, 6)) for r in behaviour.points_along_edges(edges, 1.0).collect()}
    assert got == {(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (3.0, 0.5), (1.0, 1.0)}


def test_powers_of_a_transition_matrix():
    p = np.array([[0.9, 0.1, 0.0], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]])
    assert np.allclose(behaviour.matrix_power(p, 3), p @ p @ p)
    half = behaviour.matrix_power(p, 0.5)
    assert np.allclose(half.sum(1), 1) and (half >= 0).all() and np.allclose(half @ half, p, atol=0.02)


def test_kolmogorov_smirnov(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, 80), rng.normal(0.5, 1, 60)
    df = spark.createDataFrame([(float(v), 0) for v in x] + [(float(v), 1) for v in y], "value double, g int")
    every = np.sort(np.concatenate([x, y]))
    want = np.abs((x[:, None] <= every).mean(0) - (y[:, None] <= every).mean(0)).max()
    got = stats.ks_test(df, "value", "g").first()
    assert (got.n_a, got.n_b) == (80, 60) and abs(got.ks - want) < 1e-12 and abs(got.p - stats.kolmogorov_tail(want, 80, 60)) < 1e-12


def test_ramps_of_a_detrended_signal(spark):
    t = np.arange(200)
    v = 0.05 * t + np.where(t > 100, 2.0, 0.0)
    df = spark.createDataFrame([("a", int(k), float(x)) for k, x in zip(t, v, strict=True)], "session string, bin long, value double")
    got = [r.bin for r in signals.ramp_onsets(df, "value", 3, 1.0, 0.05, KEYS, detrend=20.0).collect()]
    assert len(got) == 1 and abs(got[0] - 99) <= 3


def test_probable_bins_by_a_quantile(spark):
    p = {0: [0.1, 0.2, 0.3, 0.4], 1: [0.25] * 4}
    df = spark.createDataFrame([("a", b, l, x) for b, row in p.items() for l, x in enumerate(row)], "session string, bin long, latent long, p double")
    got = {}
    for r in decode.high_probability_bins(df, KEYS, quantile=0.5).collect():
        got.setdefault(r.bin, []).append(r.latent)
    assert {b: sorted(x) for b, x in got.items()} == {0: [2, 3], 1: [0]}


def test_statistics_weighted_by_a_gain(spark):
    rng = np.random.default_rng(2)
    p, n, g = rng.dirichlet(np.ones(3), 5), rng.poisson(1.0, (5, 2)), rng.random(5)
    post = spark.createDataFrame([("a", b, l, float(p[b, l])) for b in range(5) for l in range(3)], "session string, bin long, latent long, p double")
    counts = spark.createDataFrame([("a", b, f"u{u}", int(n[b, u])) for b in range(5) for u in range(2)], "session string, bin long, unit string, n long")
    gain = spark.createDataFrame([("a", b, float(g[b])) for b in range(5)], "session string, bin long, gain double")
    a, b = fit.weighted_stats(post, counts, KEYS, gain)
    assert np.allclose([r.b for r in b.orderBy("latent").collect()], p.T @ g)
    got = np.zeros((3, 2))
    for r in a.collect():
        got[r.latent, int(r.unit[1])] = r.a
    assert np.allclose(got, p.T @ n)


def test_distance_on_label_and_time(spark):
    rng = np.random.default_rng(3)
    x, t = rng.random(50), rng.random(50)
    d = 1 + 2 * x - 3 * t
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, t, d, strict=True)], "label double, time double, d double")
    assert np.allclose(distances.distance_label_time_ols(df, "label", "time"), [1, 2, -3])


def test_valid_bins_and_median_step(spark):
    t = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", None), (1, "b", 1.0)], "latent long, unit string, rate double")
    assert {r.latent: r.valid for r in tuning.valid_bins(t, "latent").collect()} == {0: True, 1: False}
    times = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0, 10.0)] + [("b", 1.0)], "session string, t double")
    assert {r.session: r.dt for r in tuning.median_step(times, KEYS).collect()} == {"a": 1.0, "b": None}


def test_departures_and_segment_transitions(spark):
    x = spark.createDataFrame([("a", 0, float(t), v) for t, v in enumerate((1.0, 3.0, 1.0, 2.9, 5.0, 1.0))], "session string, trial int, t double, value double")
    got = {w: intervals.threshold_crossings(x, "value", 2.0, 5.0, w, KEYS, "trial").first().t for w in ("arrival", "departure")}
    assert got == {"arrival": 0.0, "departure": 2.0}
    labels = spark.createDataFrame([("a", b, l) for b, l in enumerate("xxyyxzz")], "session string, bin long, label string")
    c = {(r.i, r.j): r.c for r in transitions.label_transitions(labels, KEYS, "segment").collect() if r.c}
    assert c == {("x", "y"): 1, ("y", "x"): 1, ("x", "z"): 1}


def test_states_of_an_event(spark):
    from latentspark.plans import mazes

    df = spark.createDataFrame([("e", 0, [0.2, 0.8]), ("e", 1, [0.6, 0.4])], "event string, bin long, p_dyn array<double>")
    got = {r.dyn: r.fraction for r in mazes.state_fractions(df, ["event"]).collect()}
    assert got == pytest.approx({0: 0.4, 1: 0.6})
