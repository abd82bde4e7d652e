"""Faults found in the third round: plans that outgrow the driver, noise at limits, windows left out, pairs by copies."""

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from latentspark.operators import distances, perievent, signals
from latentspark.plans import catalog, mazes
from latentspark.sources import shared

QUERIES = catalog.queries()


def test_steps_of_the_maze_tuning_and_the_bursts_have_small_plans(spark, monkeypatch):
    """Each plan is kept by the driver whole, again for each stage that ends."""
    seen, write = [], shared._written

    def written(df, *more):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, *more)

    monkeypatch.setattr(shared, "_written", written)
    rng = np.random.default_rng(0)
    at = np.sort(rng.random(400) * 400).tolist()
    spikes = spark.createDataFrame([("s", f"u{k % 3}", t) for k, t in enumerate(at)], "session string, unit string, t double")
    position = spark.createDataFrame([("s", t, "arm", float(t % 4)) for t in at], "session string, t double, maze string, x double")
    epochs = spark.createDataFrame([("s", 0, 0.0, 400.0)], "session string, interval_id int, start double, end double")
    one = mazes.Mazes((mazes.Maze("arm", (mazes.Axis("x", 0.0, 1.0, 4, 1.0),)),))
    for df in (mazes.maze_tuning(spikes, position, epochs, one, 1.0, ["session"]), signals.detect_bursts(spikes, epochs, 1.0, 1.0, ["session"], 1.0, 1.0, 50.0)):
        written(df, f"{shared.shared_folder(spark)}")
        assert df.count() > 0
    assert max(seen) <= 30


def _tail_of_events(folder):
    """Two bursts of one session, the last of them at the very end; one file, as the streams' source expects."""
    at = pd.to_datetime([f"2024-01-01 {t}" for t in ("00:00:00", "00:02:00", "11:50:00", "11:52:00")]).astype("datetime64[us]")
    pd.DataFrame({"event_id": range(4), "ts": at, "user_id": 4, "event_type": "view", "value": 1.0, "props": '{"k": 1}'}).to_parquet(f"{folder}/events.parquet")
    return str(folder)


def test_windows_at_the_end_of_the_stream_count(spark, tmp_path):
    got = QUERIES["t1_counts_by_window"](spark, _tail_of_events(tmp_path)).collect()
    assert sorted((r.session, r.unit, r.start, r.n) for r in got) == [("s0", "view", 1704067200.0, 2), ("s0", "view", 1704067200.0 + 21600, 2)]


def test_bursts_at_the_end_of_the_stream_count(spark, tmp_path):
    got = QUERIES["t2_session_windows"](spark, _tail_of_events(tmp_path)).collect()
    assert sorted((r.session, r.start - 1704067200, r.end - 1704067200, r.n) for r in got) == [("s0", 0.0, 1020.0, 2), ("s0", 42600.0, 43620.0, 2)]


def test_a_null_that_repeats_the_observed_mean_is_not_outside(spark):
    """Every shuffle holds the same values, summed in another order; the SQL's own answer is that of its sums' order."""
    mean = math.nextafter(0.1, 0.0)
    null = spark.createDataFrame([("a", s, 0.1) for s in range(5)] + [("b", s, mean) for s in range(5)] + [("c", s, 0.1) for s in range(5)], "k string, shuffle int, mean double")
    seen = spark.createDataFrame([("a", mean), ("b", 0.1), ("c", 0.1 + 1e-6)], "k string, mean double")
    assert {r.k: r.outside for r in perievent.null_threshold(null, seen, "mean", 0.025, ["k"]).collect()} == {"a": False, "b": False, "c": True}


def _shuffled_bytes(spark):
    time.sleep(1)  # the status store lags a little
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_pairs_copy_a_vector_for_blocks_and_not_for_places(spark):
    rng = np.random.default_rng(1)
    rows = [(k // 200, k, rng.random(64).tolist()) for k in range(400)]
    vectors = spark.createDataFrame(rows, "g long, k long, v array<double>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled_bytes(spark)
        got = {(r.g, r.i, r.j): (r.lag, r.d) for r in distances.pairwise_distance(vectors, "v", "euclidean", "k", ["g"], 99).collect()}
        assert _shuffled_bytes(spark) - before < 10 * 400 * 64 * 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {(g, i, j): (j - i, float(np.linalg.norm(np.subtract(rows[g * 200 + i - 1][2], rows[g * 200 + j - 1][2])))) for g in range(2) for i in range(1, 201) for j in range(i + 1, min(200, i + 99) + 1)}
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())


def test_pairs_over_several_blocks(spark):
    vectors = spark.createDataFrame([(k, [float(k)]) for k in range(300)], "k long, v array<double>").withColumn("g", F.lit("a"))
    got = [(r.i, r.j, r.lag, r.d) for r in distances.pairwise_distance(vectors, "v", "euclidean", "k", ["g"], 280).collect()]
    assert sorted(got) == [(i, j, j - i, float(j - i)) for i in range(1, 301) for j in range(i + 1, min(300, i + 280) + 1)]


def test_shuffled_sums_take_a_block_at_a_time(spark, monkeypatch):
    """Blocks go to a task one by one; gathered as rows, a batch held as many of them as the task had."""
    rng = np.random.default_rng(2)
    x, labels = rng.random(12), rng.random(12)
    pairs = spark.createDataFrame([("a", i + 1, j + 1, float(abs(x[i] - x[j]))) for i in range(12) for j in range(i + 1, 12)], "g string, i int, j int, d double")
    places = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(labels)], "g string, i int, label double")
    whole = {(r.shuffle, r.n): r.sxy for r in distances.shuffled_sums(pairs, places, 3, ["g"]).collect()}
    monkeypatch.setattr(distances, "PAIRS", 10)
    sums = distances.shuffled_sums(pairs, places, 3, ["g"])
    assert "CoGroup" in sums._jdf.queryExecution().executedPlan().toString()
    got = {(r.shuffle, r.n): r.sxy for r in sums.collect()}
    assert got.keys() == whole.keys() == {(s, 66) for s in range(4)} and all(abs(got[k] - whole[k]) < 1e-9 for k in got)
    seen = sum(abs(labels[i] - labels[j]) * abs(x[i] - x[j]) for i in range(12) for j in range(i + 1, 12))
    assert abs(got[0, 66] - seen) < 1e-9
