"""Structured kernels against matrices, decoding in chunks through gaps, windows in blocks against whole series, replay on several mazes against a plain version."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.operators import blocks, decode, fit, intervals, kernels, segments, signals, tuning
from latentspark.operators.structure import Blocks, Dense, LowRank, Product, SameRows, Staying, Steps, moving
from latentspark.plans import mazes
from latentspark.sources import shared

KEYS = ["session"]


def example_kernels():
    rng = np.random.default_rng(3)
    wide = np.exp(-0.5 * (np.subtract.outer(np.arange(40), np.arange(40)) / 15) ** 2)
    wide /= wide.sum(1, keepdims=True)
    odd = rng.random((6, 6))
    odd /= odd.sum(1, keepdims=True)
    x, y = moving(5, 1.0), moving(8, 2.0)
    block = np.zeros((46, 46))
    block[:40, :40], block[40:, 40:] = wide, odd
    return [
        (Dense(odd), odd), (SameRows(7), np.full((7, 7), 1 / 7)), (SameRows(6, odd[2]), np.tile(odd[2], (6, 1))), (Staying(4), np.eye(4)), (LowRank.of(wide), wide), (Product([Dense(x), Dense(y)]), np.kron(x, y)),
        (Product([Dense(x), LowRank.of(wide), SameRows(3)]), np.kron(np.kron(x, wide), np.full((3, 3), 1 / 3))), (Blocks([LowRank.of(wide), Dense(odd)]), block),
    ]


@pytest.mark.parametrize("k", range(8))
def test_kernels_are_their_matrices(k):
    kernel, matrix = example_kernels()[k]
    v = np.random.default_rng(k).random((3, 2, len(matrix)))
    assert np.allclose(kernel.dense(), matrix, atol=1e-12) and kernel.size == len(matrix)
    assert np.allclose(kernel.ahead(v), v @ matrix, atol=1e-12) and np.allclose(kernel.behind(v), v @ matrix.T, atol=1e-12)
    assert np.allclose(kernel.ahead(v[0, 0]), v[0, 0] @ matrix) and np.allclose(kernel.behind(v[0, 0]), matrix @ v[0, 0])


def test_a_smooth_kernel_has_a_low_rank_and_a_sharp_one_stays_dense():
    wide = np.exp(-0.5 * (np.subtract.outer(np.arange(200), np.arange(200)) / 60) ** 2)
    assert isinstance(k := LowRank.of(wide), LowRank) and k.left.shape[1] < 40
    assert isinstance(LowRank.of(np.eye(50)), Dense)


@pytest.mark.parametrize("joint", [0, 10_000])
def test_filter_and_smoother_on_structure_equal_the_dense_ones(monkeypatch, joint):
    """On a grid of two dimensions, by parts and by one matrix over all states."""
    rng = np.random.default_rng(1)
    parts = [Product([Dense(moving(6, 1.0)), Dense(moving(5, 2.0))]), SameRows(30), Staying(30)]
    dense = np.stack([np.kron(moving(6, 1.0), moving(5, 2.0)), np.full((30, 30), 1 / 30), np.eye(30)])
    switch = kernels.staying(3, 0.9)
    ll = rng.normal(0, 2, (50, 30))
    monkeypatch.setattr(Steps, "JOINT", 10_000 - joint)
    want = decode.forward_backward(ll, dense, switch, 0.7, 1.0)
    power = decode.forward_backward(ll, dense, switch, 0.7, 1.3)
    monkeypatch.setattr(Steps, "JOINT", joint)
    got = decode.forward_backward(ll, parts, switch, 0.7, 1.0)
    for k, v in want.items():
        assert np.abs(got[k] - v).max() < 1e-9, k
    again = decode.forward_backward(ll, parts, switch, 0.7, 1.3)
    assert all(np.abs(again[k] - v).max() < 1e-9 for k, v in power.items())
    for what in ("latent", "dynamics", "full"):
        assert np.allclose(decode.joint_sums(got["causal"], got["ratio"], parts, switch, what), decode.joint_sums(want["causal"], want["ratio"], dense, switch, what))


def test_gains_by_row_and_masked_latents():
    rng = np.random.default_rng(2)
    y, rates, gain = rng.poisson(1.0, (7, 4)).astype(float), rng.gamma(1, 1, (5, 4)), rng.gamma(2, 1, 7)
    got = decode.loglik_matrix(y, rates, 0.5, gain, valid=[0, 3])
    for t in range(7):
        one = decode.loglik_matrix(y[t : t + 1], rates, 0.5, float(gain[t]))[0]
        assert np.allclose(got[t, [0, 3]], one[[0, 3]]) and np.isneginf(got[t, [1, 2, 4]]).all()
    known = decode.log_factorials(y).sum(1)
    assert np.allclose(decode.loglik_matrix(y, rates, 0.5, 2.0), decode.loglik_matrix(y, rates, 0.5, 2.0, constant=known))


# ---- chunks ------------------------------------------------------------------------------------------------------------------


def model(spark, size=3):
    t = spark.createDataFrame([(l, u, 0.5 + l) for l in range(size) for u in ("x", "y")], "latent long, unit string, rate double")
    return decode.Model.of(t, [Dense(moving(size, 1.0)), SameRows(size)], kernels.switching(0.1, 0.2))


@pytest.mark.parametrize("valid", [None, [0, 2]])
def test_chunks_go_on_through_gaps(spark, valid):
    rng = np.random.default_rng(2)
    there = {"a": [0, 1, 2, 9, 10, 11], "b": range(30), "c": [3, 40, 41, 90], "d": [7], "e": [*range(5), *range(60, 66)]}
    rows = [(s, t, u, int(rng.poisson(1.0))) for s, ts in there.items() for t in ts for u in ("x", "y")]
    c, m = spark.createDataFrame(rows, "session string, bin long, unit string, n long"), model(spark)
    want = {(r.session, r.bin): r for r in decode.decode_hmm(c, m, KEYS, valid=valid).collect()}
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for size in (4, 7, 1000):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        got = decode.decode_in_chunks(c, m, KEYS, size, valid=valid)
        assert len(set(os.listdir(folder)) - before) == 1  # the result alone
        got = got.collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r.session, r.bin]
            assert np.allclose(r.p_latent, w.p_latent) and np.allclose(r.p_dyn, w.p_dyn) and np.allclose(r.causal_latent, w.causal_latent) and abs(r.step - w.step) < 1e-9
            assert valid is None or r.p_latent[1] == 0


def test_a_chunk_reads_its_own_files(spark):
    with shared.passing(spark) as save:
        t = save(spark.range(100).select((F.col("id") % 10).alias("k"), "id"), ["k"])
        plan = t.where("k = 3")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(k" in plan and len(t.where("k = 3").collect()) == 10


# ---- windows in blocks -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_blocks_give_what_whole_series_give(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(s, float(t), rng.choice([None, 0.0, 1.0, 2.0, 5.0])) for s in ("a", "b") for t in sorted(rng.sample(range(0, 200), 60))] + [("c", 3.0, 1.0)]
    x = spark.createDataFrame(rows, "session string, t double, value double").withColumn("state", (F.col("value") % 3).cast("int"))
    targets = spark.createDataFrame([(s, float(rng.randrange(-5, 210)) / 2) for s in "abcd" for _ in range(40)], "session string, t double")
    spans = spark.createDataFrame([("a", b, b + rng.random() * 20) for b in (rng.random() * 200 for _ in range(40))], "session string, start double, end double")
    two = {
        "runs": lambda block: intervals.runs(x, F.col("value") > 0.5, KEYS, aggregates=[F.sum("value").alias("total")], block=block),
        "states": lambda block: intervals.states_to_intervals(x, "state", {0: "zero", 1: "one", 2: "two"}, KEYS, block=block),
        "merged": lambda block: intervals.merge_close(spans, 1.5, KEYS, block=block),
        "neighbours": lambda block: intervals.neighbours(x.where("value is not null"), targets, "value", KEYS, block=block),
        "numbers": lambda block: blocks.row_numbers(x, KEYS, "t", "row", block),
    }
    for name, f in two.items():
        whole = sorted(map(repr, f(1e9).collect()))
        for block in (1.0, 7.0, 50.0):
            assert sorted(map(repr, f(block).collect())) == whole, (name, block)
    plain, flags = [], {}
    for s, t, v in rows:
        flags.setdefault(s, []).append((t, v is not None and v > 0.5, v))
    for s, r in flags.items():
        run = []
        for t, ok, v in [*r, (None, False, None)]:
            if ok:
                run.append((t, v))
            elif run:
                plain.append((s, run[0][0], run[-1][0], len(run), sum(v for _, v in run)))
                run = []
    assert sorted((r.session, r.start, r.end, r.n, r.total) for r in two["runs"](7.0).collect()) == sorted(plain)
    smooth = lambda: sorted(map(repr, signals.derivative(signals.gaussian_smooth(x, "value", 2.0, KEYS, "t", "s"), "s", KEYS).select("session", "t", F.round("s", 9), F.round("slope", 9)).collect()))
    whole = smooth()
    for n in (1, 5, 16):
        monkeypatch.setattr(blocks.halo, "__defaults__", (blocks.BLOCK, n))
        assert smooth() == whole


def test_no_window_holds_a_whole_series(spark):
    x = spark.createDataFrame([("a", 1.0, 1.0)], "session string, t double, value double")
    for df in (signals.gaussian_smooth(x, "value", 2.0, KEYS, "t"), intervals.neighbours(x, x, "value", KEYS)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        whole = [line for line in plan.split("\n") if "Window [" in line and "__block" not in line and "__at" not in line]
        assert not whole, whole


def test_labels_align_in_one_pass(spark):
    labels = spark.createDataFrame([("a", 0.0, 0.0, "left"), ("a", 10.0, 20.0, "right"), ("a", 10.0, 30.0, "zzz")], "session string, t double, x double, side string")
    bins = spark.createDataFrame([("a", 0, t) for t in (-1.0, 2.0, 5.0, 6.0, 11.0)] + [("b", 0, 1.0)], "session string, bin int, t double")
    got = {(r.session, r.t): (r.x, r.side) for r in tuning.align_labels(labels, bins, ["x"], ["side"], KEYS).collect()}
    assert got == {("a", -1.0): (0.0, "left"), ("a", 2.0): (4.0, "left"), ("a", 5.0): (10.0, "left"), ("a", 6.0): (12.0, "right"), ("a", 11.0): (20.0, "right"), ("b", 1.0): (None, None)}


# ---- mazes -----------------------------------------------------------------------------------------------------------------------

TWO = mazes.Mazes((mazes.Maze("arm", (mazes.Axis("x", 0.0, 1.0, 4, 0.8),)), mazes.Maze("field", (mazes.Axis("x", 0.0, 1.0, 3, 1.0), mazes.Axis("y", 10.0, 2.0, 2, 1.5)))))


def test_latents_of_mazes(spark):
    grid = {r.flat_idx: (r.maze, r.x, r.y) for r in TWO.grid(spark).collect()}
    assert grid[0] == ("arm", 0.5, None) and grid[4] == ("field", 0.5, 11.0) and grid[5] == ("field", 0.5, 13.0) and grid[9] == ("field", 2.5, 13.0) and len(grid) == 10
    rows = spark.createDataFrame([("arm", 3.2, None), ("field", 1.5, 12.5), ("field", 9.0, 0.0), ("other", 1.0, 1.0), ("field", 1.0, None), (None, 1.0, 1.0)], "maze string, x double, y double")
    assert [r[0] for r in rows.select(TWO.flat()).collect()] == [3, 7, 8, None, None, None]
    dense = np.zeros((10, 10))
    dense[:4, :4], dense[4:, 4:] = moving(4, 1.0), np.kron(moving(3, 1.0), moving(2, 1.0))
    assert np.allclose(TWO.moves(1.0).dense(), dense)


def plain_segments(rows, p_least, least, most):
    """rows of one event: (bin, p, maze, x, y) in order; lists of rows of the segments."""
    def long(parts):
        return [p for p in parts if len(p) >= least]

    def far(a, b):
        d = [(u - v) ** 2 for u, v in zip(a[3:], b[3:], strict=True) if not (u is None and v is None)]
        return np.sqrt(sum(d)) > most

    parts, now = [], []
    for r in [*rows, None]:
        if r and r[1] > p_least:
            now.append(r)
        elif now:
            parts.append(now)
            now = []
    parts = long(parts)
    for cut in (lambda a, b: a[2] != b[2], far):
        out = []
        for p in parts:
            now = [p[0]]
            for a, b in zip(p[:-1], p[1:], strict=True):
                if cut(a, b):
                    out.append(now)
                    now = []
                now.append(b)
            out.append(now)
        parts = long(out)
    return parts


def test_replay_on_mazes_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    spikes, position, at = [], [], 0.0
    centres = [("arm", 0.5 + k, None) for k in range(4)] + [("field", 0.5 + i, 11.0 + 2 * j) for i in range(3) for j in range(2)]
    for lap in range(60):  # behaviour: one place after another, each with a unit of its own
        for k, (m, x, y) in enumerate(centres):
            position.append(("s", at + 0.5, m, x, y))
            spikes += [("s", f"u{u}", at + rng.random()) for u in range(10) for _ in range(rng.poisson(8.0 if u == k else 0.3))]
            at += 1.0
    quiet = at
    for e in range(25):  # bursts at rest, which run through the arm or the field
        at += 3.0
        path = [0, 1, 2, 3] if e % 2 else [4, 6, 8, 9]
        for k in path:
            spikes += [("s", f"u{u}", at + rng.random() * 0.1) for u in range(10) for _ in range(rng.poisson(12.0 if u == k else 0.4))]
            at += 0.1
    spikes = spark.createDataFrame(spikes, "session string, unit string, t double")
    position = spark.createDataFrame(position, "session string, t double, maze string, x double, y double")
    epochs = spark.createDataFrame([("s", 0, 0.0, at + 3)], "session string, interval_id int, start double, end double")
    off = spark.createDataFrame([("s", quiet, at + 3), ("s", 100.0, 130.0)], "session string, start double, end double")
    got = mazes.replay_on_mazes(spikes, position, epochs, KEYS, TWO, tuning_dt=1.0, burst_dt=0.1, burst_std=1.0, z_peak=2.0, shortest=0.15, longest=3.0, event_dt=0.1, n_shuffles=20, gains=[1.0, 2.0], offtrack=off, continuous=0.6, most_step=2.5)
    # tuning: counts and seconds of the bins on the track, smoothed within a maze
    edges = [b for b in range(int(quiet)) if not 100 <= b < 130]
    place = {b: b % 10 for b in edges}
    seconds, count = np.zeros(10), np.zeros((10, 10))
    for b in edges:
        seconds[place[b]] += 1
    for r in spikes.collect():
        b = int(np.floor(r.t))
        if b in place:
            count[place[b], int(r.unit[1:])] += 1
    smooth = np.zeros((10, 10))
    for i, (m, x, y) in enumerate(centres):
        for j, (n, u, v) in enumerate(centres):
            if m == n:
                smooth[i, j] = np.exp(-0.5 * ((x - u) / (0.8 if m == "arm" else 1.0)) ** 2) * (np.exp(-0.5 * ((y - v) / 1.5) ** 2) if y else 1)
    smooth /= smooth.sum(1, keepdims=True)
    rates = (smooth @ count) / (smooth @ seconds)[:, None]
    have = np.zeros((10, 10))
    for r in got["tuning"].collect():
        have[r.latent, int(r.unit[1:])] = r.rate
    assert np.allclose(have, rates)
    # events: dense decoding of the same counts at the best gain, then segments
    gain = got["sweep"].where("best").first().gain
    dense = np.stack([TWO.moves(1.0).dense(), np.full((10, 10), 0.1)])
    by, events = {}, {r.interval_id: r for r in got["events"].collect()}
    for r in got["counts"].collect():
        by.setdefault(r.interval_id, {}).setdefault(r.bin, np.zeros(10))[int(r.unit[1:])] = r.n
    assert len(events) > 10 and set(by) == set(events)
    for i, bins in by.items():
        y = np.stack([bins[b] for b in sorted(bins)])
        post = decode.forward_backward(decode.loglik_matrix(y, rates * 0.1, 1.0, gain), dense, kernels.switching(0.02, 0.02))["smooth"]
        best = post.sum(1).argmax(1)
        rows = [(b, post[b, 0].sum(), *centres[k]) for b, k in enumerate(best)]
        parts = plain_segments(rows, 0.6, 2, 2.5)
        length = sum(np.sqrt((a[3] - b[3]) ** 2 + ((a[4] or 0) - (b[4] or 0)) ** 2) for p in parts for a, b in zip(p[:-1], p[1:], strict=True))
        far = max((np.sqrt((a[3] - p[0][3]) ** 2 + ((a[4] or 0) - (p[0][4] or 0)) ** 2) for p in parts for a in p), default=0.0)
        e = events[i]
        assert e.n_segments == len(parts) and abs(e.total_path - length) < 1e-9 and abs(e.max_displacement - far) < 1e-9
        assert abs(e.p_move - post.sum(2)[:, 0].mean()) < 1e-9 and abs(e.p_move + e.p_jump - 1) < 1e-9
        names = [r[2] for r in rows]
        assert names.count(e.maze) == max(names.count(m) for m in names) and abs(e.maze_fraction - names.count(e.maze) / len(names)) < 1e-9
    assert {e.maze for e in events.values()} == {"arm", "field"}


def test_spans_of_two_coordinates(spark):
    rng = random.Random(1)
    rows = [("e", s, b, rng.random() * 9, rng.choice([None, rng.random()]) if s == 2 else rng.random()) for s in range(3) for b in range(6)]
    df = spark.createDataFrame(rows, "event string, segment int, bin int, x double, y double").withColumn("y", F.when(F.col("segment") == 2, None).otherwise(F.col("y")))
    got = {r.segment: r for r in segments.segment_metrics(df, ["x", "y"], 0.5, ["event"]).collect()}
    for s in range(3):
        p = [(r[3], 0.0 if s == 2 else r[4]) for r in rows if r[1] == s]
        d = lambda a, b: float(np.hypot(a[0] - b[0], a[1] - b[1]))
        steps = [d(a, b) for a, b in zip(p[:-1], p[1:], strict=True)]
        want = (sum(steps), max(d(a, p[0]) for a in p), max(d(a, b) for a in p for b in p), np.mean(steps) / 0.5)
        assert np.allclose((got[s].path, got[s].displacement, got[s].span, got[s].speed), want)


def test_fits_leave_no_tables(spark):
    c = spark.createDataFrame([("a", t, u, (t * k) % 3) for t in range(30) for k, u in enumerate(("x", "y"), 1)], "session string, bin long, unit string, n long")
    start = fit.init_random(c.select("session", "bin").distinct(), KEYS, 3)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    dense = fit.fit_em(spark, c, start, np.stack([moving(3, 1.0), np.full((3, 3), 1 / 3)]), kernels.switching(0.1, 0.1), fit.tuning_basis(fit.rbf(3, 1.0)), KEYS, 2)
    parts = fit.fit_em(spark, c, start, [Dense(moving(3, 1.0)), SameRows(3)], kernels.switching(0.1, 0.1), fit.tuning_basis(fit.rbf(3, 1.0)), KEYS, 2)
    assert set(os.listdir(folder)) == before and np.allclose(dense[1], parts[1])
