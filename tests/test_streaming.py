"""Streams give what the batch forms give."""

import datetime

import numpy as np

from latentspark.operators import decode, kernels
from latentspark.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def run(spark, make, schema, batches, folder, mode="append"):
    """Rows that a stream over one file for each batch of rows gives, in order of the batches."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    name = "s" + folder.name.replace("-", "_")
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_counts_drop_late_rows_only(spark, tmp_path):
    batches = [[("s", "a", at(m)) for m in (0, 5, 20)], [("s", "b", at(m)) for m in (90, 95)], [("s", "a", at(200))], [("s", "a", at(1)), ("s", "a", at(400))], [("s", "a", at(700))]]
    got = {(r.unit, r.start): r.n for r in run(spark, lambda s: streams.stream_counts(s, "1 hour", "10 minutes"), "session string, unit string, ts timestamp", batches, tmp_path).collect()}
    assert got[("a", at(0))] == 3 and got[("b", at(60))] == 2 and got[("a", at(180))] == 1


def test_bursts_are_sessions_of_close_events(spark, tmp_path):
    batches = [[("s", "a", at(m)) for m in (0, 3, 6)], [("s", "a", at(60))], [("s", "a", at(300))], [("s", "a", at(600))]]
    got = run(spark, lambda s: streams.stream_bursts(s, "5 minutes", "10 minutes", 60.0), "session string, unit string, ts timestamp", batches, tmp_path).collect()
    assert [(r.start, r.n) for r in got] == [(at(0), 3)]


def model(spark):
    t = spark.createDataFrame([(k, u, 0.5 + k + i) for k in range(3) for i, u in enumerate("ab")], "latent long, unit string, rate double")
    return decode.Model.of(t, kernels.as_arrays(kernels.stacked_kernels([kernels.move_kernel(spark, 3, 1.0)], 3), 3), kernels.switching(0.1, 0.1))


def test_filter_equals_batch_and_drops_old_bins(spark, tmp_path):
    m, rng = model(spark), np.random.default_rng(0)
    y = rng.poisson(2, (9, 2))
    rows = [("s", b, [float(v) for v in y[b]]) for b in range(9)]
    batches = [rows[:4][::-1], [*rows[4:6], ("s", 2, [9.0, 9.0])], rows[6:]]
    schema = "session string, bin long, units array<double>"
    got = {r.bin: r for r in run(spark, lambda s: streams.stream_filter(s, m), schema, batches, tmp_path).collect()}
    want = decode.forward_backward(decode.loglik_matrix(y.astype(float), m.rates, 1.0, 1.0), m.kernels, m.switch)
    assert sorted(got) == list(range(9))
    for b in range(9):
        assert np.allclose(got[b].causal_latent, want["causal"][b].sum(0)) and np.isclose(got[b].log_marginal, want["step"][: b + 1].sum())


def test_naive_bayes_of_a_stream_equals_batch(spark, tmp_path):
    m = model(spark)
    rows = [("s", b, [float(b), 1.0]) for b in range(5)]
    got = run(spark, lambda s: streams.stream_naive_bayes(s, m), "session string, bin long, units array<double>", [rows[:2], rows[2:]], tmp_path).collect()
    ll = decode.loglik_matrix(np.array([r[2] for r in rows]), m.rates, 1.0, 1.0)
    for r in got:
        assert np.isclose(r.log_marginal, np.log(np.exp(ll[r.bin]).sum())) and np.allclose(r.p_latent, np.exp(ll[r.bin]) / np.exp(ll[r.bin]).sum())
    assert len(got) == 5


def test_a_session_expires_by_event_time_and_late_rows_go(spark, tmp_path):
    m = model(spark)
    row = lambda s, b, minute: (s, b, [1.0, 2.0], at(minute))
    batches = [
        [row("a", 0, 0), row("a", 1, 1), row("b", 0, 1)],
        [row("c", 0, 30)],  # the watermark goes to minute 20
        [row("a", 2, 5), row("c", 1, 31)],  # a's row is late
        [row("c", 2, 120)],  # watermark 110: a and b are older than an hour
        [row("c", 3, 121)],
        [row("a", 0, 125), row("b", 1, 125), row("c", 4, 125)],
    ]
    got = run(spark, lambda s: streams.stream_filter(s, m, late="10 minutes", expires_ms=3_600_000), "session string, bin long, units array<double>, ts timestamp", batches, tmp_path).collect()
    by = {}
    for r in got:
        by.setdefault(r.session, []).append((r.bin, round(r.log_marginal, 9)))
    ll = decode.loglik_matrix(np.tile([1.0, 2.0], (5, 1)), m.rates, 1.0, 1.0)
    total = np.cumsum(decode.forward(ll, m.kernels, m.switch)[1]).round(9)
    assert by["c"] == [(k, total[k]) for k in range(5)]  # c goes on
    assert by["a"] == [(0, total[0]), (1, total[1]), (0, total[0])]  # a starts anew
    assert by["b"] == [(0, total[0]), (1, total[0])]
