"""Decoding, fitting, transitions, nulls and segments, bound to the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latentspark.operators import decode as D
from latentspark.operators import fit as G
from latentspark.operators import intervals, structure
from latentspark.operators import kernels as K
from latentspark.operators import nulls as M
from latentspark.operators import segments as N
from latentspark.operators import transitions as H

from . import mazes, workflows
from .binding import EV, HASH, HC, IV, KEYS, LL, NB, TUN, Query, day_counts, events, hourly_counts, hourly_signal, half_days, hourly_tuning, posterior, rounded, whole_span, with_

BASE = with_(EV, HC, TUN, LL, NB)
LATENTS = 6
EK = ["session", "event"]


def _model(spark, sf, jump=True):
    t = hourly_tuning(hourly_counts(spark, sf))
    move = K.move_kernel(spark, LATENTS, 2.0)
    if jump:
        return D.Model.of(t, K.as_arrays(K.stacked_kernels([move], LATENTS), LATENTS), K.switching(0.02, 0.02))
    return D.Model.of(t, K.as_arrays(move, LATENTS), np.ones((1, 1)))


def _by_latent(decoded):
    return decoded.select("session", "bin", F.posexplode("p_latent").alias("latent", "p"), F.round("step", 5).alias("step")).withColumn("p", F.round("p", 6))


def _decoded(spark, sf):
    rows = D.decode_hmm(day_counts(spark, sf), _model(spark, sf), EK).select(*EK, "bin", F.posexplode(F.arrays_zip("p_latent", "causal_latent")).alias("latent", "x"), "step")
    return rows.select(*EK, "bin", "latent", F.round("x.p_latent", 6).alias("p"), F.round("x.causal_latent", 6).alias("causal"), F.round("step", 5).alias("step"))


def _expected(spark, sf):
    return D.expected_rate(posterior(spark, sf), hourly_tuning(hourly_counts(spark, sf)), KEYS)


EXPECTED = "ex AS (SELECT session, bin, unit, sum(p * rate) AS rate FROM nb JOIN tun USING (latent) GROUP BY 1, 2, 3)"


def _labels(spark, sf):
    """The most frequent event type of each hour, the first by name of several."""
    c = hourly_counts(spark, sf)
    return c.where("n > 0").groupBy("session", "bin").agg(F.min_by("unit", F.struct(-F.col("n"), F.col("unit"))).alias("label"))


LABELS = "lb AS (SELECT session, bin, unit AS label FROM hc WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY session, bin ORDER BY n DESC, unit) = 1)"


def _day_posterior(spark, sf):
    return posterior(spark, sf).withColumn("day", F.floor(F.col("bin") / 24).cast("int"))


def _distances(spark, sf):
    """Pairwise absolute difference of the latents' total rates."""
    t = hourly_tuning(hourly_counts(spark, sf)).groupBy("latent").agg(F.sum("rate").alias("r"))
    a, b = t.select(F.col("latent").alias("i"), F.col("r").alias("a")), t.select(F.col("latent").alias("j"), F.col("r").alias("b"))
    return a.join(b, F.lit(True)).select("i", "j", F.abs(F.col("a") - F.col("b")).alias("d"))


DIST = "tt AS (SELECT latent, sum(rate) AS r FROM tun GROUP BY 1), ds AS (SELECT x.latent AS i, y.latent AS j, abs(x.r - y.r) AS d FROM tt x, tt y)"


def _target(spark, sf):
    return K.move_kernel(spark, LATENTS, 2.0)


TARGET = "tg AS (SELECT a.i AS i, b.i AS j, exp(-pow(a.i - b.i, 2) / 4e0) / sum(exp(-pow(a.i - b.i, 2) / 4e0)) OVER (PARTITION BY a.i) AS p FROM range(6) a(i), range(6) b(i))"
BETAS = [1.0, 2.0, 4.0, 8.0]


def _segment_rows(spark, sf):
    """Days as events: the hour's mean value decides whether the state is continuous, k is the position."""
    e = events(spark, sf).groupBy("session", F.floor((F.col("t") - 1704067200.0) / 3600).cast("long").alias("h")).agg(F.avg("value").alias("p"), F.avg("k").alias("x"))
    return e.select("session", F.floor(F.col("h") / 24).cast("int").alias("event"), (F.col("h") % 24).alias("bin"), "p", "x")


def _segments(spark, sf):
    return N.split_segments(N.continuous_segments(_segment_rows(spark, sf), "p", 20.0, 2, EK), "x", 60.0, 2, EK)


SEG = """sr AS (SELECT session, CAST(h // 24 AS INTEGER) AS event, h % 24 AS bin, p, x FROM (SELECT session, CAST(floor((t - 1704067200e0) / 3600) AS BIGINT) AS h, avg(value) AS p, avg(k) AS x FROM ev GROUP BY 1, 2)),
      s1 AS (SELECT *, p > 20 AND NOT coalesce(lag(p > 20) OVER (PARTITION BY session, event ORDER BY bin), false) AS b FROM sr),
      s2 AS (SELECT *, sum(b::INT) OVER (PARTITION BY session, event ORDER BY bin ROWS UNBOUNDED PRECEDING) AS g FROM s1),
      s3 AS (SELECT * FROM s2 WHERE p > 20 QUALIFY count(*) OVER (PARTITION BY session, event, g) >= 2),
      s4 AS (SELECT *, coalesce(abs(x - lag(x) OVER (PARTITION BY session, event, g ORDER BY bin)) > 60, false) AS b2 FROM s3),
      s5 AS (SELECT *, sum(b2::INT) OVER (PARTITION BY session, event, g ORDER BY bin ROWS UNBOUNDED PRECEDING) AS g2 FROM s4),
      sg AS (SELECT * FROM s5 QUALIFY count(*) OVER (PARTITION BY session, event, g, g2) >= 2),
      st AS (SELECT *, abs(x - lag(x) OVER w) AS step, abs(x - first_value(x) OVER w) AS away FROM sg WINDOW w AS (PARTITION BY session, event, g, g2 ORDER BY bin)),
      sm AS (SELECT session, event, g, g2, min(bin) AS first_bin, count(*) AS n_bins, coalesce(sum(step), 0) AS path, max(away) AS displacement, max(x) - min(x) AS span, coalesce(avg(step), 0) AS speed FROM st GROUP BY 1, 2, 3, 4)"""


def _segment_metrics(spark, sf):
    return N.segment_metrics(_segments(spark, sf), "x", 1.0, EK)


def _event_metrics(spark, sf):
    e = _segment_rows(spark, sf).groupBy(*EK).agg(F.count(F.lit(1)).alias("n_bins"))
    return N.event_metrics(e, _segment_metrics(spark, sf), 1.0, EK).select("session", "event", "n_bins", "n_segments", "median_length", "max_length", "total_path", "max_displacement", "fraction_continuous")


EVENT_METRICS = """em AS (SELECT session, event, count(*) AS n_segments, quantile_cont(n_bins, 0.5) AS median_length, max(n_bins) AS max_length, sum(n_bins) AS cb, sum(path) AS total_path, max(displacement) AS max_displacement FROM sm GROUP BY 1, 2),
      ev2 AS (SELECT session, event, count(*) AS n_bins FROM sr GROUP BY 1, 2),
      er AS (SELECT session, event, n_bins, coalesce(n_segments, 0) AS n_segments, coalesce(median_length, 0) AS median_length, coalesce(max_length, 0) AS max_length, coalesce(total_path, 0) AS total_path, coalesce(max_displacement, 0) AS max_displacement, coalesce(cb, 0) / n_bins AS fraction_continuous FROM ev2 LEFT JOIN em USING (session, event))"""


def _circular(spark, sf):
    return M.circular_shuffle(hourly_counts(spark, sf), 3, KEYS)


CIRC = """cs AS (SELECT session, s.shuffle, unit, n, (bin + """ + HASH.format("s.shuffle || '|' || session || '|' || unit") + """ % 720) % 720 AS bin FROM hc, range(1, 4) s(shuffle))"""


def _replay(spark, sf):
    e = events(spark, sf)
    got = workflows.replay_supervised(e.select("session", "unit", "t"), e.select("session", "t", F.col("k").alias("label")), whole_span(spark, sf), KEYS, tuning_dt=3600.0, low=0.0, size=10.0, bins=10, std=10.0, burst_dt=1800.0, burst_std=2.0, z_peak=1.5, shortest=3600.0, longest=36000.0, event_dt=1800.0, n_shuffles=100, gains=[1.0, 2.0])
    return got["events"].select("session", "start", "end", "peak", "n_segments", "total_path", "observed", "unit_limit", "circular_limit", "significant")


def _replay_unsupervised(spark, sf):
    c = hourly_counts(spark, sf)
    got = workflows.replay_unsupervised(spark, c, day_counts(spark, sf), KEYS, "event", 5, 3)
    return got["events"]


MAZES = mazes.Mazes((mazes.Maze("arm", (mazes.Axis("x", 0.0, 10.0, 5, 10.0),)), mazes.Maze("field", (mazes.Axis("x", 50.0, 10.0, 5, 10.0), mazes.Axis("y", 0.0, 20.0, 4, 20.0)))))


def _maze_position(spark, sf):
    """k as x; below 50 an arm, from there on a field with the value as y."""
    e = events(spark, sf)
    return e.select("session", "t", F.when(F.col("k") < 50, "arm").otherwise("field").alias("maze"), F.col("k").alias("x"), F.when(F.col("k") >= 50, F.col("value")).alias("y"))


def _replay_on_mazes(spark, sf):
    e = events(spark, sf)
    off = intervals.runs(e.select("session", "t", "value", "event_id"), F.col("value") > 50, KEYS, order=["t", "event_id"]).where("n >= 2").select("session", "start", "end")
    got = mazes.replay_on_mazes(e.select("session", "unit", "t"), _maze_position(spark, sf), whole_span(spark, sf), KEYS, MAZES, tuning_dt=3600.0, burst_dt=1800.0, burst_std=2.0, z_peak=1.5, shortest=3600.0, longest=36000.0, event_dt=1800.0, n_shuffles=100, gains=[1.0, 2.0], offtrack=off, continuous=0.5, most_step=40.0)
    return got["events"].select("session", "start", "end", "peak", "n_segments", "total_path", "max_displacement", "observed", "unit_limit", "circular_limit", "significant", "maze", "maze_fraction", "p_move", "p_jump")


def _maze_tuning(spark, sf):
    e = events(spark, sf)
    return rounded(mazes.maze_tuning(e.select("session", "unit", "t"), _maze_position(spark, sf), half_days(spark, sf), MAZES, 3600.0, KEYS))


MAZE_TUNING = with_(EV, IV) + """, sm AS (SELECT session, t, min({'m': CASE WHEN k < 50 THEN 'arm' ELSE 'field' END, 'x': k, 'y': CASE WHEN k >= 50 THEN value END}) AS s FROM ev GROUP BY 1, 2),
     bn AS (SELECT session, interval_id, CAST(b AS BIGINT) AS bin, s + (b + 0.5) * 3600 AS t FROM iv, range(12) r(b)),
     bk AS (SELECT bn.*, sm.t AS bt, sm.s AS bv FROM bn ASOF LEFT JOIN sm ON bn.session = sm.session AND bn.t >= sm.t),
     al AS (SELECT bk.*, sm.t AS at_, sm.s AS av FROM bk ASOF LEFT JOIN sm ON bk.session = sm.session AND bk.t <= sm.t),
     nr AS (SELECT session, interval_id, bin, CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt <= at_ - t) THEN bv ELSE av END AS s FROM al),
     pl AS (SELECT session, interval_id, bin, CAST(CASE WHEN s.m = 'arm' THEN greatest(0, least(4, floor(s.x / 10))) ELSE 5 + greatest(0, least(4, floor((s.x - 50) / 10))) * 4 + greatest(0, least(3, floor(s.y / 20))) END AS BIGINT) AS latent FROM nr),
     oc AS (SELECT latent, count(*) * 3600e0 AS seconds FROM pl GROUP BY 1),
     ct AS (SELECT iv.session, interval_id, CAST(floor((t - s) / 3600) AS BIGINT) AS bin, unit, count(*) AS n FROM ev JOIN iv ON iv.session = ev.session AND t >= s AND t < e GROUP BY ALL),
     cn AS (SELECT latent, unit, sum(n) AS n FROM ct JOIN pl USING (session, interval_id, bin) GROUP BY 1, 2),
     gr AS (SELECT 'arm' AS m, i AS f, i * 10e0 + 5 AS x, 0e0 AS y FROM range(5) r(i) UNION ALL SELECT 'field', 5 + i * 4 + j, 50e0 + i * 10 + 5, j * 20e0 + 10 FROM range(5) r(i), range(4) q(j)),
     w0 AS (SELECT a.f AS i, b.f AS j, exp(-0.5 * pow((a.x - b.x) / 10, 2)) * exp(-0.5 * pow((a.y - b.y) / 20, 2)) AS w FROM gr a JOIN gr b USING (m)), wk AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w0),
     fr AS (SELECT oc.latent, u.unit, seconds, coalesce(n, 0) AS n FROM oc CROSS JOIN (SELECT DISTINCT unit FROM cn) u LEFT JOIN cn ON cn.latent = oc.latent AND cn.unit = u.unit)
SELECT i AS latent, unit, round(sum(w * n) / sum(w * seconds), 6) AS rate FROM fr JOIN wk ON wk.j = fr.latent WHERE i IN (SELECT latent FROM oc) GROUP BY 1, 2"""


def _grid_model(spark, sf):
    """The six latents as a grid of 2 x 3 whose axes move by themselves, and a jump; kept as a product, never as a matrix."""
    t = hourly_tuning(hourly_counts(spark, sf))
    return D.Model.of(t, [structure.Product([structure.Dense(structure.moving(2, 1.0)), structure.Dense(structure.moving(3, 2.0))]), structure.SameRows(LATENTS)], K.switching(0.02, 0.02))


def _busy_days(spark, sf):
    """Hourly counts of the days on which a session has more events than on its median day: series with gaps of days."""
    c = hourly_counts(spark, sf).withColumn("day", F.floor(F.col("bin") / 24).cast("long"))
    days = c.groupBy("session", "day").agg(F.sum("n").alias("total"))
    median = days.groupBy("session").agg(F.percentile("total", 0.5).alias("median"))
    return c.join(days.join(median, "session").where("total > median").select("session", "day"), ["session", "day"]).drop("day")


def _em(spark, sf):
    c = hourly_counts(spark, sf)
    move = np.concatenate([K.as_arrays(K.move_kernel(spark, 5, 2.0), 5), K.as_arrays(K.jump_kernel(spark, 5), 5)])
    start = G.init_random(c.select("session", "bin").distinct(), KEYS, 5)
    return G.fit_em(spark, c, start, move, K.switching(0.02, 0.02), G.tuning_basis(G.rbf(5, 2.0)), KEYS, 3)[0]


def _m_step(spark, sf):
    c = hourly_counts(spark, sf)
    a, b = G.weighted_stats(posterior(spark, sf), c, KEYS)
    return G.poisson_m_step(a, b, c.select("unit").distinct(), G.tuning_basis(G.rbf(LATENTS, 2.0)), 1.0)


def _gain_sweep(spark, sf):
    c = day_counts(spark, sf)
    return rounded(M.gain_sweep(M.event_nulls(c, hourly_tuning(hourly_counts(spark, sf)), EK, 100, [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]), EK))


def _nulls(spark, sf):
    return M.event_nulls(day_counts(spark, sf), hourly_tuning(hourly_counts(spark, sf)), EK, 100, [1.0])


def _chains(spark, sf):
    """Each session as a chain: the tuning of its own hours, the posterior under all sessions' tuning."""
    number = F.substring("session", 2, 1).cast("int").alias("chain")
    t = hourly_counts(spark, sf).groupBy(number, F.floor((F.col("bin") % 24) / 4).cast("long").alias("latent"), "unit").agg(F.avg("n").alias("rate"))
    return G.chain_agreement(t, posterior(spark, sf).select(number, "bin", "latent", F.round("p", 9).alias("p")))


CHAINS = """t2 AS (SELECT CAST(substr(session, 2, 1) AS INTEGER) AS chain, (bin % 24) // 4 AS latent, unit, avg(n) AS rate FROM hc GROUP BY ALL),
      rm AS (SELECT x.chain AS a, y.chain AS b, sqrt(avg(pow(x.rate - y.rate, 2))) / sqrt(avg(pow(x.rate, 2))) AS tuning_rmse FROM t2 x JOIN t2 y ON x.chain < y.chain AND x.latent = y.latent AND x.unit = y.unit GROUP BY 1, 2),
      q2 AS (SELECT CAST(substr(session, 2, 1) AS INTEGER) AS chain, bin, latent, round(p, 9) AS p FROM nb),
      pb AS (SELECT x.chain AS a, y.chain AS b, x.bin, sum(abs(x.p - y.p)) / 2 AS tv, arg_max(x.latent, x.p) AS ma, arg_max(y.latent, y.p) AS mb FROM q2 x JOIN q2 y ON x.chain < y.chain AND x.bin = y.bin AND x.latent = y.latent GROUP BY 1, 2, 3)"""

QUERIES = [
    Query("f1_poisson_loglik", lambda s, d: rounded(D.poisson_loglik(hourly_counts(s, d), hourly_tuning(hourly_counts(s, d)), KEYS)), with_(EV, HC, TUN, LL) + "SELECT session, bin, latent, round(ll, 6) AS ll FROM ll"),
    Query("f2_gaussian_loglik", lambda s, d: rounded(D.gaussian_loglik(hourly_counts(s, d), hourly_tuning(hourly_counts(s, d)), KEYS, 1.5)),
          with_(EV, HC, TUN) + "SELECT session, bin, latent, round(sum(-0.5 * pow((n - rate) / 1.5, 2) - 0.5 * ln(2 * pi() * 2.25)), 6) AS ll FROM hc JOIN tun USING (unit) GROUP BY 1, 2, 3"),
    Query("f4_naive_bayes", lambda s, d: rounded(posterior(s, d).select("session", "bin", "latent", "p", "log_marginal")), BASE + "SELECT session, bin, latent, round(p, 6) AS p, round(log_marginal, 6) AS log_marginal FROM nb"),
    Query("f4_event_log_marginal", lambda s, d: rounded(M.event_log_marginal(day_counts(s, d), hourly_tuning(hourly_counts(s, d)), EK)),
          BASE + "SELECT session, CAST(bin // 24 AS INTEGER) AS event, round(sum(log_marginal), 6) AS log_marginal FROM (SELECT DISTINCT session, bin, log_marginal FROM nb) GROUP BY 1, 2"),
    Query("f5_map_latent", lambda s, d: rounded(D.map_latent(posterior(s, d).withColumn("p", F.round("p", 9)), KEYS)),
          BASE + "SELECT session, bin, latent AS map_latent, round(round(p, 9), 6) AS p FROM nb QUALIFY row_number() OVER (PARTITION BY session, bin ORDER BY round(p, 9) DESC, latent) = 1"),
    Query("f7_move_kernel", lambda s, d: rounded(K.move_kernel(s, LATENTS, 2.0).join(hourly_tuning(hourly_counts(s, d)).select(F.col("latent").alias("i")).distinct(), "i")), with_(EV, HC, TUN, TARGET) + "SELECT i, j, round(p, 6) AS p FROM tg WHERE i IN (SELECT latent FROM tun)"),
    Query("f11_forward_backward", lambda s, d: _by_latent(D.decode_hmm(hourly_counts(s, d), _model(s, d), KEYS))),
    Query("f12_forward_backward_latent", lambda s, d: _by_latent(D.decode_hmm(hourly_counts(s, d), _model(s, d, False), KEYS))),
    Query("f13_decode_events", lambda s, d: _decoded(s, d)),
    Query("f13_decode_in_chunks", lambda s, d: _by_latent(D.decode_in_chunks(hourly_counts(s, d), _model(s, d), KEYS, 300))),
    Query("f13_decode_in_chunks_with_gaps", lambda s, d: _by_latent(D.decode_in_chunks(_busy_days(s, d), _model(s, d), KEYS, 72))),
    Query("f7_decode_grid", lambda s, d: _by_latent(D.decode_hmm(hourly_counts(s, d), _grid_model(s, d), KEYS))),
    Query("f1_masked_latents", lambda s, d: _by_latent(D.decode_hmm(hourly_counts(s, d), _model(s, d), KEYS, valid=[0, 2, 3, 5]))),
    Query("e8_maze_tuning", _maze_tuning, MAZE_TUNING),
    Query("o1_replay_on_mazes", _replay_on_mazes),
    Query("f14_posterior_transitions", lambda s, d: rounded(D.posterior_transitions(day_counts(s, d), _model(s, d), EK))),
    Query("f14_dynamics_transitions", lambda s, d: rounded(D.posterior_transitions(day_counts(s, d), _model(s, d), EK, what="dynamics"))),
    Query("f14_full_transitions", lambda s, d: rounded(D.posterior_transitions(day_counts(s, d), _model(s, d), EK, what="full"))),
    Query("f15_decode_compare_kernels", lambda s, d: D.event_marginals(day_counts(s, d), {"both": _model(s, d), "move": _model(s, d, False)}, EK).select(*EK, "kernel", F.round("log_marginal", 5).alias("log_marginal"), F.round("probability", 6).alias("probability"))),
    Query("f17_expected_rate", lambda s, d: rounded(_expected(s, d)), BASE.rstrip() + ",\n" + EXPECTED + " SELECT session, bin, unit, round(rate, 6) AS rate FROM ex"),
    Query("f18_gain_per_bin", lambda s, d: rounded(D.gain_per_bin(hourly_counts(s, d), _expected(s, d), KEYS)),
          BASE.rstrip() + ",\n" + EXPECTED + ", y AS (SELECT session, bin, sum(n) AS y FROM hc GROUP BY 1, 2), m2 AS (SELECT session, bin, sum(rate) AS m FROM ex GROUP BY 1, 2) SELECT session, bin, round(y / m, 6) AS gain FROM y JOIN m2 USING (session, bin)"),
    Query("f20_posterior_entropy", lambda s, d: rounded(D.entropy(posterior(s, d), KEYS)), BASE + "SELECT session, bin, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) + 0.0 AS entropy FROM nb GROUP BY 1, 2"),
    Query("f21_high_probability_bins", lambda s, d: D.high_probability_bins(posterior(s, d).withColumn("p", F.round("p", 9)), KEYS, above=0.2).select("session", "bin", "latent"),
          BASE + "SELECT session, bin, latent FROM nb QUALIFY round(p, 9) > 0.2 OR row_number() OVER (PARTITION BY session, bin ORDER BY round(p, 9) DESC, latent) = 1"),
    Query("g1_weighted_stats", lambda s, d: rounded(G.weighted_stats(posterior(s, d), hourly_counts(s, d), KEYS)[0], 4), BASE + "SELECT latent, unit, round(sum(p * n), 4) AS a FROM nb JOIN hc USING (session, bin) WHERE n > 0 GROUP BY 1, 2"),
    Query("g2_empirical_tuning", lambda s, d: rounded(G.empirical_tuning(*G.weighted_stats(posterior(s, d), hourly_counts(s, d), KEYS), hourly_counts(s, d))),
          BASE.rstrip() + ",\n b AS (SELECT latent, sum(p) AS b FROM nb GROUP BY 1), a AS (SELECT latent, unit, sum(p * n) AS a FROM nb JOIN hc USING (session, bin) GROUP BY 1, 2) SELECT latent, unit, round(a / (b + 1e-12), 6) AS rate FROM a JOIN b USING (latent)"),
    Query("g5_m_step_poisson", lambda s, d: _m_step(s, d)),
    Query("g6_fit_em", lambda s, d: _em(s, d)),
    Query("g7_init_random", lambda s, d: rounded(G.init_random(hourly_counts(s, d).select("session", "bin").distinct(), KEYS, 4)),
          with_(EV, HC) + ", u AS (SELECT session, bin, CAST(l AS INTEGER) AS latent, (" + HASH.format("'0|' || session || '|' || bin || '|' || l") + " + 0.5) / 4294967296e0 AS u FROM (SELECT DISTINCT session, bin FROM hc), range(4) r(l)) SELECT session, bin, latent, round(u / sum(u) OVER (PARTITION BY session, bin), 6) AS p FROM u"),
    Query("g7_init_pca", lambda s, d: G.init_pca(hourly_counts(s, d), ["click", "error", "purchase", "signup", "view"], KEYS, 5)),
    Query("g10_split_contiguous", lambda s, d: G.split_contiguous(hourly_counts(s, d).select("session", "bin").distinct(), KEYS).groupBy("session", "part").agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("first")),
          with_(EV, HC) + "SELECT session, CASE WHEN bin >= 576 THEN 'test' ELSE 'train' END AS part, count(DISTINCT bin) AS n, min(bin) AS first FROM hc GROUP BY 1, 2"),
    Query("g12_chain_agreement", lambda s, d: rounded(_chains(s, d)),
          BASE.rstrip() + ",\n" + CHAINS + " SELECT a, b, round(avg(tv), 6) AS total_variation, round(avg(CASE WHEN ma <> mb THEN 1.0 ELSE 0.0 END), 6) AS map_disagreement, round(any_value(tuning_rmse), 6) AS tuning_rmse FROM pb JOIN rm USING (a, b) GROUP BY 1, 2"),
    Query("h1_expected_transitions", lambda s, d: rounded(H.expected_transitions(_day_posterior(s, d), KEYS, ["day"])),
          BASE.rstrip() + ",\n c AS (SELECT a.session, a.latent AS i, b.latent AS j, sum(a.p * b.p) AS c FROM nb a JOIN nb b ON a.session = b.session AND b.bin = a.bin + 1 AND a.bin // 24 = b.bin // 24 GROUP BY 1, 2, 3) SELECT session, i, j, round(c, 6) AS c, round(c / sum(c) OVER (PARTITION BY session, i), 6) AS p FROM c"),
    Query("h2_transitions_by_epoch", lambda s, d: rounded(H.expected_transitions(_day_posterior(s, d).withColumn("name", F.when(F.col("day") < 15, "pre").otherwise("post")), ["name"], ["session", "day"])),
          BASE.rstrip() + ",\n c AS (SELECT CASE WHEN a.bin < 360 THEN 'pre' ELSE 'post' END AS name, a.latent AS i, b.latent AS j, sum(a.p * b.p) AS c FROM nb a JOIN nb b ON a.session = b.session AND b.bin = a.bin + 1 AND a.bin // 24 = b.bin // 24 GROUP BY 1, 2, 3) SELECT name, i, j, round(c, 6) AS c, round(c / sum(c) OVER (PARTITION BY name, i), 6) AS p FROM c"),
    Query("h3_label_transitions", lambda s, d: rounded(H.label_transitions(_labels(s, d), KEYS, "frame", ["view"])),
          with_(EV, HC, LABELS) + """, k AS (SELECT * FROM lb WHERE label <> 'view'), x AS (SELECT session, lag(label) OVER (PARTITION BY session ORDER BY bin) AS i, label AS j FROM k),
          g AS (SELECT a.session, a.label AS i, b.label AS j FROM (SELECT DISTINCT session, label FROM k) a JOIN (SELECT DISTINCT session, label FROM k) b USING (session)),
          c AS (SELECT g.session, g.i, g.j, count(x.i) * 1e0 AS c FROM g LEFT JOIN x ON x.session = g.session AND x.i = g.i AND x.j = g.j GROUP BY 1, 2, 3)
          SELECT session, i, j, c, CASE WHEN sum(c) OVER w > 0 THEN round(c / sum(c) OVER w, 6) ELSE 0 END AS p FROM c WINDOW w AS (PARTITION BY session, i)"""),
    Query("h4_transition_shuffle_test", lambda s, d: rounded(H.transition_shuffle_test(_labels(s, d), 200, 0.99, KEYS))),
    Query("h6_gibbs_transitions", lambda s, d: rounded(H.gibbs_transitions(_distances(s, d), 2.0)), with_(EV, HC, TUN, DIST) + "SELECT i, j, round(exp(-2 * d) / sum(exp(-2 * d)) OVER (PARTITION BY i), 6) AS p FROM ds"),
    Query("h7_select_beta", lambda s, d: rounded(H.select_beta(_distances(s, d), _target(s, d), BETAS)),
          with_(EV, HC, TUN, DIST, TARGET) + ", x AS (SELECT beta, i, j, -beta * d - ln(sum(exp(-beta * d)) OVER (PARTITION BY beta, i)) AS lp FROM ds, (VALUES (1e0), (2e0), (4e0), (8e0)) b(beta)) SELECT beta, round(-sum(p * lp), 6) AS loss FROM x JOIN tg USING (i, j) GROUP BY 1"),
    Query("h8_weighted_quantile", lambda s, d: H.weighted_quantile(events(s, d), "k", "value", 0.9, KEYS),
          with_(EV) + ", g AS (SELECT session, k, sum(value) AS w FROM ev GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY session) AS t FROM g) SELECT session, min(k) AS value FROM c WHERE c >= 0.9 * t GROUP BY 1"),
    Query("h9_match_step", lambda s, d: rounded(H.match_step(_distances(s, d), _target(s, d), BETAS, 0.9), 8)),
    Query("l1_pre_post_posterior", lambda s, d: rounded(M.pre_post_posterior(posterior(s, d), KEYS, F.col("bin") < 360, F.col("bin") >= 360).select("session", "latent", "diff")),
          BASE + "SELECT session, latent, round(avg(p) FILTER (bin >= 360) - avg(p) FILTER (bin < 360), 6) + 0.0 AS diff FROM nb GROUP BY 1, 2"),
    Query("l2_circular_shuffle", lambda s, d: _circular(s, d).where("n > 0").select("session", "shuffle", "bin", "unit", "n"), with_(EV, HC, CIRC) + "SELECT session, CAST(shuffle AS INTEGER) AS shuffle, bin, unit, n FROM cs WHERE n > 0"),
    Query("l4_relabel_pre_post", lambda s, d: rounded(M.relabel_pre_post(hourly_signal(s, d).withColumn("epoch", F.when(F.col("bin") < 360, "pre").otherwise("post")), 5, "value", [], KEYS))),
    Query("l5_poisson_surrogate", lambda s, d: M.poisson_surrogate(hourly_counts(s, d), KEYS, 2)),
    Query("l6_max_then_mean", lambda s, d: rounded(M.max_then_mean(events(s, d).withColumn("day", F.floor((F.col("t") - 1704067200.0) / 86400)), KEYS, "day", "value")),
          with_(EV) + "SELECT session, round(avg(m), 6) AS mean FROM (SELECT session, floor((t - 1704067200e0) / 86400) AS d, max(value) AS m FROM ev GROUP BY 1, 2) GROUP BY 1"),
    Query("l7_bin_significance", lambda s, d: rounded(M.bin_significance(hourly_counts(s, d).groupBy("session", "bin").agg(F.max("n").alias("v")), M.circular_shuffle(hourly_counts(s, d), 100, KEYS).groupBy("session", "shuffle", "bin").agg(F.max("n").alias("v")), "v", KEYS)),
          with_(EV, HC, CIRC.replace("range(1, 4)", "range(1, 101)")) + ", a AS (SELECT session, bin, max(n) AS v FROM hc GROUP BY 1, 2), b AS (SELECT session, bin, quantile_cont(v, 0.975) AS l FROM (SELECT session, shuffle, bin, max(n) AS v FROM cs GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT session, bin, v, round(l, 6) AS \"limit\", v > l AS significant FROM a JOIN b USING (session, bin)"),
    Query("m1_unit_shuffle", lambda s, d: M.unit_shuffle(day_counts(s, d), 2, EK).where("n > 0").select("session", "event", "shuffle", "bin", "unit", "n"),
          with_(EV, HC) + """, dc AS (SELECT session, CAST(bin // 24 AS INTEGER) AS event, bin % 24 AS bin, unit, n FROM hc), u AS (SELECT DISTINCT session, event, unit, CAST(s.shuffle AS INTEGER) AS shuffle FROM dc, range(1, 3) s(shuffle)),
          a AS (SELECT *, row_number() OVER (PARTITION BY session, event, shuffle ORDER BY unit) AS r FROM u),
          b AS (SELECT session, event, shuffle, unit AS dest, row_number() OVER (PARTITION BY session, event, shuffle ORDER BY """ + HASH.format("shuffle || '|' || session || '|' || event || '|' || unit") + """, unit) AS r FROM u)
          SELECT session, event, shuffle, bin, dest AS unit, n FROM dc JOIN a USING (session, event, unit) JOIN b USING (session, event, shuffle, r) WHERE n > 0"""),
    Query("m2_circular_shuffle_in_event", lambda s, d: M.circular_shuffle(day_counts(s, d), 2, EK).where("n > 0").select("session", "event", "shuffle", "bin", "unit", "n")),
    Query("m3_shuffle_test_marginal", lambda s, d: rounded(M.tested_events(_nulls(s, d), EK), 5)),
    Query("m3_quantile_tables", lambda s, d: rounded(M.null_quantiles(_nulls(s, d), EK), 5)),
    Query("m3_significant_fractions", lambda s, d: rounded(M.significant_fractions(M.tested_events(_nulls(s, d), EK), KEYS))),
    Query("m4_gain_sweep", lambda s, d: _gain_sweep(s, d)),
    Query("n1_continuous_segments", lambda s, d: N.continuous_segments(_segment_rows(s, d), "p", 20.0, 2, EK).groupBy("session", "event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment").alias("segments")),
          with_(EV, SEG) + "SELECT session, event, count(*) AS n, count(DISTINCT g) AS segments FROM s3 GROUP BY 1, 2"),
    Query("n2_split_segments", lambda s, d: _segments(s, d).select("session", "event", "bin", "segment"),
          with_(EV, SEG) + "SELECT session, event, bin, CAST(dense_rank() OVER (PARTITION BY session, event ORDER BY g, g2) AS INTEGER) AS segment FROM s5 QUALIFY count(*) OVER (PARTITION BY session, event, g, g2) >= 2"),
    Query("n4_segment_metrics", lambda s, d: rounded(_segment_metrics(s, d).select("session", "event", "n_bins", "path", "displacement", "span", "speed")), with_(EV, SEG) + "SELECT session, event, n_bins, round(path, 6) AS path, round(displacement, 6) AS displacement, round(span, 6) AS span, round(speed, 6) AS speed FROM sm"),
    Query("n5_event_metrics", lambda s, d: rounded(_event_metrics(s, d)),
          with_(EV, SEG, EVENT_METRICS) + "SELECT session, event, n_bins, n_segments, median_length, max_length, round(total_path, 6) AS total_path, round(max_displacement, 6) AS max_displacement, round(fraction_continuous, 6) AS fraction_continuous FROM er"),
    Query("n6_metrics_summary", lambda s, d: rounded(N.metrics_summary(_event_metrics(s, d))),
          with_(EV, SEG, EVENT_METRICS) + "SELECT count(*) AS n_events, CAST(sum(n_segments) AS BIGINT) AS total_segments, quantile_cont(n_segments, 0.5) AS median_segments, round(quantile_cont(total_path, 0.5), 6) AS median_path, round(quantile_cont(max_displacement, 0.5), 6) AS median_displacement FROM er"),
    Query("o1_replay_supervised", _replay),
    Query("o2_replay_unsupervised", _replay_unsupervised),
]
