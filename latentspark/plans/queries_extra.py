"""Further forms of the operators, and the streams, bound to the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from latentspark.functions import stats
from latentspark.operators import behaviour as B
from latentspark.operators import decode as D
from latentspark.operators import distances as I
from latentspark.operators import fit as G
from latentspark.operators import intervals as C
from latentspark.operators import kernels as K
from latentspark.operators import latents as L
from latentspark.operators import nulls as M
from latentspark.operators import perievent as J
from latentspark.operators import signals as S
from latentspark.operators import transitions as H
from latentspark.sources.shared import shared_folder, until_exit
from latentspark.sources.tables import T0
from latentspark.streaming import streams

from .binding import EV, HASH, HC, IV, KEYS, LL, NB, SIG, TUN, Query, day_counts, events, half_days, hourly_counts, hourly_signal, hourly_tuning, posterior, rounded, table, with_
from .oracles import BASE as MODEL
from .oracles import MOVE, SESSIONS, TWO, _forward, with_all
from .queries_base import RUNS, _grid_maps
from .queries_decode import BASE, LABELS, LATENTS, _day_posterior, _model
from .queries_stats import CHAINS, MAP, P0, PERI, SHUFFLED, _chains, _dense_signal, _map, _pairs, _table

UNITS = ["click", "error", "purchase", "signup", "view"]


def _arrays(spark, sf):
    """session, bin, p_latent of naive Bayes."""
    return posterior(spark, sf).groupBy(*KEYS, "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("latent", "p"))), lambda x: F.round(x["p"], 9)).alias("p_latent"))


def _mazes(spark, sf):
    """Latents 0 to 2 lie in maze a at x = 10, 20, 30, the others in maze b at y = 5, 10, 15."""
    g = hourly_tuning(hourly_counts(spark, sf)).select(F.col("latent").cast("int").alias("flat_idx")).distinct()
    a = F.col("flat_idx") < 3
    return g.select("flat_idx", F.when(a, "a").otherwise("b").alias("maze"), F.when(a, (F.col("flat_idx") + 1) * 10.0).alias("x"), F.when(~a, (F.col("flat_idx") - 2) * 5.0).alias("y"))


MAZES = "mz AS (SELECT DISTINCT CAST(latent AS INTEGER) AS flat_idx, CASE WHEN latent < 3 THEN 'a' ELSE 'b' END AS maze, CASE WHEN latent < 3 THEN (latent + 1) * 10e0 END AS x, CASE WHEN latent >= 3 THEN (latent - 2) * 5e0 END AS y FROM tun), np AS (SELECT session, bin, CAST(latent AS INTEGER) AS flat_idx, round(p, 9) AS p FROM nb)"


def _bins(spark, sf):
    """Centres of the bins of half days."""
    return C.bins_of(half_days(spark, sf).select("session", "interval_id", "start", "end"), 3600.0).select("session", "interval_id", "bin", "t")


def _kinds(spark, sf):
    h = half_days(spark, sf)
    return h.withColumn("kind", F.lit("day")).unionByName(h.where("interval_id % 2 = 0").withColumns({"kind": F.lit("late"), "start": F.col("start") + 21600}))


def _features(spark, sf):
    """session, feature, bin, value: the hourly mean of k, and the events of an hour."""
    n = hourly_counts(spark, sf).groupBy("session", "bin").agg(F.sum("n").cast("double").alias("value"))
    return _dense_signal(spark, sf).select("session", F.lit("k").alias("feature"), "bin", "value").unionByName(n.select("session", F.lit("rate").alias("feature"), "bin", "value"))


def _event_kinds(spark, sf):
    return hourly_counts(spark, sf).where("unit in ('purchase', 'error') and n > 0").select("session", F.col("unit").alias("event_kind"), F.col("bin").alias("event_bin"))


def _suite(spark, sf):
    return J.event_triggered_suite(_features(spark, sf), _event_kinds(spark, sf), 4, 5, KEYS)


SUITE = """fe AS (SELECT session, 'k' AS feature, bin, value FROM ds UNION ALL SELECT session, 'rate', bin, CAST(sum(n) AS DOUBLE) FROM hc GROUP BY 1, 3),
      ek AS (SELECT session, unit AS event_kind, bin AS event_bin FROM hc WHERE unit IN ('purchase', 'error') AND n > 0),
      st AS (SELECT ek.session, feature, event_kind, event_bin, CAST(rel AS INTEGER) AS rel, value AS y FROM ek CROSS JOIN range(-4, 5) r(rel) JOIN fe ON fe.session = ek.session AND fe.bin = event_bin + rel WHERE event_bin BETWEEN 4 AND 715)"""


def _steps(spark, sf):
    return L.null_steps(_map(spark, sf), "latent", _chains(spark, sf), 0.6, 20, KEYS)


STEPS = """c0 AS (SELECT bin FROM ch WHERE p > 0.6), mv AS (SELECT session, bin, latent AS b, lag(latent) OVER (PARTITION BY session ORDER BY bin) AS a FROM mp),
      sp AS (SELECT session, bin AS event_bin, a, b FROM mv WHERE a <> b AND bin NOT IN (SELECT bin FROM c0) QUALIFY row_number() OVER (PARTITION BY session ORDER BY CAST(('0x' || substr(md5('0|' || session || '|' || bin), 1, 8)) AS BIGINT), bin) <= 20)"""


# ---- streams: the table is read as a stream, and run over all that it holds ------------------------------------------------


def _folder(spark):
    return until_exit(spark, shared_folder(spark))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.concat(F.lit("s"), F.pmod("user_id", F.lit(4))).alias("session"), F.col("event_type").alias("unit"), F.col("ts").cast("timestamp").alias("ts"))


def _count_stream(spark, sf):
    """session, bin, units as a stream of files in the shared folder."""
    at = f"{_folder(spark)}/counts"
    dense = G.dense_counts(hourly_counts(spark, sf), UNITS, KEYS).select("session", "bin", F.col("y").alias("units"))
    dense.write.parquet(at)
    return spark.readStream.schema(dense.schema).parquet(at)


def _t1(spark, sf):
    return streams.ran(streams.stream_counts(_event_stream(spark, sf), "6 hours", "2 hours"), _folder(spark), "complete").select("session", "unit", F.col("start").cast("double").alias("start"), "n")


def _t2(spark, sf):
    got = streams.ran(streams.stream_bursts(_event_stream(spark, sf), "15 minutes", "2 hours", 60.0), _folder(spark), "complete")
    return got.select("session", F.round(F.col("start").cast("double"), 3).alias("start"), F.round(F.col("end").cast("double"), 3).alias("end"), "n")


def _t3(spark, sf):
    got = streams.ran(streams.stream_filter(_count_stream(spark, sf), _model(spark, sf)), _folder(spark))
    return got.select("session", "bin", F.posexplode("causal_latent").alias("latent", "p"), F.round("log_marginal", 4).alias("log_marginal")).withColumn("p", F.round("p", 6))


def _t4(spark, sf):
    got = streams.ran(streams.stream_naive_bayes(_count_stream(spark, sf), _model(spark, sf)), _folder(spark))
    return got.select("session", "bin", F.posexplode("p_latent").alias("latent", "p"), F.round("log_marginal", 5).alias("log_marginal")).withColumn("p", F.round("p", 6))


BURSTS = """a AS (SELECT session, t, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t) < 900 THEN 0 ELSE 1 END AS nw FROM ev), b AS (SELECT *, sum(nw) OVER (PARTITION BY session ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM a)"""

BOOT = """bt AS (SELECT session, rel, y, row_number() OVER (PARTITION BY session, rel ORDER BY event_bin) AS r, count(*) OVER (PARTITION BY session, rel) AS n FROM pt),
      dr AS (SELECT session, rel, q.repeat, CAST(floor((""" + HASH.format("q.repeat || '|' || session || '|' || rel || '|' || r") + """ + 0.5) / 4294967296e0 * n) AS BIGINT) + 1 AS r FROM bt, range(1, 21) q(repeat)),
      mn AS (SELECT dr.session, dr.rel, repeat, avg(y) AS m FROM dr JOIN bt USING (session, rel, r) GROUP BY 1, 2, 3)"""

QUERIES = [
    Query("c13_value_from", lambda s, d: rounded(C.value_from(events(s, d), _bins(s, d), "k", KEYS).select("session", "interval_id", "bin", "k"), 4),
          with_(EV, IV) + """, bn AS (SELECT session, interval_id, CAST(b AS BIGINT) AS bin, s + (b + 0.5) * 3600 AS t FROM iv, range(12) r(b)), one AS (SELECT session, t, min(k) AS k FROM ev GROUP BY 1, 2),
          bk AS (SELECT bn.*, one.t AS bt, one.k AS bv FROM bn ASOF LEFT JOIN one ON bn.session = one.session AND bn.t >= one.t), al AS (SELECT bk.*, one.t AS at_, one.k AS av FROM bk ASOF LEFT JOIN one ON bk.session = one.session AND bk.t <= one.t)
          SELECT session, interval_id, bin, round(CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt <= at_ - t) THEN bv ELSE av END, 4) AS k FROM al"""),
    Query("c5_runs_in_blocks", lambda s, d: C.runs_in_blocks(events(s, d).select("session", "t", "value", "event_id"), F.col("value") > 20, KEYS, 7200.0, order=["t", "event_id"]), with_(EV, RUNS.format(test="value > 20")) + 'SELECT session, s AS start, e AS "end", n FROM runs'),
    Query("d14_population_mean_rate", lambda s, d: rounded(S.population_mean_rate(C.count_in_bins(events(s, d), half_days(s, d), 3600.0, KEYS).join(_bins(s, d), ["session", "interval_id", "bin"]).select("session", "t", "unit", "n"), KEYS), 9),
          with_(EV, IV) + """, u AS (SELECT session, count(DISTINCT unit) AS u FROM ev GROUP BY 1), c AS (SELECT ev.session, interval_id, floor((t - s) / 3600) AS b, count(*) AS n FROM ev JOIN iv ON iv.session = ev.session AND t >= s AND t < e GROUP BY ALL)
          SELECT iv.session, s + (r.b + 0.5) * 3600 AS t, round(coalesce(n, 0) / u / 3600e0, 9) AS rate FROM iv JOIN u USING (session) CROSS JOIN range(12) r(b) LEFT JOIN c ON c.session = iv.session AND c.interval_id = iv.interval_id AND c.b = r.b"""),
    Query("f5_map_across_mazes", lambda s, d: rounded(D.map_position(_arrays(s, d), _mazes(s, d), KEYS)),
          BASE.rstrip() + ",\n" + MAZES + " SELECT session, bin, flat_idx, round(p, 6) AS p, maze, x, y FROM np JOIN mz USING (flat_idx) QUALIFY row_number() OVER (PARTITION BY session, bin ORDER BY p DESC, flat_idx) = 1"),
    Query("f6_split_posterior_by_maze", lambda s, d: rounded(D.split_posterior(_arrays(s, d), _mazes(s, d), KEYS, "b").select("session", "bin", "flat_idx", "p", "y")),
          BASE.rstrip() + ",\n" + MAZES + " SELECT session, bin, flat_idx, round(p, 6) AS p, y FROM np JOIN mz USING (flat_idx) WHERE maze = 'b'"),
    Query("n3_expected_position", lambda s, d: rounded(D.expected_position(_arrays(s, d), _mazes(s, d), KEYS, "x")),
          BASE.rstrip() + ",\n" + MAZES + " SELECT session, bin, round(sum(p * x) / sum(p), 6) AS x FROM np JOIN mz USING (flat_idx) WHERE x IS NOT NULL GROUP BY 1, 2"),
    Query("f8_label_grid_kernel", lambda s, d: rounded(K.label_grid_kernel(_grid_maps(s, d), [("x", 3.0), ("y", 5.0)])),
          """WITH a AS (SELECT DISTINCT CAST(p_size AS INTEGER) AS ix FROM part), b AS (SELECT CAST(n_nationkey AS INTEGER) AS ix FROM nation),
          g AS (SELECT 'a' AS maze, row_number() OVER (ORDER BY ix) - 1 AS f, ix * 2e0 AS c, 3e0 AS sd FROM a UNION ALL SELECT 'b', (SELECT count(*) FROM a) + row_number() OVER (ORDER BY ix) - 1, ix * 3e0, 5e0 FROM b),
          w AS (SELECT x.f AS i, y.f AS j, exp(-0.5 * pow((x.c - y.c) / x.sd, 2)) AS w FROM g x JOIN g y USING (maze)) SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS p FROM w"""),
    Query("f7_kernel_of_labels", lambda s, d: rounded(K.label_grid_kernel(_label_values(s, d), [("k", 10.0)])),
          with_(EV) + ", g AS (SELECT DISTINCT k, dense_rank() OVER (ORDER BY k) - 1 AS f FROM ev), w AS (SELECT x.f AS i, y.f AS j, exp(-0.5 * pow((x.k - y.k) / 10, 2)) AS w FROM g x, g y) SELECT i, j, p FROM (SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS p FROM w)"),
    Query("g2_map_tuning", lambda s, d: rounded(G.empirical_tuning(*G.weighted_stats(G.map_posterior(posterior(s, d).withColumn("p", F.round("p", 9)), KEYS), hourly_counts(s, d), KEYS), hourly_counts(s, d))),
          BASE.rstrip() + ",\n h1 AS (SELECT session, bin, latent, (row_number() OVER (PARTITION BY session, bin ORDER BY round(p, 9) DESC, latent) = 1)::INT * 1e0 AS p FROM nb), b AS (SELECT latent, sum(p) AS b FROM h1 GROUP BY 1), a AS (SELECT latent, unit, sum(p * n) AS a FROM h1 JOIN hc USING (session, bin) GROUP BY 1, 2) SELECT latent, unit, round(a / (b + 1e-12), 6) AS rate FROM a JOIN b USING (latent)"),
    Query("h1_transition_mass", lambda s, d: rounded(H.transition_mass(H.expected_transitions(_day_posterior(s, d), KEYS, ["day"]), _day_posterior(s, d), KEYS, ["day"])),
          BASE.rstrip() + ",\n c AS (SELECT a.session, a.latent AS i, sum(a.p * b.p) AS c FROM nb a JOIN nb b ON a.session = b.session AND b.bin = a.bin + 1 AND a.bin // 24 = b.bin // 24 GROUP BY 1, 2), n AS (SELECT session, CAST(sum(k - 1) AS BIGINT) AS n_steps FROM (SELECT session, bin // 24, count(DISTINCT bin) AS k FROM nb GROUP BY 1, 2) GROUP BY 1) SELECT session, i, round(c, 6) AS mass, n_steps FROM c JOIN n USING (session)"),
    Query("i1_jensen_shannon", lambda s, d: rounded(I.pairwise_distance(_arrays(s, d), "p_latent", "jensenshannon", "bin", KEYS, 2).select("session", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d"), 5),
          BASE.rstrip() + ",\n q AS (SELECT session, bin + 1 AS i, latent, round(p, 9) / sum(round(p, 9)) OVER (PARTITION BY session, bin) AS p FROM nb) SELECT session, i, j, round(sqrt(greatest(sum(s) / 2, 0)), 5) + 0.0 AS d FROM (SELECT a.session, a.i, b.i AS j, CASE WHEN a.p > 0 THEN a.p * ln(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * ln(2 * b.p / (a.p + b.p)) ELSE 0 END AS s FROM q a JOIN q b ON a.session = b.session AND a.latent = b.latent AND b.i - a.i IN (1, 2)) GROUP BY 1, 2, 3"),
    Query("i3_distance_by_label_quantiles", lambda s, d: rounded(I.distance_by_label_bins(_signal_pairs(s, d), "value_i", "value_j", 4)),
          with_(EV, SIG) + """, r AS (SELECT session, value, row_number() OVER (PARTITION BY session ORDER BY bin) AS i FROM sig), p AS (SELECT abs(a.value - b.value) AS d FROM r a JOIN r b ON a.session = b.session AND b.i - a.i BETWEEN 1 AND 3), e AS (SELECT quantile_cont(d, [0.25, 0.5, 0.75]) AS q FROM p)
          SELECT CASE WHEN d <= q[1] THEN 0 WHEN d <= q[2] THEN 1 WHEN d <= q[3] THEN 2 ELSE 3 END AS label_lag, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem FROM p, e GROUP BY 1"""),
    Query("i5_bin_stats_uniform", lambda s, d: rounded(I.bin_stats_auto(events(s, d), "k", "value", 5).select("bin", "left", "right", "n", "mean", "std")),
          with_(EV) + ", m AS (SELECT min(k) AS a, max(k) AS b FROM ev), x AS (SELECT least(4, CAST(floor((k - a) / (b - a) * 5 + 1e-12) AS INTEGER)) AS bin, a, b, value FROM ev, m) SELECT bin, round(any_value(a) + (any_value(b) - any_value(a)) * bin / 5, 6) AS \"left\", round(any_value(a) + (any_value(b) - any_value(a)) * (bin + 1) / 5, 6) AS \"right\", count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM x GROUP BY bin"),
    Query("i5_bin_stats_quantile", lambda s, d: rounded(I.bin_stats_auto(events(s, d), "value", "k", 4, "quantile").select("bin", "n", "mean", "std")),
          with_(EV) + ", e AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM ev) SELECT CASE WHEN value < q[1] THEN 0 WHEN value < q[2] THEN 1 WHEN value < q[3] THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std FROM ev, e GROUP BY 1"),
    Query("i11_feature_vs_label_distance", lambda s, d: rounded(I.feature_vs_label_distance(events(s, d).select("session", "t", "value", "k"), _kinds(s, d), ["value", "k"], 20, KEYS)),
          with_(EV, IV) + """, kd AS (SELECT 'day' AS kind, session, interval_id, s, e FROM iv UNION ALL SELECT 'late', session, interval_id, s + 21600, e FROM iv WHERE interval_id % 2 = 0),
          mi AS (SELECT kind, kd.session, s, avg(value) AS value, avg(k) AS k FROM ev JOIN kd ON kd.session = ev.session AND t BETWEEN s AND e GROUP BY 1, 2, 3), mf AS (SELECT kind, 'value' AS feature, session, s, value AS x FROM mi UNION ALL SELECT kind, 'k', session, s, k FROM mi),
          pl AS (SELECT *, row_number() OVER (PARTITION BY kind, feature, session ORDER BY s) AS i FROM mf), pm AS (SELECT kind, feature, session, q.shuffle, i * 1e0 AS label, CASE WHEN q.shuffle = 0 THEN i ELSE row_number() OVER (PARTITION BY kind, feature, session, q.shuffle ORDER BY """ + HASH.format("q.shuffle || '|' || kind || '|' || feature || '|' || session || '|' || i") + """, i) END AS r FROM pl, range(21) q(shuffle)),
          dd AS (SELECT a.kind, a.feature, a.session, a.i, b.i AS j, abs(a.x - b.x) AS d FROM pl a JOIN pl b ON a.kind = b.kind AND a.feature = b.feature AND a.session = b.session AND a.i < b.i),
          sl AS (SELECT kind, feature, session, a.shuffle, regr_slope(d, abs(a.label - b.label)) AS slope FROM dd JOIN pm a USING (kind, feature, session) JOIN pm b USING (kind, feature, session) WHERE a.r = dd.i AND b.r = dd.j AND a.shuffle = b.shuffle GROUP BY 1, 2, 3, 4)
          SELECT a.kind, a.feature, a.session, round(any_value(a.slope), 6) AS slope, round((1 + count(*) FILTER (abs(b.slope) >= abs(a.slope))) / (count(*) + 1), 6) AS p FROM sl a JOIN sl b USING (kind, feature, session) WHERE a.shuffle = 0 AND b.shuffle > 0 GROUP BY 1, 2, 3"""),
    Query("j4_pre_post_correlation", lambda s, d: rounded(J.pre_post_correlation(_table(s, d), KEYS, 4)),
          P0 + "SELECT session, round(corr(y, rel) FILTER (rel > -4 AND rel < 0), 6) + 0.0 AS r_pre, round(corr(y, rel) FILTER (rel > 0 AND rel < 4), 6) + 0.0 AS r_post FROM pt GROUP BY 1"),
    Query("j7_event_triggered_suite", lambda s, d: rounded(_suite(s, d)["tests"]),
          with_(EV, HC, PERI, SUITE) + """, df AS (SELECT session, feature, event_kind, avg(y) FILTER (rel > 0 AND rel < 4) - avg(y) FILTER (rel < 0 AND rel > -4) AS diff FROM st GROUP BY session, feature, event_kind, event_bin),
          rk AS (SELECT session, feature, event_kind, diff, rank() OVER (PARTITION BY session, feature, event_kind ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY session, feature, event_kind, abs(diff)) - 1) / 2 AS r FROM (SELECT * REPLACE (round(diff, 9) AS diff) FROM df) WHERE diff <> 0),
          wx AS (SELECT session, feature, event_kind, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus FROM rk GROUP BY 1, 2, 3), sz AS (SELECT session, feature, event_kind, quantile_cont(diff, 0.5) AS median, avg(diff) / stddev_samp(diff) AS effect FROM df GROUP BY 1, 2, 3)
          SELECT session, feature, event_kind, n, round(w_plus, 6) AS w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z, round(median, 6) + 0.0 AS median, round(effect, 6) AS effect FROM wx JOIN sz USING (session, feature, event_kind)"""),
    Query("j7_suite_correlation", lambda s, d: rounded(_suite(s, d)["correlation"]),
          with_(EV, HC, PERI, SUITE) + "SELECT session, feature, event_kind, round(corr(y, rel) FILTER (rel > -4 AND rel < 0), 6) + 0.0 AS r_pre, round(corr(y, rel) FILTER (rel > 0 AND rel < 4), 6) + 0.0 AS r_post FROM st GROUP BY 1, 2, 3"),
    Query("j13_bootstrap_band", lambda s, d: rounded(J.bootstrap_band(_table(s, d), ["session", "rel"], "y", "event_bin", 20)),
          with_(EV, HC, PERI, BOOT) + "SELECT session, rel, round(any_value(a.mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM mn JOIN (SELECT session, rel, avg(y) AS mean FROM pt GROUP BY 1, 2) a USING (session, rel) GROUP BY 1, 2"),
    Query("k2_classify_by_category", lambda s, d: rounded(L.classify_latents(L.mean_latent_per_epoch(posterior(s, d).withColumn("label", F.when(F.col("bin") % 24 < 12, "am").otherwise("pm"))), {"am": 0.9, "pm": 0.5})),
          BASE + ", a AS (SELECT CASE WHEN bin % 24 < 12 THEN 'am' ELSE 'pm' END AS label, latent, avg(p) AS m FROM nb GROUP BY 1, 2), b AS (SELECT *, m / sum(m) OVER (PARTITION BY latent) AS score FROM a) SELECT latent, CASE WHEN score >= CASE label WHEN 'am' THEN 0.9 ELSE 0.5 END THEN label ELSE 'unclassified' END AS kind, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY latent ORDER BY score DESC, label DESC) = 1"),
    Query("k7_circular_diff", lambda s, d: rounded(events(s, d).select("event_id", L.circular_diff(F.col("k"), F.col("value"), 0.0, 100.0).alias("diff")), 5),
          with_(EV) + "SELECT event_id, round(x - floor(x / 100) * 100 - 50, 5) + 0.0 AS diff FROM (SELECT event_id, k - value + 50 AS x FROM ev)"),
    Query("k14_triggered_features", lambda s, d: rounded(L.jump_triggered_features(_map(s, d), "latent", _map(s, d).unpivot(["session", "bin"], ["speed", "away"], "feature", "value"), hourly_counts(s, d), hourly_tuning(hourly_counts(s, d)), (0, 4), 1, 1, KEYS)),
          with_(EV, HC, TUN, MAP) + """, ax AS (SELECT unit, avg(rate) FILTER (abs(latent - 4) <= 1) - avg(rate) FILTER (abs(latent) <= 1) AS a FROM tun GROUP BY 1), un AS (SELECT unit, a / sqrt(sum(a * a) OVER ()) AS a FROM ax),
          fs AS (SELECT session, 'speed' AS feature, bin, speed AS value FROM mp UNION ALL SELECT session, 'away', bin, away FROM mp UNION ALL SELECT session, 'projection', bin, sum(n * a) FROM hc JOIN un USING (unit) GROUP BY session, bin),
          ends AS (SELECT session, feature, min(bin) AS lo, max(bin) AS hi FROM fs GROUP BY 1, 2), sp AS (SELECT session, bin AS event_bin FROM (SELECT session, bin, latent, lag(latent) OVER (PARTITION BY session ORDER BY bin) AS b FROM mp) WHERE abs(b) <= 1 AND abs(latent - 4) <= 1)
          SELECT sp.session, fs.feature, event_bin, CAST(rel AS INTEGER) AS rel, round(value, 6) + 0.0 AS y FROM sp JOIN ends USING (session) CROSS JOIN range(-1, 2) r(rel) JOIN fs ON fs.session = sp.session AND fs.feature = ends.feature AND fs.bin = event_bin + rel WHERE event_bin - 1 >= lo AND event_bin + 1 <= hi"""),
    Query("k15_null_contrast_projection", lambda s, d: rounded(L.null_contrast_projection(_steps(s, d), _map(s, d), "latent", hourly_counts(s, d), hourly_tuning(hourly_counts(s, d)), 1, 2, KEYS)),
          with_(EV, HC, TUN, MAP, CHAINS, STEPS) + """, ax AS (SELECT a, b, unit, avg(rate) FILTER (abs(latent - b) <= 1) - avg(rate) FILTER (abs(latent - a) <= 1) AS w FROM (SELECT DISTINCT a, b FROM sp), tun GROUP BY 1, 2, 3), nx AS (SELECT a, b, unit, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY a, b)), 0) AS w FROM ax)
          SELECT sp.session, event_bin, a, b, CAST(rel AS INTEGER) AS rel, round(sum(n * w), 6) + 0.0 AS y FROM sp CROSS JOIN range(-2, 3) r(rel) JOIN hc ON hc.session = sp.session AND hc.bin = event_bin + rel JOIN nx USING (a, b, unit) WHERE event_bin BETWEEN 2 AND 717 GROUP BY 1, 2, 3, 4, 5"""),
    Query("k17_null_summary", lambda s, d: rounded(L.consensus_null_summary(L.jump_consensus_shuffle(_chains(s, d), 0, 3, 0.4, 0.6, 30))),
          with_(EV, HC, CHAINS) + """, jp AS (SELECT bin FROM ch WHERE chain = 0 AND p >= 0.4), rl AS (SELECT s.shuffle, chain, (bin + """ + HASH.format("s.shuffle || '|' || chain") + """ % 720) % 720 AS at_ FROM ch, range(1, 31) s(shuffle) WHERE chain <> 0 AND p > 0.4),
          hits AS (SELECT s.shuffle, jp.bin, count(DISTINCT chain) AS k FROM jp CROSS JOIN range(1, 31) s(shuffle) LEFT JOIN rl ON rl.shuffle = s.shuffle AND rl.at_ BETWEEN jp.bin - 3 AND jp.bin + 3 GROUP BY 1, 2), fr AS (SELECT shuffle, avg(CASE WHEN k / 3 >= 0.6 THEN 1e0 ELSE 0 END) AS fraction FROM hits GROUP BY 1)
          SELECT round(quantile_cont(fraction, 0.025), 6) AS low, round(quantile_cont(fraction, 0.975), 6) AS high, round(avg(fraction), 6) AS mean, round(stddev_pop(fraction), 6) AS std FROM fr"""),
    Query("k18_rolled_consensus", lambda s, d: rounded(B.rolled_consensus(_dense_signal(s, d).withColumn("value", F.col("value") - 50.0), _purchases(s, d), 3, 4, KEYS)),
          with_(EV, HC, PERI) + """, ro AS (SELECT session, s.shuffle, (bin + """ + HASH.format("s.shuffle || '|' || session") + """ % 720) % 720 AS bin, value FROM ds, range(1, 5) s(shuffle)), e3 AS (SELECT session, bin AS event_bin FROM hc WHERE unit = 'purchase' AND n > 0 AND bin BETWEEN 3 AND 716),
          hh AS (SELECT w, ro.shuffle, e3.session, event_bin, max(CASE WHEN abs(ro.bin - event_bin) <= w AND value > 50 THEN 1e0 ELSE 0 END) AS h FROM e3 JOIN ro ON ro.session = e3.session AND ro.bin BETWEEN event_bin - 3 AND event_bin + 3 CROSS JOIN range(1, 4) q(w) GROUP BY 1, 2, 3, 4)
          SELECT CAST(shuffle AS INTEGER) AS shuffle, CAST(w AS INTEGER) AS "window", round(avg(h), 6) AS fraction FROM hh GROUP BY 1, 2"""),
    Query("l1_pre_post_means", lambda s, d: rounded(M.pre_post_posterior(posterior(s, d), KEYS, F.col("bin") < 240, F.col("bin") >= 480)),
          BASE + "SELECT session, latent, round(avg(p) FILTER (bin < 240), 6) AS pre, round(avg(p) FILTER (bin >= 480), 6) AS post, round(avg(p) FILTER (bin >= 480) - avg(p) FILTER (bin < 240), 6) + 0.0 AS diff FROM nb GROUP BY 1, 2"),
    Query("t1_counts_by_window", _t1, with_(EV) + "SELECT session, unit, floor(t / 21600) * 21600 AS start, count(*) AS n FROM ev GROUP BY 1, 2, 3"),
    Query("t2_session_windows", _t2, with_(EV, BURSTS) + 'SELECT session, round(min(t), 3) AS start, round(max(t) + 900, 3) AS "end", count(*) AS n FROM b GROUP BY session, g HAVING max(t) - min(t) > 60'),
    Query("t3_stream_filter", _t3, with_all(*MODEL, *_forward("", SESSIONS, [MOVE, "SELECT {e}, a.i, b.i, 1e0 / 6 FROM range(6) a(i), range(6) b(i)"], TWO)) + "SELECT session, bin, CAST(latent AS INTEGER) AS latent, round(p, 6) AS p, round(sum(step) OVER (PARTITION BY session, latent ORDER BY bin), 4) AS log_marginal FROM (SELECT g AS session, t AS bin, s % 6 AS latent, sum(a) AS p, any_value(step) AS step FROM fw GROUP BY 1, 2, 3)"),
    Query("t4_stream_naive_bayes", _t4, BASE + "SELECT session, bin, CAST(latent AS INTEGER) AS latent, round(p, 6) AS p, round(log_marginal, 5) AS log_marginal FROM nb"),
]


def _label_values(spark, sf):
    """The values of k as a grid of one maze."""
    from pyspark.sql import Window

    k = events(spark, sf).select("k").distinct()
    return k.select(F.lit("a").alias("maze"), (F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("flat_idx"), "k")  # at most a hundred values


def _signal_pairs(spark, sf):
    """Hours at most three apart, with their mean value and its distance."""
    return I.pairwise_distance(hourly_signal(spark, sf).withColumn("x", F.array("value")), "x", "euclidean", "bin", KEYS, 3, ["value"])


def _purchases(spark, sf):
    return hourly_counts(spark, sf).where("unit = 'purchase' and n > 0").select("session", F.col("bin").alias("event_bin"))
