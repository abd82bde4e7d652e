"""Distances, peri-event analysis, latents and streaming, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latentspark.functions import stats
from latentspark.operators import distances as I
from latentspark.operators import latents as K
from latentspark.operators import perievent as J

from . import workflows
from .binding import EV, HASH, HC, KEYS, SIG, Query, events, hourly_counts, hourly_signal, hourly_tuning, posterior, rounded, vectors, with_
from .queries_decode import BASE, LABELS, _labels

REACH = 4


def _pairs(spark, sf, metric="euclidean"):
    return I.pairwise_distance(vectors(spark, sf), "embedding", metric, "vec_id", ["series"], 10, ["label"])


PAIRS = """v AS (SELECT vec_id // 100 AS series, vec_id, CAST(embedding AS DOUBLE[64]) AS x, CAST(label AS DOUBLE) AS label FROM embeddings),
      pr AS (SELECT a.series, a.vec_id % 100 + 1 AS i, b.vec_id % 100 + 1 AS j, CAST(b.vec_id - a.vec_id AS INTEGER) AS lag, array_distance(a.x, b.x) AS d, abs(a.label - b.label) AS ll
             FROM v a JOIN v b ON a.series = b.series AND b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 10)"""


def _dense_signal(spark, sf):
    """Hourly mean of k, 0 in hours without events: session, bin, value."""
    c = hourly_counts(spark, sf).select("session", "bin").distinct()
    k = events(spark, sf).groupBy("session", F.floor((F.col("t") - 1704067200.0) / 3600).cast("long").alias("bin")).agg(F.avg("k").alias("value"))
    return c.join(k, ["session", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _events(spark, sf):
    """Hours with a purchase."""
    return hourly_counts(spark, sf).where("unit = 'purchase' and n > 0").select("session", F.col("bin").alias("event_bin"))


def _table(spark, sf):
    return J.peri_event(_dense_signal(spark, sf), _events(spark, sf), REACH, KEYS)


PERI = """ds AS (SELECT session, bin, coalesce(value, 0) AS value FROM (SELECT DISTINCT session, bin FROM hc) LEFT JOIN (SELECT session, CAST(floor((t - 1704067200e0) / 3600) AS BIGINT) AS bin, avg(k) AS value FROM ev GROUP BY 1, 2) USING (session, bin)),
      pe AS (SELECT session, bin AS event_bin FROM hc WHERE unit = 'purchase' AND n > 0 AND bin BETWEEN 4 AND 715),
      pt AS (SELECT pe.session, event_bin, CAST(rel AS INTEGER) AS rel, value AS y FROM pe CROSS JOIN range(-4, 5) r(rel) JOIN ds ON ds.session = pe.session AND ds.bin = event_bin + rel)"""
PREPOST = "pp AS (SELECT session, event_bin, avg(y) FILTER (rel < 0 AND rel > -4) AS pre, avg(y) FILTER (rel > 0 AND rel < 4) AS post FROM pt GROUP BY 1, 2)"
P0 = with_(EV, HC, PERI)


def _shuffled(spark, sf):
    return J.peri_event_shuffle(_dense_signal(spark, sf), _events(spark, sf), REACH, 5, 1, 10, KEYS)


SHUFFLED = """sh AS (SELECT s.shuffle, CAST(floor((""" + HASH.format("s.shuffle || ''") + """ + 0.5) / 4294967296e0 * 10) AS BIGINT) + 1 AS shift FROM range(1, 6) s(shuffle)),
      mv AS (SELECT session, CAST(shuffle AS INTEGER) AS shuffle, (bin + shift) % 720 AS event_bin FROM hc, sh WHERE unit = 'purchase' AND n > 0),
      sp AS (SELECT mv.session, shuffle, CAST(rel AS INTEGER) AS rel, avg(value) AS mean FROM mv CROSS JOIN range(-4, 5) r(rel) JOIN ds ON ds.session = mv.session AND ds.bin = event_bin + rel WHERE event_bin BETWEEN 4 AND 715 GROUP BY ALL)"""


def _map(spark, sf):
    """session, bin, latent: most frequent event type as a number, with the hour's mean value and k."""
    number = F.when(F.col("label") == "click", 0).when(F.col("label") == "error", 1).when(F.col("label") == "purchase", 2).when(F.col("label") == "signup", 3).otherwise(4)
    e = events(spark, sf).groupBy("session", F.floor((F.col("t") - 1704067200.0) / 3600).cast("long").alias("bin")).agg(F.avg("value").alias("speed"), F.avg("k").alias("away"))
    return _labels(spark, sf).select("session", "bin", number.alias("latent")).join(e, ["session", "bin"])


MAP = LABELS + """, mp AS (SELECT lb.session, lb.bin, CASE label WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS latent, speed, away FROM lb JOIN
      (SELECT session, CAST(floor((t - 1704067200e0) / 3600) AS BIGINT) AS bin, avg(value) AS speed, avg(k) AS away FROM ev GROUP BY 1, 2) x USING (session, bin))"""
M0 = with_(EV, HC, MAP)


def _chains(spark, sf):
    """Sessions as chains: the share of an hour's events that are views."""
    c = hourly_counts(spark, sf)
    p = c.groupBy("session", "bin").agg((F.sum(F.when(F.col("unit") == "view", F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("p"))
    return p.select(F.substring("session", 2, 1).cast("int").alias("chain"), "bin", "p")


CHAINS = "ch AS (SELECT CAST(substr(session, 2, 1) AS INTEGER) AS chain, bin, sum(n) FILTER (unit = 'view') / greatest(sum(n), 1) AS p FROM hc GROUP BY session, bin)"


def _trajectories(spark, sf):
    """Each hundred embeddings as one trajectory: traj, step, feature, value."""
    v = vectors(spark, sf)
    return v.select(F.col("series").alias("traj"), (F.col("vec_id") % 100).alias("step"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def _resampled(spark, sf):
    return I.resample_trajectories(_trajectories(spark, sf), 6)


def _label_shuffle_test(spark, sf):
    v = vectors(spark, sf)
    places = v.select("series", F.row_number().over(Window.partitionBy("series").orderBy("vec_id")).alias("i"), "label")
    return I.distance_label_shuffle_test(I.pairwise_distance(v, "embedding", "euclidean", "vec_id", ["series"], 99), places, 50, ["series"])


def _between_sessions(spark, sf):
    """The distance of each two sessions' posteriors in every bin."""
    p = posterior(spark, sf).groupBy("session", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("latent", "p"))), lambda x: x["p"]).alias("p"))
    a, b = p.select(F.col("session").alias("a"), "bin", F.col("p").alias("x")), p.select(F.col("session").alias("b"), "bin", F.col("p").alias("y"))
    return a.join(b, "bin").where("a < b").select("a", "b", "bin", I.wasserstein1(F.col("x"), F.col("y"), [1.0] * 6).alias("w1"))


def _triggered(spark, sf):
    return workflows.event_triggered(_dense_signal(spark, sf), "value", KEYS, window=3, std=1.0, height=0.05, reach=REACH, n_shuffles=5)["tests"]


def _interaction(spark, sf):
    got = J.pre_post_interaction(_table(spark, sf), ["session", "event_bin"]).select("term", "coef", "se", "z")
    return got.select("term", (F.round("coef", 6) + 0.0).alias("coef"), F.round("se", 6).alias("se"), F.round("z", 4).alias("z"))


def _interaction_by_session(spark, sf):
    got = J.pre_post_interaction(_table(spark, sf), None, KEYS).select("session", "term", "n", "coef", "se", "low", "high")
    return rounded(got, 5)


HC1 = """sd AS (SELECT session, y, CAST(rel > 0 AS INTEGER) AS post, (rel - avg(rel) OVER w) / stddev_pop(rel) OVER w AS tz FROM pt WHERE rel <> 0 AND y IS NOT NULL WINDOW w AS (PARTITION BY session, rel > 0)),
      ft AS (SELECT session, post, count(*) AS n, avg(y) AS a, regr_slope(y, tz) AS b FROM sd GROUP BY 1, 2),
      fx AS (SELECT session, max(a) FILTER (post = 0) AS a0, max(b) FILTER (post = 0) AS b0, max(a) FILTER (post = 1) AS a1, max(b) FILTER (post = 1) AS b1, max(n) FILTER (post = 0) AS n0, max(n) FILTER (post = 1) AS n1 FROM ft GROUP BY 1),
      sc AS (SELECT session, post, y - a - b * tz AS e, tz FROM sd JOIN ft USING (session, post)),
      vv AS (SELECT session, any_value(a0) AS a0, any_value(b0) AS b0, any_value(a1) AS a1, any_value(b1) AS b1, any_value(n0) + any_value(n1) AS n, (any_value(n0) + any_value(n1)) / (any_value(n0) + any_value(n1) - 4e0) AS k,
             sum(e * e) FILTER (post = 0) / pow(any_value(n0), 2) AS p0, sum(e * e * tz * tz) FILTER (post = 0) / pow(any_value(n0), 2) AS q0, sum(e * e) FILTER (post = 1) / pow(any_value(n1), 2) AS p1, sum(e * e * tz * tz) FILTER (post = 1) / pow(any_value(n1), 2) AS q1 FROM sc JOIN fx USING (session) GROUP BY 1),
      ou(session, term, n, coef, se) AS (SELECT session, 'intercept', n, a0, sqrt(k * p0) FROM vv UNION ALL SELECT session, 'tz', n, b0, sqrt(k * q0) FROM vv UNION ALL SELECT session, 'post', n, a1 - a0, sqrt(k * (p0 + p1)) FROM vv UNION ALL SELECT session, 'txp', n, b1 - b0, sqrt(k * (q0 + q1)) FROM vv)"""
WIDE = 1.959963984540054


def _label_bin_null(spark, sf):
    v = vectors(spark, sf)
    places = v.select("series", F.row_number().over(Window.partitionBy("series").orderBy("vec_id")).alias("i"), "label")
    return I.distance_label_bin_null(I.pairwise_distance(v, "embedding", "euclidean", "vec_id", ["series"], 99), places, [0, 1, 3, 6, 100], 50, ["series"])


QUERIES = [
    Query("i1_pairwise_distance", lambda s, d: rounded(_pairs(s, d).select("series", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d")), with_(PAIRS) + "SELECT series, i, j, round(d, 6) AS d FROM pr"),
    Query("i2_distance_by_index_lag", lambda s, d: rounded(I.distance_by_lag(_pairs(s, d))), with_(PAIRS) + "SELECT lag, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem FROM pr GROUP BY 1"),
    Query("i3_distance_by_label_lag", lambda s, d: rounded(I.distance_by_label(_pairs(s, d), "label_i", "label_j", [0, 2, 4, 9])),
          with_(PAIRS) + "SELECT CASE WHEN ll <= 2 THEN 0 WHEN ll <= 4 THEN 1 ELSE 2 END AS label_lag, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem FROM pr GROUP BY 1"),
    Query("i4_wasserstein1", lambda s, d: rounded(_between_sessions(s, d)),
          BASE + "SELECT a, b, bin, round(sum(abs(cx - cy)), 6) + 0.0 AS w1 FROM (SELECT x.session AS a, y.session AS b, x.bin, x.latent, sum(x.p) OVER w AS cx, sum(y.p) OVER w AS cy FROM nb x JOIN nb y ON x.session < y.session AND x.bin = y.bin AND x.latent = y.latent WINDOW w AS (PARTITION BY x.session, y.session, x.bin ORDER BY x.latent ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2, 3"),
    Query("i5_bin_stats", lambda s, d: rounded(I.bin_stats(events(s, d), "k", "value", [0, 25, 50, 75, 99]).select("bin", "n", "mean", "std", "low", "high")),
          with_(EV) + "SELECT CASE WHEN k < 25 THEN 0 WHEN k < 50 THEN 1 WHEN k < 75 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM ev WHERE k < 99 GROUP BY 1"),
    Query("i6_distance_label_ols", lambda s, d: rounded(I.distance_label_ols(_pairs(s, d).withColumn("ll", F.abs(F.col("label_i") - F.col("label_j"))), "ll", keys=["series"])),
          with_(PAIRS) + "SELECT series, round(regr_slope(d, ll), 6) AS slope, round(regr_intercept(d, ll), 6) AS intercept, round(corr(d, ll), 6) AS r, round(regr_r2(d, ll), 6) AS r2 FROM pr GROUP BY 1"),
    Query("i7_residualize", lambda s, d: rounded(I.residualize(hourly_signal(s, d), "value", "bin", KEYS, "residual").select("session", "bin", "residual")),
          with_(EV, SIG) + ", g AS (SELECT session, regr_slope(value, bin) AS a, regr_intercept(value, bin) AS b FROM sig GROUP BY 1) SELECT session, bin, round(value - b - a * bin, 6) + 0.0 AS residual FROM sig JOIN g USING (session)"),
    Query("i8_distance_label_shuffle_test", lambda s, d: rounded(_label_shuffle_test(s, d))),
    Query("i9_resample_trajectories", lambda s, d: rounded(_resampled(s, d), 5)),
    Query("i10_mean_distance_matrix", lambda s, d: rounded(I.mean_distance_matrix(_resampled(s, d), 6))),
    Query("j1_peri_event", lambda s, d: rounded(_table(s, d).select("session", "event_bin", "rel", "y")), P0 + "SELECT session, event_bin, rel, round(y, 6) AS y FROM pt"),
    Query("j2_zscore_within_event", lambda s, d: rounded(J.zscore_within_event(_table(s, d), KEYS).select("session", "event_bin", "rel", "z")),
          P0 + "SELECT session, event_bin, rel, CASE WHEN stddev_pop(y) OVER w > 0 THEN round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) + 0.0 END AS z FROM pt WINDOW w AS (PARTITION BY session, event_bin)"),
    Query("j3_peri_event_shuffle", lambda s, d: rounded(_shuffled(s, d)), with_(EV, HC, PERI, SHUFFLED) + "SELECT session, shuffle, rel, round(mean, 6) AS mean FROM sp"),
    Query("j4_pre_post_test", lambda s, d: rounded(J.pre_post_test(_table(s, d), KEYS, REACH)),
          with_(EV, HC, PERI, PREPOST) + """, df AS (SELECT session, post - pre AS diff FROM pp), rk AS (SELECT session, diff, rank() OVER (PARTITION BY session ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY session, abs(diff)) - 1) / 2 AS r FROM df WHERE diff <> 0),
          wx AS (SELECT session, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus FROM rk GROUP BY 1), sz AS (SELECT session, quantile_cont(diff, 0.5) AS median, avg(diff) / stddev_samp(diff) AS effect FROM df GROUP BY 1)
          SELECT session, n, round(w_plus, 6) AS w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z, round(median, 6) AS median, round(effect, 6) AS effect FROM wx JOIN sz USING (session)"""),
    Query("j5_pre_post_vs_shuffle", lambda s, d: rounded(J.pre_post_vs_shuffle(_table(s, d), _shuffled(s, d), KEYS, REACH)),
          with_(EV, HC, PERI, SHUFFLED) + """, o AS (SELECT session, quantile_cont(diff, 0.5) AS observed FROM (SELECT session, event_bin, avg(y) FILTER (rel >= 0) - avg(y) FILTER (rel < 0) AS diff FROM pt GROUP BY 1, 2) GROUP BY 1),
          nl AS (SELECT session, shuffle, avg(mean) FILTER (rel >= 0) - avg(mean) FILTER (rel < 0) AS x FROM sp GROUP BY 1, 2)
          SELECT session, round(any_value(observed), 6) AS observed, round(avg(CASE WHEN observed >= x THEN 1e0 ELSE 0 END), 6) AS p FROM o JOIN nl USING (session) GROUP BY 1"""),
    Query("j6_pre_post_slopes", lambda s, d: rounded(J.pre_post_slopes(_table(s, d), KEYS)),
          P0 + ", z AS (SELECT session, CAST(sign(rel) AS INTEGER) AS side, y, (rel - avg(rel) OVER w) / stddev_pop(rel) OVER w AS tz FROM pt WHERE rel <> 0 WINDOW w AS (PARTITION BY session, sign(rel))) SELECT session, side, round(regr_slope(y, tz), 6) AS slope, round(regr_intercept(y, tz), 6) AS intercept FROM z GROUP BY 1, 2"),
    Query("j6_pre_post_interaction", _interaction),
    Query("j6_interaction_by_session", _interaction_by_session,
          with_(EV, HC, PERI, HC1) + f"SELECT session, term, n, round(coef, 5) + 0.0 AS coef, round(se, 5) AS se, round(coef - {WIDE} * se, 5) + 0.0 AS low, round(coef + {WIDE} * se, 5) + 0.0 AS high FROM ou"),
    Query("i8_distance_label_bin_null", lambda s, d: rounded(_label_bin_null(s, d), 5)),
    Query("i9_mean_trajectory", lambda s, d: rounded(I.mean_trajectory(_resampled(s, d)), 4)),
    Query("j8_cluster_kmeans", lambda s, d: J.cluster_kmeans(_table(s, d), KEYS, 2)),
    Query("j9_cluster_quantile", lambda s, d: rounded(J.cluster_quantile(_table(s, d), KEYS, -2, 0, 3))),
    Query("j13_mean_error_band", lambda s, d: rounded(J.mean_error_band(_table(s, d), ["session", "rel"], "y")),
          P0 + "SELECT session, rel, count(y) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(stddev_samp(y) / sqrt(count(y)), 6) AS sem, round(quantile_cont(y, 0.025), 6) AS low, round(quantile_cont(y, 0.975), 6) AS high FROM pt GROUP BY 1, 2"),
    Query("j15_ks_two_sample", lambda s, d: rounded(stats.ks_statistic(events(s, d).withColumn("g", F.col("session").isin("s1", "s3").cast("int")), "value", "g")),
          with_(EV) + """, x AS (SELECT value, count(*) FILTER (session NOT IN ('s1', 's3')) AS a, count(*) FILTER (session IN ('s1', 's3')) AS b FROM ev GROUP BY 1),
          c AS (SELECT sum(a) OVER (ORDER BY value) AS ca, sum(b) OVER (ORDER BY value) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM x) SELECT CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM c"""),
    Query("j16_null_threshold", lambda s, d: rounded(J.null_threshold(_shuffled(s, d), _table(s, d).groupBy("session", "rel").agg(F.avg("y").alias("mean")), "mean", 0.025, ["session", "rel"])),
          with_(EV, HC, PERI, SHUFFLED) + ", l AS (SELECT session, rel, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM sp GROUP BY 1, 2), o AS (SELECT session, rel, avg(y) AS mean FROM pt GROUP BY 1, 2) SELECT session, rel, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, mean < low OR mean > high AS outside FROM o JOIN l USING (session, rel)"),
    Query("j10_gather_sessions", lambda s, d: rounded(J.gather_sessions(_shuffled(s, d), _table(s, d).groupBy("session", "rel").agg(F.avg("y").alias("mean")), "session", ["rel"])),
          with_(EV, HC, PERI, SHUFFLED) + ", a AS (SELECT session, rel, avg(mean) AS m FROM sp GROUP BY 1, 2), g AS (SELECT rel, avg(m) AS g FROM a GROUP BY 1), o AS (SELECT session, rel, avg(y) AS mean FROM pt GROUP BY 1, 2) SELECT session, rel, round(mean, 6) AS mean, round(mean - (m - g), 6) AS aligned FROM o JOIN a USING (session, rel) JOIN g USING (rel)"),
    Query("k1_mean_latent_per_epoch", lambda s, d: rounded(K.mean_latent_per_epoch(posterior(s, d).withColumn("label", F.when(F.col("bin") % 24 < 12, "am").otherwise("pm")))),
          BASE + "SELECT CASE WHEN bin % 24 < 12 THEN 'am' ELSE 'pm' END AS label, latent, round(avg(p), 6) AS mean FROM nb GROUP BY 1, 2"),
    Query("k2_classify_latents", lambda s, d: rounded(K.classify_latents(K.mean_latent_per_epoch(posterior(s, d).withColumn("label", F.when(F.col("bin") % 24 < 12, "am").otherwise("pm"))), 0.5)),
          BASE + ", a AS (SELECT CASE WHEN bin % 24 < 12 THEN 'am' ELSE 'pm' END AS label, latent, avg(p) AS m FROM nb GROUP BY 1, 2), b AS (SELECT *, m / sum(m) OVER (PARTITION BY latent) AS score FROM a) SELECT latent, CASE WHEN score >= 0.5 THEN label ELSE 'unclassified' END AS kind, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY latent ORDER BY score DESC, label DESC) = 1"),
    Query("k3_occurrence_by_level", lambda s, d: K.occurrence_by_level(_map(s, d), "latent", "speed", [20.0, 60.0]).select("latent", "level", "n"),
          M0 + "SELECT latent, CAST(speed >= 20 AS INTEGER) + CAST(speed >= 60 AS INTEGER) AS level, count(*) AS n FROM mp GROUP BY 1, 2"),
    Query("k4_classify_spatial", lambda s, d: K.classify_spatial(_map(s, d), "latent", "speed", "away", 40.0, 70.0, 10, 20, 15),
          M0 + ", g AS (SELECT latent, count(*) AS total, CAST(count(*) FILTER (speed > 40) AS BIGINT) AS run, CAST(count(*) FILTER (speed > 40 AND away > 70) AS BIGINT) AS off FROM mp GROUP BY 1) SELECT latent, total, run, off, CASE WHEN off > 15 THEN 'off_maze' WHEN run > 20 THEN 'spatial' ELSE 'immobility' END AS kind FROM g WHERE total > 10"),
    Query("k5_dbscan_per_latent", lambda s, d: K.dbscan_per_latent(_map(s, d).withColumns({"x": F.col("speed"), "y": F.col("away")}), "latent", 5.0, 5, KEYS)),
    Query("k6_field_properties", lambda s, d: rounded(K.field_properties(_map(s, d), ["latent"], "away", F.col("bin") < 240, F.col("bin") >= 480)),
          M0 + "SELECT latent, count(*) AS n, round(avg(away), 6) AS mean, round(stddev_samp(away), 6) AS std, round(avg(away) FILTER (bin < 240), 6) AS early, round(avg(away) FILTER (bin >= 480), 6) AS late, round(avg(away) FILTER (bin >= 480) - avg(away) FILTER (bin < 240), 6) + 0.0 AS change FROM mp GROUP BY 1"),
    Query("k7_circular_stats", lambda s, d: rounded(K.circular_stats(events(s, d), "k", 0.0, 100.0, ["session", "unit"]), 4),
          with_(EV) + ", a AS (SELECT session, unit, avg(cos(k / 100 * 2 * pi())) AS c, avg(sin(k / 100 * 2 * pi())) AS s FROM ev GROUP BY 1, 2) SELECT session, unit, round((CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END) / (2 * pi()) * 100, 4) AS mean, round(sqrt(-2 * ln(least(sqrt(c * c + s * s), 1))) / (2 * pi()) * 100, 4) AS std FROM a"),
    Query("k8_latent_in_range", lambda s, d: rounded(K.latent_in_range(_map(s, d), "latent", "session", "away", 30.0, 70.0)),
          M0 + ", g AS (SELECT latent, session, CAST(count(*) FILTER (away BETWEEN 30 AND 70) AS BIGINT) AS n, avg(CASE WHEN away BETWEEN 30 AND 70 THEN 1e0 ELSE 0 END) AS frac FROM mp GROUP BY 1, 2) SELECT latent, session, n, round(frac, 6) AS frac, CASE WHEN sum(n) OVER (PARTITION BY latent) > 0 THEN round(n / sum(n) OVER (PARTITION BY latent), 6) END AS share FROM g"),
    Query("k9_sided_latents", lambda s, d: K.sided_latents(K.latent_in_range(_map(s, d).withColumn("session", F.when(F.col("session").isin("s0", "s1"), "left").otherwise("right")), "latent", "session", "away", 30.0, 70.0), "latent", 0.4, 3),
          M0 + ", g AS (SELECT latent, session IN ('s0', 's1') AS side, count(*) FILTER (away BETWEEN 30 AND 70) AS n, avg(CASE WHEN away BETWEEN 30 AND 70 THEN 1e0 ELSE 0 END) AS frac FROM mp GROUP BY 1, 2) SELECT latent, count(*) AS arms FROM g WHERE frac > 0.4 AND n > 3 GROUP BY 1"),
    Query("k10_sequence_occurrence", lambda s, d: K.sequence_occurrence(_map(s, d), "latent", [0, 2, 4], 1, KEYS),
          M0 + ", x AS (SELECT session, bin, latent AS a, lead(latent, 1) OVER w AS b, lead(latent, 2) OVER w AS c FROM mp WINDOW w AS (PARTITION BY session ORDER BY bin)) SELECT session, bin FROM x WHERE abs(a) <= 1 AND abs(b - 2) <= 1 AND abs(c - 4) <= 1"),
    Query("k11_latent_pairs", lambda s, d: K.latent_pairs(_map(s, d), "latent", [(0, 4), (2, 2)], 0, KEYS),
          M0 + ", x AS (SELECT session, bin, latent AS y, lag(latent) OVER (PARTITION BY session ORDER BY bin) AS z FROM mp) SELECT session, CAST(z AS INTEGER) AS a, CAST(y AS INTEGER) AS b, bin FROM x WHERE (z = 0 AND y = 4) OR (z = 2 AND y = 2)"),
    Query("k13_contrast_projection", lambda s, d: rounded(K.contrast_projection(hourly_counts(s, d), hourly_tuning(hourly_counts(s, d)), 0, 4, 1, KEYS)),
          BASE + ", ax AS (SELECT unit, avg(rate) FILTER (abs(latent - 4) <= 1) - avg(rate) FILTER (abs(latent) <= 1) AS a FROM tun GROUP BY 1), un AS (SELECT unit, a / sqrt(sum(a * a) OVER ()) AS a FROM ax) SELECT session, bin, round(sum(n * a), 6) + 0.0 AS projection FROM hc JOIN un USING (unit) GROUP BY 1, 2"),
    Query("k16_jump_consensus", lambda s, d: rounded(K.jump_consensus(_chains(s, d), 0, 3, 0.4, 0.6)),
          with_(EV, HC, CHAINS) + ", jp AS (SELECT bin FROM ch WHERE chain = 0 AND p >= 0.4), hit AS (SELECT jp.bin, count(DISTINCT ch.chain) AS k FROM jp LEFT JOIN ch ON ch.chain <> 0 AND ch.p > 0.4 AND ch.bin >= jp.bin - 3 AND ch.bin < jp.bin + 3 GROUP BY 1) SELECT bin, round(k / 3, 6) AS agreeing, k / 3 >= 0.6 AS consensus FROM hit"),
    Query("k17_jump_consensus_shuffle", lambda s, d: rounded(K.jump_consensus_shuffle(_chains(s, d), 0, 3, 0.4, 0.6, 4)),
          with_(EV, HC, CHAINS) + """, jp AS (SELECT bin FROM ch WHERE chain = 0 AND p >= 0.4), rl AS (SELECT s.shuffle, chain, (bin + """ + HASH.format("s.shuffle || '|' || chain") + """ % 720) % 720 AS at_ FROM ch, range(1, 5) s(shuffle) WHERE chain <> 0 AND p > 0.4),
          fr AS (SELECT CAST(s.shuffle AS INTEGER) AS shuffle, jp.bin, (SELECT count(DISTINCT chain) FROM rl WHERE rl.shuffle = s.shuffle AND rl.at_ BETWEEN jp.bin - 3 AND jp.bin + 3) AS k FROM jp, range(1, 5) s(shuffle)) SELECT shuffle, round(avg(CASE WHEN k / 3 >= 0.6 THEN 1e0 ELSE 0 END), 6) AS fraction FROM fr GROUP BY 1"""),
    Query("o3_event_triggered", lambda s, d: rounded(_triggered(s, d))),
]
