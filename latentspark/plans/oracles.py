"""SQL of queries whose statement is long: hidden Markov recursions as recursive queries, ramps, epochs, permutation tests, regressions."""

from __future__ import annotations

from .binding import EV, HASH, HC, LL, NB, SIG, TUN
from .queries_decode import DIST, LABELS, TARGET
from .queries_more import POS
from .queries_stats import CHAINS, MAP, PERI


def with_all(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n     ".join(parts) + "\n"


BASE = [EV, HC, TUN, LL]

# ---- hidden Markov recursions: g is the group, t the time bin, s the state dyn * 6 + latent --------------------------------

MOVE = "SELECT {e} AS e, a.i AS i, b.i AS j, exp(-pow(a.i - b.i, 2) / {v}) / sum(exp(-pow(a.i - b.i, 2) / {v})) OVER (PARTITION BY a.i) AS p FROM range(6) a(i), range(6) b(i)"
UNIFORM = "SELECT {e}, a.i, b.i, 1e0 / 6 FROM range(6) a(i), range(6) b(i)"
ISOLATED = """SELECT {e}, i, j, CASE WHEN i > 0 AND j > 0 THEN 0.99e0 * w / sum(w) OVER (PARTITION BY i) WHEN i = 0 AND j = 0 THEN 0.99e0 WHEN i = 0 THEN 0.01e0 / 5 ELSE 0.01e0 END AS p
              FROM (SELECT a.i AS i, b.i AS j, CASE WHEN a.i > 0 AND b.i > 0 THEN exp(-0.5 * pow((a.i - b.i) / 1.5, 2)) ELSE 0e0 END AS w FROM range(6) a(i), range(6) b(i))"""
TWO = "sw(d, e, w) AS (VALUES (0, 0, 0.98e0), (0, 1, 0.02e0), (1, 0, 0.02e0), (1, 1, 0.98e0))"
ONE = "sw(d, e, w) AS (VALUES (0, 0, 1e0))"
SESSIONS = "lt AS (SELECT session AS g, bin AS t, latent, ll, max(ll) OVER (PARTITION BY session, bin) AS top FROM ll)"
DAYS = "lt AS (SELECT session || '/' || (bin // 24) AS g, bin % 24 AS t, latent, ll, max(ll) OVER (PARTITION BY session, bin) AS top FROM ll)"
#: session and event of a group of DAYS
DAY = "split_part(g, '/', 1) AS session, CAST(split_part(g, '/', 2) AS INTEGER) AS event"


def _forward(n: str, groups: str, kernels: list[str], switch: str) -> list[str]:
    """CTEs kn, sw, tr, lt, fw of one model; n keeps names of several models apart."""
    parts = [f"kn{n} AS (" + " UNION ALL ".join(k.format(e=e, v="4e0") for e, k in enumerate(kernels)) + ")", switch.replace("sw(", f"sw{n}("),
             f"tr{n} AS (SELECT d * 6 + i AS s, e * 6 + j AS s2, w * p AS p FROM sw{n} JOIN kn{n} USING (e))", f"st{n} AS (SELECT DISTINCT s FROM tr{n})"]
    if n in ("", "a"):
        parts.append(groups)
    return [*parts, f"""fr{n} AS (SELECT g, CAST(-1 AS BIGINT) AS t, s, 1e0 / (SELECT count(*) FROM st{n}) AS a, 0e0 AS step FROM (SELECT DISTINCT g FROM lt), st{n}
          UNION ALL SELECT g, t, s, x / sum(x) OVER (PARTITION BY g), ln(sum(x) OVER (PARTITION BY g)) + top FROM (
          SELECT f.g, lt.t, tr.s2 AS s, any_value(top) AS top, sum(f.a * tr.p) * exp(any_value(ll) - any_value(top)) AS x FROM fr{n} f JOIN tr{n} tr ON tr.s = f.s JOIN lt ON lt.g = f.g AND lt.t = f.t + 1 AND lt.latent = tr.s2 % 6 GROUP BY f.g, lt.t, tr.s2))""",
            f"fw{n} AS MATERIALIZED (SELECT * FROM fr{n} WHERE t >= 0)"]


BACKWARD = [
    "pr AS MATERIALIZED (SELECT fw.g, fw.t + 1 AS t, tr.s2 AS s, sum(a * p) AS q FROM fw JOIN tr ON tr.s = fw.s GROUP BY 1, 2, 3)",
    "ls AS (SELECT g, max(t) AS t FROM lt GROUP BY 1)",
    """br AS (SELECT fw.g, fw.t, fw.s, fw.a AS b FROM fw JOIN ls USING (g, t)
          UNION ALL SELECT g, t, s, x / sum(x) OVER (PARTITION BY g) FROM (SELECT c.g, c.t, c.s, any_value(c.a) * sum(tr.p * br.b / pr.q) AS x
          FROM br JOIN pr ON pr.g = br.g AND pr.t = br.t AND pr.s = br.s JOIN tr ON tr.s2 = br.s JOIN fw c ON c.g = br.g AND c.t = br.t - 1 AND c.s = tr.s GROUP BY c.g, c.t, c.s))""",
    "bw AS MATERIALIZED (SELECT * FROM br)",
]


def smoothed(groups: str, kernels: list[str], switch: str, last: str) -> str:
    return with_all(*BASE, *_forward("", groups, kernels, switch), *BACKWARD) + last


def filtered(groups: str, kernels: list[str], switch: str, last: str) -> str:
    return with_all(*BASE, *_forward("", groups, kernels, switch)) + last


BY_LATENT = "SELECT session, bin, CAST(latent AS INTEGER) AS latent, round(sum(b), 6) AS p, round(any_value(step), 5) AS step FROM (SELECT g AS session, t AS bin, s % 6 AS latent, b, step FROM bw JOIN fw USING (g, t, s)) GROUP BY 1, 2, 3"
JOINT = "pj AS (SELECT f.s AS s, tr.s2 AS s2, sum(f.a * tr.p * bw.b / pr.q) AS w FROM fw f JOIN tr ON tr.s = f.s JOIN bw ON bw.g = f.g AND bw.t = f.t + 1 AND bw.s = tr.s2 JOIN pr ON pr.g = bw.g AND pr.t = bw.t AND pr.s = bw.s GROUP BY 1, 2)"


def joint(i: str, j: str) -> str:
    return with_all(*BASE, *_forward("", DAYS, [MOVE, UNIFORM], TWO), *BACKWARD, JOINT, f"g AS (SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, sum(w) AS w FROM pj GROUP BY 1, 2)") + "SELECT i, j, round(w / sum(w) OVER (), 6) AS joint, round(w / sum(w) OVER (PARTITION BY i), 6) AS conditional FROM g"


COMPARE = with_all(*BASE, *_forward("a", DAYS, [MOVE, UNIFORM], TWO), *_forward("b", DAYS, [MOVE], ONE),
                   "lm AS (SELECT g, 'both' AS kernel, sum(step) AS m FROM (SELECT DISTINCT g, t, step FROM fwa) GROUP BY 1 UNION ALL SELECT g, 'move', sum(step) FROM (SELECT DISTINCT g, t, step FROM fwb) GROUP BY 1)") + f"SELECT {DAY}, kernel, round(m, 5) AS log_marginal, round(exp(m - max(m) OVER (PARTITION BY g)) / sum(exp(m - mx)) OVER (PARTITION BY g), 6) AS probability FROM (SELECT *, max(m) OVER (PARTITION BY g) AS mx FROM lm)"

MULTI = with_all(*BASE, *_forward("", DAYS, [MOVE.replace("{v}", "1e0"), ISOLATED, UNIFORM], "sw(d, e, w) AS (SELECT d.d, e.d, CASE WHEN d.d = e.d THEN 0.9e0 ELSE (1 - 0.9e0) / 2 END FROM range(3) d(d), range(3) e(d))"), *BACKWARD) + f"SELECT {DAY}, CAST(dyn AS INTEGER) AS dyn, round(avg(p), 6) AS mean FROM (SELECT g, t, s // 6 AS dyn, sum(b) AS p FROM bw GROUP BY 1, 2, 3) GROUP BY g, dyn"

# ---- signals and behaviour -----------------------------------------------------------------------------------------------

#: the ramps of a regular series x (session, bin, value): slope over 3 rows of the z-score, smoothed with deviation 1
RAMP = """zx AS (SELECT session, bin, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, row_number() OVER (PARTITION BY session ORDER BY bin) AS r FROM {x} WINDOW w AS (PARTITION BY session)),
      sl AS (SELECT session, bin, r, (coalesce(lead(z, 3) OVER o, last_value(z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - z) / 3 AS d FROM zx WINDOW o AS (PARTITION BY session ORDER BY bin)),
      rs AS (SELECT a.session, a.bin, sum(b.d * exp(-0.5 * pow(b.r - a.r, 2))) / sum(exp(-0.5 * pow(b.r - a.r, 2))) AS slope FROM sl a JOIN sl b ON a.session = b.session AND b.r BETWEEN a.r - 4 AND a.r + 4 GROUP BY 1, 2),
      rp0 AS (SELECT session, bin, slope, lag(slope) OVER o AS l, lead(slope) OVER o AS n FROM rs WINDOW o AS (PARTITION BY session ORDER BY bin)),
      ramps AS (SELECT session, bin FROM rp0 WHERE slope > l AND slope >= n AND slope >= 0.05)"""


def _slope(out: str, source: str, columns: dict[str, str]) -> str:
    """Central differences over t, one-sided at the ends, of columns (name: of)."""
    one = lambda of: f"(coalesce(lead({of}) OVER o, {of}) - coalesce(lag({of}) OVER o, {of})) / nullif(coalesce(lead(t) OVER o, t) - coalesce(lag(t) OVER o, t), 0)"
    return f"{out} AS (SELECT *, " + ", ".join(f"{one(of)} AS {n}" for n, of in columns.items()) + f" FROM {source} WINDOW o AS (PARTITION BY session ORDER BY t))"


OMEGA = ",\n      ".join([_slope("v1", "ps", {"vx": "x", "vy": "y"}), _slope("v2", "v1", {"ax": "vx", "ay": "vy"}), "om AS (SELECT session, t, x, y, vx, CASE WHEN vx * vx + vy * vy > 1e-12 THEN (vx * ay - vy * ax) / (vx * vx + vy * vy) END AS omega FROM v2)"])


def runs(out: str, source: str, test: str, aggregates: str = "count(*) AS n", order: str = "t") -> str:
    return f"""{out}0 AS (SELECT *, coalesce({test}, false) AS ins, coalesce({test}, false) AND NOT coalesce(lag({test}) OVER (PARTITION BY session ORDER BY {order}), false) AS b FROM {source}),
      {out}1 AS (SELECT *, sum(b::INT) OVER (PARTITION BY session ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM {out}0),
      {out} AS (SELECT session, run, min(t) AS s, max(t) AS e, {aggregates} FROM {out}1 WHERE ins GROUP BY 1, 2)"""


OFFTRACK = ",\n      ".join([
    "oa AS (SELECT om.*, away FROM om JOIN aw USING (session, t))",
    runs("ot", "oa", "away > 20", "max(away) AS peak, max(abs(omega)) AS turn, arg_min(x, t) AS xa, arg_min(y, t) AS ya, arg_max(x, t) AS xb, arg_max(y, t) AS yb"),
    "og AS (SELECT session, s, e, peak > 30 AS far, coalesce(turn > 0.5, false) AS turned, sqrt(pow(xa - xb, 2) + pow(ya - yb, 2)) <= 60 AS returned FROM ot)",
])


def difference(out: str, a: str, b: str) -> str:
    """a less b, both (session, s, e), by their edges; spans of no length are dropped."""
    return f"""{out}c AS (SELECT session, s AS x FROM {a} UNION SELECT session, e FROM {a} UNION SELECT session, s FROM {b} UNION SELECT session, e FROM {b}),
      {out}p AS (SELECT session, x, lead(x) OVER (PARTITION BY session ORDER BY x) AS nx FROM {out}c),
      {out}f AS (SELECT p.*, EXISTS (SELECT 1 FROM {a} i WHERE i.session = p.session AND i.s <= x AND i.e > x) AND NOT EXISTS (SELECT 1 FROM {b} i WHERE i.session = p.session AND i.s <= x AND i.e > x) AS keep FROM {out}p p WHERE nx IS NOT NULL),
      {out}g AS (SELECT *, sum((keep AND NOT coalesce(k0, false))::INT) OVER (PARTITION BY session ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(keep) OVER (PARTITION BY session ORDER BY x) AS k0 FROM {out}f)),
      {out} AS (SELECT session, min(x) AS s, max(nx) AS e FROM {out}g WHERE keep GROUP BY session, g)"""


EPOCHS = ",\n      ".join([
    "sx AS (SELECT session, t, abs(vx) AS speed FROM om)", runs("rest", "sx", "speed < 5"), runs("move", "sx", "speed > 20"),
    "off AS (SELECT session, s, e FROM og WHERE far AND turned AND returned)", difference("loco", "move", "off"),
])

JUMPS = ",\n      ".join([
    "cs0 AS (SELECT session, CAST(bin AS DOUBLE) AS t, p FROM (SELECT session, bin, sum(n) FILTER (unit = 'view') / greatest(sum(n), 1) AS p FROM hc GROUP BY 1, 2))",
    runs("jr", "cs0", "p > 0.5"),
    "jm0 AS (SELECT *, max(e) OVER (PARTITION BY session ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM jr)",
    "jm1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM jm0)",
    "jm AS (SELECT session, min(s) AS s, max(e) AS e FROM jm1 GROUP BY session, g)", "span AS (SELECT session, min(t) AS s, max(t) AS e FROM cs0 GROUP BY 1)", difference("calm", "span", "jm"),
])

# ---- permutations --------------------------------------------------------------------------------------------------------

LABEL_SHUFFLES = """ls0 AS (SELECT session, bin, label, s.shuffle, row_number() OVER (PARTITION BY session, s.shuffle ORDER BY bin) AS r, row_number() OVER (PARTITION BY session, s.shuffle ORDER BY """ + HASH.format("s.shuffle || '|' || bin") + """, bin) AS d FROM lb, range(1, 201) s(shuffle)),
      ls1 AS (SELECT a.session, a.shuffle, a.bin, b.label FROM ls0 a JOIN ls0 b ON a.session = b.session AND a.shuffle = b.shuffle AND a.r = b.d UNION ALL SELECT session, 0, bin, label FROM lb),
      st0 AS (SELECT session, shuffle, lag(label) OVER (PARTITION BY session, shuffle ORDER BY bin) AS i, label AS j FROM ls1),
      nm AS (SELECT DISTINCT session, shuffle, label FROM ls1),
      tc AS (SELECT a.session, a.shuffle, a.label AS i, b.label AS j, count(st0.i) * 1e0 AS c FROM nm a JOIN nm b USING (session, shuffle) LEFT JOIN st0 ON st0.session = a.session AND st0.shuffle = a.shuffle AND st0.i = a.label AND st0.j = b.label GROUP BY 1, 2, 3, 4),
      tp AS (SELECT *, CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 0 END AS p FROM tc WINDOW w AS (PARTITION BY session, shuffle, i))"""

VECTORS = "v AS (SELECT vec_id // 100 AS series, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS i, CAST(embedding AS DOUBLE[64]) AS x, CAST(label AS DOUBLE) AS label FROM embeddings)"
LABEL_TEST = """dd AS (SELECT a.series, a.i, b.i AS j, array_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.series = b.series AND a.i < b.i),
      pm AS (SELECT series, s.shuffle, label, CASE WHEN s.shuffle = 0 THEN i ELSE row_number() OVER (PARTITION BY series, s.shuffle ORDER BY """ + HASH.format("s.shuffle || '|' || series || '|' || i") + """, i) END AS r FROM v, range(51) s(shuffle)),
      sp AS (SELECT dd.series, a.shuffle, regr_slope(d, abs(a.label - b.label)) AS slope FROM dd JOIN pm a ON a.series = dd.series AND a.r = dd.i JOIN pm b ON b.series = dd.series AND b.r = dd.j AND b.shuffle = a.shuffle GROUP BY 1, 2)"""

TRAJECTORIES = """v AS (SELECT vec_id // 100 AS traj, vec_id % 100 AS step, CAST(f - 1 AS INTEGER) AS feature, CAST(embedding[f] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(f)),
      ln0 AS (SELECT traj, min(step) AS lo, max(step) - min(step) AS n FROM v GROUP BY 1),
      tg AS (SELECT DISTINCT traj, feature, CAST(p AS INTEGER) AS point, lo, p / 5e0 * n AS at_ FROM v JOIN ln0 USING (traj), range(6) q(p)),
      rz AS (SELECT tg.traj, tg.feature, tg.point, a.value + (coalesce(b.value, a.value) - a.value) * (at_ - floor(at_ + 1e-9)) AS value FROM tg JOIN v a ON a.traj = tg.traj AND a.feature = tg.feature AND a.step = lo + floor(at_ + 1e-9) LEFT JOIN v b ON b.traj = tg.traj AND b.feature = tg.feature AND b.step = lo + floor(at_ + 1e-9) + 1)"""

INTERACTION = """sd AS (SELECT session, event_bin, y, CAST(rel > 0 AS INTEGER) AS post, (rel - avg(rel) OVER w) / stddev_pop(rel) OVER w AS tz FROM pt WHERE rel <> 0 WINDOW w AS (PARTITION BY rel > 0)),
      ft AS (SELECT post, count(*) AS n, avg(y) AS a, regr_slope(y, tz) AS b FROM sd GROUP BY 1),
      sc AS (SELECT session, event_bin, {s} FROM sd JOIN ft USING (post) GROUP BY 1, 2),
      fx AS (SELECT max(a) FILTER (post = 0) AS a0, max(b) FILTER (post = 0) AS b0, max(a) FILTER (post = 1) AS a1, max(b) FILTER (post = 1) AS b1, max(n) FILTER (post = 0) AS n0, max(n) FILTER (post = 1) AS n1 FROM ft),
      vv AS (SELECT any_value(a0) AS a0, any_value(b0) AS b0, any_value(a1) AS a1, any_value(b1) AS b1, (count(*) / (count(*) - 1e0)) * ((any_value(n0) + any_value(n1) - 1e0) / (any_value(n0) + any_value(n1) - 4e0)) AS k,
             sum(pow(u0 / n0, 2)) AS v0, sum(pow(w0 / n0, 2)) AS v1, sum(pow(u1 / n1 - u0 / n0, 2)) AS v2, sum(pow(w1 / n1 - w0 / n0, 2)) AS v3 FROM sc, fx),
      ou(term, coef, se) AS (SELECT 'intercept', a0, sqrt(k * v0) FROM vv UNION ALL SELECT 'tz', b0, sqrt(k * v1) FROM vv UNION ALL SELECT 'post', a1 - a0, sqrt(k * v2) FROM vv UNION ALL SELECT 'txp', b1 - b0, sqrt(k * v3) FROM vv)""".replace(
    "{s}", ", ".join(f"coalesce(sum((y - a - b * tz){' * tz' if c == 'w' else ''}) FILTER (post = {k}), 0) AS {c}{k}" for k in (0, 1) for c in "uw"))

PP = "pp AS (SELECT session, event_bin, avg(y) FILTER (rel < 0 AND rel > -4) AS pre, avg(y) FILTER (rel > 0 AND rel < 4) AS post FROM pt GROUP BY 1, 2)"
WILCOXON = """df AS (SELECT session, post - pre AS diff FROM pp), rk AS (SELECT session, diff, rank() OVER (PARTITION BY session ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY session, abs(diff)) - 1) / 2 AS r FROM df WHERE diff <> 0),
      wx AS (SELECT session, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus FROM rk GROUP BY 1), sz AS (SELECT session, quantile_cont(diff, 0.5) AS median, avg(diff) / stddev_samp(diff) AS effect FROM df GROUP BY 1)"""
TEST_ROWS = "SELECT session, n, round(w_plus, 6) AS w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z, round(median, 6) AS median, round(effect, 6) AS effect FROM wx JOIN sz USING (session)"

#: log marginals of each day's events: observed, with units permuted, with units rolled, each by hashed draws
DAY_COUNTS = "dc AS (SELECT session, CAST(bin // 24 AS INTEGER) AS event, bin % 24 AS bin, unit, n FROM hc)"


def day_nulls(shuffles: int, gains: str) -> str:
    key = "s.shuffle || '|' || session || '|' || event || '|' || unit"
    return f"""un AS (SELECT DISTINCT session, event, unit, s.shuffle FROM dc, range(1, {shuffles + 1}) s(shuffle)),
      ua AS (SELECT *, row_number() OVER (PARTITION BY session, event, shuffle ORDER BY unit) AS r, row_number() OVER (PARTITION BY session, event, shuffle ORDER BY {HASH.format(key.replace('s.shuffle', 'shuffle'))}, unit) AS d FROM un),
      us AS (SELECT 'unit' AS kind, b.shuffle, dc.session, dc.event, dc.bin, b.unit, dc.n FROM dc JOIN ua a USING (session, event, unit) JOIN ua b ON b.session = a.session AND b.event = a.event AND b.shuffle = a.shuffle AND b.d = a.r),
      rc AS (SELECT 'circular', s.shuffle, session, event, (bin + {HASH.format(key)} % 24) % 24, unit, n FROM dc, range(1, {shuffles + 1}) s(shuffle)),
      al AS (SELECT * FROM us UNION ALL SELECT * FROM rc UNION ALL SELECT 'observed', 0, session, event, bin, unit, n FROM dc),
      tm AS (SELECT gain, latent, unit, ln(rate * gain + 1e-20) AS lm FROM tun, (VALUES {gains}) g(gain)), tb AS (SELECT gain, latent, sum(rate * gain + 1e-20) AS total FROM tun, (VALUES {gains}) g(gain) GROUP BY 1, 2),
      sx AS (SELECT kind, shuffle, session, event, bin, gain, latent, sum(n * lm) - sum(lgamma(n + 1)) AS x FROM al JOIN tm USING (unit) GROUP BY ALL),
      lb0 AS (SELECT kind, shuffle, session, event, bin, gain, x - total AS ll, max(x - total) OVER (PARTITION BY kind, shuffle, session, event, bin, gain) AS top FROM sx JOIN tb USING (gain, latent)),
      lm0 AS (SELECT kind, shuffle, session, event, bin, gain, any_value(top) + ln(sum(exp(ll - top))) AS lm FROM lb0 GROUP BY ALL),
      em AS MATERIALIZED (SELECT kind, shuffle, session, event, gain, round(sum(lm), 9) AS m FROM lm0 GROUP BY ALL),
      li AS (SELECT session, event, gain, max(m) FILTER (kind = 'observed') AS observed, quantile_cont(m, 0.95) FILTER (kind = 'unit') AS unit_limit, quantile_cont(m, 0.95) FILTER (kind = 'circular') AS circular_limit FROM em GROUP BY 1, 2, 3)"""


GAINS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]

#: Days with more events than a session's median day; bins of a series follow each other whatever lies between.
GAPS = """dy AS (SELECT session, bin // 24 AS day, sum(n) AS total FROM hc GROUP BY 1, 2), md AS (SELECT session, quantile_cont(total, 0.5) AS median FROM dy GROUP BY 1),
      bd AS (SELECT session, day FROM dy JOIN md USING (session) WHERE total > median),
      lt AS (SELECT ll.session AS g, dense_rank() OVER (PARTITION BY ll.session ORDER BY bin) - 1 AS t, bin, latent, ll, max(ll) OVER (PARTITION BY ll.session, bin) AS top FROM ll JOIN bd ON bd.session = ll.session AND bd.day = ll.bin // 24)"""
GRID = """SELECT {e} AS e, a.i AS i, b.i AS j, exp(-pow(a.i // 3 - b.i // 3, 2)) * exp(-pow(a.i % 3 - b.i % 3, 2) / 4) / sum(exp(-pow(a.i // 3 - b.i // 3, 2)) * exp(-pow(a.i % 3 - b.i % 3, 2) / 4)) OVER (PARTITION BY a.i) AS p FROM range(6) a(i), range(6) b(i)"""
#: Latents that don't count have no row, so no probability; the start is uniform over those that do.
MASKED = SESSIONS.replace("FROM ll)", "FROM ll WHERE latent IN (0, 2, 3, 5))")

SQL = {
    "f13_decode_in_chunks_with_gaps": smoothed(GAPS, [MOVE, UNIFORM], TWO, "SELECT session, bin, CAST(latent AS INTEGER) AS latent, round(sum(b), 6) AS p, round(any_value(step), 5) AS step FROM (SELECT bw.g AS session, bi.bin, bw.s % 6 AS latent, b, step FROM bw JOIN fw USING (g, t, s) JOIN (SELECT DISTINCT g, t, bin FROM lt) bi USING (g, t)) GROUP BY 1, 2, 3"),
    "f1_masked_latents": smoothed(MASKED, [MOVE, UNIFORM], TWO, "SELECT f.g AS session, f.t AS bin, CAST(l AS INTEGER) AS latent, round(coalesce(sum(b), 0), 6) AS p, round(any_value(step), 5) AS step FROM (SELECT DISTINCT g, t, step FROM fw) f CROSS JOIN range(6) r(l) LEFT JOIN bw ON bw.g = f.g AND bw.t = f.t AND bw.s % 6 = l GROUP BY 1, 2, 3").replace("st AS (SELECT DISTINCT s FROM tr)", "st AS (SELECT DISTINCT s FROM tr WHERE s % 6 IN (0, 2, 3, 5))"),
    "f7_decode_grid": smoothed(SESSIONS, [GRID, UNIFORM], TWO, BY_LATENT),
    "f11_forward_backward": smoothed(SESSIONS, [MOVE, UNIFORM], TWO, BY_LATENT),
    "f12_forward_backward_latent": smoothed(SESSIONS, [MOVE], ONE, BY_LATENT),
    "f13_decode_events": smoothed(DAYS, [MOVE, UNIFORM], TWO, f"SELECT {DAY}, t AS bin, CAST(s % 6 AS INTEGER) AS latent, round(sum(b), 6) AS p, round(sum(a), 6) AS causal, round(any_value(step), 5) AS step FROM bw JOIN fw USING (g, t, s) GROUP BY g, t, s % 6"),
    "f13_decode_in_chunks": smoothed(SESSIONS, [MOVE, UNIFORM], TWO, BY_LATENT),
    "f14_posterior_transitions": joint("s % 6", "s2 % 6"),
    "f14_dynamics_transitions": joint("s // 6", "s2 // 6"),
    "f14_full_transitions": joint("s", "s2"),
    "f15_decode_compare_kernels": COMPARE,
    "f16_decode_multi_kernel": MULTI,
    "d6_ramp_onsets": with_all(EV, SIG, RAMP.format(x="sig")) + "SELECT session, bin FROM ramps",
    "d8_angular_velocity": with_all(EV, POS, OMEGA) + "SELECT session, t, round(omega, 6) + 0.0 AS omega FROM om",
    "d11_offtrack_candidates": with_all(EV, POS, OMEGA, OFFTRACK) + 'SELECT session, s AS start, e AS "end", far, returned, far AND turned AND returned AS offtrack FROM og',
    "d12_behaviour_epochs": with_all(EV, POS, OMEGA, OFFTRACK, EPOCHS) + """SELECT session, 'immobility' AS name, s AS start, e AS "end" FROM rest UNION ALL SELECT session, 'locomotion', s, e FROM loco UNION ALL SELECT session, 'offtrack', s, e FROM off""",
    "h4_transition_shuffle_test": with_all(EV, HC, LABELS, LABEL_SHUFFLES) + "SELECT a.session, a.i, a.j, round(any_value(a.p), 6) AS p, round(quantile_cont(b.p, 0.99), 6) AS \"limit\", any_value(a.p) > quantile_cont(b.p, 0.99) AS significant FROM tp a JOIN tp b ON a.shuffle = 0 AND b.shuffle > 0 AND a.session = b.session AND a.i = b.i AND a.j = b.j GROUP BY 1, 2, 3",
    "h9_match_step": with_all(EV, HC, TUN, DIST, TARGET, """ps AS (SELECT i, j, d, p AS w FROM ds JOIN tg USING (i, j) WHERE i <> j), pc AS (SELECT d, sum(sum(w)) OVER (ORDER BY d) AS c, sum(sum(w)) OVER () AS t FROM ps GROUP BY d),
      lim AS (SELECT min(d) AS l FROM pc WHERE c >= 0.9 * t), sn AS (SELECT sum(w * d) / sum(w) AS seen FROM ps, lim WHERE d <= l), rw AS (SELECT i, sum(w) AS rw FROM ps GROUP BY 1),
      md AS (SELECT beta, i, sum(exp(-beta * d) * d) / sum(exp(-beta * d)) AS step FROM ds, lim, (VALUES (1e0), (2e0), (4e0), (8e0)) b(beta) WHERE i <> j AND d <= l GROUP BY 1, 2)""") + "SELECT beta, round(pow(sum(rw * step) / sum(rw) - any_value(seen), 2), 8) AS loss FROM md JOIN rw USING (i), sn GROUP BY 1",
    "i8_distance_label_bin_null": with_all(VECTORS, LABEL_TEST, """bx AS (SELECT dd.series, a.shuffle, CASE WHEN abs(a.label - b.label) < 1 THEN 0 WHEN abs(a.label - b.label) < 3 THEN 1 WHEN abs(a.label - b.label) < 6 THEN 2 ELSE 3 END AS bin, count(*) AS n, avg(d) AS mean FROM dd JOIN pm a ON a.series = dd.series AND a.r = dd.i JOIN pm b ON b.series = dd.series AND b.r = dd.j AND b.shuffle = a.shuffle GROUP BY 1, 2, 3),
      nl AS (SELECT series, bin, avg(mean) AS null_mean, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM bx WHERE shuffle > 0 GROUP BY 1, 2)""") + "SELECT series, bin, n, round(mean, 5) AS mean, round(null_mean, 5) AS null_mean, round(low, 5) AS low, round(high, 5) AS high FROM bx LEFT JOIN nl USING (series, bin) WHERE shuffle = 0",
    "i9_mean_trajectory": with_all(TRAJECTORIES) + "SELECT feature, point, round(avg(value), 4) + 0.0 AS mean, round(stddev_pop(value), 4) AS std FROM rz GROUP BY 1, 2",
    "f6_split_posterior": smoothed(SESSIONS, [MOVE, UNIFORM], TWO, "SELECT g AS session, t AS bin, CAST(l AS BIGINT) AS flat_idx, round(sum(b), 6) AS p, CASE WHEN l < 2 THEN 'arm' ELSE 'field' END AS maze, CASE WHEN l < 2 THEN l + 0.5e0 ELSE (l - 2) // 2 * 2 + 1e0 END AS x, CASE WHEN l >= 2 THEN (l - 2) % 2 * 3 + 1.5e0 END AS y FROM (SELECT g, t, s % 6 AS l, b FROM bw) GROUP BY g, t, l"),
    "i8_distance_label_shuffle_test": with_all(VECTORS, LABEL_TEST) + "SELECT a.series, round(any_value(a.slope), 6) AS slope, round((1 + count(*) FILTER (abs(b.slope) >= abs(a.slope))) / (count(*) + 1), 6) AS p FROM sp a JOIN sp b ON a.series = b.series AND a.shuffle = 0 AND b.shuffle > 0 GROUP BY 1",
    "i9_resample_trajectories": with_all(TRAJECTORIES) + "SELECT traj, feature, point, round(value, 5) + 0.0 AS value FROM rz",
    "i10_mean_distance_matrix": with_all(TRAJECTORIES) + "SELECT p, q, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std FROM (SELECT a.traj, a.point AS p, b.point AS q, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM rz a JOIN rz b ON a.traj = b.traj AND a.feature = b.feature AND a.point <= b.point GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "j6_pre_post_interaction": with_all(EV, HC, PERI, INTERACTION) + "SELECT term, round(coef, 6) + 0.0 AS coef, round(se, 6) AS se, round(coef / se, 4) AS z FROM ou",
    "j9_cluster_quantile": with_all(EV, HC, PERI, "mq AS (SELECT session, event_bin, avg(y) AS m FROM pt WHERE rel BETWEEN -2 AND 0 GROUP BY 1, 2)", "eq AS (SELECT quantile_cont(m, 1 / 3e0) AS a, quantile_cont(m, 2 / 3e0) AS b FROM mq)") + "SELECT session, event_bin, round(m, 6) AS m, CASE WHEN m <= a THEN 0 WHEN m <= b THEN 1 ELSE 2 END AS cluster FROM mq, eq",
    "k12_segment_by_jump": with_all(EV, HC, MAP, JUMPS) + 'SELECT calm.session, s AS start, e AS "end", quantile_cont(latent, 0.5) AS median FROM calm JOIN mp ON mp.session = calm.session AND mp.bin BETWEEN s AND e GROUP BY 1, 2, 3',
    "k14_jump_triggered": with_all(EV, HC, MAP, PERI, "kj AS (SELECT session, bin AS event_bin FROM (SELECT session, bin, latent, lag(latent) OVER (PARTITION BY session ORDER BY bin) AS b FROM mp) WHERE b = 0 AND latent = 4 AND bin BETWEEN 2 AND 717)") + "SELECT kj.session, event_bin, CAST(rel AS INTEGER) AS rel, round(value, 6) AS y FROM kj CROSS JOIN range(-2, 3) r(rel) JOIN ds ON ds.session = kj.session AND ds.bin = event_bin + rel",
    "l3_pre_post_circular_null": with_all(EV, HC, TUN, "cs AS (SELECT session, s.shuffle, unit, n, (bin + " + HASH.format("s.shuffle || '|' || session || '|' || unit") + " % 720) % 720 AS bin FROM hc, range(1, 21) s(shuffle))",
        "l3 AS (SELECT session, shuffle, bin, latent, sum(n * ln(rate + 1e-20) - rate - 1e-20 - lgamma(n + 1)) AS ll FROM cs JOIN tun USING (unit) GROUP BY 1, 2, 3, 4)", "p3 AS (SELECT session, shuffle, bin, latent, exp(ll - mx) / sum(exp(ll - mx)) OVER (PARTITION BY session, shuffle, bin) AS p FROM (SELECT *, max(ll) OVER (PARTITION BY session, shuffle, bin) AS mx FROM l3))") + "SELECT session, CAST(shuffle AS INTEGER) AS shuffle, latent, round(avg(p) FILTER (bin >= 360) - avg(p) FILTER (bin < 360), 6) + 0.0 AS diff FROM p3 GROUP BY 1, 2, 3",
    "l4_relabel_pre_post": with_all(EV, SIG, "rl AS (SELECT session, bin, value, s.shuffle, count(*) FILTER (bin < 360) OVER (PARTITION BY session, s.shuffle) AS np, row_number() OVER (PARTITION BY session, s.shuffle ORDER BY " + HASH.format("s.shuffle || '|' || session || '|' || bin") + ", bin) AS r FROM sig, range(6) s(shuffle))") + "SELECT session, CAST(shuffle AS INTEGER) AS shuffle, round(avg(value) FILTER (NOT pre) - avg(value) FILTER (pre), 6) AS diff FROM (SELECT *, CASE WHEN shuffle = 0 THEN bin < 360 ELSE r <= np END AS pre FROM rl) GROUP BY 1, 2",
    "m2_circular_shuffle_in_event": with_all(EV, HC, DAY_COUNTS) + "SELECT session, event, CAST(s.shuffle AS INTEGER) AS shuffle, (bin + " + HASH.format("s.shuffle || '|' || session || '|' || event || '|' || unit") + " % 24) % 24 AS bin, unit, n FROM dc, range(1, 3) s(shuffle) WHERE n > 0",
    "m3_shuffle_test_marginal": with_all(EV, HC, TUN, DAY_COUNTS, day_nulls(100, "(1e0)")) + "SELECT session, event, round(observed, 5) AS observed, round(unit_limit, 5) AS unit_limit, round(circular_limit, 5) AS circular_limit, observed > unit_limit AND observed > circular_limit AS significant FROM li",
    "m3_quantile_tables": with_all(EV, HC, TUN, DAY_COUNTS, day_nulls(100, "(1e0)")) + "SELECT session, event, kind, CAST(l AS INTEGER) AS level, round(list_extract(q, CAST(l AS BIGINT) + 1), 5) AS value FROM (SELECT session, event, kind, quantile_cont(m, [k / 40e0 for k in range(41)]) AS q FROM em WHERE kind <> 'observed' GROUP BY 1, 2, 3), range(41) r(l)",
    "m3_significant_fractions": with_all(EV, HC, TUN, DAY_COUNTS, day_nulls(100, "(1e0)")) + "SELECT session, count(*) AS n, round(avg((observed > unit_limit)::INT), 6) AS unit, round(avg((observed > circular_limit)::INT), 6) AS circular, round(avg((observed > greatest(unit_limit, circular_limit))::INT), 6) AS both FROM li GROUP BY 1",
    "m4_gain_sweep": with_all(EV, HC, TUN, DAY_COUNTS, day_nulls(100, ", ".join(f"({g}e0)" for g in GAINS)), """hg AS (SELECT gain, (observed > greatest(unit_limit, circular_limit))::INT * 1e0 AS hit, """ + HASH.format("'split|' || session || '|' || event") + """ < 2147483648 AS train FROM li),
      bg AS (SELECT gain, avg(hit) FILTER (train) AS train, avg(hit) FILTER (NOT train) AS test FROM hg GROUP BY 1), fl0 AS (SELECT *, coalesce(test < lag(test) OVER w AND lag(test) OVER w < lag(test, 2) OVER w AND row_number() OVER w >= 7, false) AS fall FROM bg WINDOW w AS (ORDER BY gain)),
      kp AS (SELECT gain, train, test, NOT coalesce(bool_or(fall) OVER (ORDER BY gain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS kept FROM fl0)""") + "SELECT gain, round(train, 6) AS train, round(test, 6) AS test, kept, row_number() OVER (ORDER BY kept DESC, test DESC, gain) = 1 AS best FROM kp",
    "o3_event_triggered": with_all(EV, HC, PERI.split(",\n      pe AS")[0], RAMP.format(x="ds"), "pt AS (SELECT ramps.session, ramps.bin AS event_bin, CAST(rel AS INTEGER) AS rel, value AS y FROM ramps CROSS JOIN range(-4, 5) r(rel) JOIN ds ON ds.session = ramps.session AND ds.bin = ramps.bin + rel WHERE ramps.bin BETWEEN 4 AND 715)", PP, WILCOXON) + TEST_ROWS,
}
