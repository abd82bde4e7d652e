"""The test tables as the library's inputs, in Spark and in SQL. Times are seconds; T0 is where the events begin."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators import decode, intervals
from latentspark.sources.tables import HOUR, T0, events, table

DAYS = 30
HOURS = DAYS * 24
KEYS = ["session"]

#: Every query that SQL can express begins with some of these.
EV = """ev AS (SELECT 's' || (user_id % 4) AS session, event_type AS unit, user_id, epoch_us(ts) / 1e6 AS t, value,
              CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k, event_id FROM events)"""
IV = """iv AS (SELECT session, CAST(d AS INTEGER) AS interval_id, 1704067200e0 + d * 86400 AS s, 1704067200e0 + d * 86400 + 43200 AS e
              FROM (SELECT DISTINCT session FROM ev), range(30) r(d))"""
HC = """h AS (SELECT session, CAST(floor((t - 1704067200e0) / 3600) AS BIGINT) AS bin, unit, count(*) AS n FROM ev GROUP BY ALL),
      hc AS (SELECT g.session, g.bin, g.unit, coalesce(h.n, 0) AS n FROM
             (SELECT u.session, u.unit, r.bin FROM (SELECT DISTINCT session, unit FROM ev) u, range(720) r(bin)) g LEFT JOIN h USING (session, bin, unit))"""
TUN = "tun AS (SELECT (bin % 24) // 4 AS latent, unit, avg(n) AS rate FROM hc GROUP BY ALL)"
#: hourly mean of value, hours without events left out
SIG = "sig AS (SELECT session, CAST(floor((t - 1704067200e0) / 3600) AS BIGINT) AS bin, avg(value) AS value FROM ev GROUP BY ALL)"
LL = """m AS (SELECT latent, unit, rate + 1e-20 AS mu FROM tun),
      ll AS (SELECT session, bin, latent, sum(n * ln(mu) - mu - lgamma(n + 1)) AS ll FROM hc JOIN m USING (unit) GROUP BY ALL)"""
NB = """top AS (SELECT *, max(ll) OVER (PARTITION BY session, bin) AS mx FROM ll),
      lm AS (SELECT *, mx + ln(sum(exp(ll - mx)) OVER (PARTITION BY session, bin)) AS log_marginal FROM top),
      nb AS (SELECT session, bin, latent, ll, log_marginal, exp(ll - log_marginal) AS p FROM lm)"""
HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n     ".join(parts) + "\n"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that two engines' sums in different orders agree; no -0."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns))


def rounded_halves_up(df: DataFrame, digits: int) -> DataFrame:
    """df with its doubles rounded; values that are a half of the last digit but for the order of their sums count as that half, so they go the same way whatever the order."""
    return rounded(rounded(df, digits + 6), digits)


def half_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, interval_id, start, end: the first half of each day."""
    s = events(spark, sf_dir).select("session").distinct()
    return s.withColumn("interval_id", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1)))).withColumns({"start": F.lit(T0) + F.col("interval_id") * 86400.0, "end": F.lit(T0) + F.col("interval_id") * 86400.0 + 43200.0})


def whole_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("session").distinct()
    return s.select("session", F.lit(0).alias("interval_id"), F.lit(T0).alias("start"), F.lit(T0 + HOURS * HOUR).alias("end"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, bin, unit, n by hour, zeros kept."""
    return intervals.count_in_bins(events(spark, sf_dir), whole_span(spark, sf_dir), HOUR, KEYS).select("session", "bin", "unit", "n")


def hourly_tuning(counts: DataFrame) -> DataFrame:
    """latent, unit, rate: mean count by the hour of the day, in sixths of a day."""
    return counts.groupBy(F.floor((F.col("bin") % 24) / 4).cast("long").alias("latent"), "unit").agg(F.avg("n").alias("rate"))


def hourly_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("session", F.floor((F.col("t") - T0) / HOUR).cast("long").alias("bin")).agg(F.avg("value").alias("value"))


def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts as events: session, event (day), bin (hour of the day), unit, n."""
    return hourly_counts(spark, sf_dir).select("session", F.floor(F.col("bin") / 24).cast("int").alias("event"), (F.col("bin") % 24).alias("bin"), "unit", "n")


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hourly_counts(spark, sf_dir)
    return decode.naive_bayes(decode.poisson_loglik(c, hourly_tuning(c), KEYS), KEYS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in order of vec_id, dealt to series by hundreds: series, vec_id, embedding, label."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("long").alias("series"), "vec_id", "embedding", F.col("label").cast("double").alias("label"))
