"""Reading session tables, writing results, wide and long forms, and the binding of the test tables to the library's schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "spikes": "session string, unit string, t double",
    "units": "session string, unit string, is_pyr boolean",
    "intervals": "session string, name string, interval_id int, start double, end double",
    "signal": "session string, t double, value double",
    "position": "session string, t double, x double, y double, lin double, speed double",
}
#: 2024-01-01, where the events of the test tables begin, and an hour.
T0, HOUR = 1704067200.0, 3600.0


def load_table(spark: SparkSession, path: str, kind: str, form: str = "parquet") -> DataFrame:
    """A session table with its schema; csv with a header."""
    reader = spark.read.schema(SCHEMAS[kind])
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)


def load_session_tables(spark: SparkSession, folder: str, kinds: list[str], form: str = "parquet") -> dict[str, DataFrame]:
    return {k: load_table(spark, f"{folder}/{k}.{form}", k, form) for k in kinds}


def save_results(tables: dict[str, DataFrame], folder: str, parameters: dict, force: bool = False, partition_by: str | None = "session") -> None:
    """Each table as Parquet, and the parameters as a one-row JSON table; what is there stays unless force."""
    mode = "overwrite" if force else "ignore"
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{folder}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "parameters string").write.mode(mode).json(f"{folder}/parameters.json")


def load_results(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}, json.loads(spark.read.schema("parameters string").json(f"{folder}/parameters.json").first().parameters)


def export_csv(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "ignore").csv(path, header=True)


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """One column for each listed name; of several values the first counts."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def flat_to_grid(df: DataFrame, column: str, shape: list[int]) -> DataFrame:
    """df with d0, d1, ..., the coordinates of a row-major index."""
    out, stride = df, 1
    for k in range(len(shape) - 1, -1, -1):
        out = out.withColumn(f"d{k}", F.pmod(F.floor(F.col(column) / stride), F.lit(shape[k])).cast("long"))
        stride *= shape[k]
    return out


# ---- the test tables -------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session (s0..s3), unit (event type), user_id, t (seconds), value, k (of props), event_id."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(4))).alias("session"), F.col("event_type").alias("unit"), "user_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "event_id",
    )


def hour_of(t: Column) -> Column:
    """Whole hours since T0."""
    return F.floor((t - T0) / HOUR).cast("long")
