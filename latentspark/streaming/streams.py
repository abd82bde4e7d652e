"""Streaming forms: counts, bursts, causal decoding. Streams have columns session, unit, ts (timestamp)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from latentspark.operators import decode


def stream_counts(stream: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """session, unit, start, end, n by tumbling or sliding windows; rows later than `late` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy("session", "unit", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session", "unit", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_bursts(stream: DataFrame, gap: str, late: str, longer_than: float = 0.0) -> DataFrame:
    """session, start, end, n of events that follow each other within `gap`, those that last longer than so many seconds; end is the last event's time plus the gap."""
    g = stream.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    length = F.col("last").cast("double") - F.col("first").cast("double")
    return g.where(length > longer_than).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_filter(counts: DataFrame, model: decode.Model, dt: float = 1.0, late: str | None = None, expires_ms: int = 0) -> DataFrame:
    """session, bin, causal_latent, log_marginal (so far) of a stream of session, bin, units (array of counts in the model's order).

    The state of a session is its last bin, posterior and log marginal: the filter needs no more of the past. Bins at or below the last
    one seen are dropped; a batch's bins are taken in order. With `late`, the stream has a column ts: rows behind the watermark, the latest time less `late`, are
    dropped, and a session's state goes when the watermark is expires_ms past its last row's time; if it comes back it starts anew. Without `late` states stay.
    """
    rates, kernels, switch = model.rates, model.kernels, model.switch
    dyn, size = len(kernels), len(rates)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, flat, total, seen = state.get if state.exists else (-1, [1.0 / (dyn * size)] * (dyn * size), 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("bin")
        if late:  # rows of the batch that fall behind the watermark
            at = (rows["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[rows["ts"].dt.unit]).to_numpy()
            rows, at = rows[at >= state.getCurrentWatermarkMs()], at[at >= state.getCurrentWatermarkMs()]
            seen = max([seen, *at.tolist()])
        rows = rows[rows["bin"] > last].drop_duplicates("bin")
        now, out = np.array(flat).reshape(dyn, size), []
        for r in rows.itertuples():
            ll = decode.loglik_matrix(np.array(r.units, float)[None], rates, dt, 1.0)
            causal, one = decode.forward(ll, kernels, switch, start=now)
            now, total, last = causal[0], total + float(one[0]), int(r.bin)
            out.append((key[0], last, now.sum(0).tolist(), total))
        if last >= 0:
            state.update((last, now.reshape(-1).tolist(), total, seen))
            if late:
                state.setTimeoutTimestamp(max(seen + expires_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "bin", "causal_latent", "log_marginal"])

    stream = counts.withWatermark("ts", late) if late else counts
    return stream.groupBy("session").applyInPandasWithState(step, "session string, bin long, causal_latent array<double>, log_marginal double", "last long, posterior array<double>, total double, seen long", "append", GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout)


def stream_naive_bayes(counts: DataFrame, model: decode.Model, dt: float = 1.0) -> DataFrame:
    """session, bin, p_latent, log_marginal of each row of a stream of session, bin, units, by itself."""
    rates = model.rates

    def decode_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                ll = decode.loglik_matrix(np.stack(rows["units"].to_numpy()).astype(float), rates, dt, 1.0)
                top = ll.max(1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(ll - top).sum(1))
                yield pd.DataFrame({"session": rows["session"], "bin": rows["bin"], "p_latent": list(np.exp(ll - total[:, None])), "log_marginal": total})

    return counts.select("session", "bin", "units").mapInPandas(decode_rows, "session string, bin long, p_latent array<double>, log_marginal double")


def ran(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The rows of a stream run over all that its source holds now: written to folder/rows, with its checkpoint beside them. mode `complete` keeps the last state of all groups."""
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    if mode == "append":
        query = out.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
