"""Language by the nearest centroid: normalised TF-IDF vectors of letter n-grams, several clustered centroids for each language.

Document frequencies come from all labelled training rows. Centroids are fitted on a bounded sample of them, SAMPLE_PER_LANG rows for
each language, the least by a hash of the id (one row for each id), with their whole texts: one grouped task for each language clusters at most so many
vectors. A text goes to the language of the centroid with the largest cosine; one that lies further from it than the centroid's own
members do (mean and REJECT_SPREADS standard deviations) is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_by_hash, mix, saved, sized_hint, tidy, whole

WIDTH, ORDERS = 1 << 12, (1, 2, 3)
SAMPLE_PER_LANG, CENTROIDS, CLUSTER_ROUNDS = 400, 3, 12
REJECT_SPREADS = 4.0
UNKNOWN = "und"
#: Letters of a text that are counted at once, rows that are compared with the centroids at once.
SLICE, ROWS = 1 << 20, 256


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves `part`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


class Letters:
    """Which code points are letters, learned as they come."""

    def __init__(self) -> None:
        self.known = np.array([chr(c).isalpha() for c in range(0x3000)])

    def mask(self, codes: np.ndarray) -> np.ndarray:
        out = self.known[np.minimum(codes, len(self.known) - 1)]
        far = np.flatnonzero(codes >= len(self.known))
        if len(far):
            kinds, at = np.unique(codes[far], return_inverse=True)
            out[far] = np.array([chr(c).isalpha() for c in kinds.tolist()])[at]
        return out


def gram_counts(text: str, letters: Letters) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased letters, other characters standing for one gap; None without a letter."""
    counts, any_letter = np.zeros(WIDTH, np.int64), False
    for a in range(0, len(text), SLICE):
        codes = np.frombuffer(text[a : a + SLICE].lower().encode("utf-32-le"), np.uint32)
        is_letter = letters.mask(codes)
        if not is_letter.any():
            continue
        any_letter = True
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of a run of other characters
        c = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
        h = c
        for n in ORDERS:
            if n > 1:
                if len(h) < 2:
                    break
                h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
            counts += np.bincount((mix(h + np.uint64(n << 40)) >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64), minlength=WIDTH)
    return counts if any_letter else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of train (text) each gram stands, and the rows that have letters. The result has WIDTH + 1 rows, whatever the input."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, n = Letters(), np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                counts = gram_counts(x.as_py() or "", letters)
                if counts is not None:
                    df += counts > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH)), pa.array(np.concatenate([[n], df]))], ["gram", "df"])

    got = np.zeros(WIDTH + 1, np.int64)
    for r in train.select("text").mapInArrow(tidy(rows), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        got[r.gram + 1] = r.df
    return got[1:], int(got[0])


def clustered(x: np.ndarray, k: int = CENTROIDS, rounds: int = CLUSTER_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the mean's nearest row and then the farthest ones: unit centroids, and the largest distance 1 - cosine that each takes."""
    near = x @ x.mean(0)
    picked = [int(near.argmax())]
    closest = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cos = x @ c.T
    own = cos.argmax(1)
    away = [1 - cos[own == j, j] for j in range(len(c))]
    return c, np.array([float(d.mean() + REJECT_SPREADS * d.std()) if len(d) else 1.0 for d in away])


def fit(docs: DataFrame) -> tuple[np.ndarray, list[tuple[str, np.ndarray, float]]]:
    """idf, and (language, centroid, reach) rows, from the training rows of docs."""
    train = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    picked = saved(least_by_hash(train, "lang", "doc_id", SAMPLE_PER_LANG).select(F.col("doc_id").alias("id"), F.col("lang").alias("of")))
    picked = sized_hint(picked, SAMPLE_PER_LANG * 1000)
    # of rows that repeat an id and a language one counts, so the sample holds its bound
    sample = train.join(picked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")), "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            got = [(lang, c) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (c := gram_counts(t.as_py() or "", letters)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([vector(x[1], idf) for x in got], pa.list_(pa.float32()))], ["lang", "x"])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        c, reach = clustered(np.stack(rows.x.to_numpy()))
        return pd.DataFrame({"lang": rows.lang.iloc[0], "c": list(c.astype(np.float32)), "reach": reach})

    found = sample.mapInArrow(tidy(vectors), "lang string, x array<float>").groupBy("lang").applyInPandas(cluster, "lang string, c array<float>, reach double").collect()
    rows = [(r.lang, np.array(r.c, np.float32), float(r.reach)) for r in found]
    return idf, sorted(rows, key=lambda r: (r[0], r[1].tolist()[:16]))


@whole
def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected of every row of docs.

    lang_pred is a learned value of lang, or `und` with score 0 if the text is null or has no letter, or nothing could be learned. Ties go to
    the first language by name. Whole texts of any length count. Rows keep their ids, null and repeated ones too; an empty
    table gives an empty one; other columns are not read, whatever their names.
    """
    idf, rows = fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = spark.sparkContext.broadcast((idf, [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).reshape(len(rows), WIDTH), np.array([r[2] for r in rows])))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centroids, reach = model.value
        letters = Letters()
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                counts = [gram_counts(t.as_py() or "", letters) for t in part.column(2)]
                lang, score, far = [UNKNOWN] * len(counts), [0.0] * len(counts), [False] * len(counts)
                has = [i for i, c in enumerate(counts) if c is not None]
                if has and langs:
                    cos = np.stack([vector(counts[i], idf) for i in has]) @ centroids.T
                    best = cos.argmax(1)
                    for i, b, s in zip(has, best.tolist(), cos.max(1).tolist(), strict=True):
                        lang[i], score[i], far[i] = langs[b], min(1.0, max(0.0, s)), bool(1 - s > reach[b])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(tidy(predict), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
