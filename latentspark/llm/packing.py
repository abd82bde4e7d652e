"""Documents packed into windows of tokens by a histogram plan from non-negative least squares.

A document's ids are cut into full windows and a rest; a rest of over half a window is cut once more at a hashed place, so that lengths
stay varied even if one document fills a third of the table. Of the pieces only a histogram of lengths goes to the driver. There, all
combinations of two or three lengths that fill a window are enumerated, their repeat counts solved by non-negative least squares
against the histogram and rounded, and what is left is packed greedily, longest first. The plan says for the k-th piece of a length in
which window and where it lies; pieces get their k without gaps from bucketed counts, so no task holds all pieces of a length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, mix, partitions_of, saved, tidy, whole

WINDOW, DEPTH, ROUNDS = 1024, 3, 300
SEPARATOR = 0
SPECIAL = {"<|endoftext|>": 50256}


@dataclass(frozen=True)
class Vocabulary:
    """Paths of one public vocabulary, as a tokenizer file and as ranks, and the pattern that splits texts for the ranks."""

    file: str
    ranks: str
    pattern: str

    @staticmethod
    def public() -> Vocabulary:
        import public_tokenizers

        return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


class Coder:
    """Ids of texts as the tokenizer file gives them. The ranks give the same ids (tests compare all characters) in a third of the time;
    where their pattern gives up, on very long runs of white space, the tokenizer itself takes the text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import tiktoken

        with open(vocabulary.ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("packing", pat_str=vocabulary.pattern, mergeable_ranks=merges, special_tokens=SPECIAL)
        self.file, self.whole = vocabulary.file, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def cut_lengths(tokens: int, salt: int, window: int = WINDOW) -> list[int]:
    """Lengths of a document's pieces, in order."""
    full, rest = divmod(tokens, window)
    out = [window] * full
    if rest > window // 2:
        cut = 1 + int(mix(np.array([salt], np.uint64))[0] % np.uint64(rest - 1))
        out += [cut, rest - cut]
    elif rest:
        out.append(rest)
    return out


def pieces_of(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if with_ids, ids (array) of each piece of every row; null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = Coder(vocabulary), 0
        for batch in batches:
            row, start, length, crc, tokens, ids = [], [], [], [], [], []
            for i, (salt, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                x = np.append(coder.ids(text.as_py() or ""), np.uint32(SEPARATOR)).astype("<u4")
                begin = 0
                for n in cut_lengths(len(x), (at + i if salt is None else salt) & 0xFFFFFFFF, window):
                    part = x[begin : begin + n]
                    row.append(i)
                    start.append(begin)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    tokens.append(len(x))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    begin += n
            at += batch.num_rows
            out = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


# ---- the plan: numbers only, bounded by the window ---------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All sorted pairs and triples of the lengths that fill the window; -1 stands for no third."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = lengths[lengths * 2 <= window]
    pairs = a[have[window - a]]
    out = [np.column_stack([pairs, window - pairs, np.full(len(pairs), -1)])]
    for x in lengths[lengths * 3 <= window].tolist():
        y = lengths[(lengths >= x) & (lengths * 2 <= window - x)]
        y = y[have[window - x - y]]
        out.append(np.column_stack([np.full(len(y), x), y, window - x - y]))
    return np.concatenate(out)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that makes the combinations use up the histogram in the least-squares sense, by multiplicative updates."""
    if not len(combos):
        return np.zeros(0)
    third, at = combos[:, 2] >= 0, np.maximum(combos, 0)
    back = lambda v: v[at[:, 0]] + v[at[:, 1]] + np.where(third, v[at[:, 2]], 0.0)
    target = back(histogram.astype(float))
    x = np.minimum.reduce([histogram[at[:, 0]], histogram[at[:, 1]], np.where(third, histogram[at[:, 2]], histogram.max())]).astype(float) / max(1, len(combos)) ** 0.5 + 1e-9
    for _ in range(rounds):
        used = np.bincount(at[:, 0], x, len(histogram)) + np.bincount(at[:, 1], x, len(histogram)) + np.bincount(at[third, 2], x[third], len(histogram))
        x *= target / np.maximum(back(used), 1e-12)
    return x


class Plan:
    """Segments of piece numbers: a length's pieces from `key - length * 2**40` on lie `per` in a window, from window `first` on, at `offset`."""

    STRIDE = 1 << 40

    def __init__(self, histogram: np.ndarray, window: int = WINDOW) -> None:
        left, given = histogram.astype(np.int64).copy(), np.zeros(window + 1, np.int64)
        rows: list[tuple[int, int, int, int]] = []
        self.windows = 0

        def use(parts: list[tuple[int, int]], times: int) -> None:
            """times windows, each with k pieces of length n for (n, k) in parts."""
            offset = 0
            for n, k in parts:
                rows.append((n * self.STRIDE + int(given[n]), self.windows, k, offset))
                given[n] += times * k
                left[n] -= times * k
                offset += n * k
            self.windows += times

        if left[window]:
            use([(window, 1)], int(left[window]))
        combos = combinations(np.flatnonzero(left[:window]), window)
        x = repeat_counts(combos, left[:window])
        for i in np.argsort(-x, kind="stable").tolist():
            lengths = [n for n in combos[i].tolist() if n >= 0]
            parts = [(n, lengths.count(n)) for n in dict.fromkeys(lengths)]
            times = min(max(1, round(x[i])), *(int(left[n]) // k for n, k in parts))
            if times:
                use(parts, times)
        there = np.flatnonzero(left)[::-1].tolist()
        while there:
            gap, parts = window, []
            for n in there:
                if n <= gap and left[n]:
                    k = min(int(left[n]), gap // n)
                    parts.append((n, k))
                    gap -= n * k
                if not gap:
                    break
            use(parts, min(int(left[n]) // k for n, k in parts))
            there = [n for n in there if left[n]]
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 4).T.copy()


def place(table: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of the number-th piece of each length, by the table of a plan."""
    starts, first, per, offset = table
    key = length * Plan.STRIDE + number
    i = np.searchsorted(starts, key, "right") - 1
    k = key - starts[i]
    return first[i] + k // per[i], offset[i] + k % per[i] * length


@whole
def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, ids of each piece of every row of docs.

    Ids are those of the public vocabulary and a closing 0; null and empty texts are that 0 alone. Each id lies in one piece; the
    pieces of a sequence follow each other from offset 0 without gaps. Repeated rows and null doc_ids are documents of their own. An
    empty table gives an empty one; other columns are not read.
    """
    pieces = saved(pieces_of(docs, vocabulary or Vocabulary.public(), window, with_ids).withColumn("__at", F.monotonically_increasing_id()))
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `window` rows
        histogram[r.length] = r.n
    plan = spark.sparkContext.broadcast(Plan(histogram, window).table)
    numbered = gapless_rank(pieces.select("length", "__at", *(c for c in pieces.columns if c not in ("length", "__at"))), ["length"], ["__at"], "__at", "__number", max(16, partitions_of(spark)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, number = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__number"))
            at = place(plan.value, length, number) if len(length) else (np.zeros(0, np.int64),) * 2
            keep = [c for c in names if c not in ("__number", "__at")]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64())], [*keep, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name not in ("__number", "__at")]
    placed = numbered.mapInArrow(tidy(rows), ", ".join([*fields, "sequence_id long", "offset long"]))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
