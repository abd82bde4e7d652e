"""Passages that repeat: Rabin-Karp hashes of every window of WINDOW words, counted in Spark, and merged into maximal intervals to remove.

A window is known by its polynomial over the prime field of 2^61 - 1, a word's coefficient being its 64-bit hash; where the input is so
large that 61 bits could meet by chance, as many further bytes of a second polynomial go along. Tasks pass no rows for single windows:
of FLUSH windows they pass one blob for each group of hashes, with the first place of each window; repeats inside a flush are
decided there and pass as places alone. A group finds each window's first place of all, and sends later places to blocks of documents,
where windows that touch are merged into intervals. Texts travel once, to meet their intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, from_planes, mix, planes, saved, sized_hint, text_slices, tidy, whole, word_hashes, words_of

WINDOW = 20
#: Windows that a task holds before it passes them on, and windows that a group gets on average.
FLUSH, PER_GROUP = 700_000, 1_000_000
#: Ids of repeated documents that are broadcast at most; beyond, the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: The prime of the field, and the bases of the two polynomials.
PRIME, BASES = (1 << 61) - 1, (0x1A2B5C7D9E3F4A61, 0x0F3D86C5A79B1E27)
#: What stands for a null doc_id: it comes after all others.
LAST = (1 << 63) - 1


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b in the field, a < PRIME."""
    low, high, u = np.uint64((1 << 32) - 1), np.uint64(32), np.uint64
    a0, a1, b0, b1 = a & low, a >> high, u(b & 0xFFFFFFFF), u(b >> 32)
    mid = a0 * b1 + a1 * b0  # below 2^63
    mid_low, mid_high = mid & u((1 << 29) - 1), mid >> u(29)  # mid * 2^32 = mid_high * 2^61 + mid_low * 2^32
    return folded(folded(a1 * b1 * u(8)) + mid_high + folded(mid_low << high) + folded(a0 * b0))


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """The polynomial of each run of `size` coefficients, the first one highest. Runs are put together from shorter ones, so few passes make them all."""

    def joined(a: np.ndarray, b: np.ndarray, k: int, n: int) -> np.ndarray:
        """Runs of k + n from runs a of k, each followed by one of b, of n."""
        return folded(times(a[: len(b) - k], pow(base, n, PRIME)) + b[k:])

    if len(h) < size:
        return np.zeros(0, np.uint64)
    part, n, have, k = folded(h), 1, None, 0
    while True:
        if size & n:
            have, k = (part if have is None else joined(have, part, k, n)), k + n
        if 2 * n > size:
            return have
        part, n = joined(part, part, n, n), 2 * n


def extra_bytes(windows: float) -> int:
    """Bytes of the second polynomial that keep the expected number of different windows of one name below 1 in 100."""
    return max(0, ceil((2 * log2(max(windows, 2)) + 6 - 61) / 8))


# ---- places: documents (order, tag) and starts in them ----------------------------------------------------------------


def packed_places(doc: np.ndarray, start: np.ndarray, order: np.ndarray, tag: np.ndarray) -> list[bytes]:
    """Places, sorted by doc (an index into order and tag) and start, as number columns that compress away."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    step = np.diff(start, prepend=0)
    step[first] = start[first]
    there = doc[first]
    return [planes(np.diff(order[there], prepend=0)), planes(tag[there]), planes(np.diff(np.append(first, len(doc))).astype(np.uint32)), planes(step.astype(np.uint32))]


def unpacked_places(order: bytes, tag: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, tag) of the documents, the document's index and the start of each place."""
    order, tag, n = np.cumsum(from_planes(order, np.int64)), from_planes(tag, np.int64), from_planes(counts, np.uint32).astype(np.int64)
    step = from_planes(steps, np.uint32).astype(np.int64)
    total, first = np.cumsum(step), np.cumsum(n) - n
    return order, tag, np.repeat(np.arange(len(n)), n), total - np.repeat(total[first] - step[first], n)


PLACES = "orders binary, tags binary, counts binary, steps binary"
_PLACES = [f.split()[0] for f in PLACES.split(", ")]


def later_than_first(key: np.ndarray, more: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, sorted by key, more and place: the order, and whether it lies behind the first place of its window. place: any numbers that compare as places do."""
    by = np.lexsort((place, more, key) if len(more) else (place, key))
    k, p = key[by], place[by]
    new = np.ones(len(by), bool)
    new[1:] = k[1:] != k[:-1]
    if len(more):
        m = more[by]
        new[1:] |= m[1:] != m[:-1]
    run = np.cumsum(new) - 1
    return by, p > p[np.flatnonzero(new)][run] if len(by) else new


def window_blobs(docs: DataFrame, groups: int, extra: int, window: int) -> DataFrame:
    """grp, keys, more, the places of keys, and the places of windows that surely lie behind their first; from docs (order, tag, text)."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = at = 0
        orders, tags = [], []

        def out() -> pa.RecordBatch:
            key, more, doc, start = (np.concatenate([h[i] for h in held]) for i in range(4))
            order, tag = np.array(orders, np.int64), np.array(tags, np.int64)
            rank = np.empty(len(order), np.int64)  # documents by order and tag; of one order they share a place
            by = np.lexsort((tag, order))
            rank[by] = np.arange(len(by))
            order, tag = order[by], tag[by]
            doc = rank[doc]
            same = np.cumsum(np.diff(order, prepend=order[0]) != 0)
            place = same[doc] << 32 | start
            by, later = later_than_first(key, more, place)
            key, more, doc, start, place = key[by], more[by] if extra else more, doc[by], start[by], place[by]
            again = np.zeros(len(key), bool)  # equal rows: one will do
            again[1:] = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (tag[doc[1:]] == tag[doc[:-1]])
            group = (key % np.uint64(groups)).astype(np.int64)
            rows = []
            sent, passed = ~later & ~again, later & ~again
            parts = []
            for chosen in (sent, passed):
                i = np.flatnonzero(chosen)
                i = i[np.lexsort((start[i], doc[i], group[i]))]
                parts.append((i, np.searchsorted(group[i], np.arange(groups + 1))))
            (i, ci), (j, cj) = parts
            for g in range(groups):
                a, b = i[ci[g] : ci[g + 1]], j[cj[g] : cj[g + 1]]
                if len(a) or len(b):
                    rows.append((g, planes(key[a] // np.uint64(groups)), planes(more[a])[: extra * len(a)] if extra else b"", *packed_places(doc[a], start[a], order, tag), *packed_places(doc[b], start[b], order, tag)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], ["grp", "keys", "more", *_PLACES, *(f"passed_{c}" for c in _PLACES)])

        for batch in batches:
            order, tag = (batch.column(c).to_numpy() for c in (0, 1))
            for row, data, offsets in text_slices(batch.column(2)):
                data, starts, ends, rows = words_of(data, offsets, lower=False)
                h = word_hashes(data, starts, ends)
                key = rolling(h, window, BASES[0])
                inside = rows[: len(key)] == rows[window - 1 : window - 1 + len(key)]
                if inside.any():
                    more = rolling(h, window, BASES[1])[inside] if extra else np.zeros(0, np.uint64)
                    of = rows[: len(key)][inside]
                    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
                    there, index = np.unique(of, return_inverse=True)
                    held.append((key[inside], more & np.uint64((1 << 8 * extra) - 1) if extra else more, index + at, np.flatnonzero(inside) - first[of]))
                    orders += order[row + there].tolist()
                    tags += tag[row + there].tolist()
                    at += len(there)
                    size += int(inside.sum())
                if size >= FLUSH:
                    yield out()
                    held, orders, tags, size, at = [], [], [], 0, 0
        if size:
            yield out()

    return docs.mapInArrow(tidy(blobs), f"grp long, keys binary, more binary, {PLACES}, " + ", ".join(f"passed_{c}" for c in PLACES.split(", ")))


def block_of(order: np.ndarray, tag: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(order.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(tag.view(np.uint64) + np.uint64(1))) % np.uint64(blocks)).astype(np.int64)


def repeats(blobs: DataFrame, groups: int, extra: int) -> DataFrame:
    """block and the places of windows whose words also start earlier: each group knows all places of its windows."""

    def group(table: pa.Table) -> pa.Table:
        order, tag, doc, start, key, more, sure = [], [], [], [], [], [], []
        at = 0
        for r in range(table.num_rows):
            for prefix in ("", "passed_"):
                o, t, d, s = unpacked_places(*(table.column(prefix + c)[r].as_py() for c in _PLACES))
                order.append(o)
                tag.append(t)
                doc.append(d + at)
                start.append(s)
                sure.append(np.full(len(d), bool(prefix)))
                at += len(o)
            key.append(from_planes(table.column("keys")[r].as_py(), np.uint64))
            if extra:
                few = np.frombuffer(table.column("more")[r].as_py(), np.uint8).reshape(extra, -1)
                more.append(sum(few[k].astype(np.uint64) << np.uint64(8 * k) for k in range(extra)))
        order, tag, doc, start, sure = (np.concatenate(x) for x in (order, tag, doc, start, sure))
        key, more = np.concatenate(key), np.concatenate(more) if extra else np.zeros(0, np.uint64)
        kinds, rank = np.unique(order, return_inverse=True)
        asked = np.flatnonzero(~sure)
        place = rank[doc[asked]].astype(np.int64) << 32 | start[asked]
        by, later = later_than_first(key, more, place)
        gone = np.concatenate([asked[by[later]], np.flatnonzero(sure)])
        doc, start = doc[gone], start[gone]
        block = block_of(order, tag, groups)
        sort = np.lexsort((start, tag[doc], rank[doc], block[doc]))
        doc, start = doc[sort], start[sort]
        new = np.ones(len(doc), bool)  # one index for each document, whichever blob it came from
        new[1:] = (order[doc[1:]] != order[doc[:-1]]) | (tag[doc[1:]] != tag[doc[:-1]])
        named = np.cumsum(new) - 1
        o, t, b = order[doc[new]], tag[doc[new]], block[doc]
        cuts = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
        rows = [(int(b[x]), *packed_places(named[x:y], start[x:y], o, t)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table({n: pa.array(c, pa.int64() if n == "block" else pa.binary()) for n, c in zip(["block", *_PLACES], columns, strict=True)})

    return blobs.groupBy("grp").applyInArrow(group, f"block long, {PLACES}")


def intervals(places: DataFrame, window: int) -> DataFrame:
    """ord, tag, n_removed, begins, lengths (of maximal intervals of words) of each document that loses words."""

    def merged(table: pa.Table) -> pa.Table:
        order, tag, doc, start, at = [], [], [], [], 0
        for r in range(table.num_rows):
            o, t, d, s = unpacked_places(*(table.column(c)[r].as_py() for c in _PLACES))
            order.append(o)
            tag.append(t)
            doc.append(d + at)
            start.append(s)
            at += len(o)
        order, tag, doc, start = (np.concatenate(x) for x in (order, tag, doc, start))
        by = np.lexsort((start, tag[doc], order[doc]))
        o, t, start = order[doc[by]], tag[doc[by]], start[by]
        new = np.ones(len(start), bool)
        new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
        cut = new.copy()
        cut[1:] |= start[1:] > start[:-1] + window  # windows that overlap or touch make one interval
        begin = start[cut]
        end = start[np.append(np.flatnonzero(cut)[1:], len(start)) - 1] + window
        first = np.flatnonzero(new[cut])
        length = end - begin
        split = lambda x: [planes(p.astype(np.int64)) for p in np.split(x, first[1:])]
        return pa.table({"ord": o[new], "tag": t[new], "n_removed": np.add.reduceat(length, first) if len(first) else length, "begins": pa.array(split(begin), pa.binary()), "lengths": pa.array(split(length), pa.binary())})

    return places.groupBy("block").applyInArrow(merged, "ord long, tag long, n_removed long, begins binary, lengths binary")


def kept_text(data: bytes, begins: np.ndarray, lengths: np.ndarray) -> tuple[int, bytes]:
    """The number of words, and those outside the intervals joined by one space."""
    raw = np.frombuffer(data, np.uint8)
    raw, starts, ends, _ = words_of(raw, np.array([0, len(raw)]), lower=False)
    n = len(starts)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + lengths, -1)
    keep = np.cumsum(change[:-1]) == 0
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return n, b""
    size = np.append(ends[:-1] - starts[:-1] + 1, ends[-1] - starts[-1])  # a space behind each but the last
    to = np.cumsum(size) - size
    out = raw[np.repeat(starts - to, size) + np.arange(int(size.sum()))]  # behind a word stands white space, or nothing is read there
    out[to[1:] - 1] = 0x20
    return n, out.tobytes()


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord, tag, text: the id as it was, its place among ids (nulls last), and a hash of the text where an id is null or repeated, so that rows are told apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.col(text_col).cast("string").alias("text"))
    more = saved(rows.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ord", F.lit(True).alias("many")))
    if more.isEmpty():
        return rows.withColumn("tag", F.lit(0).cast("long"))
    return rows.join(sized_hint(more, BROADCAST_ROWS), "ord", "left").withColumn("tag", F.when(F.col("many"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("many")


@whole
def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 and, if with_text, kept_text of every row of docs.

    A word goes if a window of `window` words that covers it also starts earlier: in a smaller id, or in the same one at an earlier
    word. Windows are judged on the input. Ids are whole numbers. Rows of one id count as one document whose rows share their places:
    at equal places neither is earlier, so rows that repeat an id and its text lose nothing to each other. Null ids come after all others
    and count as one id. Null and empty texts have no words; texts of any length count whole; an empty table gives an empty one; other columns aren't read.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    rows = identified(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, ceil(size / 6 / PER_GROUP))  # a word and its space take about 6 bytes
    extra = extra_bytes(size / 2)
    places = repeats(window_blobs(rows.select("ord", "tag", "text"), groups, extra, window), groups, extra)
    gone = saved(intervals(places, window))
    kind, named = docs.schema[id_col].dataType.simpleString(), rows.join(gone, ["ord", "tag"], "left").select("id", "text", "n_removed", "begins", "lengths")
    none = np.zeros(0, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, texts = [], [], []
            for text, begins, lengths in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                b, k = (none, none) if begins is None else (from_planes(begins, np.int64), from_planes(lengths, np.int64))
                words, kept = kept_text((text.as_py() or "").encode(), b, k)
                n.append(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            out = [batch.column(0), pa.array(n, pa.int64()), batch.column(2).fill_null(0), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(texts, pa.string())] if with_text else []), [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return named.mapInArrow(tidy(cut), f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
