"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, found by pairs of trie nodes.

Words are dealt into ranges in code-point order; in each, neighbours' common beginnings give the nodes of the trie, and each node gets a
number: that of the word that made it, and its depth. The words read backwards give a second trie. A word that skips position i is the
pair (node of what stands before i, node of what stands behind it); a word with a gap before position i is the pair around the gap. Two
words share a pair of skips if they differ by a replaced letter there, and a skip meets a gap if one word has a letter more. Pairs are
integers whatever the words' length, and only those are made whose two nodes other words pass too. A pair fixes all letters but one,
so it never has more members than the alphabet has letters, and one more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, tidy, whole

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is this many times as frequent as its variant at least; so a chain of forms has at most 26 steps.
TIMES, CHAIN = 5, 26
#: A run loses a letter if its hash with the doc_id can be divided by this.
NOISE = 199
#: Different words that a task holds before it passes their counts on, and words of a range on average.
HELD, PER_RANGE = 300_000, 100_000
#: The node of nothing.
ROOT = -1

_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs_of(doc_id: int | str | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, times) of the maximal runs of at least LEAST_LENGTH letters, A-Z lower-cased, some of them with a letter deleted."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUNS.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % NOISE == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words of docs (id, text) that occur LEAST_COUNT times; tasks add up before they pass counts on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in runs_of(doc_id, text.as_py() or ""):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.mapInArrow(tidy(rows), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- trie nodes --------------------------------------------------------------------------------------------------------


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    if n <= 32:
        i = 0
        while a[i] == b[i]:
            i += 1
        return i
    return len(commonprefix([a, b]))


class Border:
    """Beginnings that words on both sides of a border between ranges share, and their nodes. They may run through many ranges: a node is named at the first border it crosses."""

    def __init__(self, text: str, nodes: np.ndarray) -> None:
        self.text, self.nodes = text, nodes

    @staticmethod
    def all(ends: list[tuple[str, str]]) -> list[Border]:
        """Between each two ranges that follow each other, from their (first, last) words."""
        out, given, before = [], 0, Border("", np.zeros(0, np.int64))
        for (_, last), (first, _) in zip(ends[:-1], ends[1:], strict=True):
            text = last[: shared(last, first)]
            old = shared(text, before.text)
            new = ROOT - 1 - given - np.arange(len(text) - old)
            given += len(new)
            before = Border(text, np.concatenate([before.nodes[:old], new]))
            out.append(before)
        return out


def nodes_of(words: list[str], before: Border, after: Border, base: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of a range's sorted words the longest beginning that another word has too, and the nodes of its beginnings up to there, the empty one first.

    before, after: the borders of the range; base: letters in all ranges before.
    """
    upto = np.zeros(0, np.int64)  # of the word before: nodes of its beginnings
    common = [len(before.text), *(shared(a, b) for a, b in zip(words[:-1], words[1:], strict=True)), len(after.text)]
    for j, word in enumerate(words):
        most, old = max(common[j], common[j + 1]), common[j] if j else 0
        nodes = np.empty(most, np.int64)
        nodes[:old] = upto[:old]
        nodes[old:] = np.arange(base + old, base + most)
        for border in (before, after):
            if border.text and word[0] == border.text[0]:
                n = min(shared(word, border.text), most)
                nodes[:n] = border.nodes[:n]
        yield most, np.concatenate([[ROOT], nodes])
        upto, base = nodes, base + len(word)


def numbered_nodes(words: DataFrame, number: str) -> DataFrame:
    """words (w, and more columns) with `number` (0, 1, ... in code-point order), most (length of the longest beginning that another word has too) and nodes (of its beginnings up to there). Words differ."""
    spark, more = words.sparkSession, [c for c in words.columns if c != "w"]
    ranges = max(1, ceil(words.count() / PER_RANGE))
    dealt = saved(words.repartitionByRange(ranges, "w").withColumn("part", F.spark_partition_id()))
    # one row for each range
    ends = sorted(dealt.groupBy("part").agg(F.min("w").alias("a"), F.max("w").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.length("w").cast("long")).alias("letters")).collect())
    borders = [Border("", np.zeros(0, np.int64)), *Border.all([(r.a, r.b) for r in ends]), Border("", np.zeros(0, np.int64))]
    rank, letters = np.cumsum([0, *(r.n for r in ends)]), np.cumsum([0, *(r.letters for r in ends)])
    held = spark.sparkContext.broadcast({r.part: (borders[i].text, borders[i].nodes, borders[i + 1].text, borders[i + 1].nodes, int(rank[i]), int(letters[i])) for i, r in enumerate(ends)})

    def number_range(table: pa.Table) -> pa.Table:
        text, nodes, next_text, next_nodes, first, base = held.value[table.column("part")[0].as_py()]
        words = table.column("w").to_pylist()
        by = sorted(range(len(words)), key=words.__getitem__)
        got = list(nodes_of([words[i] for i in by], Border(text, nodes), Border(next_text, next_nodes), base))
        out = {c: table.column(c).take(pa.array(by)) for c in ["w", *more]}
        cuts = np.cumsum([0, *(len(x) for _, x in got)])
        return pa.table(out | {number: pa.array(np.arange(first, first + len(by)), pa.int64()), "most": pa.array([m for m, _ in got], pa.int64()), "nodes": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([x for _, x in got]), pa.int64()))})

    fields = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in ["w", *more])
    return dealt.groupBy("part").applyInArrow(number_range, f"{fields}, {number} long, most long, nodes array<long>")


def node_pairs(words: DataFrame) -> DataFrame:
    """f, b (nodes), id, n, gap, counts of words (w, id, n, nodes and most forwards, back_nodes and back_most backwards).

    gap: the pair stands around a gap, else it skips a letter. counts: the letter is the first of a run of equal ones; deleting any of a run gives one word, which so counts once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, b, of, gap, counts = [], [], [], [], []
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("w", "id", "n", "nodes", "back_nodes")}
            for i, (word, ahead, back) in enumerate(zip(*(columns[c] for c in ("w", "nodes", "back_nodes")), strict=True)):
                word, ahead, back = word.as_py(), ahead.values.to_numpy(), back.values.to_numpy()
                letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                new = np.ones(len(letters), bool)
                new[1:] = letters[1:] != letters[:-1]
                for is_gap, size in ((False, len(word) - 1), (True, len(word))):  # letters that a pair fixes
                    at = np.arange(max(0, size - len(back) + 1), min(size, len(ahead) - 1) + 1)
                    if len(at):
                        f.append(ahead[at])
                        b.append(back[size - at])
                        of.append(np.full(len(at), i))
                        gap.append(np.full(len(at), is_gap))
                        counts.append(np.ones(len(at), bool) if is_gap else new[at])
            if f:
                take = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)), pa.array(np.concatenate(b)), columns["id"].take(take), columns["n"].take(take), pa.array(np.concatenate(gap)), pa.array(np.concatenate(counts))], ["f", "b", "id", "n", "gap", "counts"])

    return words.mapInArrow(tidy(rows), "f long, b long, id long, n long, gap boolean, counts boolean")


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near, form (struct of -n and id of the near word of largest n, the least of several) of each word with a near one."""
    one = F.struct((-F.col("n")).alias("m"), "id", "gap", "counts")
    met = pairs.groupBy("f", "b").agg(F.collect_list(one).alias("all")).where(F.size("all") > 1)  # as many as the alphabet has letters, and one
    key = lambda x: F.struct(x["m"].alias("m"), x["id"].alias("id"))
    met = met.select("all", F.sort_array(F.transform(F.filter("all", lambda x: ~x["gap"]), key)).alias("skips"), F.sort_array(F.transform(F.filter("all", lambda x: ~x["gap"] & x["counts"]), key)).alias("longer"), F.get(F.transform(F.filter("all", lambda x: x["gap"]), key), 0).alias("short"))
    x = F.col("x")
    one = met.select("skips", "longer", "short", F.explode("all").alias("x"))
    other = F.when(F.get("skips", 0)["id"] != x["id"], F.get("skips", 0)).otherwise(F.get("skips", 1))
    shorter = F.when(x["counts"], F.col("short"))
    # least() passes over nulls
    found = one.select(
        x["id"].alias("id"),
        F.when(x["gap"], F.size("longer")).otherwise(F.size("skips") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("k"),
        F.when(x["gap"], F.get("longer", 0)).otherwise(F.least(other, shorter)).alias("best"),
    )
    return found.where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("form"))


@whole
def group_variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs that has LEAST_LENGTH letters and occurs LEAST_COUNT times.

    Words are maximal runs of letters of whole texts, A-Z lower-cased, a few with a letter deleted by a hash of id and run (a null id is
    empty there). Near words differ by one letter inserted, deleted or replaced; form is the near word of largest n, the first in
    code-point order of several, if that is at least TIMES this word's; root is the last of the chain of forms. Null and empty texts have no words;
    repeated rows count each; words of any length are compared whole; an empty table gives an empty one; other columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = saved(word_counts(texts).withColumnRenamed("word", "w"))
    ahead = saved(numbered_nodes(words, "id"))
    back = saved(numbered_nodes(ahead.select(F.reverse("w").alias("w"), "id"), "back_id").select("id", F.col("nodes").alias("back_nodes")))
    both = ahead.select("w", "id", "n", "nodes").join(back, "id")
    near = saved(near_words(node_pairs(both)).select("id", "n_near", F.col("form.id").alias("form"), (-F.col("form.m")).alias("form_n")))
    named = saved(ahead.select("id", F.col("w").alias("word"), "n").join(near, "id", "left"))
    fits = F.col("form_n") >= TIMES * F.col("n")
    chain = saved(named.where(fits).select("id", F.col("form").alias("to")))
    steps = 1
    while steps < CHAIN:  # each round doubles the steps that are followed
        on = chain.select(F.col("id").alias("to"), F.col("to").alias("next"))
        longer = saved(chain.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("went")))
        if longer.where("went").isEmpty():
            break
        chain, steps = longer.select("id", "to"), 2 * steps
    spelled = lambda name: named.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"))
    with_forms = named.where(fits).join(chain, "id").join(spelled("form"), "form").join(spelled("to"), "to").select("id", F.col("form_word").alias("form"), F.col("to_word").alias("root"), F.col("form_n"))
    out = named.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")).join(with_forms, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
