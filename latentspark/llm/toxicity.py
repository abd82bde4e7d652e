"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton over folded text.

Folding lower-cases, strips marks, and maps look-alike letters and digits that stand for letters; words are runs of letters of any
script, ideographs words of their own. The lexicon is learned: starts of words (of short words the whole, and pairs of them) that label
1 has far more often than label 0, each start as long as the words that it stands for agree, weighted by its log odds. Words and phrases of two words around an entry that
label 0 has more often are exception phrases: they cancel the entries in them. A text's weight is normalised by its length; a
logistic fit on the same rows turns it into a score.

Lexicon and fit use a bounded sample of labelled training rows: SAMPLE_PER_LABEL rows of each label, the least by a hash of the id (one
row for each id). Entries and exceptions are as many as that sample supports.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_by_hash, numbered, saved, sized_hint, small_batches, tidy, whole
from .language_id import held_out

SAMPLE_PER_LABEL = {1: 4000, 0: 8000}
#: Lengths of word starts (words below the first are taken whole), least share of toxic sample rows that have an entry, least log odds.
STARTS, SUPPORT, ODDS = (4, 12), 0.002, 3.0
#: Rows of label 0 that an exception phrase has at least.
EXCEPTION_ROWS = 3
#: A text's weight is divided by this power of its words.
LENGTH_POWER = 0.5
#: An entry's log likelihood ratio exceeds the log of the number of starts that were looked at by so much, so that chance makes few.
MARGIN = 1.0
THRESHOLD = 0.7
#: Labels that are broadcast at most; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Files at most that the sample is saved in, and its counts: both are bounded, and on a local folder Hadoop starts processes for each file (chmod), from a JVM whose memory these show until they run.
SAMPLE_FILES = 16

#: Letters of other scripts that look like Latin ones, then digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


def fold_table() -> dict[int, str]:
    """Letters with marks go to their bare letter by decomposition; the fixed values above go as they say."""
    table = {c: unicodedata.normalize("NFKD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)] if chr(c).isalpha() or c >= 0xFF00}
    table |= dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD], "")
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    return {k: v.lower() for k, v in table.items()}


_WORD_SUBSTITUTES = str.maketrans(SUBSTITUTES)
_HAS_SUBSTITUTE = re.compile(r"[a-z][0-9@$]|[0-9@$!][a-z]")
_NOT_WORD = re.compile(r"[\W\d_]+")
_IDEOGRAPH = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def folded(text: str, table: dict[int, str]) -> str:
    """Folded words, each between single spaces: ` so it reads `. Digits count as letters only next to letters."""
    x = text.lower()
    if not x.isascii():
        x = _IDEOGRAPH.sub(r" \g<0> ", x.translate(table))
    if _HAS_SUBSTITUTE.search(x):
        x = re.sub(r"\S*(?:[a-z][0-9@$]|[0-9@$!][a-z])\S*", lambda m: m[0].translate(_WORD_SUBSTITUTES), x)
    return " " + _NOT_WORD.sub(" ", x).strip() + " "


def possible_entries(words: list[str]) -> set[str]:
    """Starts of long words; short words whole, and pairs of those, each closed by a space."""
    low, high = STARTS
    out = {w[:k] for w in set(words) if len(w) >= low for k in range(low, min(len(w), high) + 1)}
    short = [w if len(w) < low else None for w in words]
    out.update(w + " " for w in set(short) if w)
    out.update(f"{v} {w} " for v, w in zip(short, short[1:], strict=False) if v and w)
    return out


class Lexicon:
    """entries: (start of a word, weight), closed by a space where it has to be the whole; exceptions: phrases of whole words, which cancel entries in them."""

    def __init__(self, entries: list[tuple[str, float]], exceptions: list[str]) -> None:
        import ahocorasick

        self.table, self.automaton = fold_table(), ahocorasick.Automaton()
        patterns: dict[str, tuple[float, tuple[int, ...]]] = {" " + word: (weight, ()) for word, weight in entries}
        for phrase in exceptions:
            x = f" {phrase} "
            patterns[x] = (patterns.get(x, (0.0, ()))[0], tuple(i for i, c in enumerate(x[:-1]) if c == " "))
        for x, (weight, words) in patterns.items():
            self.automaton.add_word(x, (len(x), weight, words))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, x: str) -> dict[int, tuple[int, float]]:
        """In a folded text, the place before each word that an entry has and no exception cancels: length and weight of the longest entry."""
        best: dict[int, tuple[int, float]] = {}
        cancelled: set[int] = set()
        if len(self.automaton):
            for end, (n, weight, words) in self.automaton.iter(x):
                at = end - n + 1
                if words:
                    cancelled.update(at + i for i in words)
                if weight and best.get(at, (0, 0.0))[0] < n:
                    best[at] = (n, weight)
        return {at: b for at, b in best.items() if at not in cancelled} if cancelled else best

    def features(self, text: str) -> tuple[float, int, int]:
        """(weight, hits, words)."""
        x = folded(text, self.table)
        hits = self.hits(x)
        return float(sum(w for _, w in hits.values())), len(hits), max(1, x.count(" ") - 1)


def phrases_around(x: str, hits: dict[int, tuple[int, float]]) -> set[str]:
    """Words of a folded text that are longer than the entry that they begin with, and each such word with the one before or behind it."""
    out = set()
    for at, (n, _) in hits.items():
        end = x.index(" ", at + max(1, n - 1))
        word = x[at + 1 : end]
        if len(word) > n - 1:
            out.add(word)
        before, behind = x.rfind(" ", 0, at) if at else -1, x.find(" ", end + 1)
        if before >= 0:
            out.add(f"{x[before + 1 : at]} {word}")
        if behind >= 0:
            out.add(f"{word} {x[end + 1 : behind]}")
    return out


def inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of the logistic fit: 1 and the log of the weight normalised by length."""
    return np.column_stack([np.ones(len(weight)), np.log1p(weight / words**LENGTH_POWER)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Ridge-regularised coefficients by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the sample; of several labels of a document the largest holds."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = least_by_hash(known, "toxic", "doc_id", F.when(F.col("toxic") == 1, SAMPLE_PER_LABEL[1]).otherwise(SAMPLE_PER_LABEL[0]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # of rows that repeat an id one counts, so the sample holds its bound
    return texts.join(sized_hint(saved(picked), BROADCAST_ROWS), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def _label_counts(sample: DataFrame, things) -> DataFrame:
    """thing, bad, good: in how many sample rows of label 1 and 0 each of things(text) stands; and the rows themselves for the empty thing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, of = (Counter(), Counter()), [0, 0], things()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                counts[toxic].update(of(text.as_py()))
        counts[0][""], counts[1][""] = n
        names = [w for w, c in counts[1].items()] + [w for w in counts[0] if w not in counts[1]]
        for a in range(0, len(names), 10_000):
            part = names[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][w] for w in part], pa.int64()), pa.array([counts[0][w] for w in part], pa.int64())], ["thing", "bad", "good"])

    return sample.select("text", "toxic").mapInArrow(tidy(rows), "thing string, bad long, good long").groupBy("thing").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn(sample: DataFrame) -> tuple[list[tuple[str, float]], list[str]]:
    """Entries and exceptions, from counts of rows of each label."""
    low, high = STARTS

    def starts():
        table = fold_table()
        return lambda text: possible_entries(folded(text, table).split())

    totals = saved(_label_counts(sample, starts).coalesce(SAMPLE_FILES))
    n = totals.where("thing = ''").first()
    if not n or not n.bad:
        return [], []
    odds = F.log((F.col("bad") + 0.5) / F.lit(n.bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(n.good + 1.0))
    least, share = max(2, SUPPORT * n.bad), n.bad / (n.bad + n.good)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("bad") + F.col("good")) * F.lit(max(p, 1e-9))))).otherwise(0.0)
    chance = float(np.log(totals.count())) + MARGIN
    strong = totals.where("thing != ''").withColumn("odds", odds).where((F.col("bad") >= least) & (F.col("odds") >= min(ODDS, float(np.log(n.good + 1.0)))) & (part("bad", share) + part("good", 1 - share) >= chance))
    found = {r.thing: r for r in strong.collect()}  # each has `least` of the sample's rows
    longer: dict[str, list[str]] = {}
    for thing in sorted(found):
        longer.setdefault(thing[:-1], []).append(thing)
    entries: dict[str, float] = {}
    for thing in sorted(found, key=lambda s: (len(s), s)):
        words = thing.split()
        if thing.endswith(" "):
            if len(words) == 1 or not any(w + " " in found for w in words):
                entries[thing] = float(found[thing].odds)
            continue
        if any(thing[:k] in found for k in range(low, len(thing))):
            continue
        word = thing  # as long as the rows agree
        while len(word) < high:
            agree = [s for s in longer.get(word, []) if found[s].bad >= 0.95 * found[word].bad]
            if not agree:
                break
            word = agree[0]
        entries[word] = float(found[word].odds)
    known = sorted(entries.items())

    def phrases():
        lexicon = Lexicon(known, [])

        def of(text: str) -> set[str]:
            x = folded(text, lexicon.table)
            return phrases_around(x, lexicon.hits(x))

        return of

    exceptions = _label_counts(sample, phrases).where((F.col("thing") != "") & (F.col("good") >= EXCEPTION_ROWS) & (F.col("good") > F.col("bad"))).select("thing").collect()  # as many as the sample supports
    return known, sorted(r.thing for r in exceptions)


@dataclass(frozen=True)
class Model:
    entries: list[tuple[str, float]]
    exceptions: list[str]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = saved(training_sample(docs, labels).coalesce(SAMPLE_FILES))
    entries, exceptions = learn(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries, exceptions)
        for batch in batches:
            got = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), batch.column(1)], ["weight", "words", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(tidy(rows), "weight double, words long, toxic int").collect()  # as many rows as the sample has
    if not got:
        return Model(entries, exceptions, np.array([-5.0, 0.0]))
    order = sorted((r.weight, r.words, r.toxic) for r in got)
    w, n, y = (np.array(c, float) for c in zip(*order, strict=True))
    return Model(entries, exceptions, logistic(inputs(w, n), y))


def _judge(entries: list[tuple[str, float]], exceptions: list[str], weights: np.ndarray):
    """A function of a column of texts: (scores, hits)."""
    lexicon = Lexicon(entries, exceptions)

    def judge(texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        got = [lexicon.features(t.as_py() or "") for t in texts]
        weight, words = np.array([g[0] for g in got]), np.array([float(g[2]) for g in got])
        return 1 / (1 + np.exp(-np.clip(inputs(weight, words) @ weights, -30, 30))) if got else weight, [g[1] for g in got]

    return judge


def without_toxic(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, in all their columns, whose text scores below THRESHOLD; null texts score as empty ones. Only the numbers of the others are saved."""
    held = spark.sparkContext.broadcast((model.entries, model.exceptions, model.weights))
    rows, number = numbered(docs)

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(*held.value)
        for batch in batches:
            yield batch.select([0]).filter(pa.array(judge(batch.column(1))[0] >= THRESHOLD, pa.bool_()))

    with small_batches(spark):
        gone = saved(rows.select(number, F.col("text").cast("string").alias("text")).mapInArrow(tidy(toxic), f"{number} long"))
    return rows.join(sized_hint(gone, BROADCAST_ROWS), number, "left_anti").select(*docs.columns)


@whole
def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of every row of docs.

    Rows keep their ids, null and repeated ones too; null and empty texts get the score of a text without hits; without labels of
    both kinds nothing is toxic. Whole texts of any length count; an empty table gives an empty one; other columns are not read.
    """
    model = fit(docs, labels)
    held = spark.sparkContext.broadcast((model.entries, model.exceptions, model.weights))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(*held.value)
        for batch in batches:
            score, hits = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "hits"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, hits long")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
