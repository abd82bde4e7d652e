"""Names that clash, ids that are null or repeated, samples that hold their bounds, long texts in linear time, settings and tables left as they were."""

import os
import random
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, EDGE, WORDS, docs_of

from latentspark.llm import common, language_id, nearest, packing, queries, secret_scan, toxicity, url_filter, warc

NAMES = ["__row", "__id", "__lang", "__score", "__weight", "__text", "__hits", "__doc", "__many", "__rank", "id", "of", "row", "grp", "score", "lang_pred", "number", "cid", "term", "toxic", "item_id", "label", "hits", "sig", "v", "q", "b"]
LABELS = "doc_id long, quality int, toxic int"


def clashing(df):
    for c in NAMES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def tables(spark, tmp_path, rows):
    at = str(tmp_path)
    rng = random.Random(1)
    clashing(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)).write.parquet(f"{at}/documents.parquet")
    clashing(spark.createDataFrame([(i, 1, k % 2) for k, (i, _) in enumerate(rows)], LABELS)).write.parquet(f"{at}/labels.parquet")
    clashing(spark.createDataFrame([(k, " ".join(rng.choices(WORDS, k=30))) for k in range(3)] + [(None, None)], "item_id long, text string")).write.parquet(f"{at}/benchmark.parquet")
    clashing(spark.createDataFrame([(i, f"http://a.com/{i}", t) for i, t in rows], "page_id long, url string, html string")).write.parquet(f"{at}/pages.parquet")
    clashing(spark.createDataFrame([(i, [float(k % 7), 1.0], k % 2) for k, (i, _) in enumerate(rows)], "vec_id long, embedding array<double>, label int")).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("rows", [EDGE + EDGE, []], ids=["edge rows, repeated", "empty"])
def test_every_query_and_stage_takes_edge_rows_and_clashing_names(spark, tmp_path, rows):
    at = tables(spark, tmp_path, rows)
    for name, query in queries.queries().items():
        n = query(spark, at).count()
        if name not in ("op5_nearest_neighbours", "op6_packing", "op7_decontamination", "op11_vector_codes", "op13_spelling_variants"):
            assert n == len(rows), name
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert name == "packing" or out.columns == docs.columns
        out.count()


def test_samples_hold_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_PER_LABEL", {1: 40, 0: 60})
    text = lambda k: f"some text number {k} of many"
    docs = spark.createDataFrame([(7, text(k), "en", "s", 0) for k in range(3000)] + [(None, text(k), "de", "s", 0) for k in range(3000)] + [(k, text(k), "en", "s", 0) for k in range(100, 1500)], DOCS)
    labels = spark.createDataFrame([(7, 1, 1)] * 5 + [(k, 1, int(k % 3 == 0)) for k in range(100, 1500)] + [(None, 1, 1)], LABELS)
    got = Counter(r.toxic for r in toxicity.training_sample(docs, labels).collect())
    assert got == {1: 40, 0: 60}
    picked = common.least_by_hash(docs, "lang", "doc_id", 50).collect()
    assert Counter(r.lang for r in picked) == {"en": 50, "de": 1} and len(set(picked)) == 51
    model = language_id.identify(spark, docs)
    assert {r.lang_pred for r in model.select("lang_pred").distinct().collect()} <= {"en", "de"}


def test_toxic_words_of_any_length_and_script_and_exception_phrases(spark):
    rng = random.Random(5)
    good = [f"plain{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows, labels = [], []
    for i in range(1200):
        w = rng.choices(good, k=40)
        kind = i % 6
        if kind == 0:
            w[rng.randrange(40)] = rng.choice(["zq", "Ъжщюя", "殺死", "ЪЖЩЮЯ"])
        elif i % 120 == 1:
            w[10:12] = ["zq", "harmless"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind == 0)))
    rows += [(5000, " ".join([*good[:38], "zq", "alone"])), (5001, " ".join([*good[:38], "zq", "harmless"])), (5002, " ".join([*good[:39], "ЪЖЩЮЯ"])), (5003, " ".join([*good[:39], "殺死"]))]
    got = {r.doc_id: r for r in toxicity.score_documents(spark, docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(i, t) for i, _, t in labels if got[i].held_out]
    assert len(held) > 300 and sum(got[i].predicted == t for i, t in held) / len(held) > 0.97
    assert [got[i].predicted for i in range(5000, 5004)] == [1, 0, 1, 1]


def test_lexicon_equals_a_search_without_automaton():
    rng = random.Random(6)
    letters = "abz"
    for _ in range(300):
        word = lambda: "".join(rng.choices(letters, k=rng.randrange(1, 7)))
        entries = sorted({(w if len(w) > 3 else w + " "): rng.random() + 0.1 for w in (word() for _ in range(6))}.items())
        exceptions = sorted({" ".join(word() for _ in range(rng.choice([1, 2]))) for _ in range(3)})
        words = [word() for _ in range(30)]
        weight = 0.0
        gone = {k + d for k in range(30) for e in exceptions for d in range(len(e.split())) if words[k : k + len(e.split())] == e.split()}
        for k, w in enumerate(words):
            best = max(((len(e), x) for e, x in entries if (w + " ").startswith(e)), default=(0, 0.0))
            weight += best[1] if k not in gone else 0.0
        assert abs(toxicity.Lexicon(entries, exceptions).features(" ".join(words))[0] - weight) < 1e-9


def test_secrets_of_long_texts_take_linear_time():
    auto = secret_scan.compile_rules(secret_scan.RULES)
    for text in ("eyJ" * 10**6, "eyJa.eyJb." * 100_000, "token=" * 200_000, "-----BEGIN A" * 100_000, "-----BEGIN PRIVATE KEY-----\nabcd " * 30_000, "-----BEGIN PRIVATE KEY-----\n" + "a b" * 400_000, "AKIA" * 200_000, "ghp_" * 300_000):
        t = time.time()
        list(secret_scan.spans_of_texts(pa.array([text]), secret_scan.RULES, auto))
        assert time.time() - t < 12, text[:12]


def test_long_hosts_take_linear_time(spark):
    host = "a." * 400_000 + "example.org"
    rows = [(1, f"http://{host}/es/x"), (1, f"http://{host}/es/x"), (2, "http://a.com/" + "x" * 1_000_000), (None, None)]
    got = url_filter.judge_urls(spark, clashing(spark.createDataFrame(rows, "page_id long, url string")), queries.RULES).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == {(1, "example.org/es/", "block"): 2, (2, None, "allow"): 1, (None, None, "allow"): 1}


def test_archives_of_repeated_rows_and_long_payloads(spark):
    big = "long payload " * 300_000
    rows = [(1, "http://a", big), (1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (3, "http://c", "x"), (3, "http://c", "x")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_archives(spark, warc.write_archives(pages)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == {(1, len(big), "revisit", 2): 2, (2, len(big), "response", None): 2, (3, 1, "response", None): 2}


def test_packing_of_null_and_repeated_ids_is_whole(spark):
    rows = [(None, None), (None, "a b c"), (5, "same words"), (5, "same words"), (5, None), (6, "w " * 3000)]
    got = packing.pack_documents(spark, clashing(docs_of(spark, rows))).collect()
    coder = packing.Coder(packing.Vocabulary.public())
    want = Counter()
    for i, t in rows:
        n = len(coder.ids(t or "")) + 1
        want[i, n] += n
    have = Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
    assert have == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()


def test_neighbours_of_several_blocks_reach_recall(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 2500)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (8, x[8].tolist()), (9001, [1.0, 2.0])]
    got = {}
    for r in nearest.nearest_neighbours(spark, clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    truth = nearest.exact_neighbours(rows[:9000])
    assert set(got) == set(truth) and all(len(v) == len(set(v)) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(truth[q])) / 20 for q in truth]) > 0.9


def test_candidates_are_few_where_neighbours_are_near():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((200, 32)), 50, axis=0) + 0.01 * rng.standard_normal((10_000, 32))
    index = nearest.CollisionIndex(np.arange(10_000), x, float(np.sqrt((x**2).sum(1).max())))
    seen = []
    index.vectors = type("Seen", (), {"__getitem__": lambda self, at: (seen.append(len(at)), x[at])[1]})()
    asked = np.arange(0, 10_000, 100)
    hit = [len(set(p.tolist()) & set(np.lexsort((np.arange(10_000), -(x @ x[i])))[:21].tolist())) / 20 for i, p, _ in index.search_all(asked, x[asked], 20)]
    assert np.mean(hit) > 0.9 and sum(seen) / len(asked) < 2000


def test_settings_and_tables_are_left_as_they_were(spark):
    names = list(common.BATCHES)
    before = [spark.conf.get(k) for k in names]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = packing.pack_documents(spark, docs_of(spark, EDGE), with_ids=False)
    assert [spark.conf.get(k) for k in names] == before
    assert len(set(os.listdir(folder)) - there) == 1 and out.count() > 0
