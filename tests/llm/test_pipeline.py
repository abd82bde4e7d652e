"""The pipeline's stages, each on its own input, against what its operator and brute force say."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from test_operators import DOCS, WORDS, brute_components, brute_spans

LABELS = "doc_id long, quality int, toxic int"


def folder(spark, tmp_path):
    """A small corpus with toxic, copied, leaked, secret and clean documents; the kind of each."""
    rng = random.Random(11)
    rows, kinds, labels, items = [], {}, [], [(k, " ".join(rng.choices(WORDS, k=40))) for k in range(5)]
    base = rng.choices(WORDS, k=120)
    for i in range(400):
        w, kind = rng.choices(WORDS, k=rng.choice([30, 100, 600])), "clean"
        if i % 8 == 0:
            w[3], kind = "vilexx" + rng.choice("abc"), "toxic"
        elif i % 8 == 1 and i < 200:
            w, kind = list(base), "copy"
            w[rng.randrange(120)] = rng.choice(WORDS)
        elif i % 16 == 2:
            w[5:5], kind = items[i % 5][1].split(), "leak"
        elif i % 16 == 3:
            w[4:4], kind = ["password=0123456789abcdef01"], "secret"
        rows.append((i, " ".join(w), "en", "s", 0))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id here", "en", "s", 0)]
    at = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, kinds


def test_each_stage_does_its_own_work(spark, tmp_path):
    at, rows, kinds = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    every = [r[0] for r in rows]
    stage = dict(corpus_pipeline.STAGES)
    assert ids(stage["toxicity"](spark, docs, at)) == sorted((i for i in every if kinds.get(i) != "toxic"), key=str)
    groups = defaultdict(set)
    for (i, n, c), _ in brute_components([(r[0], r[1]) for r in rows]).items():
        groups[c].add((i, n))
    gone = {i for c, members in groups.items() for i, n in members if n and i is not None and i != c}
    assert len(gone) == sum(k == "copy" for k in kinds.values()) - 1
    assert ids(stage["near_duplicates"](spark, docs, at)) == sorted((i for i in every if i not in gone), key=str)
    assert ids(stage["decontamination"](spark, docs, at)) == sorted((i for i in every if kinds.get(i) != "leak"), key=str)
    masked = {r.doc_id: r for r in stage["secrets"](spark, docs, at).collect()}
    for i, text, *_ in rows:
        assert masked[i].text == (re.sub(r"password=\w+", "[assign]", text) if text else text)
        assert not brute_spans(masked[i].text or "")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, at).columns == docs.columns, name


def test_run_chains_the_stages(spark, tmp_path):
    at, rows, kinds = folder(spark, tmp_path)
    got = corpus_pipeline.run(spark, at).collect()
    first_copy = min(i for i, k in kinds.items() if k == "copy")
    want = {i for i, *_ in rows if kinds.get(i) in ("clean", "secret", None)} | {first_copy}
    assert {r.doc_id for r in got} == want
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(tokens.values())
