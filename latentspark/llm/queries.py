"""One query for each operator, with production parameters over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, nearest, ngram_join, packing, secret_scan, sharding, spelling_variants, substring_dedup, toxicity, url_filter, vector_codes, warc
from .common import shared_folder, whole

#: The rules of op4.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, _table(spark, sf_dir, "documents"))


@whole
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), folder=shared_folder(spark))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, _table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, _table(spark, sf_dir, "pages"), RULES)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(spark, _table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), with_ids=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), sharding.Tree.even(SHARDS))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, _table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard_join, op2_warc, op3_language_id, op4_url_filter, op5_nearest_neighbours, op6_packing, op7_decontamination, op8_toxicity, op9_secret_scan, op10_sharding,
        op11_vector_codes, op12_substring_dedup, op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
     k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept IS NULL OR kept = page_id THEN NULL ELSE kept END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""

OP4_SQL = r"""
WITH h AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages),
     r AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS rest FROM h),
     q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^[^?#]*') AS path FROM r),
     f AS (SELECT page_id, host, path,
                  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


def _op11_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Every round in turn: the nearest entry of each part, then the means; exact on whole numbers."""
    steps = [
        "k AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"p AS (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) AS t(p))",
        f"c0 AS (SELECT p, e, x FROM p JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}) USING (row))",
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, p, min({{'d': CAST({distance} AS BIGINT), 'e': e}}) AS b FROM p JOIN c{r} AS c USING (p) GROUP BY row, p)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT p, b.e AS e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{r} JOIN p USING (row, p)) GROUP BY p, e, i)")
            steps.append(f"m{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM s{r} GROUP BY p, e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (p, e))")
    steps.append(f"f AS (SELECT row, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (row), h"


OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT row, doc_id, i, array_to_string(ws[i : i + 19], ' ') AS passage FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
     f AS (SELECT passage, min({'d': doc_id, 'i': i}) AS first FROM s GROUP BY passage),
     r AS (SELECT row, i FROM s JOIN f USING (passage) WHERE {'d': doc_id, 'i': i} > first),
     g AS (SELECT DISTINCT row, unnest(range(i, i + 20)) AS j FROM r),
     x AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
     k AS (SELECT row, count(*) AS n_words, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL) AS kept FROM x LEFT JOIN g USING (row, j) GROUP BY row)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express within their size; the others are tested against brute force."""
    return {"op2_warc": OP2_SQL, "op4_url_filter": OP4_SQL, "op11_vector_codes": _op11_sql(), "op12_substring_dedup": OP12_SQL}
