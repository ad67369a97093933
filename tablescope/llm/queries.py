"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import ann, bpe, codes, counts, decontam, html, jaccard, langid, periodic, quality, suffix, urls, wavelet
from tablescope.llm.common import new_path, table

Query = Callable[[SparkSession, str], DataFrame]

#: Host, path, verdict of the rules that the URL query applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the boosted trees, fitted on the labelled documents, for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document as wavelet matrices and returns what the files hold, per document."""
    path = new_path(spark, "tokens", lasting=True)
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_documents(spark, path)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that it holds a copy of, exact or edited."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, from its text, what it declares, its address and its host."""
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's address; addresses without a rule are not listed: allow."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under similarity of five-word shingles of 0.8 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled transducers of the byte-level tokenizer."""
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that start earlier."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document (with the planted repetitions of the contract), and what is left."""
    runs = periodic.detect(table(spark, sf_dir, "documents"))
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found by the tree for every embedding whose id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every kept embedding: 16 parts, 64 entries, two rounds."""
    coded = codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT q.host, q.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM (SELECT DISTINCT host, path FROM p) q
  JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p)
  GROUP BY q.host, q.path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


def _op13_assign(n: int, book: str) -> str:
    return f"""
d{n} AS (
  SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS dist
  FROM comps c JOIN {book} b ON c.part = b.part AND c.pos = b.pos GROUP BY c.vec_id, c.part, b.entry
), a{n} AS (
  SELECT vec_id, part, min(dist * 64 + entry) % 64 AS entry, min(dist * 64 + entry) // 64 AS dist FROM d{n} GROUP BY vec_id, part
)"""


def _op13_update(n: int, book: str) -> str:
    return f"""
cb{n} AS (
  SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
    SELECT a.part, a.entry, c.pos, CAST(floor(sum(c.v) / count(*)) AS BIGINT) AS v
    FROM a{n} a JOIN comps c ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY a.part, a.entry, c.pos
  ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))
), flat AS (
  SELECT vec_id, len(e) // 16 AS w, unnest(range(0, len(e))) AS i, unnest(e) AS x FROM kept
), comps AS (
  SELECT vec_id, i // w AS part, i % w AS pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM flat
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64
), cb0 AS (
  SELECT c.part, f.entry, c.pos, c.v FROM comps c JOIN firsts f ON c.vec_id = f.vec_id
), {_op13_assign(1, "cb0")}, {_op13_update(1, "cb0")}, {_op13_assign(2, "cb1")}, {_op13_update(2, "cb1")},
{_op13_assign(3, "cb2")}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist) AS error FROM a3 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM cb2
)
SELECT k.vec_id, c.code, CAST(c.error AS BIGINT) AS error,
       CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN codes c ON k.vec_id = c.vec_id CROSS JOIN digest d
"""

QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_main_text": op7_main_text,
    "op8_token_counts": op8_token_counts,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ann_search": op12_ann_search,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op5_url_filter": OP5_SQL, "op13_vector_codes": OP13_SQL}
