"""The registered queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm.cost_packing import cost_packing
from hearthline.llm.embed_dedup import embedding_dedup
from hearthline.llm.filter_audit import filter_audit
from hearthline.llm.fim_transform import fim_digests
from hearthline.llm.forced_bpe import encode_digests
from hearthline.llm.heavy_hitter_dedup import exact_dedup
from hearthline.llm.html_extract import extract_text
from hearthline.llm.separator_scan import token_counts
from hearthline.llm.simhash_dedup import simhash_dedup
from hearthline.llm.source_mixing import mix_counts
from hearthline.llm.substring_chain import repeated_passages
from hearthline.llm.toxicity import toxicity
from hearthline.llm.url_trust import url_verdicts

#: Fixed values of the URL contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Passages are alike if 0.8 of their 5-word shingles are equal; these seeds find every such passage of 50 words, across documents and within one.
PASSAGES = dict(k=5, window=10, least_seeds=2, most=8, shingle=5, similarity=0.8, min_words=50)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), **PASSAGES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), *BYTE_BPE)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), RULES)


def op6_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), WORD_BPE)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing(_table(spark, sf_dir, "documents"), *BYTE_BPE)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op11_fim_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(_table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_token_counts, op4_html_extract, op5_url_filter, op6_forced_bpe, op7_embedding_dedup, op8_exact_dedup, op9_packing, op10_simhash_dedup, op11_fim_transform, op12_source_mixing, op13_filter_audit)}

ORACLE = {
    "op8_exact_dedup": r"""
        WITH plain AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM plain WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op7_embedding_dedup": r"""
        WITH RECURSIVE sound AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        linked AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
        counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a),
        named AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept
        FROM embeddings e JOIN named ON named.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
    """,
    "op11_fim_transform": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
        numbers AS (
            SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM drawn),
        cut AS (
            SELECT *, least(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS a, greatest(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers),
        parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
        FROM parts
    """,
    "op13_filter_audit": r"""
        WITH RECURSIVE known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        failed AS (
            SELECT doc_id, part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
            FROM texts),
        filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        fails AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails
            FROM failed LEFT JOIN known USING (doc_id)),
        kinds AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM fails GROUP BY part, fails),
        orders AS (SELECT letter AS o FROM filters UNION ALL SELECT o || letter FROM orders JOIN filters ON NOT contains(o, letter)),
        steps AS (SELECT o AS filter_order, s::INTEGER AS step, o[s:s] AS letter, o[1:s - 1] AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
        judged AS (
            SELECT part, filter_order, step, n, good, toxic, fails, letter, contains(fails, letter) AS has, earlier <> '' AND fails <> '' AND regexp_matches(fails, '[' || earlier || '-]') AS gone FROM kinds, steps),
        summed AS (
            SELECT part, filter_order, step, letter, sum(n) FILTER (NOT has AND NOT gone) AS kept, sum(n) FILTER (has AND NOT gone) AS removed, sum(n) FILTER (has AND gone) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
                sum(good) FILTER (has AND NOT gone) AS good_lost, sum(toxic) FILTER (has AND NOT gone) AS toxic_lost FROM judged GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
            coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
        FROM summed
    """,
}
