"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm.common import read
from lemmaflow.llm.divergence import source_divergence
from lemmaflow.llm.licenses import scan_licenses
from lemmaflow.llm.lines import remove_cross_site_lines
from lemmaflow.llm.mixing import mix_report
from lemmaflow.llm.negatives import hard_negatives
from lemmaflow.llm.packing import pack_minimum_slack
from lemmaflow.llm.privacy import privacy_report
from lemmaflow.llm.quality import quality_verdicts
from lemmaflow.llm.simhash import simhash_components
from lemmaflow.llm.spans import remove_repeated_spans
from lemmaflow.llm.tokens import pack_tokens
from lemmaflow.llm.topk import top_k
from lemmaflow.llm.toxicity import toxicity_scores


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"), size=4, radius=4)


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return remove_cross_site_lines(docs, site="source", min_sites=10).select("doc_id", "text", "n_lines", "n_removed")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return remove_repeated_spans(docs, min_words=36).select("doc_id", "text", "n_sentences", "n_removed")


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(read(spark, sf_dir, "documents"), size=2048, end_id=50256)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"), cap=3).drop("source")


def op6_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_minimum_slack(read(spark, sf_dir, "documents"), size=1024, end_id=2)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("notices")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy_report(read(spark, sf_dir, "documents"), window=8, share=0.95, contexts=3, bits=20.0, letters=3)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), anchors=F.col("id") % 100 == 0, label=shifted, positives=5, k=5, low=80, high=100, scale=256)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"), min_docs=30, most_terms=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_spread": op2_line_spread,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_token_packing": op4_token_packing,
    "op5_mixing": op5_mixing,
    "op6_bin_slack": op6_bin_slack,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op2_line_spread": """
        WITH docs AS (
            SELECT *, row_number() OVER () AS r, string_split(text, chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT r, doc_id, coalesce(source, '') AS site, text,
                   unnest(parts) AS line, unnest(range(len(parts))) AS pos
            FROM docs
        ), named AS (
            SELECT *, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS norm FROM lines
        ), common AS (
            SELECT norm FROM named
            WHERE norm <> ''
            GROUP BY norm HAVING count(DISTINCT site) >= 10
        ), ranked AS (
            SELECT r, pos, norm, rank() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, text, pos) AS k
            FROM named SEMI JOIN common USING (norm)
        ), gone AS (
            SELECT r, pos FROM ranked WHERE k > 1
        ), rest AS (
            SELECT named.r, string_agg(line, chr(10) ORDER BY named.pos) FILTER (gone.r IS NULL) AS text,
                   count(*) AS n_lines, count(gone.r) AS n_removed
            FROM named LEFT JOIN gone ON gone.r = named.r AND gone.pos = named.pos GROUP BY named.r
        )
        SELECT doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM docs LEFT JOIN rest USING (r)
    """,
    "op7_topk": """
        WITH whole AS (
            SELECT vec_id AS id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE "rank" <= 20
    """,
    "op12_hard_negatives": """
        WITH whole AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM whole a JOIN whole c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 100 = 0
        ), positive AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
        QUALIFY "rank" <= 5
    """,
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), words AS (
            SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
        ), langs AS (
            SELECT d.lang, (SELECT coalesce(sum(n), 0) FROM kept k WHERE k.lang = d.lang) AS total, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v
            FROM (SELECT DISTINCT lang FROM docs) d
        ), counts AS (
            SELECT w.lang, w.source, w.term, count(*) AS n FROM words w SEMI JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 5 * l.v AS HUGEINT) AS p,
                   1 + (1000000000 * CAST(k.n + 5 AS HUGEINT)) // CAST(l.total + 5 * l.v AS HUGEINT) AS q
            FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), apart AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                   CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank"
            FROM rows
        )
        SELECT * FROM ranked WHERE part = 'pair' OR "rank" <= 50
    """,
}
