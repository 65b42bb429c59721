"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm.ann import nearest
from critiq.llm.common import read_table
from critiq.llm.conversations import damaged, repaired
from critiq.llm.exact_dup import exact_duplicates
from critiq.llm.exact_topk import exact_topk
from critiq.llm.html_text import extract_text
from critiq.llm.lm_score import fit_lm, score_lm
from critiq.llm.mixing import mixed_rows, plan_mix
from critiq.llm.near_dup import near_duplicates
from critiq.llm.packing import pack
from critiq.llm.pii import find_pii, fit_pii
from critiq.llm.quality import fit_quality, score_quality
from critiq.llm.url_rules import judge_urls
from critiq.llm.whitening import whitened_rows


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector among all others."""
    rows = read_table(spark, sf_dir, "embeddings")
    return exact_topk(rows.filter(F.col("vec_id") % 50 == 0), rows, k=5)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages, keep=("page_id", "url"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL.

    URLs end in the id of the document that the page shows; a URL is labelled "block" if that
    document is marked as toxic or of low quality.
    """
    pages = read_table(spark, sf_dir, "pages")
    labels = read_table(spark, sf_dir, "labels")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})[^/]*/?$", 1)
    shown = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marked = labels.groupBy("doc_id").agg(
        F.when(F.max(F.coalesce(bad, F.lit(False)).cast("int")) == 1, "block")
        .otherwise("allow").alias("label")
    )
    return judge_urls(pages, shown.join(marked, "doc_id").select("url", "label"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = read_table(spark, sf_dir, "documents")
    return find_pii(docs, fit_pii(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a document in a mix that draws each at least once and none over twice."""
    docs = read_table(spark, sf_dir, "documents")
    rows = mixed_rows(docs.select("doc_id", "source"), plan_mix(docs, max_repeats=2.0))
    return rows.select(
        "doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__block").alias("block_order"),
        F.col("__row").alias("row_order"),
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows found of every 20th vector among all others."""
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows.filter(F.col("vec_id") % 20 == 0), rows, k=20)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return score_lm(docs, fit_lm(docs))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    rows = read_table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen uncorrelated components of every embedding."""
    return whitened_rows(read_table(spark, sf_dir, "embeddings"))


def op13_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_html_text": op2_html_text,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_url_rules": op7_url_rules,
    "op8_lm_score": op8_lm_score,
    "op9_near_dup": op9_near_dup,
    "op10_packing": op10_packing,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_exact_dup": op13_exact_dup,
}

LLM_ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) AS x, i
            FROM (SELECT vec_id, unnest(embedding) AS e,
                         generate_subscripts(embedding, 1) AS i FROM embeddings)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 5
    """,
    "op7_url_rules": r"""
        WITH u AS (
            SELECT page_id, coalesce(url, '') AS url,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
                   regexp_extract(coalesce(url, ''), '^(.*?)://', 1, 's') AS scheme,
                   regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1, 's') AS query,
                   try_cast(regexp_extract(coalesce(url, ''),
                                           '/([0-9]{1,18})[^/]*/?$', 1) AS BIGINT) AS doc_id
            FROM pages
        ), f AS (
            SELECT *, regexp_replace(host, '[0-9]+', '0', 'g') AS folded,
                   regexp_replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''),
                                  '[0-9]+', '0', 'g') AS plain
            FROM u
        ), t AS (
            SELECT page_id, url, host, path, doc_id,
                   CASE WHEN contains(url, '://') THEN list_sort(list_distinct(list_concat(
                       list_transform(list_filter([translate(scheme,
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')],
                           lambda x: x <> ''), lambda x: 'scheme:' || x),
                       list_transform(list_filter(string_split(folded, '.'),
                           lambda x: x <> ''), lambda x: 'label:' || x),
                       list_transform(list_filter(string_split_regex(folded, '[.-]'),
                           lambda x: x <> '' AND contains(host, '-')), lambda x: 'part:' || x),
                       list_transform(list_filter(string_split(plain, '/'),
                           lambda x: x <> ''), lambda x: 'path:' || x),
                       list_transform(list_filter(
                           [regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)],
                           lambda x: x <> ''), lambda x: 'ending:' || x),
                       list_transform(list_filter(list_transform(string_split(query, '&'),
                           lambda x: regexp_extract(x, '^([^=]*)', 1)),
                           lambda x: x <> ''), lambda x: 'key:' || x)
                   ))) ELSE [] END AS tokens
            FROM f
        ), g AS (
            SELECT tokens, CASE WHEN l.bad = 1 THEN 'block' ELSE 'allow' END AS label,
                   row_number() OVER () AS u
            FROM t JOIN (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0
                                                 THEN 1 ELSE 0 END) AS bad
                         FROM labels GROUP BY 1) l USING (doc_id)
            WHERE len(tokens) > 0
        ), n AS (
            SELECT count(*) AS n, greatest(5, ceil(0.00001 * count(*))) AS least FROM g
        ), e AS (SELECT u, label, unnest(tokens) AS token FROM g
        ), c AS (
            SELECT token, label, count(*) AS freq,
                   CAST(sum(count(*)) OVER (PARTITION BY token) AS BIGINT) AS whole
            FROM e GROUP BY token, label
        ), o AS (
            SELECT DISTINCT token, whole FROM c, n
            WHERE whole >= least AND freq < whole AND whole < n
        ), s AS (
            SELECT u, label, list_sort(list(token ORDER BY whole, token)[1:8]) AS tokens
            FROM e JOIN o USING (token) GROUP BY u, label HAVING count(*) > 1
        ), b AS (
            SELECT tokens, unnest(list_filter(list_transform(
                CAST(range(1, CAST(1 AS BIGINT) << len(tokens)) AS BIGINT[]),
                lambda m: list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1)),
                lambda p: len(p) > 1)) AS part
            FROM (SELECT DISTINCT tokens FROM s) s
        ), p AS (
            SELECT part, label, count(*) AS freq,
                   CAST(sum(count(*)) OVER (PARTITION BY part) AS BIGINT) AS whole
            FROM s JOIN b USING (tokens) GROUP BY part, label
            UNION ALL SELECT [token], label, freq, whole FROM c
        ), r AS (
            SELECT part, label, freq / whole AS sure FROM p, n
            WHERE freq >= CASE WHEN len(part) > 1 THEN least ELSE 5 END AND freq / whole >= 0.5
              AND (freq >= 0.01 * n
                   OR (freq / whole + 1.645 * 1.645 / (2 * whole)
                       - 1.645 * sqrt(freq / whole * (1 - freq / whole) / whole
                                      + 1.645 * 1.645 / (4 * whole * whole)))
                      / (1 + 1.645 * 1.645 / whole) >= 0.5)
        ), v AS (
            SELECT tokens, coalesce(max(sure) FILTER (label = 'block'), 0)
                           > coalesce(max(sure) FILTER (label = 'allow'), 0) AS bad
            FROM (SELECT DISTINCT tokens FROM t) d JOIN r ON list_has_all(d.tokens, r.part)
            GROUP BY 1
        ), k AS (
            SELECT t.page_id, host, path, coalesce(bad, false) AS bad,
                CASE WHEN (host = 'example.net' OR host LIKE '%.example.net')
                          AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com')
                          AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org')
                          AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net')
                          AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM t LEFT JOIN v USING (tokens)
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
                    WHEN rule IS NOT NULL THEN 'allow'
                    WHEN bad THEN 'block' ELSE 'allow' END AS verdict
        FROM k
    """,
    "op9_near_dup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3),
                                    lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
            FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id,
               d.doc_id = k.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
    """,
    "op13_exact_dup": r"""
        WITH n AS (
            SELECT doc_id,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
}
