"""The registered queries of this subpackage: thin digests of its operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .lines import line_digest
from .media_flac import media_digest
from .mixing import Target, mixed_counts
from .near_dup import near_duplicates
from .packing import pack
from .quality_gam import quality_scores
from .quality_rules import quality_verdicts
from .secrets import secret_digest
from .substring import substring_digest
from .token_counts import token_counts


#: Weights of at least 0.97 of the greatest entropy, at most four passes over a source, as many tokens as there are.
MIXTURE = Target(entropy=0.97, repetitions=4.0, budget=1.0, seed=7)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(read_table(spark, sf_dir, "documents"), width=13)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(read_table(spark, sf_dir, "documents"), MIXTURE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), limit=4096)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_flac_media": op9_flac_media,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
        k AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM g),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM k),
        c AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(0, 13) t(j) WHERE hit),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
        r AS (SELECT p.doc_id, p.word, p.i, c.i IS NOT NULL AS gone FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i),
        s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM w LEFT JOIN s USING (doc_id)""",
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                              ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        g AS (SELECT s, list(doc_id) AS docs, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
        f AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM (SELECT list_sort(s) AS s, min(rep) AS rep FROM g GROUP BY 1)),
        p AS (
          SELECT a.rep AS a, b.rep AS b FROM f a JOIN f b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        c AS (SELECT min(rep) OVER (PARTITION BY list_sort(s)) AS rep, unnest(docs) AS doc_id FROM g),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT rep, doc_id FROM c UNION ALL SELECT doc_id, rep FROM c),
        r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op3_source_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, coalesce(source, '') AS source, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
        t AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY source),
        p AS (SELECT source, tokens, docs, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM t) AS p FROM t WHERE tokens > 0),
        e(i, a, b) AS (  -- the smallest k in a..b with too little entropy
          SELECT 0, 0, 1048576
          UNION ALL
          SELECT i + 1, CASE WHEN yes THEN a ELSE m + 1 END, CASE WHEN yes THEN m ELSE b END
          FROM (SELECT i, a, b, m, ln(z) - m / 1048576.0 * s / z < 0.97 * ln(n) - 1e-9 AS yes
                FROM (SELECT i, a, b, (a + b) // 2 AS m, (SELECT count(*) FROM p) AS n, (SELECT sum(pow(p, ((a + b) // 2) / 1048576.0)) FROM p) AS z,
                             (SELECT sum(pow(p, ((a + b) // 2) / 1048576.0) * ln(p)) FROM p) AS s FROM e WHERE a < b))),
        q(i, a, b) AS (  -- the smallest k in a..b with few enough passes
          SELECT 0, 0, 1048576
          UNION ALL
          SELECT i + 1, CASE WHEN yes THEN a ELSE m + 1 END, CASE WHEN yes THEN m ELSE b END
          FROM (SELECT i, a, b, m, pow((SELECT min(p) FROM p), m / 1048576.0 - 1) / (SELECT sum(pow(p, m / 1048576.0)) FROM p) <= 4 + 1e-9 AS yes
                FROM (SELECT i, a, b, (a + b) // 2 AS m FROM q WHERE a < b))),
        even AS (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) < 0.97 * ln(count(*)) - 1e-9 AS low FROM p),
        x AS (SELECT greatest(CASE WHEN a = 1048576 AND NOT low THEN a ELSE greatest(0, a - 1) END, (SELECT a FROM q ORDER BY i DESC LIMIT 1)) / 1048576.0 AS x
              FROM (SELECT a FROM e ORDER BY i DESC LIMIT 1), even),
        w AS (SELECT source, tokens, CAST(ceil(sqrt(docs)) AS BIGINT) AS blocks,
                     CAST(floor(pow(p, x) / (SELECT sum(pow(p, x)) FROM p, x) * (SELECT CAST(sum(tokens) AS DOUBLE) FROM t) + 1e-6) AS BIGINT) AS budget_tokens FROM p, x),
        r AS (SELECT *, budget_tokens // tokens AS passes, budget_tokens % tokens AS rest FROM w),
        k AS (SELECT d.*, r.rest, CAST('0x' || substr(key, 1, 8) AS BIGINT) % r.blocks AS block FROM d JOIN r USING (source)),
        b AS (SELECT source, block, rest, md5('7|' || source || '|' || block) AS block_key, sum(n_tokens) AS n FROM k GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY block_key, block) AS run FROM b),
        y AS (SELECT k.doc_id, k.source, k.key, run <= c.rest OR (run - n <= c.rest AND
                     run - n + sum(n_tokens) OVER (PARTITION BY k.source, k.block ORDER BY k.key) <= c.rest) AS inside
              FROM k JOIN c ON c.source = k.source AND c.block = k.block)
        SELECT d.doc_id, d.source, d.n_tokens, r.budget_tokens, CAST(CASE WHEN r.passes IS NULL THEN 1 ELSE r.passes + CASE WHEN y.inside THEN 1 ELSE 0 END END AS INTEGER) AS copies
        FROM d LEFT JOIN r USING (source) LEFT JOIN (SELECT DISTINCT * FROM y) y ON y.doc_id IS NOT DISTINCT FROM d.doc_id AND y.source = d.source""",
    "op4_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        l AS (
          SELECT d.r, d.doc_id, t.i, t.line, regexp_replace(t.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
          FROM d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) t),
        k AS (SELECT r, doc_id, i, line, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        g AS (SELECT k.r, k.doc_id, k.i, k.line, coalesce(c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM g GROUP BY r""",
}
