"""The registered queries opN_<name> of the training-data operators, and DuckDB SQL where SQL can express them.

Each query reads whole tables and applies its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filteraudit, hardneg, langid, packing, pagediff, quality, sharding, simhash, substring, tokencount, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived with a Zstandard dictionary, and read back."""
    return warc.digests(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words of all documents, cut wherever they occur."""
    return substring.digests(table(spark, sf_dir, "documents"), k=35, anchor=12)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens by deficit round-robin over sources."""
    return packing.digests(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash fingerprints differ in two bits or fewer."""
    return simhash.digests(table(spark, sf_dir, "documents"))


def op5_token_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits."""
    return tokencount.digests(table(spark, sf_dir, "documents"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    return sharding.digests(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of 13 words of benchmark items."""
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by a conditional random field learned from three quarters of them."""
    return langid.digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base limits and robust outliers over all documents."""
    return quality.digests(table(spark, sf_dir, "documents"))


#: The rules that op10 judges by: fixed values.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by listed hosts and paths."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its markup and by what it shares with the nearest pages of its host."""
    return pagediff.digests(table(spark, sf_dir, "pages"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in all orders."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return hardneg.digests(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_archive, op2_substring_dedup, op3_mixture_packing, op4_simhash_dedup, op5_token_recount, op6_kd_sharding, op7_decontamination, op8_language_id, op9_quality_rules, op10_url_filter, op11_page_differencing, op12_filter_interaction, op13_pivot_negatives)
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
            FROM w, unnest(range(1, greatest(len(words) - 33, 1))) AS t(i)
        ), rep AS (
            SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
        ), gone AS (
            SELECT doc_id, list(DISTINCT i + j) AS places FROM rep, unnest(range(0, 35)) AS t(j) GROUP BY doc_id
        ), flat AS (
            SELECT w.doc_id, len(words) AS n, words, coalesce(places, []) AS places FROM w LEFT JOIN gone USING (doc_id)
        ), kept AS (
            SELECT doc_id, string_agg(words[i], ' ' ORDER BY i) AS t
            FROM (SELECT doc_id, words, unnest(range(1, n + 1)) AS i FROM flat) x
            ANTI JOIN (SELECT doc_id, unnest(places) AS i FROM gone) g USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM flat LEFT JOIN kept USING (doc_id)
    """,
    "op1_warc_archive": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
                first_value(page_id) OVER w AS head, row_number() OVER w AS turn
            FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id, url)
        )
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
            CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN turn = 1 THEN NULL ELSE head END AS refers_to
        FROM p
    """,
    "op7_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS win, least(len(words), 13) AS size
            FROM b, unnest(range(1, greatest(len(words) - 11, 2))) AS t(i) WHERE len(words) > 0
        ), dw AS (
            SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
            FROM d, (SELECT DISTINCT size FROM bw), unnest(range(1, greatest(len(words) - size + 2, 1))) AS t(i)
        ), found AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (win, size)),
        hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, size)) AS t(j) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY doc_id),
        gap AS (
            SELECT doc_id, size, array_to_string(words[i:i + g - 1], ' ') || ' ' || array_to_string(words[i + g + 1:i + size], ' ') AS win
            FROM d, (SELECT DISTINCT size FROM bw WHERE size > 1), unnest(range(1, greatest(len(words) - size + 1, 1))) AS t(i), unnest(range(1, size)) AS o(g)
        ), near AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_near
            FROM (SELECT doc_id, item_id FROM found UNION ALL SELECT doc_id, item_id FROM gap JOIN bw USING (win, size)) GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op10_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), rules(rh, rp, rv) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), best AS (
            SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
            FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
    """,
    "op12_filter_interaction": r"""
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), d AS (
            SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
            FROM w
        ), l AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id
        ), m AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY part, mask
        ), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM f a JOIN f b ON a.bit & b.bit = 0 JOIN f c ON (a.bit | b.bit) & c.bit = 0 JOIN f d ON (a.bit | b.bit | c.bit) & d.bit = 0
            JOIN f e ON (a.bit | b.bit | c.bit | d.bit) & e.bit = 0
        ), s AS (
            SELECT filter_order, step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step) AS before
            FROM o, unnest(range(1, 6)) AS t(step), f WHERE f.letter = substr(filter_order, step, 1)
        ), r AS (
            SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (before::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & before::INT > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & before::INT = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM m, s GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
    """,
    "op13_pivot_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
    """,
}
