"""The registered queries of the training-text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import chat_format, exact_dedup, language_id, license_scan, mixing, packing, pii, pipeline, quality_rules, simhash, url_filter
from kerbside.llm.frames import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_across_hosts(pages, url_filter.page_labels(pages))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed_documents(docs, pipeline.target_weights(docs))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.train(docs))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.good_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_license_scan": op4_license_scan,
    "op5_mixing": op5_mixing,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": pipeline.run,
}

#: The lengths of what each template adds are running sums; the late system text is rendered before the last user turn.
_CHATS = """
        WITH told AS (SELECT *, coalesce(conv_id::varchar, 'null' || row_number() OVER ()) AS conv, coalesce(role, 'user') AS r, coalesce(text, '') AS x FROM conversations),
        turns AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM told),
        sizes AS (SELECT *, length(x) AS n, length(r) + length(x) + 24 AS marked,
            CASE r WHEN 'system' THEN length(x) + 19 WHEN 'user' THEN length(x) + 15 WHEN 'assistant' THEN length(x) + 5 ELSE length(x) + 1 END AS instructed,
            CASE r WHEN 'system' THEN 0 WHEN 'user' THEN length(x) + 15 ELSE length(x) + 5 END AS body FROM turns),
        sums AS (SELECT *, sum(marked) OVER w AS m, sum(instructed) OVER w AS i, sum(body) OVER w AS b, count(*) FILTER (r = 'user') OVER w AS users,
            greatest(0, sum(CASE WHEN r = 'system' THEN n + 2 ELSE 0 END) OVER w - 2) AS s FROM sizes WINDOW w AS (PARTITION BY conv ORDER BY k)),
        heads AS (SELECT *, b + CASE WHEN users > 0 AND s > 0 THEN s + 2 ELSE 0 END AS l, coalesce(lag(s) OVER v, 0) AS s0, coalesce(lag(users) OVER v, 0) AS u0 FROM sums WINDOW v AS (PARTITION BY conv ORDER BY k)),
        moved AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY conv ORDER BY k), 0) AS l0, u0 > 0 AND (r = 'user' AND s > 0 OR r = 'system' AND s <> s0) AS rewrites FROM heads),
        late AS (SELECT *, max(CASE WHEN rewrites THEN k ELSE 0 END) OVER (PARTITION BY conv) AS last FROM moved)
        SELECT conv_id, 'marked' AS template, turn, r AS role, (m - marked)::bigint AS start, m::bigint AS "end", false AS rewrites, r = 'assistant' AS trained FROM late UNION ALL
        SELECT conv_id, 'instructed', turn, r, (i - instructed)::bigint, i::bigint, false, r = 'assistant' FROM late UNION ALL
        SELECT conv_id, 'late_system', turn, r, CASE WHEN NOT rewrites THEN l0::bigint END, CASE WHEN NOT rewrites THEN l::bigint END, rewrites, r = 'assistant' AND k > last FROM late"""

SQL = {
    "op6_chat_format": _CHATS,
    "op8_exact_dedup": """
        SELECT doc_id, duplicate_of FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> duplicate_of""",
}
