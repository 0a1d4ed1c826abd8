"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weekpanel.llm import (
    decontaminate,
    exact_dedup,
    licences,
    main_text,
    manifest,
    mixing,
    near_join,
    personal_data,
    quality,
    sharding,
    spelling,
    token_file,
    url_filter,
)
from weekpanel.llm.shared import Staging, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("op4_sharding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.contiguous_shards(read_table(spark, folder, "documents"))
    return placed.selectExpr("*", "CAST(NULL AS INT) AS grown_shard")


@query(
    "op6_exact_dedup",
    """
    WITH n AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
            AS text_sha256
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
    FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(read_table(spark, folder, "documents"))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_join.near_groups(read_table(spark, folder, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op1_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    )


@query("op9_licence_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_notices(read_table(spark, folder, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op2_mixing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.document_rates(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op8_personal_data")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(read_table(spark, folder, "documents"))


@query("op5_token_file")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = Staging(spark, "token-file").path("ids")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_file.write_token_file(read_table(spark, folder, "documents"), path, str(tokenizer))
    return token_file.read_token_file(spark, path)


@query("op7_main_text")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(read_table(spark, folder, "pages"))


@query("op11_merkle_manifest")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verified_documents(read_table(spark, folder, "documents"))


#: Verdict, host and path; the rule ``org/`` fits example.org and all its subdomains.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)

_HOST = "translate(regexp_extract({0}, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '^[^/?]*([^?]*)', 1)"
_QUERY = "CASE WHEN instr({0}, '?') > 0 THEN substr({0}, instr({0}, '?')) ELSE '' END"
_REST = "CASE WHEN instr({0}, '://') > 0 THEN split_part(substr({0}, instr({0}, '://') + 3), '#', 1) END"
_NODE = f"CASE WHEN {_HOST} <> '' THEN {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || {_QUERY} END"
_FOUND = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.name}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.name))
)
_ATTRIBUTE = r"""CASE WHEN regexp_matches(tag, '(?is)\s{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)') THEN regexp_replace(
    trim(regexp_extract(tag, '(?is)\s{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"'' ' || chr(9) || chr(10) || chr(13)),
    '&(?:amp|#38|#[xX]26);', '&', 'g') END"""
_DOTS = """CASE WHEN contains({0}, '/.') THEN array_to_string(list_reduce(string_split({0}, '/'), lambda done, part:
    CASE WHEN part = '.' THEN done WHEN part = '..' THEN done[1 : greatest(len(done) - 1, 1)]
    ELSE list_append(done, part) END, CAST([] AS VARCHAR[])), '/')
    || CASE WHEN string_split({0}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {0} END"""


@query(
    "op12_url_filter",
    rf"""
    WITH RECURSIVE parsed AS (SELECT page_id, url, html, {_REST.format("url")} AS rest FROM pages),
    judged AS (
        SELECT *, coalesce({_HOST.format("rest")}, '') AS host, coalesce({_PATH.format("rest")}, '') AS path,
            {_NODE.format("rest")} AS node
        FROM parsed
    ),
    tags AS (
        SELECT url, host, path, node, unnest(regexp_extract_all(
            regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\s[^>]*>')) AS tag
        FROM judged WHERE host <> ''
    ),
    links AS (
        SELECT *, split_part(CASE
            WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_ATTRIBUTE.format("rel")}, '(?i)(?:^|\s)canonical(?:\s|$)')
                THEN {_ATTRIBUTE.format("href")}
            WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_ATTRIBUTE.format("http-equiv")}) = 'refresh'
                THEN trim(regexp_extract({_ATTRIBUTE.format("content")},
                    '(?is)^[\s\d.]*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)) END, '#', 1) AS link
        FROM tags
    ),
    parts AS (
        SELECT *, split_part(url, '://', 1) AS scheme, CASE WHEN path = '' THEN '/' ELSE path END AS place,
            split_part(link, '?', 1) AS link_path, {_QUERY.format("link")} AS link_query,
            {_REST.format("link")} AS link_rest
        FROM links WHERE link IS NOT NULL
    ),
    targets AS (
        SELECT node AS a, CASE
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {_HOST.format("link_rest")}
                || {_DOTS.format(_PATH.format("link_rest"))} || {_QUERY.format("link_rest")}
            WHEN starts_with(link, '//') THEN substr(link, 3)
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
            WHEN starts_with(link, '/') THEN host || {_DOTS.format("link_path")} || link_query
            WHEN link_path = '' THEN host || place || link_query
            ELSE host || {_DOTS.format("(regexp_replace(place, '[^/]*$', '') || link_path)")} || link_query END AS target
        FROM parts
    ),
    edges AS (SELECT a, {_NODE.format("target")} AS b FROM targets WHERE target <> ''),
    both_ways AS (
        SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
    ),
    reached AS (
        SELECT a AS node, a AS other FROM both_ways
        UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON e.a = r.other
    ),
    nodes AS (
        SELECT node, other, {_HOST.format("other")} AS host, {_PATH.format("other")} AS path FROM reached
    ),
    classes AS (
        SELECT node, min(other) AS alias_of, min(split_part(CASE {_FOUND} END, ' ', 1)) AS verdict FROM nodes GROUP BY node
    ),
    ruled AS (SELECT page_id, host, path, node, CASE {_FOUND} END AS found FROM judged)
    SELECT page_id, host, path, CASE WHEN found IS NOT NULL THEN split_part(found, ' ', 2) END AS rule,
        coalesce(CASE WHEN found IS NOT NULL THEN split_part(found, ' ', 1) END, verdict, 'allow') AS verdict, alias_of
    FROM ruled LEFT JOIN classes USING (node)
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged_pages(read_table(spark, folder, "pages"), URL_RULES)


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(read_table(spark, folder, "documents"))
