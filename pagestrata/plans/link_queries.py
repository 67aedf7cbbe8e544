"""Queries of eager aggregation and nested records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagestrata.operators import eager, nested
from pagestrata.runtime import table

NORM = """regexp_replace(
    lower(regexp_extract({u}, '^[^:/?#]+://[^/?#]*')), CASE WHEN {u} ILIKE 'https:%' THEN ':443$' ELSE ':80$' END, '')
  || CASE WHEN regexp_matches({u}, '^[^:/?#]+://[^/?#]*/?(#.*)?$') THEN '/'
     ELSE regexp_replace(split_part(regexp_replace({u}, '^[^:/?#]+://[^/?#]*', ''), '#', 1), '/$', '') END"""
LINKS_SQL = f"""
pages AS (SELECT DISTINCT page_id, crawl_id, domain, url, {NORM.format(u="url")} AS own FROM page_data WHERE page_id IS NOT NULL),
raw AS (SELECT page_id, crawl_id, unnest(internal_links).url AS link FROM page_data WHERE page_id IS NOT NULL),
links AS (SELECT DISTINCT page_id, crawl_id, {NORM.format(u="link")} AS target FROM raw WHERE link IS NOT NULL),
counted AS (SELECT l.crawl_id, l.target, count(*) AS n FROM links l JOIN pages p USING (page_id) WHERE l.target <> p.own GROUP BY ALL)"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.wrong_in_degrees(table(spark, sf_dir, "ranked_pages"), table(spark, sf_dir, "page_data"))


def p1_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.in_degrees(table(spark, sf_dir, "page_data"))


def p1_site_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eager.site_in_degrees(table(spark, sf_dir, "page_data"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_records(table(spark, sf_dir, "crawl_results"))


def _flat(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ancestor, fields = nested.TABLES[name]
        return nested.flat_table(nested.triples(table(spark, sf_dir, "crawl_results")), ancestor, fields)

    return query


QUERIES = {
    "p1_found": p1_found,
    "p1_in_degrees": p1_in_degrees,
    "p1_site_in_degrees": p1_site_in_degrees,
    "p3_found": p3_found,
    **{f"p3_{name}": _flat(name) for name in nested.TABLES},
}
ORACLE = {
    "p1_found": f"""WITH {LINKS_SQL},
ranked AS (SELECT DISTINCT rank_id, crawl_id, in_degree, {NORM.format(u="url")} AS target FROM ranked_pages WHERE rank_id IS NOT NULL)
SELECT rank_id FROM ranked LEFT JOIN counted USING (crawl_id, target) WHERE in_degree IS DISTINCT FROM coalesce(n, 0)""",
    "p1_in_degrees": f"""WITH {LINKS_SQL}
SELECT page_id, coalesce(n, 0)::BIGINT AS in_degree FROM pages p LEFT JOIN counted c ON p.crawl_id = c.crawl_id AND p.own = c.target""",
    "p1_site_in_degrees": f"""WITH {LINKS_SQL}
SELECT domain, count(*)::BIGINT AS pages, sum(coalesce(n, 0))::BIGINT AS in_links
FROM pages p LEFT JOIN counted c ON p.crawl_id = c.crawl_id AND p.own = c.target GROUP BY domain""",
}

# Nested payloads, by the database's own JSON functions.
_TYPE = lambda j: f"coalesce(json_type({j}), 'NULL')"
_LIST = lambda j: f"json_extract({j}, '$[*]')"


def _items(j: str, texts: bool = False) -> str:
    """Elements of an array, of a text that holds one, or the single element in its place."""
    inner = f"CASE WHEN ltrim({j} ->> '$') LIKE '[%' AND json_valid({j} ->> '$') THEN {_LIST(f'CAST({j} ->> ' + chr(39) + '$' + chr(39) + ' AS JSON)')}" + (f" WHEN trim({j} ->> '$') <> '' THEN [{j}]" if texts else "") + " END"
    return f"CASE {_TYPE(j)} WHEN 'ARRAY' THEN {_LIST(j)} WHEN 'OBJECT' THEN [{j}] WHEN 'VARCHAR' THEN {inner} END"


def _child(name: str, source: str, items: str, kept: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT {kept}, unnest({items}) AS e, generate_subscripts({items}, 1)::INTEGER - 1 AS pos FROM {source}) WHERE {_TYPE('e')} <> 'NULL')"


RECORDS = f"""payloads AS (SELECT DISTINCT result_id, ltrim(payload, chr(65279)) AS t FROM crawl_results WHERE result_id IS NOT NULL),
parsed AS (SELECT result_id, CAST(t AS JSON) AS j FROM payloads WHERE json_valid(t)),
bare AS (SELECT result_id, CASE {_TYPE('j')} WHEN 'ARRAY' THEN CASE WHEN json_array_length(j) = 1 THEN j -> '$[0]' END ELSE j END AS j FROM parsed),
records AS (SELECT result_id, CASE WHEN {_TYPE("j -> '$.result'")} = 'OBJECT' THEN j -> '$.result' WHEN {_TYPE("j -> '$.data.crawl'")} = 'OBJECT' THEN j -> '$.data.crawl' ELSE j END AS j FROM bare WHERE {_TYPE('j')} = 'OBJECT'),
listed AS (SELECT result_id, j -> '$.pages' AS pages, CASE WHEN json_exists(j, '$.issues.issues') THEN j -> '$.issues.issues' ELSE j -> '$.issues' END AS issues FROM records),
{_child('pages', 'listed', _items('pages'), 'result_id')}, {_child('issues', 'listed', _items('issues'), 'result_id')},
{_child('internal_links', 'pages', _items("(e -> '$.internal_links')"), 'result_id, pos AS parent_pos')}, {_child('images', 'pages', _items("(e -> '$.images')"), 'result_id, pos AS parent_pos')},
{_child('issue_urls', 'issues', _items("(e -> '$.urls')", True), 'result_id, pos AS parent_pos')}"""


def _flat_sql(name: str, fields: list[str]) -> str:
    value = lambda f: f"CASE WHEN {_TYPE(f'e -> {chr(39)}$.{f}{chr(39)}')} NOT IN ('OBJECT', 'ARRAY') THEN e ->> '$.{f}' END"
    own = f"CASE WHEN {_TYPE('e')} NOT IN ('OBJECT', 'ARRAY') THEN e ->> '$' END"
    columns = ", ".join(f"coalesce({value(f)}, {own}) AS \"{f}\"" if k == 0 else f"{value(f)} AS \"{f}\"" for k, f in enumerate(fields))
    parent = "parent_pos" if name in ("internal_links", "images", "issue_urls") else "0::INTEGER AS parent_pos"
    return f"WITH {RECORDS} SELECT result_id, {parent}, pos AS child_pos, {columns} FROM {name}"


_KIND = {"page": "pages", "issue": "issues", "internal_link": "internal_links", "image": "images", "issue_url": "issue_urls"}
ORACLE["p3_found"] = f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT result_id, '{k}' AS kind, {'0::INTEGER' if k in ('page', 'issue') else 'parent_pos'} AS parent_pos, pos AS child_pos FROM {t}" for k, t in _KIND.items())
ORACLE |= {f"p3_{name}": _flat_sql(name, fields) for name, (_, fields) in nested.TABLES.items()}
