"""SQL that checks the audit queries independently, for a single-node database over the same tables."""

from __future__ import annotations

from pagestrata.plans.check_catalog import SEVERITY, rows

# Fixed values, written out here so that the SQL takes nothing from the engine but identifiers, severities and weights of the checks.
FULL_WIDTH = r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{4DBF}\x{4E00}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{2FA1F}"
ZERO_WIDTH = r"\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{20D0}-\x{20FF}"
UNSPACED = FULL_WIDTH + r"\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}"
NORM = """regexp_replace(
    lower(regexp_extract({u}, '^[^:/?#]+://[^/?#]*')), CASE WHEN {u} ILIKE 'https:%' THEN ':443$' ELSE ':80$' END, '')
  || CASE WHEN regexp_matches({u}, '^[^:/?#]+://[^/?#]*/?(#.*)?$') THEN '/'
     ELSE regexp_replace(split_part(regexp_replace({u}, '^[^:/?#]+://[^/?#]*', ''), '#', 1), '/$', '') END"""
NEEDS_ALT = "NOT coalesce(starts_with(lower(ltrim(i.src)), 'data:'), false) AND NOT (i.width IS NOT NULL AND i.height IS NOT NULL AND (i.width <= 1 OR i.height <= 1))"

SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def norm(u: str) -> str:
    return f"({NORM.format(u=u)})"


def _count(text: str, cls: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{cls}', '', 'g')))"


def _px(t: str, wide: int, upper: int, lower: int, narrow: int, digit: int, space: int) -> str:
    listed = f"[{FULL_WIDTH}{ZERO_WIDTH}A-Za-z0-9!.,:;|''\" ]"
    return (
        f"({_count(t, f'[{FULL_WIDTH}]')} * {2 * lower} + {_count(t, '[MWmw]')} * {wide} + {_count(t, '[A-LN-VX-Z]')} * {upper} + {_count(t, '[a-eghknop-su-vx-z]')} * {lower} + "
        f"""{_count(t, "[iltfj1!.,:;|''" + '"]')} * {narrow} + {_count(t, '[02-9]')} * {digit} + {_count(t, ' ')} * {space} + length(regexp_replace({t}, '{listed}', '', 'g')) * {lower})::INTEGER"""
    )


def _wide(t: str) -> str:
    return f"coalesce(length(regexp_replace({t}, '{SPACE}', '', 'g')) > 0 AND {_count(t, f'[{FULL_WIDTH}]')} * 2 >= length(regexp_replace({t}, '{SPACE}', '', 'g')), false)"


def _length(t: str) -> str:
    return f"length(regexp_replace({t}, '[{ZERO_WIDTH}]', '', 'g'))"


WORDS = f"({_count('body_text', f'[{UNSPACED}]')} + len(list_filter(regexp_split_to_array(body_text, '{SPACE}+'), lambda w: w <> '' AND NOT regexp_matches(w, '[{UNSPACED}]'))))"
PHRASES = "regexp_matches(lower(coalesce(body_text, '')) || chr(10) || lower(coalesce(title, '')), 'page not found|page doesn''t exist|no longer available|we can''t find|does not exist')"
P = f"""p AS (
  SELECT *, {norm('url')} AS url_key, status BETWEEN 200 AND 299 AS is_ok,
    coalesce(status BETWEEN 200 AND 299 AND regexp_matches(lower(content_type), 'text/html|application/xhtml\\+xml'), false) AS is_html,
    list_filter(list_transform(string_split(lower(coalesce(meta_robots, '')), ','), lambda t: trim(t)), lambda t: t <> '') AS directives
  FROM (SELECT DISTINCT ON (page_id) * FROM page_data WHERE page_id IS NOT NULL ORDER BY page_id)),
q AS (SELECT *, list_has_any(directives, ['noindex', 'none']) AS noindex, is_html AND NOT list_has_any(directives, ['noindex', 'none']) AS indexable,
    {_length('title')} AS title_length, {_px('title', 17, 13, 11, 6, 11, 5)} AS title_px, {_length('meta_description')} AS md_length, {_px('meta_description', 12, 9, 8, 4, 8, 4)} AS md_px,
    regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path
  FROM p)"""
ANCHORS = "'click here', 'read more', 'learn more', 'here', 'link', 'more', 'continue', 'click', 'this'"
LOCAL = "'^[^:/?#]+://(localhost|[^/?#:]*\\.localhost|127(\\.[0-9]{1,3}){3})([:/?#]|$)'"
# Predicate of each row-local check that the crawl table can decide.
PREDICATES = {
    "response_codes.internal_server_error": "status BETWEEN 500 AND 599",
    "response_codes.internal_client_error": "status BETWEEN 400 AND 499 AND status NOT IN (401, 403, 429)",
    "response_codes.internal_access_restricted": "status IN (401, 403, 429)",
    "response_codes.internal_no_response": "status = 0",
    "security.http_urls": "NOT starts_with(lower(url), 'https://')",
    "url.contains_space": "contains(url, '%20') OR contains(url, ' ')",
    "url.over_115_chars": "strlen(url) > 115",
    "url.contains_uppercase": "regexp_matches(regexp_replace(path, '%[0-9A-Fa-f]{2}', '', 'g'), '[A-Z]')",
    "url.contains_underscores": "contains(path, '_')",
    "url.has_parameters": "contains(url, '?')",
    "url.multiple_slashes": "contains(path, '//')",
    "url.non_ascii": "regexp_matches(path, '[^\\x00-\\x7F]|%[89A-Fa-f][0-9A-Fa-f]')",
    "url.repetitive_path": "len(list_distinct(list_filter(string_split(path, '/'), lambda s: s <> ''))) < len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
    "url.ga_tracking_params": "regexp_matches(lower(url), '[?&]utm_')",
    "page_titles.missing": "is_html AND coalesce(title, '') = ''",
    "page_titles.over_60_chars": f"indexable AND NOT {_wide('title')} AND title_length > 60",
    "page_titles.below_30_chars": f"indexable AND title <> '' AND NOT {_wide('title')} AND title_length < 30",
    "page_titles.over_561_pixels": "indexable AND title_px > 561",
    "page_titles.below_200_pixels": "indexable AND title <> '' AND title_px < 200",
    "meta_description.missing": "is_html AND coalesce(meta_description, '') = ''",
    "meta_description.over_155_chars": f"indexable AND NOT {_wide('meta_description')} AND md_length > 155",
    "meta_description.below_70_chars": f"indexable AND meta_description <> '' AND NOT {_wide('meta_description')} AND md_length < 70",
    "meta_description.over_985_pixels": "indexable AND md_px > 985",
    "headings.h1_missing": "is_html AND len(list_filter(coalesce(h1, []), lambda h: h IS NOT NULL AND trim(h) <> '')) = 0",
    "headings.h1_multiple": "indexable AND len(h1) > 1",
    "headings.h1_same_as_title": "h1[1] = title AND title <> ''",
    "headings.h1_over_70_chars": "indexable AND len(list_filter(h1, lambda h: length(h) > 70)) > 0",
    "content.soft_404": f"is_ok AND {PHRASES} AND coalesce({WORDS}, 0) < 100",
    "content.low_content": "word_count < 100 AND is_html",
    "content.readability_very_difficult": "readability_score < 10",
    "content.readability_difficult": "readability_score >= 10 AND readability_score < 30",
    "images.missing_alt_attribute": f"is_ok AND len(list_filter(images, lambda i: i.alt IS NULL AND {NEEDS_ALT})) > 0",
    "images.alt_over_100_chars": "is_ok AND len(list_filter(images, lambda i: length(i.alt) > 100)) > 0",
    "images.missing_dimensions": "is_ok AND len(list_filter(images, lambda i: i.width IS NULL OR i.height IS NULL)) > 0",
    "canonicals.missing": "is_html AND canonical IS NULL",
    "canonicals.canonicalised": f"canonical IS NOT NULL AND {norm('canonical')} <> url_key",
    **{f"directives.{d}": f"list_contains(directives, '{d}')" for d in ("noindex", "nofollow", "none", "nosnippet", "noimageindex")},
    "directives.noai_directive": "list_has_any(directives, ['noai', 'noimageai'])",
    "links.localhost_outlinks": f"len(list_filter(list_concat(coalesce(internal_links, []), coalesce(external_links, [])), lambda l: regexp_matches(lower(l.url), {LOCAL}))) > 0",
    "links.no_internal_outlinks": "is_html AND coalesce(len(internal_links), 0) = 0",
    "links.no_anchor_text": "is_ok AND len(list_filter(internal_links, lambda l: l.anchor IS NULL OR trim(l.anchor) = '')) > 0",
    "links.non_descriptive_anchor": f"is_ok AND len(list_filter(internal_links, lambda l: lower(trim(l.anchor)) IN ({ANCHORS}))) > 0",
    "links.internal_nofollow": "is_ok AND len(list_filter(internal_links, lambda l: l.nofollow)) > 0",
    "links.high_crawl_depth": "depth > 4",
    "links.high_external_outlinks": "len(external_links) > 100",
    "performance.slow_server_response": "is_html AND response_time_ms >= 1500",
}
REDIRECTS = {
    "internal_redirect_loop": "len(list_distinct(hops)) < len(hops)",
    "internal_redirect_chain": "len(hops) >= 2",
    "internal_redirect": "len(hops) = 1",
}


def _row(key: str, predicate: str) -> str:
    category, check = key.split(".")
    return f"SELECT crawl_id, '{category}' AS category, '{check}' AS \"check\", '{SEVERITY[category, check]}' AS severity, url FROM q WHERE {predicate}"


def _redirect(check: str, predicate: str) -> str:
    return f"SELECT crawl_id, 'response_codes', '{check}', '{SEVERITY['response_codes', check]}', hops[1] FROM (SELECT crawl_id, list_transform(redirect_chain, lambda h: h.url) AS hops FROM q) WHERE {predicate}"


ROW_ISSUES = "row_issues AS (" + "\nUNION ALL ".join([_row(k, v) for k, v in PREDICATES.items()] + [_redirect(k, v) for k, v in REDIRECTS.items()]) + ")"


def _shared(category: str, check: str, source: str, key: str) -> str:
    return f"SELECT crawl_id, '{category}' AS category, '{check}' AS \"check\", url FROM (SELECT crawl_id, url, {key} AS k, count(*) OVER (PARTITION BY crawl_id, {key}) AS n FROM q WHERE {source}) WHERE n > 1"


HASH = f"sha256(trim(regexp_replace(body_text, '{SPACE}+', ' ', 'g')))"
DUPLICATES = "duplicates AS (" + "\nUNION ALL ".join([
    _shared("page_titles", "duplicate", "indexable AND title <> ''", "title"),
    _shared("meta_description", "duplicate", "indexable AND meta_description <> ''", "meta_description"),
    _shared("headings", "h1_duplicate", "indexable AND h1[1] <> ''", "h1[1]"),
    _shared("content", "exact_duplicate", "indexable AND redirect_chain IS NULL AND body_text <> '' AND word_count > 0", HASH),
]) + ")"
ALIASES = f"""own AS (SELECT DISTINCT crawl_id, url_key AS requested FROM q),
hops AS (SELECT crawl_id, page_id, url_key, unnest(redirect_chain).url AS hop, generate_subscripts(redirect_chain, 1) AS pos FROM q),
moved AS (SELECT crawl_id, requested, arg_min(url_key, page_id * 1000 + pos) AS served FROM (SELECT *, {norm('hop')} AS requested FROM hops)
  WHERE (crawl_id, requested) NOT IN (SELECT crawl_id, requested FROM own) GROUP BY ALL HAVING requested <> served)"""
LINKS = f"""raw_links AS (SELECT crawl_id, page_id, url, url_key, is_ok, unnest(internal_links).url AS href FROM q),
links AS (SELECT DISTINCT crawl_id, page_id, url, url_key, is_ok, {norm('href')} AS link FROM raw_links WHERE href IS NOT NULL),
resolved AS (SELECT l.*, coalesce(m.served, l.link) AS target FROM links l LEFT JOIN moved m ON l.crawl_id = m.crawl_id AND l.link = m.requested)"""
LINK_ISSUES = """broken AS (SELECT DISTINCT r.crawl_id, r.url FROM resolved r JOIN q t ON t.crawl_id = r.crawl_id AND t.url_key = r.target
  WHERE r.is_ok AND t.status >= 400 AND t.status NOT IN (401, 403, 429)),
orphans AS (SELECT crawl_id, url FROM q WHERE is_ok AND depth > 0 AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.crawl_id = q.crawl_id AND r.target = q.url_key AND r.url_key <> q.url_key)),
link_issues AS (SELECT crawl_id, 'links' AS category, 'broken_internal' AS "check", url FROM broken UNION ALL SELECT crawl_id, 'links', 'orphan_pages', url FROM orphans)"""
CANONICAL = f"""targets AS (SELECT crawl_id, url_key, arg_max(status, page_id) AS t_status, arg_max(noindex, page_id) AS t_noindex, arg_max({norm('canonical')}, page_id) FILTER (canonical IS NOT NULL) AS next_key FROM q GROUP BY ALL),
start AS (SELECT crawl_id, url, url_key, is_ok, {norm('canonical')} AS k FROM q WHERE canonical IS NOT NULL AND {norm('canonical')} <> url_key),
hop AS (SELECT s.*, t.t_status, t.t_noindex, t.next_key FROM start s JOIN targets t ON t.crawl_id = s.crawl_id AND t.url_key = s.k),
canonical_issues AS (SELECT crawl_id, 'canonicals' AS category, 'canonical_loop' AS "check", url, k AS detail FROM hop WHERE next_key <> k AND next_key = url_key
  UNION ALL SELECT crawl_id, 'canonicals', 'canonical_chain', url, url_key || ' -> ' || k || ' -> ' || next_key FROM hop WHERE next_key <> k AND next_key <> url_key
  UNION ALL SELECT crawl_id, 'canonicals', 'non_indexable_target', url, k FROM hop WHERE is_ok AND (t_status >= 400 OR t_noindex))"""
GRAPH = """nodes AS (SELECT DISTINCT crawl_id, url_key AS node FROM q),
edges AS (SELECT DISTINCT r.crawl_id, r.url_key AS src, r.target AS dst FROM resolved r JOIN nodes n ON n.crawl_id = r.crawl_id AND n.node = r.target WHERE r.target <> r.url_key)"""
BASE = f"WITH RECURSIVE {P}"
WITH_LINKS = f"{BASE}, {ALIASES}, {LINKS}"
SEVERITIES = "severities AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', '{s}', '{t}')" for c, k, s, t, _ in rows()) + ') v(category, "check", severity, tier))'
ISSUES = f"""{ROW_ISSUES}, {DUPLICATES}, {LINK_ISSUES}, {CANONICAL}, {SEVERITIES},
issues AS (SELECT i.*, s.severity, s.tier FROM (SELECT crawl_id, category, "check", url FROM row_issues UNION ALL SELECT * FROM duplicates UNION ALL SELECT * FROM link_issues
  UNION ALL SELECT crawl_id, category, "check", url FROM canonical_issues) i JOIN severities s USING (category, "check"))"""
WITH_ISSUES = f"{WITH_LINKS}, {ISSUES}"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
SERVED = f"""served AS (SELECT i.*, coalesce(m.served, {norm('i.url')}) AS url_key FROM issues i LEFT JOIN moved m ON m.crawl_id = i.crawl_id AND m.requested = {norm('i.url')})"""
COUNTS = "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info"

ORACLE = {
    "row_checks": f"{BASE}, {ROW_ISSUES} SELECT * FROM row_issues",
    "duplicates": f"{BASE}, {DUPLICATES} SELECT * FROM duplicates",
    "canonical_checks": f"{BASE}, {CANONICAL} SELECT * FROM canonical_issues",
    "link_checks": f"{WITH_LINKS}, {LINK_ISSUES} SELECT * FROM link_issues",
    "alias_resolution": f"{BASE}, {ALIASES} SELECT * FROM moved",
    "link_degrees": f"""{WITH_LINKS}, {GRAPH} SELECT crawl_id, node, (SELECT count(*) FROM edges e WHERE e.crawl_id = n.crawl_id AND e.dst = n.node) AS in_degree,
  (SELECT count(*) FROM edges e WHERE e.crawl_id = n.crawl_id AND e.src = n.node) AS out_degree FROM nodes n""",
    "orphan_nodes": f"{WITH_LINKS}, {GRAPH} SELECT crawl_id, node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.crawl_id = n.crawl_id AND e.dst = n.node)",
    "component_sizes": f"""{WITH_LINKS}, {GRAPH}, both_ways AS (SELECT crawl_id, src AS a, dst AS b FROM edges UNION SELECT crawl_id, dst, src FROM edges),
reach AS (SELECT crawl_id, node, node AS seen FROM nodes UNION SELECT r.crawl_id, r.node, b.b FROM reach r JOIN both_ways b ON b.crawl_id = r.crawl_id AND b.a = r.seen),
named AS (SELECT crawl_id, node, min(seen) AS first_node FROM reach GROUP BY ALL) SELECT crawl_id, count(*) AS nodes, first_node FROM named GROUP BY crawl_id, first_node""",
    "pagerank": f"""{WITH_LINKS}, {GRAPH}, sized AS (SELECT crawl_id, count(*) AS n FROM nodes GROUP BY ALL), outs AS (SELECT crawl_id, src, count(*) AS o FROM edges GROUP BY ALL),
fixed AS MATERIALIZED (SELECT nodes.crawl_id, node, n, o FROM nodes JOIN sized USING (crawl_id) LEFT JOIN outs ON outs.crawl_id = nodes.crawl_id AND src = node),
ranks AS (SELECT 0 AS k, crawl_id, node, n, o, 1.0::DOUBLE / n AS r FROM fixed UNION ALL
  SELECT k, crawl_id, node, n, o, 0.15 / n + 0.85 * (sum(part) + lost / n) FROM (
    SELECT cur.k + 1 AS k, f.crawl_id, f.node, f.n, f.o, coalesce(g.part, 0) AS part, coalesce(l.lost, 0) AS lost
    FROM fixed f, (SELECT DISTINCT k FROM ranks) cur
    LEFT JOIN (SELECT e.crawl_id, e.dst, sum(r.r / r.o) AS part FROM edges e JOIN ranks r ON r.crawl_id = e.crawl_id AND r.node = e.src GROUP BY ALL) g ON g.crawl_id = f.crawl_id AND g.dst = f.node
    LEFT JOIN (SELECT crawl_id, sum(r) AS lost FROM ranks WHERE o IS NULL GROUP BY ALL) l ON l.crawl_id = f.crawl_id WHERE cur.k < 40) GROUP BY k, crawl_id, node, n, o, lost)
SELECT crawl_id, node, round(r, 9) AS pagerank FROM ranks WHERE k = 40""",
    "silos": f"{BASE} SELECT crawl_id, coalesce(nullif(string_split(path, '/')[2], ''), '(root)') AS silo, count(*) AS pages FROM q GROUP BY ALL",
    "severity_totals": f"{WITH_ISSUES} SELECT crawl_id, severity, count(*) AS found FROM issues GROUP BY ALL",
    "category_summary": f'{WITH_ISSUES} SELECT crawl_id, category, count(DISTINCT "check") AS checks, count(*) AS found, {COUNTS}, count(DISTINCT url) AS urls FROM issues GROUP BY ALL',
    "check_counts": f'{WITH_ISSUES} SELECT crawl_id, category, "check", severity, count(*) AS found, count(DISTINCT url) AS urls FROM issues GROUP BY ALL',
    "page_issue_counts": f"{WITH_ISSUES}, {SERVED} SELECT crawl_id, url_key, {COUNTS}, count(*) AS total FROM served GROUP BY ALL",
    "worst_pages": f"{WITH_ISSUES}, {SERVED} SELECT * FROM (SELECT crawl_id, url_key, {COUNTS}, count(*) AS total FROM served GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY total DESC, url_key) <= 10",
    "top_issues": f"""{WITH_ISSUES} SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY {RANK}, found DESC, category, "check")::INTEGER AS place
FROM (SELECT crawl_id, category, "check", severity, count(*) AS found FROM issues GROUP BY ALL) QUALIFY place <= 3""",
    "health_score": f"""{WITH_ISSUES}, sized AS (SELECT crawl_id, count(*) AS pages FROM q GROUP BY ALL),
hit AS (SELECT crawl_id, count(*) FILTER (b) AS broken, count(*) FILTER (NOT b) AS defective FROM (SELECT crawl_id, url, bool_or(tier = 'broken') AS b FROM issues WHERE tier IN ('broken', 'defective') GROUP BY ALL) GROUP BY crawl_id),
per AS (SELECT i.crawl_id, category, "check", tier, severity, least(1, greatest(0.12, sqrt(count(*) / any_value(pages)))) AS cov, count(DISTINCT url) AS urls FROM issues i JOIN sized USING (crawl_id) GROUP BY ALL),
sums AS (SELECT crawl_id, coalesce(sum(12.0 * cov) FILTER (tier = 'site_high'), 0)::DOUBLE AS high, coalesce(sum(4.0 * cov) FILTER (tier = 'site_medium'), 0)::DOUBLE AS medium, coalesce(sum(cov) FILTER (tier = 'minor'), 0)::DOUBLE AS small,
  coalesce(max(urls) FILTER ("check" = 'low_content'), 0) AS thin, coalesce(max(urls) FILTER ("check" = 'exact_duplicate'), 0) AS same, coalesce(max(urls) FILTER ("check" = 'no_internal_outlinks'), 0) AS linkless,
  bool_or(severity = 'critical') AS crit, bool_or(severity = 'warning') AS warn FROM per GROUP BY ALL),
wall AS (SELECT crawl_id, count(DISTINCT url) AS unreached FROM issues WHERE category = 'response_codes' AND "check" IN ('internal_server_error', 'internal_client_error', 'internal_no_response', 'internal_access_restricted') GROUP BY ALL),
pts AS (SELECT s.crawl_id, pages, coalesce(broken, 0) AS broken, coalesce(defective, 0) AS defective, coalesce(unreached, 0) AS unreached, thin, same, linkless, crit, warn,
  100.0::DOUBLE * least(1, coalesce(broken, 0) / greatest(pages, 5)) AS bp, 55.0::DOUBLE * least(1, coalesce(defective, 0) / greatest(pages, 5)) AS dp, least(coalesce(high, 0), 24) + least(coalesce(medium, 0), 14) AS sp, least(coalesce(small, 0), 12) AS mp
  FROM sized s LEFT JOIN hit USING (crawl_id) LEFT JOIN sums USING (crawl_id) LEFT JOIN wall USING (crawl_id)),
graded AS (SELECT *, unreached > 0 AND unreached >= pages AS blocked, thin / pages >= 0.8 AND (same / pages >= 0.8 OR linkless / pages >= 0.8) AS unread, floor(greatest(round(100 - (bp + dp + sp + mp), 9), 0))::INTEGER AS raw FROM pts)
SELECT crawl_id, pages, broken::BIGINT AS broken, defective::BIGINT AS defective, CASE WHEN blocked OR unread THEN 0 ELSE raw END AS score,
  CASE WHEN blocked OR unread THEN '–' WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN blocked THEN 'Crawl blocked' WHEN unread THEN 'No readable content' WHEN raw >= 90 THEN 'Excellent' WHEN raw >= 80 THEN 'Good' WHEN raw >= 70 THEN 'Needs Work' WHEN raw >= 60 THEN 'Poor'
    WHEN crit THEN 'Critical' WHEN warn THEN 'Widespread Warnings' ELSE 'Many Minor Issues' END AS verdict,
  round(bp, 6) AS broken_points, round(dp, 6) AS defective_points, round(sp, 6) AS site_points, round(mp, 6) AS minor_points FROM graded""",
    "query_issues": f"""{WITH_ISSUES}, {SERVED}, kept AS (SELECT category, "check", severity, url FROM served WHERE crawl_id = 1 AND severity = 'warning' AND (url LIKE '%/shop/%' OR url_key IN (SELECT url_key FROM q WHERE crawl_id = 1 AND url LIKE '%/shop/%'))),
counted AS (SELECT *, row_number() OVER (ORDER BY total_urls DESC, category, "check") AS place, greatest(1, ceil(count(*) OVER () / 20.0))::INTEGER AS page_count
  FROM (SELECT category, "check", severity, count(*) AS total_urls FROM kept GROUP BY ALL))
SELECT category, "check", severity, total_urls, url, url_no, page_count FROM (SELECT *, row_number() OVER (PARTITION BY category, "check" ORDER BY url)::INTEGER AS url_no FROM kept) JOIN counted USING (category, "check", severity) WHERE place <= 20 AND url_no <= 500""",
    "query_all_issues": f"""{WITH_ISSUES}, {SERVED}, kept AS (SELECT crawl_id, category, "check", severity, url FROM served WHERE severity = 'warning' AND (url LIKE '%/shop/%' OR (crawl_id, url_key) IN (SELECT crawl_id, url_key FROM q WHERE url LIKE '%/shop/%'))),
counted AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY total_urls DESC, category, "check") AS place, greatest(1, ceil(count(*) OVER (PARTITION BY crawl_id) / 20.0))::INTEGER AS page_count
  FROM (SELECT crawl_id, category, "check", severity, count(*) AS total_urls FROM kept GROUP BY ALL))
SELECT crawl_id, category, "check", severity, total_urls, url, url_no, page_count FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, category, "check" ORDER BY url)::INTEGER AS url_no FROM kept) JOIN counted USING (crawl_id, category, "check", severity) WHERE place <= 20 AND url_no <= 500""",
    "compare_crawls": f"""{WITH_ISSUES}, {SERVED}, roles AS (SELECT crawl_id, crawl_id = max(crawl_id) OVER (PARTITION BY site_id) AS latest FROM crawls),
found AS (SELECT DISTINCT latest, category, "check", url_key FROM served JOIN roles USING (crawl_id))
SELECT category, "check", url_key, CASE WHEN bool_and(latest) THEN 'new' ELSE 'resolved' END AS change FROM found GROUP BY category, "check", url_key HAVING count(DISTINCT latest) = 1""",
    "compare_consecutive": f"""{WITH_ISSUES}, {SERVED}, pairs AS (SELECT * FROM (SELECT crawl_id AS crawl_a, lead(crawl_id) OVER (PARTITION BY site_id ORDER BY crawl_date NULLS FIRST, crawl_id) AS crawl_b FROM crawls WHERE site_id IS NOT NULL) WHERE crawl_b IS NOT NULL),
keyed AS (SELECT DISTINCT crawl_id, category, "check", url_key FROM served),
before AS (SELECT crawl_a, crawl_b, category, "check", url_key FROM pairs JOIN keyed ON crawl_id = crawl_a), after AS (SELECT crawl_a, crawl_b, category, "check", url_key FROM pairs JOIN keyed ON crawl_id = crawl_b)
SELECT *, 'new' AS change FROM (SELECT * FROM after EXCEPT SELECT * FROM before) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM before EXCEPT SELECT * FROM after)""",
    "list_crawls": "SELECT crawl_id, domain, crawl_date, pages_crawled FROM crawls ORDER BY crawl_date DESC NULLS LAST, crawl_id DESC LIMIT 20",
    "crawl_summary": f"""{BASE} SELECT crawl_id, count(*) AS pages, floor(sum(response_time_ms) / count(*))::BIGINT AS mean_response_ms, sum(word_count)::BIGINT AS words, floor(sum(word_count) / count(*))::BIGINT AS mean_words,
  sum(coalesce(len(internal_links), 0))::BIGINT AS internal_links, sum(coalesce(len(external_links), 0))::BIGINT AS external_links, sum(coalesce(len(images), 0))::BIGINT AS images,
  sum(coalesce(len(list_filter(images, lambda i: i.alt IS NULL AND {NEEDS_ALT})), 0))::BIGINT AS images_without_alt, 0::BIGINT AS pages_with_schema, floor(quantile_cont(response_time_ms, 0.5))::BIGINT AS p50_response_ms, quantile_disc(response_time_ms, 0.95)::BIGINT AS p95_response_ms FROM q GROUP BY crawl_id""",
    "status_counts": f"{BASE} SELECT crawl_id, status, count(*) AS pages FROM q GROUP BY ALL",
    "status_classes": f"""{BASE} SELECT *, round(100.0::DOUBLE * pages / sum(pages) OVER (PARTITION BY crawl_id), 6) AS percent
FROM (SELECT crawl_id, (status // 100)::VARCHAR || 'xx' AS status_class, count(*) AS pages FROM q WHERE status BETWEEN 200 AND 599 GROUP BY ALL)""",
    "response_histogram": f"""{BASE} SELECT crawl_id, CASE WHEN response_time_ms < 200 THEN '0-199' WHEN response_time_ms < 500 THEN '200-499' WHEN response_time_ms < 1000 THEN '500-999' ELSE '1000+' END AS bucket, count(*) AS pages
FROM q WHERE response_time_ms IS NOT NULL GROUP BY ALL""",
    "depth_distribution": f"""{BASE} SELECT s.crawl_id, s.depth, count(q.page_id) AS pages FROM (SELECT crawl_id, unnest(range(0, max(depth) + 1))::INTEGER AS depth FROM q WHERE depth IS NOT NULL GROUP BY crawl_id) s
LEFT JOIN q ON q.crawl_id = s.crawl_id AND q.depth = s.depth GROUP BY ALL""",
    "directory_tree": f"""{BASE}, parts AS (SELECT crawl_id, list_slice(list_filter(string_split(path, '/'), lambda s: s <> ''), 1, 24) AS a FROM q)
SELECT crawl_id, directory, count(*) AS pages FROM (SELECT crawl_id, '/' || array_to_string(list_slice(a, 1, unnest(range(0, len(a) + 1))), '/') AS directory FROM parts) GROUP BY ALL""",
    "script_rendering": f"""{BASE}, n AS (SELECT crawl_id, count(*) FILTER (is_html AND status = 200 AND coalesce(word_count, 0) = 0 AND coalesce(body_text, '') = '') AS empty, count(*) FILTER (is_html AND status = 200) AS considered FROM q GROUP BY ALL)
SELECT *, considered > 0 AND coalesce(100 * empty // nullif(considered, 0), 0) > 25 AS suspected FROM n""",
    "url_parts": f"""{BASE}, l AS (SELECT DISTINCT page_id, unnest(internal_links).url AS url FROM q)
SELECT page_id, url, {norm('url')} AS url_key, lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
  coalesce(nullif(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/')[2], ''), '(root)') AS segment, string_split(url, '#')[1] AS bare FROM l""",
    "text_measures": f"{BASE} SELECT page_id, title_length::INTEGER AS title_length, title_px AS title_pixel_width, md_length::INTEGER AS meta_description_length, md_px AS meta_description_pixel_width, {WORDS}::INTEGER AS words FROM q",
    "reading_scores": f"""{BASE}, t AS (SELECT page_id, body_text, list_filter(regexp_split_to_array(body_text, '{SPACE}+'), lambda w: w <> '') AS w, greatest(1, len(regexp_extract_all(body_text, '[.!?]+'))) AS s,
  length(regexp_replace(body_text, '[^\\p{{L}}\\p{{Nl}}]', '', 'g')) AS letters, length(regexp_replace(regexp_replace(body_text, '[^\\p{{L}}\\p{{Nl}}]', '', 'g'), '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g')) AS latin FROM q),
y AS (SELECT *, list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: CASE WHEN x = '' THEN 0 WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') THEN 1 ELSE 0 END) END)) AS syl FROM t)
SELECT page_id, CASE WHEN len(w) > 0 AND letters >= 10 AND latin * 2 >= letters AND len(w) // s <= 40 THEN round(greatest(0, least(100, 206.835::DOUBLE - 1.015::DOUBLE * (len(w) / s) - 84.6::DOUBLE * (syl / len(w)))), 6) END AS reading_ease FROM y""",
    "sitemap_urls": f"""{BASE}, u AS (SELECT DISTINCT crawl_id, url FROM q WHERE indexable AND (canonical IS NULL OR {norm('canonical')} = url_key OR canonical = url) AND strlen(url) <= 2048)
SELECT crawl_id, ((row_number() OVER w - 1) // 50000)::INTEGER AS file_no, (row_number() OVER w - 1)::BIGINT AS position, url FROM u WINDOW w AS (PARTITION BY crawl_id ORDER BY url)""",
    "events_hourly": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "events_sessions": """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM m) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM n GROUP BY user_id, no""",
}

# Answers composed of the ones above, written as joins of them.
_PART = lambda name: f"({ORACLE[name]})"
ORACLE["crawl_answer"] = f"""SELECT s.crawl_id, s.score, s.grade, s.verdict, m.pages, m.mean_response_ms, m.p50_response_ms, m.p95_response_ms, coalesce(t.total, 0)::BIGINT AS total, coalesce(t.critical, 0)::BIGINT AS critical, coalesce(t.warning, 0)::BIGINT AS warning,
  coalesce(t.info, 0)::BIGINT AS info, k.top_categories, w.worst_pages FROM {_PART("health_score")} s JOIN {_PART("crawl_summary")} m USING (crawl_id)
LEFT JOIN (SELECT crawl_id, sum(found) AS total, sum(found) FILTER (severity = 'critical') AS critical, sum(found) FILTER (severity = 'warning') AS warning, sum(found) FILTER (severity = 'info') AS info FROM {_PART("severity_totals")} GROUP BY ALL) t USING (crawl_id)
LEFT JOIN (SELECT crawl_id, string_agg(category || ':' || found || ':' || urls, '|' ORDER BY found DESC, category) AS top_categories FROM (SELECT * FROM {_PART("category_summary")} QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY found DESC, category) <= 10) GROUP BY ALL) k USING (crawl_id)
LEFT JOIN (SELECT crawl_id, string_agg(url_key || ':' || total, '|' ORDER BY total DESC, url_key) AS worst_pages FROM {_PART("worst_pages")} GROUP BY ALL) w USING (crawl_id)"""
ORACLE["score_changes"] = f"""{WITH_ISSUES}, {SERVED}, pairs AS (SELECT * FROM (SELECT crawl_id AS crawl_a, lead(crawl_id) OVER (PARTITION BY site_id ORDER BY crawl_date NULLS FIRST, crawl_id) AS crawl_b FROM crawls WHERE site_id IS NOT NULL) WHERE crawl_b IS NOT NULL),
keyed AS (SELECT DISTINCT crawl_id, "check", url_key FROM served), was AS (SELECT crawl_a, crawl_b, "check", url_key FROM pairs JOIN keyed ON crawl_id = crawl_a), now AS (SELECT crawl_a, crawl_b, "check", url_key FROM pairs JOIN keyed ON crawl_id = crawl_b),
fresh AS (SELECT crawl_a, crawl_b, count(*) AS new_issues, count(DISTINCT url_key) AS regressed_urls FROM (SELECT * FROM now EXCEPT SELECT * FROM was) GROUP BY ALL), gone AS (SELECT crawl_a, crawl_b, count(*) AS resolved_issues FROM (SELECT * FROM was EXCEPT SELECT * FROM now) GROUP BY ALL),
s AS (SELECT * FROM {_PART("health_score")})
SELECT p.crawl_a, p.crawl_b, a.score AS score_from, a.grade AS grade_from, b.score AS score_to, b.grade AS grade_to, b.score - a.score AS score_delta, coalesce(new_issues, 0) AS new_issues, coalesce(resolved_issues, 0) AS resolved_issues, coalesce(regressed_urls, 0) AS regressed_urls
FROM pairs p JOIN s a ON a.crawl_id = p.crawl_a JOIN s b ON b.crawl_id = p.crawl_b LEFT JOIN fresh f ON f.crawl_a = p.crawl_a AND f.crawl_b = p.crawl_b LEFT JOIN gone g ON g.crawl_a = p.crawl_a AND g.crawl_b = p.crawl_b"""
