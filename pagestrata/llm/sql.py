"""SQL for the text queries that a plain database can express; the others are tested in tests/llm."""

FLAT = "regexp_replace(replace(replace(replace(replace(lower(upper({c})), 'ß', 'ss'), 'ẞ', 'ss'), 'ſ', 's'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+|[\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
SOLID = r"'[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'"
GROUPS = f"""records AS (SELECT DISTINCT page_id, title, meta_description FROM page_data WHERE page_id IS NOT NULL AND regexp_matches(title, {SOLID}) AND regexp_matches(meta_description, {SOLID})),
flat AS (SELECT page_id, {FLAT.format(c="title")} AS a, {FLAT.format(c="meta_description")} AS b FROM records),
grouped AS (SELECT page_id, min(page_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS keep_id FROM flat)"""
SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ORACLE = {
    "p4_found": f"WITH {GROUPS} SELECT keep_id, page_id FROM grouped WHERE keep_id <> page_id",
    "p4_copies": f"WITH {GROUPS} SELECT keep_id, count(*) AS copies FROM grouped GROUP BY keep_id",
    "p6_found": f"""WITH once AS (SELECT DISTINCT page_id, body_text FROM page_data WHERE page_id IS NOT NULL AND body_text IS NOT NULL),
t AS (SELECT page_id, list_filter(regexp_split_to_array(body_text, '{SPACE}+'), lambda w: w <> '') AS w, greatest(1, len(regexp_extract_all(body_text, '[.!?]+'))) AS s,
  length(regexp_replace(body_text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(regexp_replace(body_text, '[^\\p{{L}}]', '', 'g'), '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g')) AS latin FROM once),
y AS (SELECT *, list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: CASE WHEN x = '' THEN 0 WHEN length(x) <= 3 THEN 1
  ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') THEN 1 ELSE 0 END) END)) AS syl FROM t WHERE len(w) > 0 AND letters >= 10 AND latin * 2 >= letters AND len(w) // s <= 40),
z AS (SELECT page_id, greatest(0, 206.835::DOUBLE - 1.015::DOUBLE * (len(w) / s) - 84.6::DOUBLE * (syl / len(w))) AS ease FROM y)
SELECT page_id, CASE WHEN ease < 10 THEN 'readability_very_difficult' ELSE 'readability_difficult' END AS band FROM z WHERE ease < 30""",
    "p7_found": """WITH once AS (SELECT DISTINCT page_id, body_text FROM page_data WHERE page_id IS NOT NULL AND status = 200 AND word_count >= 120),
w AS (SELECT page_id, regexp_extract_all(lower(body_text), '[\\p{L}\\p{N}]+') AS w FROM once),
g AS (SELECT DISTINCT page_id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT page_id, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.page_id AS page_id_a, b.page_id AS page_id_b, count(*) AS c FROM g a JOIN g b ON a.h = b.h AND a.page_id < b.page_id GROUP BY ALL)
SELECT page_id_a, page_id_b FROM c JOIN n x ON x.page_id = page_id_a JOIN n y ON y.page_id = page_id_b WHERE c >= 0.5 * (x.n + y.n - c)""",
}
