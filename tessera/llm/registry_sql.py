"""DuckDB SQL for the queries whose operator SQL can express."""

from __future__ import annotations

from tessera.llm import licenses, mixing

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# The mix: sizes, targets by sharing again until none is over its cap, places in the shuffled streams, then the golden
# points one by one, each to the source whose share of the cumulative targets holds it. Blocks that a source lacks when
# the points are drawn come after them.
OP2 = f"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, sid % 3 + 1 AS weight, 3 * source_size AS cap, 3.0::DOUBLE * source_size / (sid % 3 + 1) AS ratio FROM sources
), summed AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS passed,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighted WINDOW w AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - caps)::DOUBLE / (weights - passed)::DOUBLE AS level FROM summed
), final AS (
  SELECT *, (SELECT level FROM levels WHERE cap >= level * weight ORDER BY ratio, sid LIMIT 1) AS final FROM levels
), aimed AS MATERIALIZED (
  SELECT source, sid, source_size, total,
    CASE WHEN final IS NULL OR cap < final * weight THEN cap::DOUBLE ELSE final * weight END AS target FROM final
), shares AS (
  SELECT *, sum(target) OVER (ORDER BY sid) / nullif(sum(target) OVER (), 0) AS high,
    ceil(round(target) / {mixing.BLOCK_WORDS})::BIGINT AS needed, ceil(total / {mixing.BLOCK_WORDS})::BIGINT AS drawn
  FROM aimed
), ends AS MATERIALIZED (
  SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM shares
), points AS (
  SELECT i AS slot, (i * {mixing.GOLDEN} % {mixing.POINTS}) / {mixing.POINTS}::DOUBLE AS point
  FROM unnest(range((SELECT max(drawn) FROM ends))) r(i)
), turns AS (
  SELECT slot, sid, needed, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block
  FROM points JOIN ends ON point >= low AND point < high
), blocks AS (
  SELECT slot, sid, block FROM turns WHERE block < needed
  UNION ALL
  SELECT block * 1000000 + sid + drawn, sid, block
  FROM (SELECT *, unnest(range((SELECT count(*) FROM turns WHERE turns.sid = ends.sid), needed)) AS block FROM ends)
), placed AS MATERIALIZED (
  SELECT nr, doc_id, size, sid, source_size, target, round(target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized JOIN aimed ON sized.source IS NOT DISTINCT FROM aimed.source
), copies AS (
  SELECT nr, sid, place + e * source_size AS begun, least(size, goal - place - e * source_size) AS words
  FROM placed, unnest([0, 1, 2]) c(e) WHERE size > 0 AND place + e * source_size < goal
), pieces AS (
  SELECT nr, sid, unnest(range(begun // {mixing.BLOCK_WORDS}, (begun + words - 1) // {mixing.BLOCK_WORDS} + 1)) AS block FROM copies
), slots AS (
  SELECT nr, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n_pieces FROM pieces JOIN blocks USING (sid, block) GROUP BY nr
)
SELECT doc_id, size, source_size, target, (greatest(least(size, goal - place), 0)
  + greatest(least(size, goal - place - source_size), 0) + greatest(least(size, goal - place - 2 * source_size), 0))::BIGINT AS taken,
  first_slot, last_slot, coalesce(n_pieces, 0) AS n_pieces
FROM placed LEFT JOIN slots USING (nr)
"""


def _canonical(line: str) -> str:
    out = f"translate({line}, {ABC})"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g'))"


def _text(lines: str) -> str:
    skipped = " ".join(f"AND NOT starts_with(x, '{s}')" for s in licenses.SKIPPED)
    return f"coalesce(array_to_string(list_filter({lines}, lambda x: x <> '' {skipped}), ' '), '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in rows)


OP3 = f"""
WITH known AS (
  SELECT license, md5({_text(f"list_transform(string_split(t, chr(10)), lambda l: {_canonical('l')})")}) AS digest
  FROM (VALUES {_values(licenses.LICENSES)}) v(license, t)
), notices AS (
  SELECT license, md5({_canonical('t')}) AS digest FROM (VALUES {_values(licenses.NOTICES)}) v(license, t)
), canon AS (
  SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_canonical('l')}) AS lines FROM documents
), named AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, md5(unnest(lines)) AS digest FROM canon) JOIN notices USING (digest) GROUP BY doc_id
)
SELECT doc_id, md5({_text('lines')}) AS digest, license, notices
FROM canon LEFT JOIN known ON md5({_text('lines')}) = known.digest LEFT JOIN named USING (doc_id)
"""

OP6 = rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), {ABC}) AS key FROM split
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, place, line, coalesce(doc_id < keeper, FALSE) AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _shingles(name: str, key: str) -> str:
    return f"""
{name}_words AS (
  SELECT {key}, list_filter(regexp_split_to_array(regexp_replace(lower(text), '{_PUNCTUATION}', '', 'g'), '{SPACE}+'), lambda w: w <> '') AS w
  FROM {"documents" if name == "doc" else "benchmark"} WHERE text IS NOT NULL
)"""


OP7 = f"""
WITH {_shingles('item', 'item_id')}, {_shingles('doc', 'doc_id')}, item_grams AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
  FROM item_words, unnest(range(1, greatest(len(w) - 3, 2))) r(i) WHERE len(w) > 0
), item_sizes AS (
  SELECT item_id, n, count(*) AS n_shingles FROM item_grams GROUP BY item_id, n
), lengths AS (SELECT DISTINCT n FROM item_sizes), doc_grams AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM doc_words, lengths, unnest(range(1, greatest(len(w) - n + 2, 1)::BIGINT)) r(i)
), hits AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM doc_grams JOIN item_grams USING (n, gram) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, n_found::INTEGER AS n_found, n_found / n_shingles AS containment
FROM hits JOIN item_sizes USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""

OP8 = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) * 1000 + length(rule_path)) AS rule, arg_max(rule_verdict, length(rule_host) * 1000 + length(rule_path)) AS verdict
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (page_id)
"""

SQL = {"op2_mixing": OP2, "op3_licenses": OP3, "op6_lines": OP6, "op7_contamination": OP7, "op8_urls": OP8}
