"""Pieces of DuckDB SQL for the relations and functions, written apart from the engine."""

from __future__ import annotations

PUNCT = r'[\s!-"$-*,-/:-@\[-`{-~]'
SIGN = r'[!-"$-*,-/:-@\[-`{-~]'


def lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def trim(x: str, what: str = PUNCT) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{what}+', ''), '{what}+$', '')"


def words(x: str) -> str:
    split = f"string_split_regex({lower(x)}, '[ \\t,|!]')"
    return f"list_filter(list_transform({split}, lambda w: {trim('w')}), lambda w: strlen(w) BETWEEN 1 AND 100)"


def expanded(x: str) -> str:
    parts = "string_split_regex(w, '[.\\-:]')"
    return f"flatten(list_transform({words(x)}, lambda w: CASE WHEN len({parts}) > 1 THEN list_concat([w], list_transform({parts}, lambda q: {trim('q')})) ELSE [w] END))"


def clean_words(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z0-9åäö]*'))"


def entities(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def clean(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '<[^>]*(>|$)', '', 'g'), '\\s+', ' ', 'g')"
    return trim(f"regexp_replace({entities(bare)}, '\\s+', ' ', 'g')")


HOST = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\.', '')"
RAW_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
PATH_QUERY = f"({PATH}) || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END"
SHOWN = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '', 'g')"

_BODY = r"regexp_replace(regexp_replace(substr(shown, CASE WHEN instr(shown, '</h1>') > 0 THEN instr(shown, '</h1>') ELSE instr(shown, '<body') END), '<[^>]*(>|$)', ' ', 'g'), '\s+', ' ', 'g')"

URLS = f"""urls AS MATERIALIZED (SELECT page_id, url, host, host || path_query AS url_key, strlen(path_query)::INTEGER AS url_length, path_query,
 {clean("regexp_extract(shown, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title,
 {clean("regexp_extract(shown, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, '' AS meta,
 CASE WHEN instr(shown, '</h1>') > 0 OR instr(shown, '<body') > 0 THEN {clean(_BODY)} ELSE '' END AS text
FROM (SELECT page_id, url, {HOST} AS host, {PATH_QUERY} AS path_query, {SHOWN} AS shown FROM pages) p)"""

LINKS = """links AS MATERIALIZED (SELECT s.host, s.path_query AS path, t.host AS target_host, t.path_query AS target_path, t.title AS text, (s.page_id + j) % 5 = 0 AS nofollow
FROM urls s, (VALUES (0), (1), (2)) v(j), (SELECT count(*) AS n FROM pages) c, urls t
WHERE t.page_id = (s.page_id * (7 + 2 * j) + 3 + j) % n AND s.host <> t.host)"""

CENTRALITY = """centrality AS MATERIALIZED (SELECT target_host AS host, count(DISTINCT host) / (count(DISTINCT host) + 40.0::DOUBLE) AS harmonic FROM links GROUP BY ALL)"""

_PART = lambda c, w: f"SELECT page_id, unnest(list_distinct({expanded(c)})) AS token, {w}::DOUBLE AS weight FROM urls"

URL_POSTINGS = f"""raw_postings AS (
{_PART('title', 10)} UNION ALL {_PART('h1', 3)} UNION ALL {_PART('meta', 2)} UNION ALL {_PART('text', 1)}
UNION ALL SELECT page_id, unnest(list_distinct(['site:' || host, 'site:www.' || host, host, coalesce(string_split(host, '.')[-2], '')])), 20::DOUBLE FROM urls),
postings AS MATERIALIZED (SELECT token, url_key AS value, round(sum(weight * coalesce(harmonic, 0)), 9) AS score, host AS domain, url_length
FROM raw_postings JOIN urls USING (page_id) LEFT JOIN centrality USING (host) WHERE token <> '' GROUP BY ALL)"""

LINK_POSTINGS = f"""link_rows AS (SELECT l.host || l.path AS source_url, l.target_host || l.target_path AS target, l.target_host AS target_domain, coalesce(harmonic, 0) AS score, list_distinct({expanded("substr(text, 1, 1000)")}) AS words FROM links l LEFT JOIN centrality USING (host)),
link_postings AS MATERIALIZED (SELECT token, source_url || '>' || target AS value, source_url, target, max(score) AS score FROM (SELECT *, unnest(words) AS token FROM link_rows) WHERE token <> '' AND target IN (SELECT url_key FROM urls) GROUP BY ALL),
domain_link_postings AS MATERIALIZED (SELECT token, source_url || '>' || target_domain AS value, source_url, target_domain, max(score) AS score FROM (SELECT *, unnest(words) AS token FROM link_rows) WHERE token <> '' GROUP BY ALL)"""

COUNTS = f"""counts AS MATERIALIZED (SELECT token, value, count(*) AS count FROM (SELECT doc_id AS value, unnest({words('text')}) AS token FROM documents) GROUP BY ALL)"""

HISTORY = "history AS (SELECT user_id AS key, event_type AS value, epoch_us(ts) AS version, event_id AS seq FROM events)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


WEB = (URLS, LINKS, CENTRALITY)
