"""Links of pages, guards of messages and lines of manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import messages, urls
from tidewatch.operators import imports, match_patterns
from tidewatch.sources.tables import table

from .registry import Registry

register = Registry()

_HOST = "lower(regexp_replace(regexp_replace(regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


@register(f"""WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?:href|src|action)="([^"]*)"', 1)) AS target FROM pages WHERE url LIKE '%//%'),
 r AS (SELECT *, regexp_extract(url, '^([^/?#]*//[^/?#]*)', 1) AS origin FROM t)
 SELECT page_id, target, CASE WHEN regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN target WHEN starts_with(target, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || target WHEN starts_with(target, '/') THEN origin || target
  WHEN starts_with(target, '#') THEN regexp_replace(url, '#.*$', '') || target ELSE origin || regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[^/]*//[^/]*', ''), '[^/]*$', '') || target END AS resolved,
  CASE WHEN regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//') THEN {_HOST.format('target')} <> {_HOST.format('url')} ELSE false END AS cross_domain FROM r""")
def resolved_links(spark, sf_dir):
    """C4: every referenced target of a page as the browser resolves it, and whether it is on another host."""
    pages = table(spark, sf_dir, "pages").filter("url LIKE '%//%'")
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?:href|src|action)="([^"]*)"'), F.lit(1))).alias("target"))
    return found.select("page_id", "target", urls.resolved(F.col("url"), F.col("target")).alias("resolved"), urls.is_cross_domain(F.col("url"), F.col("target")).alias("cross_domain"))


@register(f"SELECT page_id, coalesce(nullif({_HOST.format('url')}, ''), url) AS domain, starts_with(lower(url), 'https:') AS is_https FROM pages WHERE url IS NOT NULL")
def page_domains(spark, sf_dir):
    """Host of a page, or its whole url without one, and whether it is HTTPS."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", urls.page_domain(url).alias("domain"), (urls.scheme(url) == "https").alias("is_https"))


_MESSAGE = """'{"schemaVersion":' || CASE user_id % 13 WHEN 0 THEN '"2.0.0"' WHEN 1 THEN '3' ELSE '"3.0.0"' END || ',"collectionId":' || CASE event_type WHEN 'error' THEN '' || user_id ELSE '"c' || event_id || '"' END
 || ',"timestamp":' || CASE WHEN event_type = 'click' AND value > 20 THEN '"' || user_id || '"' WHEN value > 90 THEN '1.5' ELSE '' || user_id END
 || ',"page":' || CASE user_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '[]' WHEN 2 THEN '"/p"' ELSE '{"url":"/' || event_type || '"}' END || ',"forms":[],"inputs":' || CASE WHEN value < 3 THEN '{}' ELSE '[{"a":1}]' END
 || ',"scripts":[1,"x"],"requests":[]' || CASE WHEN event_type = 'signup' AND value > 30 THEN '' ELSE ',"relationships":[{"sourceId":"p"}]' END || CASE WHEN value > 60 THEN ',"requestedDataTypes":{}' ELSE '' END || '}'"""
_ARRAYS = " AND ".join(f"coalesce(json_type(m, '$.{n}') = 'ARRAY', false)" for n in messages.LISTS)
_KINDS = "coalesce(json_type(m, '$.schemaVersion') = 'VARCHAR' AND m->>'$.schemaVersion' = '3.0.0' AND json_type(m, '$.collectionId') = 'VARCHAR' AND json_type(m, '$.timestamp') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(m, '$.page') IN ('OBJECT', 'ARRAY'), false)"


@register(f"SELECT event_id, ({_KINDS} AND {_ARRAYS}) AS valid FROM (SELECT event_id, ({_MESSAGE})::JSON AS m FROM events)")
def message_guard(spark, sf_dir):
    """Version, id, time, page and lists of messages made from whole events."""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_MESSAGE} AS body").select("event_id", messages.valid_message(F.col("body")).alias("valid"))


_LINE = "CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN 'dir ' || p_brand || chr(92) || p_size WHEN 2 THEN 'file  ' || p_brand || '/' || p_size || '.csv ' WHEN 3 THEN '' ELSE 'files ' || p_brand END"


@register(f"SELECT p_partkey, regexp_extract(line, '^(dir|file) ', 1) AS kind, replace(trim(regexp_replace(line, '^(dir|file) +', '')), chr(92), '/') AS path FROM (SELECT p_partkey, {_LINE} AS line FROM part) WHERE regexp_matches(line, '^(dir|file) ')")
def manifest_lines(spark, sf_dir):
    """Entries of manifest lines made from parts, their paths with slashes."""
    lines = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_LINE} AS line").select("p_partkey", messages.manifest_entry(F.col("line")).alias("e"))
    return lines.filter("e IS NOT NULL").select("p_partkey", "e.kind", "e.path")


#: Sources made from parts: a statement, a bare import, a call, an external and one that leads nowhere.
_SOURCE = """'// ' || p_name || chr(10) || 'import x, { y } from "./m' || (2 * p_partkey) || '.js";' || chr(10) || CASE WHEN p_size % 4 > 0 THEN 'import ' || chr(39) || './m' || (2 * p_partkey + 1) || chr(39) || ';' ELSE '' END || chr(10)
 || CASE WHEN p_size % 3 = 0 THEN 'const z = import( "./m' || CAST(floor(p_partkey / 3) AS BIGINT) || '.js" );' ELSE 'import k from "' || p_brand || '"' END || chr(10) || 'imports("./no.js")'"""
_STATEMENT, _CALL = (f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in (imports.STATEMENT, imports.CALL))
_EDGES = f"""s AS (SELECT '/src/m' || p_partkey || '.js' AS base, {_SOURCE} AS text FROM part), i AS (SELECT base, unnest(list_concat({_STATEMENT}, {_CALL})) AS specifier, unnest(range(len(list_concat({_STATEMENT}, {_CALL})))) AS turn FROM s),
 d AS (SELECT *, CASE WHEN starts_with(specifier, './') THEN '/src/' || substr(specifier, 3) END AS direct FROM i),
 e AS (SELECT base, turn, specifier, direct IS NULL AS is_external, direct IS NULL OR direct IN (SELECT base FROM s) OR direct || '.js' IN (SELECT base FROM s) AS resolvable,
  CASE WHEN direct IS NULL THEN specifier WHEN direct IN (SELECT base FROM s) THEN direct WHEN direct || '.js' IN (SELECT base FROM s) THEN direct || '.js' ELSE direct END AS path FROM d)"""


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("'/src/m' || p_partkey || '.js' AS path", f"{_SOURCE} AS text")


@register(f"WITH {_EDGES} SELECT * FROM e")
def import_graph(spark, sf_dir):
    """Imports of sources, statements and calls, and the files they stand for."""
    return imports.import_edges(_sources(spark, sf_dir))


@register(f"WITH RECURSIVE {_EDGES}, r AS (SELECT '/src/m1.js' AS path UNION SELECT e.path FROM r JOIN e ON e.base = r.path WHERE resolvable AND NOT is_external) SELECT path FROM r")
def reachable_files(spark, sf_dir):
    """All files that the first one needs."""
    edges = imports.import_edges(_sources(spark, sf_dir)).filter("resolvable AND NOT is_external")
    return imports.reachable(edges, spark.createDataFrame([("/src/m1.js",)], "path string")).select("path")


# Patterns that no page decides: fixed test input beside those made from the hosts of pages.
_FIXED_PATTERNS = ["<all_urls>", "*://*/fr/*", "https://*.example.net/*", "http://*.example.com/en/1*", "ftp://*/*", "*://*.example.org", "no pattern", "https://a://b", "*://www.*/x", "*://*.org/*"]
_MADE = "CASE page_id % 4 WHEN 0 THEN '*://' || host || '/*' WHEN 1 THEN 'https://*.' || host || '/en/*' WHEN 2 THEN 'http://' || host || path ELSE '*://' || upper(host) || '/*' END"
_URL_PATH = "coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/')"


@register(f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme, {_HOST.format('url')} AS host, {_URL_PATH} AS path FROM pages WHERE url IS NOT NULL),
 p AS (SELECT DISTINCT {_MADE} AS pattern FROM u WHERE page_id % 10 < 4 UNION SELECT unnest([{', '.join(f"'{x}'" for x in _FIXED_PATTERNS)}])),
 c AS (SELECT pattern, string_split(pattern, '://') AS parts FROM p), k AS (SELECT pattern, parts[1] AS s, regexp_extract(parts[2], '^([^/]*)', 1) AS h, coalesce(nullif(regexp_extract(parts[2], '^[^/]*(.*)$', 1), ''), '/') AS q FROM c WHERE len(parts) = 2)
 SELECT page_id, pattern FROM u, k WHERE (s = scheme OR (s = '*' AND scheme IN ('http', 'https'))) AND (h = '*' OR (starts_with(h, '*.') AND (host = substr(h, 3) OR ends_with(host, substr(h, 2)))) OR host = h) AND (path = q OR (ends_with(q, '*') AND starts_with(path, left(q, -1))))
 UNION ALL SELECT page_id, '<all_urls>' FROM u""")
def matched_patterns(spark, sf_dir):
    """Every page with the match patterns that its URL fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    made = pages.filter("url IS NOT NULL AND page_id % 10 < 4").select("page_id", urls.host(url).alias("host"), F.coalesce(F.nullif(urls.path(url), F.lit("")), F.lit("/")).alias("path")).select(F.expr(_MADE).alias("pattern"))
    patterns = made.union(spark.createDataFrame([(p,) for p in _FIXED_PATTERNS], "pattern string"))
    return match_patterns.matches(pages, patterns).select("page_id", "pattern")
