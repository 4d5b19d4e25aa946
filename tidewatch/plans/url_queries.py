"""URL parts and features of the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import browser, features, lexical, urls
from tidewatch.operators import profiles
from tidewatch.sources.tables import BLOCKED_HOSTS, table

from .registry import Registry

register = Registry()

_P = r"'^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
PARTS = f"""u AS (SELECT page_id, url, lower(regexp_extract(url, {_P}, 1)) AS u_scheme, regexp_extract(url, {_P}, 2) AS u_auth,
  regexp_replace(regexp_extract(url, {_P}, 3), ';[^/]*$', '') AS u_path, regexp_extract(url, {_P}, 4) AS u_query, regexp_extract(url, {_P}, 5) AS u_frag,
  lower(regexp_replace(regexp_replace(regexp_extract(url, {_P}, 2), '^.*@', ''), ':[0-9]*$', '')) AS u_host FROM pages)"""
_LABELS = "list_filter(string_split(u_host, '.'), lambda x: x <> '')"


def _present(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")::BIGINT"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))::BIGINT"


LEXICAL = {
    "url_length": "length(url)::BIGINT",
    "hostname_length": "length(u_host)::BIGINT",
    "path_length": "length(regexp_replace(u_path, '^/+', ''))::BIGINT",
    "query_length": "length(u_query)::BIGINT",
    "fragment_length": "length(u_frag)::BIGINT",
    "subdomain_count": f"greatest(len({_LABELS}) - 2, 0)::BIGINT",
    "path_depth": "len(list_filter(string_split(u_path, '/'), lambda x: x <> ''))::BIGINT",
    "query_parameter_count": "len(list_filter(string_split(u_query, '&'), lambda x: x <> ''))::BIGINT",
    "special_character_count": _count("url", r"[^a-zA-Z0-9\s]"),
    "digit_count": _count("url", r"\d"),
    "letter_count": _count("url", "[a-zA-Z]"),
    "encoded_character_count": _count("url", "%[0-9a-fA-F]{2}"),
    "entropy": "round((SELECT -sum(n / length(url) * log2(n / length(url))) FROM (SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(url, '')) AS ch) GROUP BY ch)), 4)",
    "ip_address_host": r"regexp_matches(u_host, '^(\d{1,3}\.){3}\d{1,3}$')::BIGINT",
    "punycode_present": "contains(u_host, 'xn--')::BIGINT",
    "at_symbol_present": "contains(url, '@')::BIGINT",
    "hyphen_count": _count("url", "-"),
    "underscore_count": _count("url", "_"),
    "suspicious_token_count": _present("lower(url)", lexical.SUSPICIOUS_TOKENS),
    "brand_keyword_count": _present("lower(url)", lexical.KNOWN_BRANDS),
}
DOMAIN = {
    "brand_domain_mismatch": "(b_brand <> '' AND contains(lower(url), b_brand) AND NOT contains(u_host, b_brand))::BIGINT",
    "domain_length": "length(u_host)::BIGINT",
    "subdomain_length": f"CASE WHEN len({_LABELS}) > 2 THEN length(array_to_string({_LABELS}[1:len({_LABELS}) - 2], '.')) ELSE 0 END::BIGINT",
    "domain_is_ip": LEXICAL["ip_address_host"],
    "punycode": LEXICAL["punycode_present"],
    "domain_similarity_to_brand": "CASE WHEN b_brand <> '' AND contains(u_host, b_brand) THEN 1.0 ELSE 0.0 END::DOUBLE",
    "homograph_indicator": "(contains(u_host, 'xn--') OR contains(u_host, '%'))::BIGINT",
    "domain_known_to_registry": "(b_official <> '' AND contains(u_host, b_official))::BIGINT",
    "domain_matches_claimed_service": "(b_official <> '' AND contains(u_host, b_official))::BIGINT",
}
#: What samples give besides the url, from the page's number; the same text in both engines.
GIVEN = {
    "claimed_service": "CASE page_id % 3 WHEN 0 THEN 'Bank' ELSE NULL END",
    "known_brand": "CASE page_id % 4 WHEN 0 THEN 'Tion' WHEN 1 THEN 'en' WHEN 2 THEN 'paypal' ELSE '' END",
    "official_domain": "CASE page_id % 5 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' ELSE '' END",
    "login_form_detected": "CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 2 END",
    "password_field_detected": "CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END",
    "otp_field_detected": "CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END",
    "cross_origin_submission": "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 4 = 0 THEN 1 ELSE 0 END",
    "redirect_count": "page_id % 3",
    "cross_domain_redirect": "CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END",
    "input_count": "CASE WHEN page_id % 2 = 0 THEN NULL ELSE page_id % 9 END",
    "purpose_mismatch": "CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def _samples(spark, sf_dir):
    return _pages(spark, sf_dir).selectExpr("page_id", "url", *[f"{v} AS {k}" for k, v in GIVEN.items()])


@register(f"WITH {PARTS} SELECT page_id, u_scheme, u_host, u_path, u_query, u_frag FROM u")
def url_parts(spark, sf_dir):
    """C1, C2."""
    return lexical.with_url_parts(_pages(spark, sf_dir)).select("page_id", "u_scheme", "u_host", "u_path", "u_query", "u_frag")


@register(f"WITH {PARTS} SELECT page_id, CASE WHEN u_auth <> '' THEN u_scheme || '://' || u_auth || u_path ELSE url END AS sanitized FROM u")
def url_sanitize(spark, sf_dir):
    """C3."""
    return _pages(spark, sf_dir).select("page_id", urls.sanitized(F.col("url")).alias("sanitized"))


@register(f"WITH {PARTS} SELECT page_id, {_select(LEXICAL)} FROM u")
def url_lexical_features(spark, sf_dir):
    """F1 to F20, A14, A15, C12."""
    return lexical.with_url_parts(_pages(spark, sf_dir)).select("page_id", *[c.alias(n) for n, c in lexical.lexical_features().items()])


_SAMPLES = f"{PARTS}, s AS (SELECT u.*, {_select(GIVEN)} FROM u), b AS (SELECT *, lower(coalesce(known_brand, '')) AS b_brand, lower(coalesce(official_domain, '')) AS b_official FROM s)"


@register(f"WITH {_SAMPLES} SELECT page_id, {_select(DOMAIN)} FROM b")
def domain_features(spark, sf_dir):
    """F21 to F29."""
    df = lexical.with_url_parts(_samples(spark, sf_dir))
    brand, official = F.lower(F.coalesce("known_brand", F.lit(""))), F.lower(F.coalesce("official_domain", F.lit("")))
    return df.select("page_id", *[c.alias(n) for n, c in lexical.domain_features(brand, official).items()])


_ALL = {k: k for k in [*LEXICAL, *DOMAIN]} | {
    "dom_element_count": "2 * f + i + cdr", "form_count": "f", "input_count": "i", "button_count": "f", "iframe_count": "0", "hidden_element_count": "0", "external_resource_count": "cdr",
    "external_script_count": "0", "inline_script_count": "0", "login_form_detected": "login", "payment_form_detected": "0", "registration_form_detected": "0", "password_form_detected": "pw",
    "file_upload_form_detected": "0", "field_count": "i", "sensitive_field_count": "pw + otp", "hidden_field_count": "0", "same_origin_submission": "CASE WHEN f > 0 AND cos = 0 THEN 1 ELSE 0 END",
    "cross_origin_submission": "cos", "cross_registrable_domain_submission": "cos", "form_secure_transport": "CASE WHEN u_scheme = 'https' THEN 1 ELSE 0 END", "autocomplete_present": "login",
    "password_field_detected": "pw", "otp_field_detected": "otp", "payment_field_detected": "0", "identity_field_detected": "0", "redirect_count": "rc", "redirect_chain_length": "rc",
    "cross_domain_redirect": "cdr", "cross_registrable_domain_redirect": "cdr", "redirect_to_ip": "cdr * ip_address_host", "redirect_to_punycode": "cdr * punycode_present",
    "redirect_to_similar_brand": "cdr * brand_domain_mismatch", "redirect_chain_contains_unknown_domain": "cdr * (1 - domain_known_to_registry)", "official_domain_match": "domain_known_to_registry",
    "authentication_domain_match": "domain_known_to_registry * asked", "authorization_domain_match": "domain_known_to_registry", "brand_impersonation_indicator": "brand_domain_mismatch",
    "credential_requested": "asked", "password_requested": "pw", "otp_requested": "otp", "financial_data_requested": "0", "identity_data_requested": "0", "personal_data_requested": "asked",
    "device_data_requested": "0", "unexpected_data_request": "asked * (1 - domain_known_to_registry)", "purpose_mismatch": "pm", "possibly_excessive": "CASE WHEN i > 5 THEN 1 ELSE 0 END",
    "deceptive_collection_indicator": "cos * pw",
}
_NUMBERS = ", ".join(f"({v})::BIGINT AS {k}" if k not in ("entropy", "domain_similarity_to_brand") else f"{v} AS {k}" for k, v in _ALL.items())


@register(f"""WITH {_SAMPLES},
g AS (SELECT *, coalesce(password_field_detected, 0) AS pw, coalesce(otp_field_detected, 0) AS otp, coalesce(cross_origin_submission, 0) AS cos, coalesce(redirect_count, 0) AS rc,
  coalesce(cross_domain_redirect, 0) AS cdr, purpose_mismatch AS pm, CASE WHEN coalesce(login_form_detected, 0) = 1 OR password_field_detected = 1 THEN 1 ELSE 0 END AS f,
  coalesce(input_count, CASE WHEN password_field_detected = 1 THEN 2 WHEN login_form_detected = 1 THEN 1 ELSE 0 END) AS i FROM b),
h AS (SELECT *, coalesce(login_form_detected, CASE WHEN f > 0 THEN 1 ELSE 0 END) AS login FROM g),
k AS (SELECT page_id, u_scheme, b_brand, claimed_service, f, i, pw, otp, cos, rc, cdr, pm, login, CASE WHEN login = 1 OR pw = 1 THEN 1 ELSE 0 END AS asked, {_select(LEXICAL)}, {_select(DOMAIN)} FROM h)
SELECT page_id, {_NUMBERS}, lower(coalesce(claimed_service, 'unknown')) AS claimed_service_category, CASE WHEN b_brand = '' THEN 'unknown' ELSE b_brand END AS known_brand,
  CASE WHEN domain_known_to_registry = 1 THEN 'verified' WHEN b_brand = '' THEN 'unknown' ELSE 'mismatched' END AS identity_status FROM k""")
def features_81(spark, sf_dir):
    """F1 to F81, P3, P11, P12."""
    return features.sample_features(_samples(spark, sf_dir), keep=("page_id",))


@register(f"WITH {PARTS} SELECT page_id FROM u WHERE NOT (u_host = '{BLOCKED_HOSTS[0]}' OR ends_with(u_host, '.{BLOCKED_HOSTS[0]}') OR u_host = 'tionsh.example.net' OR ends_with(u_host, '.tionsh.example.net'))")
def block_list(spark, sf_dir):
    """Pages whose host is on no block list; a listed host stands for its subdomains."""
    blocked = spark.createDataFrame([(h,) for h in [*BLOCKED_HOSTS, "tionsh.example.net"]], "suffix string")
    pages = _pages(spark, sf_dir).select("page_id", F.explode(profiles.host_suffixes(urls.host(F.col("url")))).alias("suffix"))
    hit = pages.join(F.broadcast(blocked), "suffix").select("page_id").distinct()  # two listed hosts
    return _pages(spark, sf_dir).select("page_id").join(hit, "page_id", "left_anti")


@register(f"WITH {PARTS} SELECT page_id, (u_scheme IN ('http', 'https') AND (u_host = 'example.net' OR ends_with(u_host, '.example.net')) AND starts_with(u_path, '/en/')) AS matches FROM u")
def url_match_pattern(spark, sf_dir):
    """The match pattern *://*.example.net/en/*."""
    df = lexical.with_url_parts(_pages(spark, sf_dir))
    host = (F.col("u_host") == "example.net") | F.col("u_host").endswith(".example.net")
    return df.select("page_id", (F.col("u_scheme").isin("http", "https") & host & F.col("u_path").startswith("/en/")).alias("matches"))


@register(r"SELECT page_id, len(regexp_extract_all(html, '<script'))::BIGINT AS scripts, len(regexp_extract_all(html, '<script[^>]*\ssrc='))::BIGINT AS external_scripts, len(regexp_extract_all(html, '<form'))::BIGINT AS forms, len(regexp_extract_all(html, '<(?:input|select|textarea)'))::BIGINT AS inputs, len(regexp_extract_all(html, '<a\s'))::BIGINT AS links FROM pages")
def pages_html_scan(spark, sf_dir):
    """Flat tags by pattern; nested forms are sources.html_forms.forms."""
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", count("<script").alias("scripts"), count(r"<script[^>]*\ssrc=").alias("external_scripts"), count("<form").alias("forms"), count("<(?:input|select|textarea)").alias("inputs"), count(r"<a\s").alias("links"))


@register(r"SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS target FROM pages")
def import_scan(spark, sf_dir):
    """Every referenced target, one row each."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]*)"'), F.lit(1))).alias("target"))


_KINDS = list(browser.TYPE_FLAGS.values())
_EVIDENCE = {
    "domain": "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'xn--p.example.org' ELSE NULL END",
    "forms": "page_id % 4",
    "inputs": "page_id % 9",
    "scripts": "page_id % 5",
}


def _evidence(spark, sf_dir):
    numbers = F.expr("array(1, 2, 3, 4, 5, 6, 7, 8)")
    page = F.col("page_id")
    first = lambda n: F.slice(numbers, F.lit(1), (page % n).cast("int"))
    kind = lambda k: F.array(F.get(F.array(*map(F.lit, _KINDS)), ((page + k) % 8).cast("int")))
    form = lambda k: F.struct(((page + k) % 4 == 0).alias("is_cross_domain"), ((page + k) % 3 == 0).alias("has_password"), ((page + k) % 7 == 0).alias("has_otp"), F.array().cast("array<string>").alias("types"))
    field = lambda k: F.struct(((page + k) % 13 == 0).alias("is_password"), ((page + k) % 17 == 0).alias("is_otp"), kind(k).alias("types"))
    script = lambda k: F.struct((k % 2 == 0).alias("is_inline"), (k % 3 == 0).alias("is_cross_domain"))
    return _pages(spark, sf_dir).select("page_id", "url", F.expr(_EVIDENCE["domain"]).alias("domain"), F.transform(first(4), form).alias("forms"), F.transform(first(9), field).alias("inputs"), F.transform(first(5), script).alias("scripts"))


def _some(count: str, test: str) -> str:
    return f"len(list_filter(range(1, ({count}) + 1), lambda k: {test})) > 0"


_HAS = {n: _some(_EVIDENCE["inputs"], f"(page_id + k) % 8 = {i}") for i, n in enumerate(browser.TYPE_FLAGS)}
_BROWSER = LEXICAL | {"path_length": "length(regexp_replace(u_path, '^/', ''))::BIGINT"} | {
    "domain_length": "length(u_host)::BIGINT", "domain_is_ip": LEXICAL["ip_address_host"], "punycode": LEXICAL["punycode_present"],
    "dom_element_count": "(page_id % 4 + page_id % 9 + page_id % 5)::BIGINT", "external_script_count": "((page_id % 5) // 3)::BIGINT", "inline_script_count": "((page_id % 5) // 2)::BIGINT",
    "login_form_detected": "pw::BIGINT", "password_field_detected": "pw::BIGINT", "otp_field_detected": "otp::BIGINT", "payment_field_detected": "has_card_field::BIGINT", "identity_field_detected": "has_identity_field::BIGINT",
    "same_origin_submission": "(page_id % 4 > 0 AND NOT xd)::BIGINT", "cross_origin_submission": "xd::BIGINT", "cross_registrable_domain_submission": "xd::BIGINT", "form_secure_transport": "(u_scheme = 'https')::BIGINT",
    "field_count": "(page_id % 9)::BIGINT", "credential_requested": "pw::BIGINT", "password_requested": "pw::BIGINT", "otp_requested": "otp::BIGINT", "financial_data_requested": "(has_card_field OR has_bank_field)::BIGINT", "identity_data_requested": "has_identity_field::BIGINT",
}


@register(f"""WITH {PARTS}, e AS (SELECT page_id, url, u_scheme, coalesce(nullif({_EVIDENCE['domain']}, ''), u_host) AS u_host, CASE WHEN u_path = '' THEN '/' ELSE u_path END AS u_path, u_query, u_frag,
 ({_some('page_id % 4', '(page_id + k) % 3 = 0')} OR {_some('page_id % 9', '(page_id + k) % 13 = 0')}) AS pw, ({_some('page_id % 4', '(page_id + k) % 7 = 0')} OR {_some('page_id % 9', '(page_id + k) % 17 = 0')}) AS otp, {_some('page_id % 4', '(page_id + k) % 4 = 0')} AS xd, {_select(_HAS)} FROM u)
SELECT page_id, pw AS has_password_field, otp AS has_otp_field, xd AS cross_domain_form, (page_id % 4)::BIGINT AS form_count, (page_id % 9)::BIGINT AS input_count, {', '.join(browser.TYPE_FLAGS)}, {_select(_BROWSER)} FROM e""")
def browser_features(spark, sf_dir):
    """The browser's variant of the features (section 2.15), A10."""
    return browser.browser_features(_evidence(spark, sf_dir), keep=("page_id",))
