"""Row-wise features of a URL and its host (F1 to F29), native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

# Fixed values that results depend on: brand names and tokens looked for in URLs.
KNOWN_BRANDS = ["google", "paypal", "apple", "microsoft", "amazon", "netflix", "facebook", "instagram", "bankone", "chase", "wellsfargo", "bankofamerica", "github", "dropbox", "stripe"]
SUSPICIOUS_TOKENS = ["login", "signin", "verify", "account", "update", "banking", "secure", "ebayisapi", "webscr", "cmd", "auth", "confirm", "wallet"]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def _pieces(text: Column, separator: str) -> Column:
    return F.filter(F.split(text, separator), lambda x: x != "")


def entropy(text: Column) -> Column:
    """Shannon entropy over code points, base 2, rounded to 4 digits; 0 for the empty text."""
    chars = F.split(text, "")
    n = F.length(text)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n == 0, 0.0).otherwise(F.round(-F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p)), 4))


def substrings_present(text: Column, words: list[str]) -> Column:
    """How many of words are in text."""
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def with_url_parts(df: DataFrame, url: str = "url", host: str | None = None) -> DataFrame:
    """df with u_scheme, u_host, u_path, u_query, u_frag; host: a column that wins over the parsed host."""
    u = F.coalesce(F.col(url), F.lit(""))
    parsed = urls.host(u)
    return df.withColumns(
        {
            "u_url": u,
            "u_scheme": urls.scheme(u),
            "u_host": F.coalesce(F.col(host), parsed) if host else parsed,
            "u_path": F.regexp_replace(urls.path(u), ";[^/]*$", ""),
            "u_query": urls.query(u),
            "u_frag": urls.fragment(u),
        }
    )


def lexical_features() -> dict[str, Column]:
    """F1 to F20 over the columns of with_url_parts."""
    url, host, path = F.col("u_url"), F.col("u_host"), F.col("u_path")
    labels = _pieces(host, r"\.")
    return {
        "url_length": F.length(url),
        "hostname_length": F.length(host),
        "path_length": F.length(F.regexp_replace(path, "^/+", "")),
        "query_length": F.length("u_query"),
        "fragment_length": F.length("u_frag"),
        "subdomain_count": F.greatest(F.size(labels) - 2, F.lit(0)),
        "path_depth": F.size(_pieces(path, "/")),
        "query_parameter_count": F.size(_pieces(F.col("u_query"), "&")),
        "special_character_count": F.regexp_count(url, F.lit(r"[^a-zA-Z0-9\s]")),
        "digit_count": F.regexp_count(url, F.lit(r"\d")),
        "letter_count": F.regexp_count(url, F.lit("[a-zA-Z]")),
        "encoded_character_count": F.regexp_count(url, F.lit("%[0-9a-fA-F]{2}")),
        "entropy": entropy(url),
        "ip_address_host": _flag(host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")),
        "punycode_present": _flag(F.lower(host).contains("xn--")),
        "at_symbol_present": _flag(url.contains("@")),
        "hyphen_count": F.regexp_count(url, F.lit("-")),
        "underscore_count": F.regexp_count(url, F.lit("_")),
        "suspicious_token_count": substrings_present(F.lower(url), SUSPICIOUS_TOKENS),
        "brand_keyword_count": substrings_present(F.lower(url), KNOWN_BRANDS),
    }


def domain_features(brand: Column, official: Column) -> dict[str, Column]:
    """F21 to F29; brand and official are in lower case, empty if unknown. Matching is by substring, not by label."""
    url, host = F.lower(F.col("u_url")), F.lower(F.col("u_host"))
    labels = _pieces(F.col("u_host"), r"\.")
    ip, puny = _flag(F.col("u_host").rlike(r"^(\d{1,3}\.){3}\d{1,3}$")), _flag(host.contains("xn--"))
    known = _flag((official != "") & host.contains(official))
    return {
        "brand_domain_mismatch": _flag((brand != "") & url.contains(brand) & ~host.contains(brand)),
        "domain_length": F.length("u_host"),
        "subdomain_length": F.when(F.size(labels) > 2, F.length(F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), "."))).otherwise(0),
        "domain_is_ip": ip,
        "punycode": puny,
        "domain_similarity_to_brand": F.when((brand != "") & host.contains(brand), 1.0).otherwise(0.0),
        "homograph_indicator": _flag((puny == 1) | host.contains("%")),
        "domain_known_to_registry": known,
        "domain_matches_claimed_service": known,
    }
