"""URL parts by the RFC 3986 expression, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment
PATTERN = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def host(url: Column) -> Column:
    """Lower case, without user info and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def sanitized(url: Column) -> Column:
    """scheme://authority/path without query, fragment and the ;params of the last segment; a URL without authority stays as it is."""
    short = F.concat(scheme(url), F.lit("://"), authority(url), F.regexp_replace(path(url), ";[^/]*$", ""))
    return F.when(authority(url) != "", short).otherwise(url)


def page_domain(url: Column) -> Column:
    """The host, or the whole url where it has none."""
    return F.coalesce(F.nullif(host(url), F.lit("")), url)


def without_dots(path_: Column) -> Column:
    """path_ with its . and .. segments worked off (RFC 3986, 5.2.4)."""
    segments = F.split(F.regexp_replace(path_, "^/", ""), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    last = F.element_at(segments, -1)
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def resolved(base: Column, ref: Column) -> Column:
    """ref as a browser resolves it against base (RFC 3986, 5.2.2); as it stands where base has no authority."""
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    base_path = F.when(path(base) == "", "/").otherwise(path(base))
    base_query = F.regexp_extract(base, r"^[^#?]*(\?[^#]*)", 1)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    own = path(ref)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), own))
    relative = F.when(own != "", F.concat(origin, without_dots(merged), tail)).when(tail.startswith("?"), F.concat(origin, base_path, tail)).otherwise(F.concat(origin, base_path, base_query, tail))
    absolute = F.when(authority(ref) == "", ref).otherwise(F.concat(scheme(ref), F.lit("://"), authority(ref), F.when(own == "", "").otherwise(without_dots(own)), tail))
    shared = F.concat(scheme(base), F.lit("://"), authority(ref), F.when(own == "", "").otherwise(without_dots(own)), tail)
    return F.when(scheme(ref) != "", absolute).when(authority(base) == "", ref).when(authority(ref) != "", shared).otherwise(relative)


def is_cross_domain(page: Column, target: Column) -> Column:
    """Whether a target, relative to its page, is on another host; a target without host (mailto:, data:) isn't."""
    other = host(resolved(page, target))
    return F.coalesce((other != "") & (other != host(page)), F.lit(False))
