"""Guards of messages and lines of manifests, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: the version of messages and their lists.
VERSION = "3.0.0"
LISTS = ["forms", "inputs", "scripts", "requests", "relationships"]


def _kind(message: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(message, f"$.{name}", "variant"))


def valid_message(body: Column) -> Column:
    """Whether a JSON text is an object of that version with a text as collectionId, a number as timestamp, an object or array as page, and its lists."""
    message = F.try_parse_json(body)
    good = (_kind(message, "schemaVersion") == "STRING") & (F.try_variant_get(message, "$.schemaVersion", "string") == VERSION)
    good = good & (_kind(message, "collectionId") == "STRING") & _kind(message, "timestamp").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & _kind(message, "page").rlike("^(OBJECT|ARRAY)")
    for name in LISTS:
        good = good & _kind(message, name).startswith("ARRAY")
    return F.coalesce(good, F.lit(False))


def normal_path(path: Column, prefix: str = "") -> Column:
    """Slashes for backslashes, without the prefix."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(prefix), F.substring(slashed, len(prefix) + 1, 1 << 30)).otherwise(slashed) if prefix else slashed


def manifest_entry(line: Column) -> Column:
    """(kind, path) of a line `dir X` or `file X`; null for comments, blank lines and others."""
    found = lambda k: F.regexp_extract(line, r"^\s*(dir|file)\s+(.*?)\s*$", k)
    return F.when(found(2) != "", F.struct(found(1).alias("kind"), normal_path(found(2)).alias("path")))


def checksum_entry(line: Column) -> Column:
    """(hash, path) of a line of 64 hexadecimal digits and a path, star or not before it; null for others."""
    found = lambda k: F.regexp_extract(line, r"^([0-9a-fA-F]{64})\s+\*?(.*?)\s*$", k)
    return F.when(found(2) != "", F.struct(F.lower(found(1)).alias("hash"), normal_path(found(2)).alias("path")))
