"""Redaction, gates and secret scans over text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

# Fixed values that results depend on: redaction patterns with their replacements, in order.
REDACTIONS = [
    (r"([?&](?:user|username|password|otp|token|code|secret)=)[^&#\s]+", "$1[REDACTED]"),
    (r"(password|otp|token|secret|code|user|username)\s*[:=]\s*[^,\s;]+", "$1=[REDACTED]"),
    (r"(victim_user|SuperSecretPassword123!|998877)", "[REDACTED]"),
]
# Fixed values that results depend on: literals that no payload may hold.
TRIPWIRES = ["victim_user", "SuperSecretPassword123!", "998877"]
# Fixed values that results depend on: keys that no payload may have, at any depth.
FORBIDDEN_KEYS = ["value", "password_value", "raw_value", "secret", "cvv_value", "otp_value", "pin_value", "card_value"]
# Fixed values that results depend on: keys that no item of these lists may have.
FORBIDDEN_ITEM_KEYS = ["value", "password_value", "raw_value", "secret", "cvv_value", "otp_value"]
ITEM_LISTS = ["forms", "inputs"]
# Fixed values that results depend on: names and patterns of secrets in text files.
SECRETS = {
    "API Key": r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*['"][A-Za-z0-9+/=_\-]{16,}['"]""",
    "AWS Key": r"AKIA[0-9A-Z]{16}",
    "Private Key": r"-----BEGIN\s+(RSA\s+)?PRIVATE KEY-----",
    "Password Assignment": r"""(?i)(password|passwd|pwd)\s*[=:]\s*['"][^'"]{4,}['"]""",
    "Token": r"""(?i)(token|secret|bearer)\s*[=:]\s*['"][A-Za-z0-9+/=_\-]{16,}['"]""",
    "Connection String": r"""(?i)(mongodb|postgres|mysql|redis)://[^\s"']+""",
}
# Fixed values that results depend on: names of files that may not be stored.
FORBIDDEN_GLOBS = ["*.exe", "*.dll", "*.so", "*.dylib", "*.env", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_ed25519"]
FORBIDDEN_FILES = "|".join("^" + g.replace(".", r"\.").replace("*", ".*") + "$" for g in FORBIDDEN_GLOBS)


def redacted(text: Column, passes: int = 1) -> Column:
    """Passes matter: the second one changes some texts again."""
    for _ in range(passes):
        for pattern, replacement in REDACTIONS:
            text = F.regexp_replace(text, "(?i)" + pattern, replacement)
    return text


def redacted_value(value: Column, kind: DataType, passes: int = 1) -> Column:
    """value with every text in it redacted, at any depth of structs, arrays and maps; keys, names and other types stay."""
    if isinstance(kind, StringType):
        return redacted(value, passes)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redacted_value(v, kind.elementType, passes))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: redacted_value(v, kind.valueType, passes))
    if isinstance(kind, StructType):
        fields = [redacted_value(value.getField(f.name), f.dataType, passes).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, VariantType):
        return F.try_parse_json(redacted_json(F.to_json(value), passes))
    return value


def redacted_json(json_text: Column, passes: int = 1) -> Column:
    """A JSON text, on one line, with every string value redacted at any depth; keys stay. Null where the text is no JSON."""
    tokens = F.regexp_extract_all(canonical(json_text), F.lit(r'"(?:[^"\\]|\\.)*+":|"(?:[^"\\]|\\.)*+"|[^"]++'), F.lit(0))

    def changed(token: Column) -> Column:
        text = F.from_json(F.concat(F.lit('{"v":'), token, F.lit("}")), "v string")["v"]
        back = F.to_json(F.struct(redacted(text, passes).alias("v")))
        return F.when(token.startswith('"') & token.endswith('"'), F.substring(back, F.lit(6), F.length(back) - 6)).otherwise(token)

    return F.array_join(F.transform(tokens, changed), "")


def trips(payload: Column) -> Column:
    out = F.lit(False)
    for literal in TRIPWIRES:
        out = out | payload.contains(literal)
    return F.coalesce(out, F.lit(False))


def canonical(json_text: Column) -> Column:
    """JSON on one line with its escapes decoded, so that a key has one spelling; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json_text))


def has_forbidden_key(json_text: Column, keys: list[str] | None = None) -> Column:
    """Whether a JSON text has one of keys at any depth, whatever its case and escapes. What is no JSON is searched as it stands."""
    names = "(" + "|".join(keys or FORBIDDEN_KEYS) + ")"
    # in canonical JSON a key follows a brace or comma, and a quote inside a string has a backslash before it
    decoded = canonical(json_text)
    found = F.when(decoded.isNotNull(), decoded.rlike('(?i)[{,]"' + names + '":')).otherwise(json_text.rlike('(?i)"' + names + r'"\s*:'))
    return F.coalesce(found, F.lit(False))


def has_forbidden_item_key(json_text: Column, lists: list[str] | None = None, keys: list[str] | None = None) -> Column:
    """Whether an item of one of the lists of a JSON object has one of keys itself, in that very case. Keys elsewhere or deeper, and items that are no objects, don't count."""
    payload, names = F.try_parse_json(json_text), F.array(*map(F.lit, keys or FORBIDDEN_ITEM_KEYS))
    found = F.lit(False)
    for name in lists or ITEM_LISTS:
        items = F.try_variant_get(payload, f"$.{name}", "array<variant>")
        found = found | F.coalesce(F.exists(items, lambda i: F.coalesce(F.arrays_overlap(F.map_keys(F.try_variant_get(i, "$", "map<string,variant>")), names), F.lit(False))), F.lit(False))
    return found


def secrets(text: Column) -> Column:
    """Names of the secret patterns found, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()]))
