"""Redaction, secret scans and payload gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import privacy
from tidewatch.sources.tables import payloads, table

from .registry import Registry

register = Registry()


def _redacted(text: str) -> str:
    for pattern, replacement in privacy.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'gi')"
    return text


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@register(f"SELECT doc_id, {_redacted('text')} AS redacted FROM documents")
def redact_text(spark, sf_dir):
    """C5, once over each text."""
    return table(spark, sf_dir, "documents").select("doc_id", privacy.redacted(F.col("text")).alias("redacted"))


@register(f"SELECT conv_id, turn, {_redacted(_redacted('text'))} AS redacted FROM conversations")
def redact_turns(spark, sf_dir):
    """C5, twice, as messages that are redacted on sending and on wrapping are."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", privacy.redacted(F.col("text"), 2).alias("redacted"))


@register("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN '{n}' END" for n, p in privacy.SECRETS.items()) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents WHERE " + " OR ".join(f"regexp_matches(text, {_quoted(p)})" for p in privacy.SECRETS.values()))
def secret_scan(spark, sf_dir):
    """C17."""
    found = table(spark, sf_dir, "documents").select("doc_id", privacy.secrets(F.col("text")).alias("found"))
    return found.filter(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("found"))


_BODY = """CASE event_id % 5 WHEN 0 THEN '{"collectionId":"c' || event_id || '","page":{"domain":"d' || (event_id % 50) || '.example.com","url":"https://d' || (event_id % 50) || '.example.com/p;x?q=1","isHTTPS":true},"forms":[{"action":"/l","hasPasswordField":true}],"inputs":[{"detectedDataTypes":["EMAIL"],"isPassword":false,"isOtp":false},{"isPassword":true,"isOtp":false}]}'
 WHEN 1 THEN '{"collectionId":"c","page":{"domain":"x.org","url":"http://x.org"},"inputs":[{"Value":"v"}]}' WHEN 2 THEN '{"page":{"domain":"","url":""},"note":"998877"}' WHEN 3 THEN CASE event_id % 4 WHEN 0 THEN 'no json' WHEN 1 THEN '[{"secret":1}]' WHEN 2 THEN '{"page":{"domain":"x.org","url":"http://x.org/' || event_id || '"},"scripts":[{"sec' || chr(92) || 'u0072et":1}]}' ELSE '{' || chr(10) || ' "page" : {"domain" : "n' || event_id || '.org",' || chr(10) || ' "url" : "http://n.org/a?b", "title" : "a ' || chr(92) || '"secret' || chr(92) || '": b"}' || chr(10) || '}' END ELSE props END"""


def _bodies(spark, sf_dir):
    """Request bodies made from events."""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_BODY} AS body")


_NAMES = ", ".join(f"'{k}'" for k in privacy.FORBIDDEN_KEYS)
_REJECTED = f"(json_valid(body) AND coalesce(list_has_any(list_transform((SELECT list(key) FROM json_tree(CASE WHEN json_valid(body) THEN body END)), lambda k: lower(k)), [{_NAMES}]), false))"


@register(f"SELECT event_id, {_REJECTED} AS rejected FROM (SELECT event_id, {_BODY} AS body FROM events)")
def privacy_gate(spark, sf_dir):
    """A forbidden key at any depth, in any case and however it is escaped."""
    return _bodies(spark, sf_dir).select("event_id", privacy.has_forbidden_key(F.col("body")).alias("rejected"))


_ITEMS = f"""CASE WHEN value < 2 THEN '{{"forms":[{{"value":1}}]}}' WHEN value < 4 THEN '{{"forms":[1,null],"inputs":[{{"Value":1}},{{"otp_value":"' || event_type || '"}}]}}' WHEN value < 6 THEN '{{"pin_value":1,"value":2,"forms":{{"value":1}}}}'
 WHEN value < 8 THEN '{{"inputs":[[{{"value":1}}],"value",{{"pin_value":1,"card_value":2}}]}}' WHEN value < 10 THEN '{{"forms":[{{"x":{{"secret":1}}}}],"scripts":[{{"secret":1}}]}}' WHEN event_type = 'error' THEN '{{"inputs":[{{"sec' || chr(92) || 'u0072et":{{}}}}]}}' ELSE {_BODY} END"""
_ITEM_NAMES = ", ".join(f"'{k}'" for k in privacy.FORBIDDEN_ITEM_KEYS)
_ITEM_HIT = " OR ".join(f"coalesce(list_has_any(flatten(list_transform(CASE WHEN json_type(j, '$.{n}') = 'ARRAY' THEN (j->'$.{n}')::JSON[] ELSE [] END, lambda i: CASE WHEN json_type(i) = 'OBJECT' THEN json_keys(i) ELSE [] END)), [{_ITEM_NAMES}]), false)" for n in privacy.ITEM_LISTS)


@register(f"SELECT event_id, ({_ITEM_HIT}) AS rejected FROM (SELECT event_id, CASE WHEN json_valid(body) THEN body END::JSON AS j FROM (SELECT event_id, {_ITEMS} AS body FROM events))")
def item_gate(spark, sf_dir):
    """A forbidden key of an item of forms or inputs, in that very case."""
    items = table(spark, sf_dir, "events").selectExpr("event_id", f"{_ITEMS} AS body")
    return items.select("event_id", privacy.has_forbidden_item_key(F.col("body")).alias("rejected"))


_NESTED = "named_struct('text', text, 'meta', named_struct('role', role, 'turn', turn, 'lines', split(text, '\\\\n'), 'extra', map('note', concat('password: ', role), 'code=1', concat('otp = ', conv_id, ', x'))), 'parts', array(named_struct('name', 'url', 'value', concat('/p?user=', role, '&q=', turn, '&token=', conv_id)), named_struct('name', 'secret=1', 'value', cast(null as string))))"
_NESTED_SQL = "json_object('text', text, 'meta', json_object('role', role, 'turn', turn, 'lines', string_split(text, chr(10)), 'extra', json_object('note', 'password: ' || role, 'code=1', 'otp = ' || conv_id || ', x')), 'parts', json_array(json_object('name', 'url', 'value', '/p?user=' || role || '&q=' || turn || '&token=' || conv_id), json_object('name', 'secret=1', 'value', NULL)))"
_LEAVES = f"WITH d AS (SELECT conv_id, turn, {_NESTED_SQL} AS j FROM conversations), t AS (SELECT conv_id, turn, unnest(json_each.leaves) AS leaf FROM d, LATERAL (SELECT list({{'path': replace(fullkey, chr(34), ''), 'value': atom ->> '$'}}) AS leaves FROM json_tree(d.j) WHERE type = 'VARCHAR') json_each) SELECT conv_id, turn, leaf.path AS path, {_redacted('leaf.value')} AS value FROM t"


def _leaves(value, kind, path):
    """(path, value) of each text in a value of a type, as an array column."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructType

    if isinstance(kind, StringType):
        return F.array(F.struct(path.alias("path"), value.alias("value")))
    if isinstance(kind, ArrayType):
        return F.flatten(F.transform(value, lambda v, i: _leaves(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    if isinstance(kind, MapType):
        return F.flatten(F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"]))))
    if isinstance(kind, StructType):
        return F.concat(*[_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
    return F.array().cast("array<struct<path:string,value:string>>")


@register(_LEAVES)
def redact_payload(spark, sf_dir):
    """Every text of a payload of structs, arrays and maps, at three depths; keys stay. A row for each text."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NESTED).alias("p"))
    kind = docs.schema["p"].dataType
    shown = docs.withColumn("p", privacy.redacted_value(F.col("p"), kind)).select("conv_id", "turn", F.inline(_leaves(F.col("p"), kind, F.lit("$"))))
    return shown.filter("value IS NOT NULL")


@register(_LEAVES)
def redact_json(spark, sf_dir):
    """C5 over payloads that come as JSON texts without a schema."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NESTED).alias("p"))
    kind = docs.schema["p"].dataType
    back = F.from_json(privacy.redacted_json(F.to_json("p")), kind)
    return docs.select("conv_id", "turn", F.inline(_leaves(back, kind, F.lit("$")))).filter("value IS NOT NULL")


@register("SELECT event_id, (contains(body, 'victim_user') OR contains(body, 'SuperSecretPassword123!') OR contains(body, '998877')) AS tripped FROM (SELECT event_id, " + _BODY + " AS body FROM events)")
def payload_tripwire(spark, sf_dir):
    """C6."""
    return _bodies(spark, sf_dir).select("event_id", privacy.trips(F.col("body")).alias("tripped"))


@register(f"""WITH b AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN body END::JSON AS j, {_REJECTED} AS rejected FROM (SELECT event_id, {_BODY} AS body FROM events)),
 s AS (SELECT *, j->>'$.page.domain' AS domain, j->>'$.page.url' AS url, CASE WHEN coalesce(json_type(j), '') <> 'OBJECT' THEN 400 WHEN rejected THEN 422 WHEN coalesce(j->>'$.page.domain', '') = '' OR coalesce(j->>'$.page.url', '') = '' THEN 400 ELSE 201 END AS status FROM b),
 t AS (SELECT *, list_sort(list_distinct(flatten([CASE WHEN coalesce(json_array_length(i, '$.detectedDataTypes'), 0) > 0 THEN (i->'$.detectedDataTypes')::VARCHAR[] WHEN (i->>'$.isPassword') = 'true' THEN ['PASSWORD'] WHEN (i->>'$.isOtp') = 'true' THEN ['OTP'] ELSE [] END FOR i IN coalesce((j->'$.inputs')::JSON[], [])]))) AS types FROM s)
 SELECT event_id, status::BIGINT AS status, CASE WHEN status = 201 THEN domain END AS page_domain, CASE WHEN status = 201 THEN regexp_replace(url, '[;?#].*$', '') END AS page_url_sanitized,
 CASE WHEN status = 201 THEN coalesce(json_array_length(j, '$.forms'), 0) END::BIGINT AS form_count, CASE WHEN status = 201 THEN coalesce(json_array_length(j, '$.inputs'), 0) END::BIGINT AS input_count, CASE WHEN status = 201 THEN coalesce(json_array_length(j, '$.scripts'), 0) END::BIGINT AS script_count, CASE WHEN status = 201 THEN array_to_string(types, ',') END AS requested FROM t""")
def observation_ingest(spark, sf_dir):
    """Decode, gate, check, sanitize and count; the status each body gets."""
    from tidewatch.operators.store import observations

    return observations(payloads(_bodies(spark, sf_dir)), "event_id").withColumn("requested", F.array_join("requested_data_types", ",")).select("event_id", "status", "page_domain", "page_url_sanitized", "form_count", "input_count", "script_count", "requested")


@register("""SELECT p_partkey, name, regexp_matches(name, '\\.(exe|dll|so|dylib|env|pem|key|p12|pfx)$|^id_rsa$|^id_ed25519$') AS forbidden FROM (SELECT p_partkey, lower(replace(p_name, ' ', '_')) || CASE p_partkey % 6 WHEN 0 THEN '.pem' WHEN 1 THEN '.py' WHEN 2 THEN '.env' WHEN 3 THEN '.exe.txt' ELSE '.ts' END AS name FROM part)""")
def forbidden_files(spark, sf_dir):
    """C18, P19 over file names made from parts."""
    names = table(spark, sf_dir, "part").selectExpr("p_partkey", "lower(replace(p_name, ' ', '_')) || CASE p_partkey % 6 WHEN 0 THEN '.pem' WHEN 1 THEN '.py' WHEN 2 THEN '.env' WHEN 3 THEN '.exe.txt' ELSE '.ts' END AS name")
    return names.withColumn("forbidden", F.col("name").rlike(privacy.FORBIDDEN_FILES))


_STORED = """CASE WHEN value < 10 THEN '{"page":{"domain":"d.example.com","url":"https://d.example.com/' || event_type || ';p?q"},"inputs":[{"isPassword":true},{"detectedDataTypes":["EMAIL","OTP"]},{"isOtp":true}],"threatLevel":"benign"}'
 WHEN value < 20 THEN '{"collectionId":null,"page":{"domain":"d","url":"about:blank"},"requestedDataTypes":["B","A","B"]}' WHEN value < 30 THEN '{"collectionId":' || user_id || ',"page":{"domain":"d","url":"//d/x"}}' ELSE '{"collectionId":"c-' || user_id || '"}' END"""


@register(f"""WITH b AS (SELECT event_id, {_STORED} AS body FROM events), j AS (SELECT *, body::JSON AS j FROM b)
 SELECT event_id, 'obs-' || left(sha256(event_id || body), 12) AS observation_id, CASE WHEN list_contains(json_keys(j), 'collectionId') THEN coalesce(j->>'$.collectionId', 'None') ELSE 'coll-' || left(sha256('coll' || event_id || body), 8) END AS collection_id,
 to_json(list_sort(list_distinct(CASE WHEN json_array_length(j, '$.requestedDataTypes') > 0 THEN (j->'$.requestedDataTypes')::VARCHAR[] ELSE flatten([CASE WHEN json_array_length(i, '$.detectedDataTypes') > 0 THEN (i->'$.detectedDataTypes')::VARCHAR[] WHEN (i->>'$.isPassword') = 'true' THEN ['PASSWORD'] WHEN (i->>'$.isOtp') = 'true' THEN ['OTP'] ELSE [] END FOR i IN coalesce((j->'$.inputs')::JSON[], [])]) END)))::VARCHAR AS requested_data_types,
 j->>'$.threatLevel' AS threat_level FROM j WHERE coalesce(j->>'$.page.domain', '') <> ''""")
def observation_rows(spark, sf_dir):
    """Rows as the table stores them, ids and JSON texts included."""
    from tidewatch.operators import store

    bodies = table(spark, sf_dir, "events").selectExpr("event_id", f"{_STORED} AS body")
    found = store.observations(payloads(bodies), "event_id").join(bodies, "event_id")
    return store.stored_rows(found, "event_id").select("event_id", "observation_id", "collection_id", "requested_data_types", "threat_level")


_FIELDS = """CASE event_type WHEN 'view' THEN '{"name":"n' || user_id || '","idAttribute":null,"autocomplete":0}' WHEN 'click' THEN '{"name":' || user_id || ',"idAttribute":false,"autocomplete":"off"}' WHEN 'error' THEN '{"name":true,"idAttribute":"","autocomplete":[]}' ELSE '{"idAttribute":"i","autocomplete":0.0}' END"""


@register("SELECT event_id, " + ", ".join(f"CASE WHEN coalesce(json_type(j, '$.{f}'), 'NULL') IN ('NULL', 'ARRAY') THEN '' WHEN json_type(j, '$.{f}') = 'BOOLEAN' THEN CASE WHEN (j->>'$.{f}') = 'true' THEN 'True' ELSE '' END WHEN json_type(j, '$.{f}') <> 'VARCHAR' AND (j->>'$.{f}')::DOUBLE = 0 THEN '' ELSE j->>'$.{f}' END AS {f}" for f in ("name", "idAttribute", "autocomplete")) + f" FROM (SELECT event_id, ({_FIELDS})::JSON AS j FROM events)")
def field_texts(spark, sf_dir):
    """Names, ids and autocomplete values of inputs as texts, whatever they come as."""
    from tidewatch.operators.store import field_text

    inputs = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.expr(_FIELDS)).alias("j"))
    return inputs.select("event_id", *[F.when(F.schema_of_variant(F.try_variant_get("j", f"$.{f}", "variant")).startswith("ARRAY"), "").otherwise(field_text(F.col("j"), f"$.{f}")).alias(f) for f in ("name", "idAttribute", "autocomplete")])


@register("SELECT event_id, event_type || '-' || lower(to_base(epoch_us(ts) // 1000, 36)) || '-' || row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def timed_artifact_ids(spark, sf_dir):
    """C14: kind, time in base 36 and a counter over all rows."""
    from tidewatch.operators import ids

    return ids.timed_ids(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), F.col("event_type"), "ts", "event_id").select("event_id", "id")
