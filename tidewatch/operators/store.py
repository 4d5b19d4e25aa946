"""Observations and registry tables: building rows, seeding, looking up, verifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import privacy, urls


def observations(df: DataFrame, key: str, body: str = "body", payload: str = "payload") -> DataFrame:
    """Rows of the observations table with a status: 400 bad JSON or fields, 422 forbidden key, 201 stored. Counts are null where nothing is stored."""
    p = F.col(payload)
    good_json = F.coalesce(privacy.canonical(F.col(body)).startswith("{"), F.lit(False)) & p.isNotNull()
    named = (F.coalesce(p["page"]["domain"], F.lit("")) != "") & (F.coalesce(p["page"]["url"], F.lit("")) != "")
    status = F.when(~good_json, 400).when(privacy.has_forbidden_key(F.col(body)), 422).when(~named, 400).otherwise(201)
    inputs = F.coalesce(p["inputs"], F.array().cast("array<struct<detectedDataTypes:array<string>,isPassword:boolean,isOtp:boolean>>"))
    derived = F.flatten(F.transform(inputs, lambda i: F.when(F.size(F.coalesce(i["detectedDataTypes"], F.array().cast("array<string>"))) > 0, i["detectedDataTypes"]).otherwise(F.array_compact(F.array(F.when(i["isPassword"], "PASSWORD").when(i["isOtp"], "OTP"))))))
    asked = F.coalesce(p["requestedDataTypes"], F.array().cast("array<string>"))
    stored = F.col("status") == 201
    count = lambda name: F.when(stored, F.size(F.coalesce(p[name], F.array())))
    out = df.withColumn("status", status)
    return out.select(
        key,
        "status",
        F.when(stored, F.concat(F.lit("obs-"), F.substring(F.sha2(F.concat(F.col(key).cast("string"), body), 256), 1, 12))).alias("observation_id"),
        F.when(stored, p["collectionId"]).alias("collection_id"),
        F.when(stored, p["page"]["domain"]).alias("page_domain"),
        F.when(stored, urls.sanitized(p["page"]["url"])).alias("page_url_sanitized"),
        F.when(stored, F.coalesce(p["page"]["isHTTPS"], F.lit(False))).alias("is_https"),
        F.when(stored, F.size(F.coalesce(p["forms"], F.array().cast("array<struct<action:string,hasPasswordField:boolean>>")))).alias("form_count"),
        F.when(stored, F.size(inputs)).alias("input_count"),
        F.when(stored, F.size(F.coalesce(p["scripts"], F.array().cast("array<struct<src:string>>")))).alias("script_count"),
        F.when(stored, F.array_sort(F.array_distinct(F.when(F.size(asked) > 0, asked).otherwise(derived)))).alias("requested_data_types"),
        F.when(stored, p["threatLevel"]).alias("threat_level"),
        F.when(stored, p["modelScore"].cast("float")).alias("model_score"),
        F.when(stored, p["policyAction"]).alias("policy_action"),
    )


def stored_rows(found: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Of observations() rows that are stored (status 201), beside their body, the row as the table has it: collection_id coll- and 8 digits where the body names none, types as a JSON text."""
    named = F.array_contains(F.json_object_keys(body), "collectionId")
    given = F.try_variant_get(F.try_parse_json(body), "$.collectionId", "string")
    made = F.concat(F.lit("coll-"), F.substring(F.sha2(F.concat(F.lit("coll"), F.col(key).cast("string"), body), 256), 1, 8))
    stored = found.filter("status = 201").withColumns({"collection_id": F.when(named, F.coalesce(given, F.lit("None"))).otherwise(made), "requested_data_types": F.to_json("requested_data_types")})
    return stored.drop("status", body)


def field_text(payload: Column, path: str) -> Column:
    """A field of a variant as a text: empty where it is missing, null, false, zero or empty."""
    value = F.try_variant_get(payload, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    plain = F.when(kind == "BOOLEAN", F.when(value == "true", "True").otherwise("")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (value.cast("double") == 0), "").otherwise(value)
    return F.coalesce(plain, F.lit(""))


def missing_rows(seed: DataFrame, target: DataFrame, *keys: str) -> DataFrame:
    """Rows of seed whose keys aren't in target: what to append, any number of times."""
    return seed.join(target.select(*keys), list(keys), "left_anti")


def nested(parent: DataFrame, child: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """parent with an array of its children's fields, sorted; empty if it has none."""
    grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS {grouped.schema[name].dataType.simpleString()})")))


def latest(df: DataFrame, key: str, time: list[str], values: list[str]) -> DataFrame:
    """The last row's values of each key by time."""
    return df.groupBy(key).agg(*[F.max_by(v, F.struct(*time)).alias(v) for v in values])


def checksum_errors(files: DataFrame, sums: DataFrame, path: str, hash_: str) -> DataFrame:
    """Files whose hash differs from the listed one; files that aren't listed pass."""
    listed = sums.select(path, F.col(hash_).alias("listed"))
    return files.join(listed, path).filter(F.col(hash_) != F.col("listed"))


def path_findings(found: DataFrame, expected: DataFrame, approved: DataFrame, path: str = "path") -> DataFrame:
    """(path, finding): expected paths that aren't found are missing; found ones that aren't expected are approved where they begin with an approved text, else unexpected.

    A path meets the approved texts by an equi-join of its beginnings, one for each length that approved texts have
    (these lengths, at most as many as the longest path has characters, are all that the driver sees).
    """
    approved = approved.select(F.col(path).alias("_begin")).filter(F.length("_begin") > 0).distinct()
    lengths = sorted(r[0] for r in approved.select(F.length("_begin")).distinct().collect())
    missing = expected.select(path).distinct().join(found.select(path), path, "left_anti").withColumn("finding", F.lit("missing"))
    others = found.select(path).distinct().join(expected.select(path), path, "left_anti")
    begins = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    known = others.select(path, F.explode(F.array_compact(begins)).alias("_begin")).join(approved, "_begin", "left_semi").select(path)
    told = others.join(known, path, "left_anti").withColumn("finding", F.lit("unexpected")).unionByName(known.distinct().withColumn("finding", F.lit("approved")))
    return missing.unionByName(told)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
