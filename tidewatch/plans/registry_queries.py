"""Registry lookups, seeding, verification and change reports over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import display
from tidewatch.operators import store
from tidewatch.sources.tables import table

from .registry import Registry

register = Registry()


@register("SELECT r.r_regionkey::BIGINT AS r_regionkey, r_name, coalesce((SELECT string_agg(n_name || ':' || (n_nationkey % 2), ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), '') AS domains FROM region r")
def profile_with_domains(spark, sf_dir):
    """Parents with their children nested, regions and nations standing for services and domains."""
    child = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("domain"), (F.col("n_nationkey") % 2).alias("is_primary"))
    out = store.nested(table(spark, sf_dir, "region"), child, "r_regionkey", ["domain", "is_primary"], "domains")
    return out.select("r_regionkey", "r_name", F.array_join(F.transform("domains", lambda d: F.concat(d["domain"], F.lit(":"), d["is_primary"].cast("string"))), ",").alias("domains"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def active_model(spark, sf_dir):
    """One active row, the first by key."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").orderBy("c_custkey").limit(1).select("c_custkey", "c_name")


@register("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def service_by_id(spark, sf_dir):
    """Look-up by lower-cased id."""
    return table(spark, sf_dir, "customer").filter(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007"))).select("c_custkey", "c_name")


@register("SELECT s_suppkey, s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0) t WHERE t.k = s.s_suppkey)")
def seed_if_empty(spark, sf_dir):
    """Seed rows whose key the target lacks; the target holds every third supplier."""
    seed = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return store.missing_rows(seed, seed.filter("s_suppkey % 3 = 0"), "s_suppkey")


@register("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_decision(spark, sf_dir):
    """The last event of each user by event time."""
    return store.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@register("""WITH found AS (SELECT doc_id, sha256(text) AS found FROM documents WHERE text IS NOT NULL), listed AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN reverse(sha256(text)) ELSE sha256(text) END AS listed FROM documents WHERE doc_id % 4 = 0)
 SELECT doc_id, found FROM found JOIN listed USING (doc_id) WHERE found <> listed""")
def checksum_verify(spark, sf_dir):
    """SHA-256 of texts against a list of hashes; the list has every fourth text, and a wrong hash for every third of these."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("found"))
    listed = docs.filter("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse("found")).otherwise(F.col("found")).alias("found"))
    return store.checksum_errors(docs, listed, "doc_id", "found").select("doc_id", "found")


@register("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def foreign_key_orphans(spark, sf_dir):
    """Lines whose order is not among the kept ones."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'")
    return store.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o_orderkey")


@register("WITH e AS (SELECT DISTINCT p_brand || '/' || p_size AS path FROM part WHERE p_partkey % 3 < 2), a AS (SELECT DISTINCT p_brand || '/' || p_size AS path FROM part WHERE p_partkey % 3 > 0) SELECT path, 'missing' AS finding FROM e WHERE path NOT IN (SELECT path FROM a) UNION ALL SELECT path, 'unexpected' FROM a WHERE path NOT IN (SELECT path FROM e)")
def path_differences(spark, sf_dir):
    """Expected against actual names, both ways."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey % 3 AS k", "p_brand || '/' || p_size AS path")
    expected, actual = part.filter("k < 2").select("path").distinct(), part.filter("k > 0").select("path").distinct()
    missing = expected.join(actual, "path", "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(actual.join(expected, "path", "left_anti").withColumn("finding", F.lit("unexpected")))


_CODE = "CASE event_id % 7 WHEN 0 THEN '??' WHEN 1 THEN 'A ' WHEN 2 THEN ' M' WHEN 3 THEN 'D ' WHEN 4 THEN 'R ' WHEN 5 THEN 'UU' ELSE 'MM' END"


@register(f"SELECT CASE WHEN starts_with(code, '??') THEN 'untracked' WHEN starts_with(code, 'A') THEN 'created' WHEN starts_with(code, 'D') OR starts_with(code, ' D') THEN 'deleted' ELSE 'modified' END AS change, count(*) AS n FROM (SELECT {_CODE} AS code FROM events) GROUP BY 1")
def change_classes(spark, sf_dir):
    """A22, C22."""
    code = F.col("code")
    change = F.when(code.startswith("??"), "untracked").when(code.startswith("A"), "created").when(code.rlike("^( ?D)"), "deleted").otherwise("modified")
    return table(spark, sf_dir, "events").selectExpr(f"{_CODE} AS code").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CASE WHEN sum(issues) > 0 THEN 'FAIL' WHEN sum(warnings) > 0 THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS verdict, count(*) AS files, sum(issues)::BIGINT AS issues, sum(warnings)::BIGINT AS warnings FROM (SELECT CASE WHEN contains(text, 'PRIVATE KEY') OR regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 1 ELSE 0 END AS issues, CASE WHEN length(text) > 20000 THEN 1 ELSE 0 END AS warnings FROM documents)")
def scan_verdict(spark, sf_dir):
    """A23, P20."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select((text.contains("PRIVATE KEY") | text.rlike("AKIA[0-9A-Z]{16}")).cast("int").alias("issues"), (F.length(text) > 20000).cast("int").alias("warnings"))
    total = docs.agg(F.count(F.lit(1)).alias("files"), F.sum("issues").alias("issues"), F.sum("warnings").alias("warnings"))
    return total.select(F.when(F.col("issues") > 0, "FAIL").when(F.col("warnings") > 0, "PASS WITH WARNINGS").otherwise("PASS").alias("verdict"), "files", "issues", "warnings")


_REASON = "event_type || '_<' || user_id || '>_&'"


@register(f"""SELECT event_id, upper(replace(event_type, '_', ' ')) AS level, round(value, 2) AS score, floor(value / 1000 * 100 + 0.5)::BIGINT AS percent, greatest(5.0::DOUBLE, value / 1000 * 100) AS bar_width,
 CASE WHEN event_id % 3 = 0 THEN 'None detected' ELSE event_type || ', ' || user_id END AS categories, CASE WHEN event_id % 5 = 0 THEN 'Unknown Domain' ELSE 'u' || user_id END AS domain,
 '<li>' || replace(replace(replace(replace({_REASON}, '_', ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</li><li>' || replace(upper(event_type), '_', ' ') || '</li>' AS reasons FROM events""")
def display_format(spark, sf_dir):
    """What the user interface shows of each event, whose value over 1000 is the confidence."""
    confidence, user = F.col("value") / 1000, F.col("user_id").cast("string")
    asked = F.when(F.col("event_id") % 3 != 0, F.array("event_type", user))
    domain = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("u"), user))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.upper(display.spaced(F.col("event_type"))).alias("level"),
        F.round("value", 2).alias("score"),
        display.percent(confidence).alias("percent"),
        display.bar_width(confidence).alias("bar_width"),
        display.joined(asked).alias("categories"),
        F.coalesce(domain, F.lit("Unknown Domain")).alias("domain"),
        display.reason_items(F.array(F.expr(_REASON), F.upper("event_type"))).alias("reasons"),
    )


_PATH = "p_brand || '/' || p_type || '/' || p_size || '/' || p_partkey || '.csv'"


@register(f"""WITH f AS (SELECT DISTINCT {_PATH} AS path FROM part WHERE p_partkey % 3 > 0), e AS (SELECT DISTINCT {_PATH} AS path FROM part WHERE p_partkey % 3 < 2),
 a AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || (p_size // 10) AS begin FROM part WHERE p_retailprice < 1000 UNION SELECT '')
 SELECT path, 'missing' AS finding FROM e WHERE path NOT IN (SELECT path FROM f)
 UNION ALL SELECT path, CASE WHEN EXISTS (SELECT 1 FROM a WHERE begin <> '' AND starts_with(path, begin)) THEN 'approved' ELSE 'unexpected' END FROM f WHERE path NOT IN (SELECT path FROM e)""")
def path_approvals(spark, sf_dir):
    """Missing, approved by the beginning of a path (any text, as 'a/b/1' approves 'a/b/12/x'), unexpected."""
    part = table(spark, sf_dir, "part")
    paths = part.select("p_partkey", F.expr(_PATH).alias("path"))
    approved = part.filter("p_retailprice < 1000").select(F.expr("p_brand || '/' || p_type || '/' || (p_size div 10)").alias("path")).union(spark.createDataFrame([("",)], "path string"))
    return store.path_findings(paths.filter("p_partkey % 3 > 0").select("path"), paths.filter("p_partkey % 3 < 2").select("path"), approved)
