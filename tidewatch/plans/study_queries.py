"""Imports of files, what the user interface is told, and the study's models by feature group."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import features, lexical
from tidewatch.operators import decisions, imports, learning
from tidewatch.operators.lineage import cut
from tidewatch.sources.tables import table

from .evidence_queries import _ACTED, _REASONS, _flags
from .registry import Registry
from .url_queries import PARTS, _samples

register = Registry()

_SPECIFIER = "CASE page_id % 5 WHEN 0 THEN 'lodash' WHEN 1 THEN '../en/' || (page_id * 7) % 1000 WHEN 2 THEN '../de/' || (page_id * 3) % 1000 ELSE './' || (page_id * 11) % 1000 END"
_FILE = "CASE page_id % 4 WHEN 0 THEN u_path WHEN 1 THEN u_path || '.js' WHEN 2 THEN u_path || '.mjs' ELSE u_path || '/index.js' END"
_DIR = "regexp_replace(u_path, '/[^/]*$', '')"


@register(f"""WITH {PARTS}, s AS (SELECT page_id, {_SPECIFIER} AS specifier, {_DIR} AS dir FROM u WHERE url LIKE '%//%'), files AS (SELECT DISTINCT {_FILE} AS path FROM u WHERE url LIKE '%//%'),
 d AS (SELECT *, CASE WHEN starts_with(specifier, './') THEN dir || substr(specifier, 2) WHEN starts_with(specifier, '../') THEN regexp_replace(dir, '/[^/]*$', '') || substr(specifier, 3) END AS direct FROM s),
 c AS (SELECT page_id, k, path FROM d, (SELECT unnest([0, 1, 2, 3]) AS k), files WHERE path = direct || ['', '.js', '.mjs', '/index.js'][k + 1]),
 f AS (SELECT page_id, arg_min(path, k) AS path FROM c GROUP BY 1)
 SELECT d.page_id, specifier, direct IS NULL AS is_external, direct IS NULL OR f.path IS NOT NULL AS resolvable, coalesce(f.path, direct, specifier) AS path FROM d LEFT JOIN f ON d.page_id = f.page_id""")
def resolved_imports(spark, sf_dir):
    """An import for each page, resolved among the files that the paths of all pages make."""
    pages = lexical.with_url_parts(table(spark, sf_dir, "pages").select("page_id", "url").filter("url LIKE '%//%'"))
    found = pages.select("page_id", F.col("u_path").alias("base"), F.expr(_SPECIFIER).alias("specifier"))
    files = pages.select(F.expr(_FILE).alias("path"))
    return imports.resolved_imports(found, files, "page_id").select("page_id", "specifier", "is_external", "resolvable", "path")


@register(f"""SELECT event_id, level AS threat_level, round(score, 6) AS score, round(confidence, 4) AS confidence, CASE WHEN len(reasons) = 0 THEN 'INSUFFICIENT_DATA' ELSE array_to_string(reasons, ',') END AS reasons, action,
 CASE action WHEN 'ALLOW' THEN 'ALLOWED' WHEN 'WARN' THEN 'WARNED' WHEN 'BLOCK' THEN 'BLOCKED_BEFORE_LOAD' ELSE 'CONTAINED_AFTER_LOAD' END AS outcome, 'e' || event_id AS domain,
 array_to_string(list_filter([CASE WHEN password THEN 'PASSWORD' END, CASE WHEN card THEN 'PAYMENT_CARD' END], lambda t: t IS NOT NULL), ',') AS requested_data_types FROM (SELECT *, {_REASONS} AS reasons FROM ({_ACTED}))""")
def ui_messages(spark, sf_dir):
    """The eight fields of a decision that the user interface is told, lists joined by commas."""
    c = F.col
    df = decisions.decided(_flags(spark, sf_dir), decisions.model_score(c("password"), c("otp"), c("cross_domain")), c("password"), c("otp"), c("cross_domain"), c("forms"), c("inputs"), (c("forms") == 0) & (c("scripts") == 0))
    flags = {"PASSWORD_FIELD_DETECTED": c("password"), "OTP_FIELD_DETECTED": c("otp"), "PAYMENT_CARD_FIELD_DETECTED": c("card"), "CVV_FIELD_DETECTED": c("cvv"), "IDENTITY_DOCUMENT_FIELD_DETECTED": c("identity"), "BANK_ACCOUNT_FIELD_DETECTED": c("bank"), "CROSS_DOMAIN_FORM": c("cross_domain")}
    df = df.withColumns({"reasons": decisions.reasons(c("score"), flags, c("forms"), c("inputs"), c("scripts"), c("cross_scripts")), "domain": F.concat(F.lit("e"), c("event_id")), "requested_data_types": F.array_compact(F.array(F.when(c("password"), "PASSWORD"), F.when(c("card"), "PAYMENT_CARD")))})
    out = decisions.ui_message(df, keep=("event_id",))
    return out.withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 4), "reasons": F.array_join("reasons", ","), "requested_data_types": F.array_join("requested_data_types", ",")})


def _labelled(spark, sf_dir):
    """Samples whose label is what only group E sees, one in four held out."""
    df = features.sample_features(_samples(spark, sf_dir), keep=("page_id",))
    df = df.withColumns({"label": F.col("deceptive_collection_indicator").cast("int"), "is_test": F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0})
    return cut(df.select(*features.GROUPS["E"], "label", "is_test"))  # each fit reads it several times


@register()
def feature_group_grid(spark, sf_dir):
    """The three models on each of the five feature groups, scored on the held-out rows. Fitted numbers depend on the library, so there is no SQL."""
    return learning.grid(_labelled(spark, sf_dir), features.GROUPS, "label", "is_test")


@register()
def balanced_baselines(spark, sf_dir):
    """M3, M4: the two baselines with balanced weights on all groups' features. No SQL, as above."""
    return learning.grid(_labelled(spark, sf_dir), {"E": features.GROUPS["E"]}, "label", "is_test", balanced=True)
