"""Pages to decisions in one plan: the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import lexical
from tidewatch.operators import decisions
from tidewatch.sources.tables import table

from .registry import Registry
from .url_queries import LEXICAL, PARTS

register = Registry()

_PW, _OTP, _XD = "page_id % 3 = 0", "page_id % 4 = 0", "page_id % 5 = 0"


@register(f"""WITH {PARTS}, s AS (SELECT u.page_id, u_host AS domain, {LEXICAL['entropy']} AS entropy, (SELECT len(regexp_extract_all(html, '<script')) FROM pages p WHERE p.page_id = u.page_id)::BIGINT AS scripts,
 ((CASE WHEN {_PW} THEN 0.4::FLOAT ELSE 0::FLOAT END + CASE WHEN {_OTP} THEN 0.3::FLOAT ELSE 0::FLOAT END) + CASE WHEN {_XD} THEN 0.3::FLOAT ELSE 0::FLOAT END)::FLOAT::DOUBLE AS score FROM u),
 c AS (SELECT *, CASE WHEN score < 0.3::DOUBLE THEN 'benign' WHEN score < 0.7::DOUBLE THEN 'suspicious' ELSE 'malicious' END AS threat_level, greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN score < 0.2::DOUBLE OR score > 0.8::DOUBLE THEN 0.2::DOUBLE ELSE 0 END + (({_PW})::INT + ({_OTP})::INT + ({_XD})::INT) * 0.1::DOUBLE - CASE WHEN scripts = 0 THEN 0.2::DOUBLE ELSE 0 END)) AS confidence FROM s)
 SELECT page_id, domain, entropy, scripts, round(score, 6) AS score, threat_level, CASE WHEN threat_level = 'benign' THEN 'ALLOW' WHEN threat_level = 'malicious' AND confidence > 0.8::DOUBLE THEN 'BLOCK' WHEN threat_level = 'malicious' THEN 'CONTAIN' ELSE 'WARN' END AS action FROM c""")
def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL parts, entropy, scripts, score, level and action of every page; fields come from the page's number."""
    df = lexical.with_url_parts(table(spark, sf_dir, "pages")).withColumns({"password": F.expr(_PW), "otp": F.expr(_OTP), "cross_domain": F.expr(_XD), "scripts": F.regexp_count("html", F.lit("<script")), "entropy": lexical.entropy(F.col("u_url"))})
    c = F.col
    out = decisions.decided(df, decisions.model_score(c("password"), c("otp"), c("cross_domain")), c("password"), c("otp"), c("cross_domain"), F.lit(0), F.lit(0), c("scripts") == 0)
    return out.select("page_id", c("u_host").alias("domain"), "entropy", "scripts", F.round("score", 6).alias("score"), "threat_level", "action")
