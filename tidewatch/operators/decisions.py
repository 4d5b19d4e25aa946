"""Score, threat level, confidence, reasons and policy of a page, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def model_score(password: Column, otp: Column, cross_domain: Column) -> Column:
    """The linear model in single precision; forms and inputs weigh nothing."""
    part = lambda c, w: _one(c).cast("float") * F.lit(w).cast("float")
    return (part(password, 0.4) + part(otp, 0.3) + part(cross_domain, 0.3)).cast("float").cast("double")


def fallback_score(password: Column, otp: Column, cross_domain: Column, brand: Column | None = None) -> Column:
    """The rule that scores where no model is ready."""
    total = F.lit(0.0) + F.when(password, 0.35).otherwise(0.0) + F.when(otp, 0.25).otherwise(0.0) + F.when(cross_domain, 0.35).otherwise(0.0)
    if brand is not None:
        total = total + F.when(brand, 0.3).otherwise(0.0)
    return F.least(total, F.lit(0.99))


#: Scorers by name: functions of (password, otp, cross_domain) columns.
SCORERS = {"model": model_score, "fallback": fallback_score}


def threat_level(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score) | (score < 0), "insufficient_evidence").when(score < 0.3, "benign").when(score < 0.7, "suspicious").otherwise("malicious")


def confidence(score: Column, password: Column, otp: Column, cross_domain: Column, forms: Column, inputs: Column, sparse: Column) -> Column:
    """Doubles are added in this order; another one changes what is above 0.8."""
    total = F.lit(0.5) + F.when((score < 0.2) | (score > 0.8), 0.2).otherwise(0.0)
    total = total + (_one(password) + _one(otp) + _one(cross_domain)) * F.lit(0.1)
    total = total + F.when(forms > 1, 0.1).otherwise(0.0) + F.when(inputs > 3, 0.1).otherwise(0.0) - F.when(sparse, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), total))


def reasons(score: Column, flags: dict[str, Column], forms: Column, inputs: Column, scripts: Column, cross_scripts: Column, comparison: Column | None = None) -> Column:
    """Reason codes in their fixed order, then those of the comparison that aren't there yet. flags: code to condition."""
    codes = [F.when(score > 0.8, "HIGH_ML_SCORE").when(score > 0.6, "ELEVATED_ML_SCORE").when(score < 0.2, "LOW_ML_SCORE")]
    codes += [F.when(condition, F.lit(code)) for code, condition in flags.items()]
    for count, least, name in ((forms, 2, "MULTIPLE_FORMS_"), (inputs, 5, "MANY_INPUT_FIELDS_"), (scripts, 3, "MULTIPLE_SCRIPTS_"), (cross_scripts, 0, "CROSS_DOMAIN_SCRIPTS_")):
        codes.append(F.when(count > least, F.concat(F.lit(name), count.cast("string"))))
    out = F.array_compact(F.array(*codes))
    if comparison is not None:
        out = F.array_distinct(F.concat(out, F.coalesce(comparison, F.array().cast("array<string>"))))
    return F.when(F.size(out) == 0, F.array(F.lit("INSUFFICIENT_DATA"))).otherwise(out)


def policy_action(level: Column, sure: Column) -> Column:
    return F.when(level.isin("benign", "insufficient_evidence"), "ALLOW").when((level == "malicious") & (sure > 0.8), "BLOCK").when(level == "malicious", "CONTAIN").otherwise("WARN")


# Fixed values that results depend on: outcome and wording of each action.
OUTCOMES = {"ALLOW": "ALLOWED", "WARN": "WARNED", "BLOCK": "BLOCKED_BEFORE_LOAD", "CONTAIN": "CONTAINED_AFTER_LOAD"}
CLAUSES = {"ALLOW": "allowing page to load normally", "WARN": "displaying warning to user", "BLOCK": "blocking page due to high-risk indicators", "CONTAIN": "containing page with restricted interactions"}


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def enforcement_outcome(action: Column) -> Column:
    return _looked_up(action, OUTCOMES)


def policy_reason(level: Column, sure: Column, action: Column) -> Column:
    band = F.when(sure > 0.7, "high confidence").when(sure > 0.5, "moderate confidence").otherwise("low confidence")
    return F.concat(level, F.lit(" threat ("), band, F.lit(") - "), _looked_up(action, CLAUSES))


def decided(df: DataFrame, score: Column, password: Column, otp: Column, cross_domain: Column, forms: Column, inputs: Column, sparse: Column) -> DataFrame:
    """df with score, threat_level, confidence, action, enforcement and policy_reason."""
    out = df.withColumn("score", score)
    out = out.withColumns({"threat_level": threat_level(F.col("score")), "confidence": confidence(F.col("score"), password, otp, cross_domain, forms, inputs, sparse)})
    out = out.withColumn("action", policy_action(F.col("threat_level"), F.col("confidence")))
    return out.withColumns({"enforcement": enforcement_outcome(F.col("action")), "policy_reason": policy_reason(F.col("threat_level"), F.col("confidence"), F.col("action"))})


def ui_message(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and the eight fields of decided() pages that the user interface is told; no data types asked for are an empty list."""
    asked = F.coalesce("requested_data_types", F.array().cast("array<string>")).alias("requested_data_types")
    return df.select(*keep, "threat_level", "score", "confidence", "reasons", "action", F.col("enforcement").alias("outcome"), "domain", asked)
