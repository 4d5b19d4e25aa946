"""Matching hosts with declared services and comparing observed behaviour with what is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.sources import tables


def host_suffixes(host: Column) -> Column:
    """a.b.c: [a.b.c, b.c, c]."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_profiles(df: DataFrame, host: str, services: list[tuple] = tables.PROFILES) -> DataFrame:
    """df with ord, service_id, official_domains and documented_data_categories of the first declared service that has the host or a domain above it; nulls if none.

    services: a bounded declaration (rows of tables.PROFILES). Its domains are a literal map that the suffixes of a host are looked up in, so rows stay where they are.
    """
    first = {d: i for i, s in reversed(list(enumerate(services))) for d in s[3]}
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    if not first:
        return df.withColumns({"ord": F.lit(None).cast("int"), "service_id": F.lit(None).cast("string"), "official_domains": texts([]), "documented_data_categories": texts([])})
    place = F.create_map(*[F.lit(v) for pair in first.items() for v in pair])
    declared = F.array(*[F.struct(F.lit(s[0]).alias("service_id"), texts(s[3]).alias("official_domains"), texts(s[4]).alias("documented_data_categories")) for s in services])
    placed = df.withColumn("ord", F.array_min(F.array_compact(F.transform(host_suffixes(F.col(host)), lambda h: place[h]))))
    named = F.get(declared, F.col("ord"))
    return placed.withColumns({n: named[n] for n in ("service_id", "official_domains", "documented_data_categories")})


def is_under(host: Column, domains: Column) -> Column:
    return F.coalesce(F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))), F.lit(False))


def observed_event(form: Column, page_domain: Column) -> Column:
    """What submitting a form (action, is_cross_domain, has_password, has_otp) would do."""
    password, otp = form["has_password"], form["has_otp"]
    return F.struct(
        F.when(password, "credential_input").when(otp, "otp_input").otherwise("form_submission").alias("event_type"),
        F.when(password | otp, "credentials").otherwise("general").alias("data_category"),
        F.when(password & otp, "mfa_login").when(password, "password_login").when(otp, "otp_verification").otherwise("general_input").alias("data_subtype"),
        F.when(form["action"] == "", page_domain).otherwise(form["action"]).alias("destination"),
        F.when(form["is_cross_domain"], "unauthorized").otherwise("authorized").alias("authorization_status"),
    )


def with_comparison(df: DataFrame, host: str = "page_domain", forms: str = "forms", url: str | None = None, services: list[tuple] = tables.PROFILES) -> DataFrame:
    """df with service_id, outcome, risk_modifier and comparison_reasons (in order of the forms).

    Destinations that start with a slash are not looked at; the others count as the page's url (https://host by
    default) resolves them. One with a scheme and no host (javascript:, mailto:) has the empty host, which no service
    has; a relative one on a page without host can't be resolved and isn't looked at.
    """
    matched = match_profiles(df, host, services)
    base = F.col(url) if url else F.concat(F.lit("https://"), F.col(host))
    page = F.col(host)

    def against(event: Column) -> Column:
        place = event["destination"]
        target = urls.host(urls.resolved(base, place))
        known = (urls.scheme(place) != "") | (urls.authority(base) != "")
        away = F.coalesce(known & (place != "") & ~place.startswith("/"), F.lit(False)) & ~is_under(target, F.col("official_domains"))
        extra = (event["data_category"] != "general") & ~F.array_contains("documented_data_categories", event["data_category"])
        return F.array_compact(F.array(F.when(away, F.concat(F.lit("DESTINATION_MISMATCH_"), target)), F.when(extra, F.concat(F.lit("UNDOCUMENTED_DATA_CATEGORY_"), event["data_category"]))))

    found = F.flatten(F.transform(forms, lambda f: against(observed_event(f, page))))
    out = matched.withColumn("_found", F.when(F.col("service_id").isNotNull(), found))
    deceptive = F.exists(forms, lambda f: f["has_password"]) & F.exists(forms, lambda f: f["is_cross_domain"])
    outcome = (
        F.when(F.col("service_id").isNull() & deceptive, "DECEPTIVE_INDICATOR")
        .when(F.col("service_id").isNull(), "UNKNOWN")
        .when(F.exists("_found", lambda r: r.startswith("DESTINATION_MISMATCH_")), "IDENTITY_MISMATCH")
        .when(F.size("_found") > 0, "POSSIBLY_EXCESSIVE")
        .otherwise("EXPECTED")
    )
    out = out.withColumn("outcome", outcome)
    modifier = F.when(F.col("outcome") == "DECEPTIVE_INDICATOR", 0.35).when(F.col("outcome") == "IDENTITY_MISMATCH", 0.4).when(F.col("outcome") == "POSSIBLY_EXCESSIVE", 0.2).when(F.col("outcome") == "EXPECTED", -0.2).otherwise(0.0)
    reasons = (
        F.when(F.col("outcome") == "DECEPTIVE_INDICATOR", F.array(F.lit("UNKNOWN_DOMAIN_COLLECTING_CREDENTIALS_CROSS_ORIGIN")))
        .when(F.col("outcome") == "UNKNOWN", F.array(F.lit("SERVICE_PROFILE_UNREGISTERED")))
        .when(F.col("outcome") == "EXPECTED", F.array(F.lit("MATCHES_DECLARED_SERVICE_PROFILE")))
        .otherwise(F.col("_found"))
    )
    return out.withColumn("risk_modifier", modifier).withColumn("comparison_reasons", reasons).drop("_found", "ord", "official_domains", "documented_data_categories")
