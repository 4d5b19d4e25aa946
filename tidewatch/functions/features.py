"""All 81 features of a sample: lexical and domain ones, then what a sample gives or what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import domain_features, lexical_features, with_url_parts


def sample_features(samples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, then the 81 features in their fixed order.

    samples has url and any of the optional columns (hostname, claimed_service, known_brand, official_domain,
    form_count, login_form_detected, ...). A missing column and a null both mean "not given".
    """
    have = set(samples.columns)

    def given(name: str, default: Column | int) -> Column:
        default = F.lit(default) if isinstance(default, int) else default
        return F.coalesce(F.col(name).cast("int"), default) if name in have else default

    def flag(name: str, default: Column | int) -> Column:
        return (given(name, default) != 0).cast("int")

    def text(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in have]
        return F.lower(F.coalesce(*found, F.lit(""))) if found else F.lit("")

    base = with_url_parts(samples, host="hostname" if "hostname" in have else None)
    brand, official = text("known_brand"), text("official_domain")
    base = base.select(*keep, *[c for c in base.columns if c not in keep and c.startswith("u_")], *[F.col(c).alias(f"g_{c}") for c in samples.columns], brand.alias("b_brand"), official.alias("b_official"), F.when(text("claimed_service", "claimed_service_category") == "", "unknown").otherwise(text("claimed_service", "claimed_service_category")).alias("b_service") if have & {"claimed_service", "claimed_service_category"} else F.lit("unknown").alias("b_service"))
    have_g = {f"g_{c}" for c in have}

    def given(name: str, default: Column | int) -> Column:  # noqa: F811  over the renamed columns
        default = F.lit(default) if isinstance(default, int) else default
        return F.coalesce(F.col(f"g_{name}").cast("int"), default) if f"g_{name}" in have_g else default

    c = F.col
    out = base.withColumns(lexical_features()).withColumns(domain_features(c("b_brand"), c("b_official")))
    either = (flag("login_form_detected", 0) == 1) | (flag("password_field_detected", 0) == 1)
    out = out.withColumns(
        {
            "form_count": given("form_count", F.when(either, 1).otherwise(0)),
            "input_count": given("input_count", F.when(flag("password_field_detected", 0) == 1, 2).when(flag("login_form_detected", 0) == 1, 1).otherwise(0)),
            "iframe_count": given("iframe_count", 0),
            "hidden_element_count": given("hidden_element_count", 0),
            "external_resource_count": given("external_resource_count", flag("cross_domain_redirect", 0)),
            "external_script_count": given("external_script_count", 0),
            "inline_script_count": given("inline_script_count", 0),
            "payment_form_detected": flag("payment_form_detected", 0),
            "registration_form_detected": flag("registration_form_detected", 0),
            "file_upload_form_detected": flag("file_upload_form_detected", 0),
            "password_field_detected": flag("password_field_detected", 0),
            "otp_field_detected": flag("otp_field_detected", 0),
            "payment_field_detected": flag("payment_field_detected", 0),
            "identity_field_detected": flag("identity_field_detected", 0),
            "hidden_field_count": given("hidden_field_count", 0),
            "cross_origin_submission": flag("cross_origin_submission", given("cross_domain_form", 0)),
            "form_secure_transport": (c("u_scheme") == "https").cast("int"),
            "redirect_count": given("redirect_count", 0),
            "cross_domain_redirect": flag("cross_domain_redirect", 0),
            "claimed_service_category": c("b_service"),
            "known_brand": F.when(c("b_brand") == "", "unknown").otherwise(c("b_brand")),
            "device_data_requested": flag("device_data_requested", 0),
            "purpose_mismatch": flag("purpose_mismatch", 0),
        }
    )
    both = lambda a, b: ((c(a) == 1) & (c(b) == 1)).cast("int")
    out = out.withColumns(
        {
            "button_count": c("form_count"),
            "dom_element_count": 2 * c("form_count") + c("input_count") + c("external_resource_count"),
            "login_form_detected": flag("login_form_detected", (c("form_count") > 0).cast("int")),
            "password_form_detected": flag("password_form_detected", c("password_field_detected")),
            "field_count": c("input_count"),
            "sensitive_field_count": c("password_field_detected") + c("otp_field_detected"),
            "same_origin_submission": ((c("form_count") > 0) & (c("cross_origin_submission") == 0)).cast("int"),
            "cross_registrable_domain_submission": c("cross_origin_submission"),
            "redirect_chain_length": c("redirect_count"),
            "cross_registrable_domain_redirect": c("cross_domain_redirect"),
            "redirect_to_ip": both("cross_domain_redirect", "ip_address_host"),
            "redirect_to_punycode": both("cross_domain_redirect", "punycode_present"),
            "redirect_to_similar_brand": both("cross_domain_redirect", "brand_domain_mismatch"),
            "redirect_chain_contains_unknown_domain": ((c("cross_domain_redirect") == 1) & (c("domain_known_to_registry") == 0)).cast("int"),
            "official_domain_match": c("domain_known_to_registry"),
            "authorization_domain_match": c("domain_known_to_registry"),
            "brand_impersonation_indicator": flag("brand_impersonation_indicator", c("brand_domain_mismatch")),
            "identity_status": F.when(c("domain_known_to_registry") == 1, "verified").when(c("b_brand") == "", "unknown").otherwise("mismatched"),
            "password_requested": flag("password_requested", c("password_field_detected")),
            "otp_requested": flag("otp_requested", c("otp_field_detected")),
            "financial_data_requested": flag("financial_data_requested", c("payment_field_detected")),
            "identity_data_requested": flag("identity_data_requested", c("identity_field_detected")),
            "possibly_excessive": flag("possibly_excessive", (c("input_count") > 5).cast("int")),
            "deceptive_collection_indicator": flag("deceptive_collection_indicator", both("cross_origin_submission", "password_field_detected")),
        }
    )
    asked = ((c("login_form_detected") == 1) | (c("password_field_detected") == 1)).cast("int")
    out = out.withColumns(
        {
            "autocomplete_present": flag("autocomplete_present", c("login_form_detected")),
            "authentication_domain_match": ((c("domain_known_to_registry") == 1) & (asked == 1)).cast("int"),
            "credential_requested": flag("credential_requested", asked),
        }
    )
    out = out.withColumns(
        {
            "personal_data_requested": flag("personal_data_requested", c("credential_requested")),
            "unexpected_data_request": flag("unexpected_data_request", ((c("credential_requested") == 1) & (c("official_domain_match") == 0)).cast("int")),
        }
    )
    return out.select(*keep, *FEATURES)


# Fixed values that results depend on: the features in order.
FEATURES = [
    "url_length", "hostname_length", "path_length", "query_length", "fragment_length", "subdomain_count", "path_depth", "query_parameter_count", "special_character_count",
    "digit_count", "letter_count", "encoded_character_count", "entropy", "ip_address_host", "punycode_present", "at_symbol_present", "hyphen_count", "underscore_count",
    "suspicious_token_count", "brand_keyword_count", "brand_domain_mismatch", "domain_length", "subdomain_length", "domain_is_ip", "punycode", "domain_similarity_to_brand",
    "homograph_indicator", "domain_known_to_registry", "domain_matches_claimed_service", "dom_element_count", "form_count", "input_count", "button_count", "iframe_count",
    "hidden_element_count", "external_resource_count", "external_script_count", "inline_script_count", "login_form_detected", "payment_form_detected", "registration_form_detected",
    "password_form_detected", "file_upload_form_detected", "field_count", "sensitive_field_count", "hidden_field_count", "same_origin_submission", "cross_origin_submission",
    "cross_registrable_domain_submission", "form_secure_transport", "autocomplete_present", "password_field_detected", "otp_field_detected", "payment_field_detected",
    "identity_field_detected", "redirect_count", "redirect_chain_length", "cross_domain_redirect", "cross_registrable_domain_redirect", "redirect_to_ip", "redirect_to_punycode",
    "redirect_to_similar_brand", "redirect_chain_contains_unknown_domain", "claimed_service_category", "known_brand", "official_domain_match", "authentication_domain_match",
    "authorization_domain_match", "brand_impersonation_indicator", "identity_status", "credential_requested", "password_requested", "otp_requested", "financial_data_requested",
    "identity_data_requested", "personal_data_requested", "device_data_requested", "unexpected_data_request", "purpose_mismatch", "possibly_excessive", "deceptive_collection_indicator",
]

_URL = ["url_length", "hostname_length", "path_length", "query_length", "subdomain_count", "entropy", "ip_address_host", "punycode_present", "hyphen_count", "suspicious_token_count", "brand_keyword_count"]
_DOMAIN = ["domain_length", "domain_is_ip", "domain_similarity_to_brand", "homograph_indicator", "domain_known_to_registry"]
_DOM = ["dom_element_count", "form_count", "input_count", "button_count", "external_script_count", "inline_script_count"]
_FORM = ["login_form_detected", "password_field_detected", "otp_field_detected", "same_origin_submission", "cross_origin_submission", "form_secure_transport"]
_CONTEXT = ["redirect_count", "cross_domain_redirect", "credential_requested", "password_requested", "otp_requested", "purpose_mismatch", "brand_impersonation_indicator", "deceptive_collection_indicator"]
GROUPS = {"A": _URL, "B": _URL + _DOMAIN, "C": _URL + _DOMAIN + _DOM, "D": _URL + _DOMAIN + _DOM + _FORM, "E": _URL + _DOMAIN + _DOM + _FORM + _CONTEXT}
