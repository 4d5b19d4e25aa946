"""The browser's feature vector: 54 keys over one evidence collection a row.

It differs from sample_features() on purpose: one leading slash of the path is stripped instead of all, an empty host
falls back to the parsed one, DOM elements are forms, inputs and scripts, and a login form is a password field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import lexical_features, with_url_parts

# Fixed values that results depend on: flags and the data type each stands for.
TYPE_FLAGS = {"has_email_field": "EMAIL", "has_username_field": "USERNAME", "has_phone_field": "PHONE", "has_card_field": "PAYMENT_CARD", "has_cvv_field": "CVV", "has_identity_field": "IDENTITY_DOCUMENT", "has_bank_field": "BANK_ACCOUNT", "has_file_upload": "FILE_UPLOAD"}


def browser_features(evidence: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, then the 54 features.

    evidence: url, domain, forms array<struct<is_cross_domain, has_password, has_otp, types>>, inputs
    array<struct<is_password, is_otp, types>>, scripts array<struct<is_inline, is_cross_domain>>; null arrays are empty.
    """
    forms, inputs, scripts = (F.coalesce(c, F.array().cast(evidence.schema[c].dataType)) for c in ("forms", "inputs", "scripts"))
    df = evidence.withColumns({"forms": forms, "inputs": inputs, "scripts": scripts})
    df = with_url_parts(df.withColumn("_host", F.nullif(F.col("domain"), F.lit(""))), host="_host").withColumn("u_path", F.regexp_replace("u_path", "^$", "/"))

    def any_of(test_form: str, test_input: str | None) -> Column:
        found = F.exists("forms", lambda f: f[test_form])
        return F.coalesce(found | F.exists("inputs", lambda i: i[test_input]) if test_input else found, F.lit(False))

    def typed(kind: str) -> Column:
        has = lambda x: F.coalesce(F.array_contains(x["types"], kind), F.lit(False))
        return F.exists("forms", has) | F.exists("inputs", has)

    flags = {"has_password_field": any_of("has_password", "is_password"), "has_otp_field": any_of("has_otp", "is_otp"), "cross_domain_form": any_of("is_cross_domain", None)}
    df = df.withColumns(flags | {n: typed(t) for n, t in TYPE_FLAGS.items()} | {"form_count": F.size("forms"), "input_count": F.size("inputs")})
    lexical = lexical_features() | {"path_length": F.length(F.regexp_replace("u_path", "^/", ""))}
    one = lambda c: F.col(c).cast("int")
    derived = {
        "domain_length": F.length("u_host"),
        "domain_is_ip": lexical["ip_address_host"],
        "punycode": lexical["punycode_present"],
        "dom_element_count": F.col("form_count") + F.col("input_count") + F.size("scripts"),
        "external_script_count": F.size(F.filter("scripts", lambda s: s["is_cross_domain"])),
        "inline_script_count": F.size(F.filter("scripts", lambda s: s["is_inline"])),
        "login_form_detected": one("has_password_field"),
        "password_field_detected": one("has_password_field"),
        "otp_field_detected": one("has_otp_field"),
        "payment_field_detected": one("has_card_field"),
        "identity_field_detected": one("has_identity_field"),
        "same_origin_submission": ((F.col("form_count") > 0) & ~F.col("cross_domain_form")).cast("int"),
        "cross_origin_submission": one("cross_domain_form"),
        "cross_registrable_domain_submission": one("cross_domain_form"),
        "form_secure_transport": (F.col("u_scheme") == "https").cast("int"),
        "field_count": F.col("input_count"),
        "credential_requested": one("has_password_field"),
        "password_requested": one("has_password_field"),
        "otp_requested": one("has_otp_field"),
        "financial_data_requested": (F.col("has_card_field") | F.col("has_bank_field")).cast("int"),
        "identity_data_requested": one("has_identity_field"),
    }
    first = ["has_password_field", "has_otp_field", "cross_domain_form", "form_count", "input_count", *TYPE_FLAGS]
    return df.select(*keep, *first, *[c.alias(n) for n, c in (lexical | derived).items()])
