"""Evidence of forms and inputs made from events, its classification, comparison and decisions.

The pages table has no forms, so evidence comes from event numbers: the same rule text in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import classifier
from tidewatch.operators import decisions, profiles
from tidewatch.sources import html_forms
from tidewatch.sources.tables import PROFILES, table

from .registry import Registry

register = Registry()

_DOMAIN = "CASE event_id % 6 WHEN 0 THEN 'auth.bankone.com' WHEN 1 THEN 'www.PayPal.com' WHEN 2 THEN 'evil.example.org' WHEN 3 THEN 'accounts.google.com' WHEN 4 THEN CASE WHEN event_type = 'view' THEN 'help.docs.example.com' ELSE 'notgoogle.com' END ELSE 'login.microsoftonline.com' END"
_ACTION = "CASE (event_id + k) % 5 WHEN 0 THEN '/login' WHEN 1 THEN 'https://auth.bankone.com/x' WHEN 2 THEN 'https://collect.example.net:8443/p' WHEN 3 THEN CASE event_type WHEN 'error' THEN 'javascript:void(0)' WHEN 'click' THEN 'mailto:x@evil.example.org' WHEN 'signup' THEN 'next/step?user=' || user_id ELSE '' END ELSE '//cdn.example.org/q' END"
_INPUT = {
    "input_type": "CASE event_id % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'Email' WHEN 2 THEN 'tel' WHEN 3 THEN 'file' WHEN 4 THEN 'date' ELSE 'text' END",
    "name": "CASE event_id % 23 WHEN 0 THEN 'user_password' WHEN 1 THEN 'otp' WHEN 2 THEN 'security-code' WHEN 3 THEN 'card_number' WHEN 4 THEN 'Login' WHEN 5 THEN 'birth-date' WHEN 6 THEN 'iban' WHEN 7 THEN 'passport' WHEN 8 THEN 'zipcode' WHEN 9 THEN 'geo_lat' WHEN 10 THEN 'exp_month' WHEN 11 THEN 'pwd' WHEN 12 THEN 'e-mail' WHEN 13 THEN 'webcam' WHEN 14 THEN 'voice_record' WHEN 15 THEN 'cell' ELSE 'q' END",
    "autocomplete": "CASE event_id % 13 WHEN 0 THEN 'current-password' WHEN 1 THEN 'one-time-code' WHEN 2 THEN 'email-address' WHEN 3 THEN 'cc-number' WHEN 4 THEN 'username' WHEN 5 THEN 'bday-day' WHEN 6 THEN 'cc-csc' WHEN 7 THEN 'cc-exp-month' ELSE '' END",
    "capture": "CASE event_id % 17 WHEN 0 THEN 'user' WHEN 1 THEN 'microphone' WHEN 2 THEN 'x' ELSE '' END",
    "accept": "CASE event_id % 3 WHEN 0 THEN 'image/*' WHEN 1 THEN 'audio/*' ELSE '' END",
}


def _inputs(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", *[f"{v} AS {k}" for k, v in _INPUT.items()])


def _classified(spark, sf_dir):
    df = _inputs(spark, sf_dir)
    types = classifier.data_types(F.col("input_type"), F.col("name"), F.lit(None).cast("string"), F.col("autocomplete"), accept=F.col("accept"), capture=F.col("capture"))
    return df.withColumn("types", types)


def _rule(category: str) -> str:
    tests = [f"t = '{classifier.TYPES[category]}'"] if category in classifier.TYPES else []
    tests += [f"contains(a, '{p}')" for p in classifier.AUTOCOMPLETE.get(category, [])]
    named = f"regexp_matches(w, '\\b({classifier.WORDS[category]})\\b')" if category in classifier.WORDS else None
    if category == "USERNAME":
        return f"(a IN ('username', 'nickname', 'webauthn') OR ({named} AND NOT ({_rule('PASSWORD')}) AND NOT ({_rule('EMAIL')})))"
    if category == "DATE_OF_BIRTH":
        named = f"({named} AND t IN ('date', 'text', 'number', ''))"
    if category == "CAMERA":
        tests += ["c IN ('user', 'environment', 'camera')", "((contains(x, 'video') OR contains(x, 'image')) AND c <> '')"]
    if category == "MICROPHONE":
        tests += ["c = 'microphone'", "(contains(x, 'audio') AND c <> '')"]
    return "(" + " OR ".join([*tests, *([named] if named else [])]) + ")"


_TYPES_SQL = "SELECT event_id, t, [" + ", ".join(f"CASE WHEN {_rule(c)} THEN '{c}' END" for c in classifier.CATEGORIES) + "] AS all_types FROM (SELECT event_id, trim(lower(input_type)) AS t, trim(lower(name)) || '   ' AS w, trim(lower(autocomplete)) AS a, capture AS c, accept AS x FROM (SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _INPUT.items()) + " FROM events))"
_KEPT = "list_filter(all_types, lambda v: v IS NOT NULL)"


@register(f"SELECT event_id, array_to_string({_KEPT}, ',') AS types, (t = 'password' OR list_contains({_KEPT}, 'PASSWORD')) AS is_password, (t = 'one-time-code' OR list_contains({_KEPT}, 'OTP')) AS is_otp FROM ({_TYPES_SQL})")
def classify_inputs(spark, sf_dir):
    """K1 to K17 over one input an event."""
    df = _classified(spark, sf_dir)
    return df.select("event_id", F.array_join("types", ",").alias("types"), classifier.is_password(F.col("input_type"), F.col("types")).alias("is_password"), classifier.is_otp(F.col("input_type"), F.col("types")).alias("is_otp"))


@register(f"""WITH i AS (SELECT event_id, {_KEPT} AS types FROM ({_TYPES_SQL})), e AS (SELECT event_id, event_id // 4 AS form_id, types FROM i),
 u AS (SELECT form_id, unnest(types) AS ty FROM e), n AS (SELECT form_id, count(*) AS inputs FROM e GROUP BY 1)
 SELECT n.form_id, n.inputs, coalesce(string_agg(DISTINCT ty, ',' ORDER BY ty), '') AS types, coalesce(bool_or(ty = 'PASSWORD'), false) AS has_password, coalesce(bool_or(ty = 'EMAIL'), false) AS has_email FROM n LEFT JOIN u ON n.form_id = u.form_id GROUP BY 1, 2""")
def form_fold(spark, sf_dir):
    """Inputs folded to their forms, four inputs a form."""
    df = _classified(spark, sf_dir).withColumn("form_id", F.expr("event_id div 4"))
    folded = df.groupBy("form_id").agg(F.count(F.lit(1)).alias("inputs"), F.collect_list("types").alias("lists"))
    types = F.array_sort(classifier.folded(F.col("lists")))
    return folded.select("form_id", "inputs", F.array_join(types, ",").alias("types"), F.exists(types, lambda t: t == "PASSWORD").alias("has_password"), F.exists(types, lambda t: t == "EMAIL").alias("has_email"))


_EDGES = "SELECT 'page-' || (event_id // 16) AS source_id, 'form-' || (event_id // 4) AS target_id, 'contains' AS relation FROM events UNION SELECT 'form-' || (event_id // 4), 'input-' || event_id, 'contains' FROM events"


@register(_EDGES)
def evidence_edges(spark, sf_dir):
    """Containment edges page to form to input."""
    ids = table(spark, sf_dir, "events").selectExpr("concat('page-', event_id div 16) AS page", "concat('form-', event_id div 4) AS form", "concat('input-', event_id) AS input")
    edge = lambda a, b: F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit("contains").alias("relation"))
    return ids.select(F.inline(F.array(edge("page", "form"), edge("form", "input")))).distinct()


_FLAGS = {"password": "event_id % 3 = 0", "otp": "event_id % 4 = 0", "cross_domain": "event_id % 5 = 0", "forms": "event_id % 4", "inputs": "event_id % 9", "scripts": "event_id % 6", "cross_scripts": "event_id % 2", "card": "event_id % 11 = 0", "cvv": "event_id % 13 = 0", "identity": "event_id % 17 = 0", "bank": "event_id % 19 = 0"}
_FLAGS_SQL = ", ".join(f"({v}) AS {k}" for k, v in _FLAGS.items())


def _flags(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", *[f"({v}) AS {k}" for k, v in _FLAGS.items()])


_SCORE = "((CASE WHEN password THEN 0.4::FLOAT ELSE 0::FLOAT END + CASE WHEN otp THEN 0.3::FLOAT ELSE 0::FLOAT END) + CASE WHEN cross_domain THEN 0.3::FLOAT ELSE 0::FLOAT END)::FLOAT::DOUBLE"
_FALLBACK = "least(0.0::DOUBLE + CASE WHEN password THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN otp THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN cross_domain THEN 0.35::DOUBLE ELSE 0 END, 0.99::DOUBLE)"


def _level(score: str) -> str:
    return f"CASE WHEN {score} < 0.3::DOUBLE THEN 'benign' WHEN {score} < 0.7::DOUBLE THEN 'suspicious' ELSE 'malicious' END"


@register(f"SELECT event_id, round({_SCORE}, 6) AS model, CASE WHEN {_SCORE} >= 0.5 THEN 'malicious' ELSE 'benign' END AS label, round({_FALLBACK}, 6) AS fallback, {_level(_SCORE)} AS model_level, {_level(_FALLBACK)} AS fallback_level FROM (SELECT event_id, {_FLAGS_SQL} FROM events)")
def model_scores(spark, sf_dir):
    """D1 to D4, X-1, X-2."""
    p, o, x = F.col("password"), F.col("otp"), F.col("cross_domain")
    df = _flags(spark, sf_dir).withColumns({"m": decisions.SCORERS["model"](p, o, x), "f": decisions.SCORERS["fallback"](p, o, x)})
    return df.select("event_id", F.round("m", 6).alias("model"), F.when(F.col("m") >= 0.5, "malicious").otherwise("benign").alias("label"), F.round("f", 6).alias("fallback"), decisions.threat_level(F.col("m")).alias("model_level"), decisions.threat_level(F.col("f")).alias("fallback_level"))


_ONE = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
_CONFIDENCE = f"greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN score < 0.2::DOUBLE OR score > 0.8::DOUBLE THEN 0.2::DOUBLE ELSE 0 END + ({_ONE('password')} + {_ONE('otp')} + {_ONE('cross_domain')}) * 0.1::DOUBLE + CASE WHEN forms > 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN inputs > 3 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN forms = 0 AND scripts = 0 THEN 0.2::DOUBLE ELSE 0 END))"
_REASONS = """list_filter([CASE WHEN score > 0.8::DOUBLE THEN 'HIGH_ML_SCORE' WHEN score > 0.6::DOUBLE THEN 'ELEVATED_ML_SCORE' WHEN score < 0.2::DOUBLE THEN 'LOW_ML_SCORE' END,
 CASE WHEN password THEN 'PASSWORD_FIELD_DETECTED' END, CASE WHEN otp THEN 'OTP_FIELD_DETECTED' END, CASE WHEN card THEN 'PAYMENT_CARD_FIELD_DETECTED' END, CASE WHEN cvv THEN 'CVV_FIELD_DETECTED' END,
 CASE WHEN identity THEN 'IDENTITY_DOCUMENT_FIELD_DETECTED' END, CASE WHEN bank THEN 'BANK_ACCOUNT_FIELD_DETECTED' END, CASE WHEN cross_domain THEN 'CROSS_DOMAIN_FORM' END, CASE WHEN forms > 2 THEN 'MULTIPLE_FORMS_' || forms END,
 CASE WHEN inputs > 5 THEN 'MANY_INPUT_FIELDS_' || inputs END, CASE WHEN scripts > 3 THEN 'MULTIPLE_SCRIPTS_' || scripts END, CASE WHEN cross_scripts > 0 THEN 'CROSS_DOMAIN_SCRIPTS_' || cross_scripts END], lambda r: r IS NOT NULL)"""
_ACTED = f"SELECT *, CASE WHEN level = 'benign' THEN 'ALLOW' WHEN level = 'malicious' AND confidence > 0.8::DOUBLE THEN 'BLOCK' WHEN level = 'malicious' THEN 'CONTAIN' ELSE 'WARN' END AS action FROM (SELECT *, {_CONFIDENCE} AS confidence, {_level('score')} AS level FROM (SELECT *, {_SCORE} AS score FROM (SELECT event_id, {_FLAGS_SQL} FROM events)))"


@register(f"""SELECT event_id, round(score, 6) AS score, level AS threat_level, round(confidence, 4) AS confidence, action,
 CASE action WHEN 'ALLOW' THEN 'ALLOWED' WHEN 'WARN' THEN 'WARNED' WHEN 'BLOCK' THEN 'BLOCKED_BEFORE_LOAD' ELSE 'CONTAINED_AFTER_LOAD' END AS enforcement,
 level || ' threat (' || CASE WHEN confidence > 0.7::DOUBLE THEN 'high confidence' WHEN confidence > 0.5::DOUBLE THEN 'moderate confidence' ELSE 'low confidence' END || ') - ' || CASE action WHEN 'ALLOW' THEN 'allowing page to load normally' WHEN 'WARN' THEN 'displaying warning to user' WHEN 'BLOCK' THEN 'blocking page due to high-risk indicators' ELSE 'containing page with restricted interactions' END AS policy_reason,
 CASE WHEN len(reasons) = 0 THEN 'INSUFFICIENT_DATA' ELSE array_to_string(reasons, ',') END AS reasons FROM (SELECT *, {_REASONS} AS reasons FROM ({_ACTED}))""")
def policy_decisions(spark, sf_dir):
    """D4 to D7, D12 to D14, C25, C26, P13."""
    c = F.col
    df = decisions.decided(_flags(spark, sf_dir), decisions.model_score(c("password"), c("otp"), c("cross_domain")), c("password"), c("otp"), c("cross_domain"), c("forms"), c("inputs"), (c("forms") == 0) & (c("scripts") == 0))
    flags = {"PASSWORD_FIELD_DETECTED": c("password"), "OTP_FIELD_DETECTED": c("otp"), "PAYMENT_CARD_FIELD_DETECTED": c("card"), "CVV_FIELD_DETECTED": c("cvv"), "IDENTITY_DOCUMENT_FIELD_DETECTED": c("identity"), "BANK_ACCOUNT_FIELD_DETECTED": c("bank"), "CROSS_DOMAIN_FORM": c("cross_domain")}
    codes = decisions.reasons(c("score"), flags, c("forms"), c("inputs"), c("scripts"), c("cross_scripts"))
    return df.select("event_id", F.round("score", 6).alias("score"), "threat_level", F.round("confidence", 4).alias("confidence"), "action", "enforcement", "policy_reason", F.array_join(codes, ",").alias("reasons"))


def _collections(spark, sf_dir):
    """One page with up to three forms an event."""
    each = lambda k: F.struct(F.expr(_ACTION.replace("+ k", f"+ {k}")).alias("action"), F.expr(f"(event_id + {k}) % 4 = 0").alias("is_cross_domain"), F.expr(f"(event_id + {k}) % 3 = 0").alias("has_password"), F.expr(f"(event_id + {k}) % 7 = 0").alias("has_otp"))
    forms = F.slice(F.array(each(1), each(2), each(3)), F.lit(1), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.expr(_DOMAIN).alias("page_domain"), forms.alias("forms"))


_FORMS_SQL = f"f AS (SELECT event_id, {_DOMAIN} AS page_domain, k, {_ACTION} AS action, (event_id + k) % 4 = 0 AS xd, (event_id + k) % 3 = 0 AS pw, (event_id + k) % 7 = 0 AS otp FROM events, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= event_id % 4)"


@register(f"""WITH {_FORMS_SQL} SELECT event_id, k::BIGINT AS form, CASE WHEN pw THEN 'credential_input' WHEN otp THEN 'otp_input' ELSE 'form_submission' END AS event_type, CASE WHEN pw OR otp THEN 'credentials' ELSE 'general' END AS data_category,
 CASE WHEN pw AND otp THEN 'mfa_login' WHEN pw THEN 'password_login' WHEN otp THEN 'otp_verification' ELSE 'general_input' END AS data_subtype, CASE WHEN action = '' THEN page_domain ELSE action END AS destination, CASE WHEN xd THEN 'unauthorized' ELSE 'authorized' END AS authorization_status FROM f""")
def observed_events(spark, sf_dir):
    """D8."""
    df = _collections(spark, sf_dir).select("event_id", "page_domain", F.posexplode("forms").alias("form", "f"))
    return df.withColumn("e", profiles.observed_event(F.col("f"), F.col("page_domain"))).select("event_id", (F.col("form") + 1).alias("form"), "e.*")


#: The declared services and one that documents no credentials.
_SERVICES = [*PROFILES, ("docs", "Documents", "reference", ["docs.example.com"], ["search_terms"])]
_OFFICIAL = "official AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p[0]}', '{d}')" for i, p in enumerate(_SERVICES) for d in p[3]) + ") AS v(ord, service_id, domain))"
_MATCHED = f"m AS (SELECT event_id, {_DOMAIN} AS page_domain, (SELECT min(ord) FROM official WHERE lower({_DOMAIN}) = domain OR ends_with(lower({_DOMAIN}), '.' || domain)) AS ord FROM events)"


@register(f"WITH {_OFFICIAL}, {_MATCHED} SELECT event_id, page_domain, (SELECT any_value(service_id) FROM official o WHERE o.ord = m.ord) AS service_id FROM m")
def profile_lookup(spark, sf_dir):
    """The first declared service that a host belongs to."""
    df = table(spark, sf_dir, "events").select("event_id", F.expr(_DOMAIN).alias("page_domain"))
    return profiles.match_profiles(df, "page_domain", _SERVICES).select("event_id", "page_domain", "service_id")


@register(f"""WITH {_OFFICIAL}, {_MATCHED}, {_FORMS_SQL},
 t AS (SELECT f.event_id, f.k, m.ord, f.pw, f.otp, f.xd, CASE WHEN regexp_matches(action, '^(javascript|mailto):') THEN '' WHEN NOT contains(action, '//') THEN lower(f.page_domain) ELSE lower(regexp_replace(regexp_extract(action, '//([^/?#]*)', 1), ':[0-9]*$', '')) END AS target, starts_with(CASE WHEN action = '' THEN f.page_domain ELSE action END, '/') AS skipped FROM f JOIN m ON f.event_id = m.event_id),
 r AS (SELECT event_id, string_agg(concat_ws(',', CASE WHEN away THEN 'DESTINATION_MISMATCH_' || target END, CASE WHEN ord = 4 AND (pw OR otp) THEN 'UNDOCUMENTED_DATA_CATEGORY_credentials' END), ',' ORDER BY k) FILTER (away OR (ord = 4 AND (pw OR otp))) AS found, coalesce(bool_or(away), false) AS mismatch, bool_or(pw) AND bool_or(xd) AS deceptive FROM (SELECT *, NOT skipped AND NOT EXISTS (SELECT 1 FROM official o WHERE o.ord = t.ord AND (target = domain OR ends_with(target, '.' || domain))) AS away FROM t) GROUP BY 1),
 q AS (SELECT m.event_id, m.ord, found, coalesce(mismatch, false) AS mismatch, coalesce(deceptive, false) AS deceptive FROM m LEFT JOIN r ON m.event_id = r.event_id)
 SELECT event_id, CASE WHEN ord IS NULL AND deceptive THEN 'DECEPTIVE_INDICATOR' WHEN ord IS NULL THEN 'UNKNOWN' WHEN mismatch THEN 'IDENTITY_MISMATCH' WHEN found IS NOT NULL THEN 'POSSIBLY_EXCESSIVE' ELSE 'EXPECTED' END AS outcome,
 CASE WHEN ord IS NULL AND deceptive THEN 0.35 WHEN ord IS NULL THEN 0.0 WHEN mismatch THEN 0.4 WHEN found IS NOT NULL THEN 0.2 ELSE -0.2 END::DOUBLE AS risk_modifier,
 CASE WHEN ord IS NULL AND deceptive THEN 'UNKNOWN_DOMAIN_COLLECTING_CREDENTIALS_CROSS_ORIGIN' WHEN ord IS NULL THEN 'SERVICE_PROFILE_UNREGISTERED' WHEN found IS NOT NULL THEN found ELSE 'MATCHES_DECLARED_SERVICE_PROFILE' END AS reasons FROM q""")
def compare_behavior(spark, sf_dir):
    """D9 to D11, J6, J7."""
    return profiles.with_comparison(_collections(spark, sf_dir), services=_SERVICES).select("event_id", "outcome", "risk_modifier", F.array_join("comparison_reasons", ",").alias("reasons"))


#: Forms rendered into the html of pages, which have none, by the page's number: what is put before </body>, or at the end.
_RENDERED = """CASE page_id % 6 WHEN 0 THEN '<div><input type="password" name="pin' || page_id || '"><select name="iban"></select><INPUT name=passport></div>'
 WHEN 1 THEN '<form action="https://collect.example.net/' || page_id || '" method="post"><div><input type="Email" name="mail" autocomplete="username"><textarea name="zipcode"></textarea></div></form><input name="otp">'
 WHEN 2 THEN '<form><label>Card<input name="card number" type=tel /></label><select id="cvv code"></select></form><!-- <form> --><form action="/login?p=' || page_id || '"><p><input type=password required value="never read"><input type="text" autocomplete="one-time-code" aria-label="sms code"></p></form>'
 WHEN 3 THEN '<script>var f = "<form><input name=otp>"</script>' WHEN 4 THEN '<form action="/q">no field</form><textarea name="otp"></textarea>' ELSE '' END"""
#: The rows that these forms hold: page_id % 6, form, action, method, input, type, name, id, autocomplete, label.
_HELD = """(VALUES (0, 0, '', 'GET', 0, 'password', 'pin' || page_id, '', '', ''), (0, 0, '', 'GET', 1, 'text', 'passport', '', '', ''), (1, 0, 'https://collect.example.net/' || page_id, 'POST', 0, 'Email', 'mail', '', 'username', ''),
 (1, 0, 'https://collect.example.net/' || page_id, 'POST', 1, 'textarea', 'zipcode', '', '', ''), (2, 0, '', 'GET', 0, 'tel', 'card number', '', '', ''), (2, 0, '', 'GET', 1, 'select', '', 'cvv code', '', ''),
 (2, 1, '/login?p=' || page_id, 'GET', 0, 'password', '', '', '', ''), (2, 1, '/login?p=' || page_id, 'GET', 1, 'text', '', '', 'one-time-code', 'sms code'), (4, 0, '/q', 'GET', NULL, NULL, NULL, NULL, NULL, NULL))"""


@register(f"""WITH i AS (SELECT page_id, v.* FROM pages, LATERAL {_HELD} v(k, form_no, action, method, input_no, input_type, name, id_attribute, autocomplete, label) WHERE page_id % 6 = k),
 t AS (SELECT *, [{', '.join(f"CASE WHEN {_rule(c)} THEN '{c}' END" for c in classifier.CATEGORIES)}] AS all_types FROM (SELECT *, trim(lower(input_type)) AS t, lower(name) || ' ' || lower(id_attribute) || '  ' || lower(label) AS w, autocomplete AS a, '' AS c, '' AS x FROM i)),
 k AS (SELECT *, {_KEPT} AS types FROM t)
 SELECT page_id, form_no::BIGINT AS form_no, action, method, input_no::BIGINT AS input_no, input_type, name, CASE WHEN input_no IS NOT NULL THEN array_to_string(types, ',') END AS types,
 coalesce(bool_or(t = 'password' OR list_contains(types, 'PASSWORD')) OVER f, false) AS form_has_password, coalesce(bool_or(t = 'one-time-code' OR list_contains(types, 'OTP')) OVER f, false) AS form_has_otp FROM k WINDOW f AS (PARTITION BY page_id, form_no)""")
def form_inputs(spark, sf_dir):
    """S9, S10, X-5, A10, A11, K1 to K17: page to form to input out of whole html, with each input's data types; a page without forms has its inputs in one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.expr(_RENDERED).alias("more"))
    cut = F.instr("html", "</body>")
    whole = F.when(cut > 0, F.concat(F.expr("left(html, instr(html, '</body>') - 1)"), "more", F.expr("substring(html, instr(html, '</body>'))"))).otherwise(F.concat(F.coalesce("html", F.lit("")), "more"))
    found = html_forms.with_types(html_forms.forms(pages.select("page_id", whole.alias("html"))))
    each = found.select("page_id", "form_no", "action", "method", F.col("has_password").alias("form_has_password"), F.col("has_otp").alias("form_has_otp"), F.posexplode_outer("inputs").alias("input_no", "i"))
    types = classifier.data_types(F.col("i.input_type"), F.col("i.name"), F.col("i.id_attribute"), F.col("i.autocomplete"), F.col("i.placeholder"), F.col("i.label"), F.col("i.accept"), F.col("i.capture"))
    return each.select("page_id", "form_no", "action", "method", "input_no", "i.input_type", "i.name", F.when(F.col("i").isNotNull(), F.array_join(types, ",")).alias("types"), "form_has_password", "form_has_otp")
