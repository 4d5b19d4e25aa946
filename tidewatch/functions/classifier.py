"""What data an input field asks for: ordered rules over its attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: words in an input's name, id, placeholder or label, per category.
WORDS = {
    "PASSWORD": "password|passwd|pwd|secret",
    "OTP": "otp|2fa|mfa|totp|passcode|token|verification[-_]?code|auth[-_]?code|security[-_]?code|pin[-_]?code",
    "EMAIL": "email|e-mail|user_email|useremail|mail",
    "USERNAME": "username|user_id|userid|login_id|account_name|login",
    "PHONE": "phone|telephone|mobile|cellphone|cell|tel_num",
    "ADDRESS": "address|street|addr|city|state|zipcode|postal|postalcode|country",
    "DATE_OF_BIRTH": "dob|birth[-_]?date|birthdate|birthday|date[-_]?of[-_]?birth",
    "IDENTITY_DOCUMENT": "ssn|social[-_]?security|passport|national[-_]?id|driver[-_]?license|id[-_]?number|aadhaar|tax[-_]?id|nin|gov[-_]?id",
    "PAYMENT_CARD": "card[-_]?number|cc[-_]?number|cardnumber|cc_num|creditcard|debitcard|card_num|pan_number",
    "CARD_EXPIRY": "exp[-_]?date|cc[-_]?exp|card[-_]?exp|expiry|expiration|exp_month|exp_year",
    "CVV": "cvv|cvc|csc|cvv2|cvc2|security[-_]?code|card[-_]?code",
    "BANK_ACCOUNT": "iban|swift|bic|routing[-_]?number|bank[-_]?account|account[-_]?number|sort[-_]?code|acc[-_]?num",
    "CAMERA": "camera|webcam|photo_capture",
    "MICROPHONE": "microphone|audio_capture|voice_record",
    "LOCATION": "latitude|longitude|coords|geolocation|geo_lat|geo_lon",
}
# Fixed values that results depend on: parts of the autocomplete attribute, per category.
AUTOCOMPLETE = {
    "PASSWORD": ["current-password", "new-password"],
    "OTP": ["one-time-code"],
    "EMAIL": ["email"],
    "PHONE": ["tel", "mobile"],
    "ADDRESS": ["address", "postal-code", "country", "zip"],
    "DATE_OF_BIRTH": ["bday"],
    "IDENTITY_DOCUMENT": ["id-number"],
    "PAYMENT_CARD": ["cc-number", "cc-type"],
    "CARD_EXPIRY": ["cc-exp"],
    "CVV": ["cc-csc", "cc-cvc", "cc-cvv"],
}
TYPES = {"PASSWORD": "password", "OTP": "one-time-code", "EMAIL": "email", "PHONE": "tel", "FILE_UPLOAD": "file", "LOCATION": "location"}
CATEGORIES = ["PASSWORD", "OTP", "EMAIL", "USERNAME", "PHONE", "ADDRESS", "DATE_OF_BIRTH", "IDENTITY_DOCUMENT", "PAYMENT_CARD", "CARD_EXPIRY", "CVV", "BANK_ACCOUNT", "FILE_UPLOAD", "CAMERA", "MICROPHONE", "LOCATION"]


def data_types(input_type: Column, name: Column, id_attribute: Column, autocomplete: Column, placeholder: Column | None = None, label: Column | None = None, accept: Column | None = None, capture: Column | None = None) -> Column:
    """Array of categories in rule order; nulls count as empty. "_" is a word character, so user_password holds no word password."""

    def clean(value: Column | None) -> Column:
        return F.trim(F.lower(F.coalesce(value, F.lit("")))) if value is not None else F.lit("")

    kind, auto, accepts, captures = clean(input_type), clean(autocomplete), clean(accept), clean(capture)
    words = F.concat_ws(" ", clean(name), clean(id_attribute), clean(placeholder), clean(label))

    def named(category: str) -> Column:
        return words.rlike(rf"\b({WORDS[category]})\b")

    def plain(category: str) -> Column:
        test = kind == TYPES[category] if category in TYPES else F.lit(False)
        for part in AUTOCOMPLETE.get(category, []):
            test = test | auto.contains(part)
        return test | named(category) if category in WORDS else test

    rules = {category: plain(category) for category in CATEGORIES}
    rules["USERNAME"] = auto.isin("username", "nickname", "webauthn") | (named("USERNAME") & ~rules["PASSWORD"] & ~rules["EMAIL"])
    rules["DATE_OF_BIRTH"] = auto.contains("bday") | (named("DATE_OF_BIRTH") & kind.isin("date", "text", "number", ""))
    rules["CAMERA"] = captures.isin("user", "environment", "camera") | ((accepts.contains("video") | accepts.contains("image")) & (captures != "")) | named("CAMERA")
    rules["MICROPHONE"] = (captures == "microphone") | (accepts.contains("audio") & (captures != "")) | named("MICROPHONE")
    return F.array_compact(F.array(*[F.when(rules[c], F.lit(c)) for c in CATEGORIES]))


def is_password(input_type: Column, types: Column) -> Column:
    return (F.lower(F.coalesce(input_type, F.lit(""))) == "password") | F.array_contains(types, "PASSWORD")


def is_otp(input_type: Column, types: Column) -> Column:
    return (F.lower(F.coalesce(input_type, F.lit(""))) == "one-time-code") | F.array_contains(types, "OTP")


def folded(list_of_lists: Column) -> Column:
    """Different categories over a form's inputs, in order of appearance."""
    return F.array_distinct(F.flatten(list_of_lists))
