"""Label columns: collapse of entity types, canonical labels of detections and of predictions, severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical labels and their risk weights.
RISK_WEIGHTS = {
    "person": 2.0,
    "email": 3.0,
    "phone": 3.0,
    "location": 1.0,
    "date": 1.0,
    "identifier": 4.0,
    "payment_card": 5.0,
    "ip": 3.0,
    "url": 2.0,
    "secret": 5.0,
    "organization": 2.0,
}
CANONICAL = tuple(RISK_WEIGHTS)

# Entity types that are one type for thresholds and detector names.
COLLAPSED = {
    "PERSON": ["PERSON", "FULL_NAME", "FIRST_NAME", "MIDDLE_NAME", "LAST_NAME", "NAME"],
    "ORGANIZATION": ["ORGANIZATION", "ORG"],
    "LOCATION": ["LOCATION", "ADDRESS", "CITY", "DISTRICT", "POSTAL_CODE", "STREET_ADDRESS"],
    "EMAIL_ADDRESS": ["EMAIL", "EMAIL_ADDRESS"],
    "PHONE_NUMBER": ["PHONE", "PHONE_NUMBER", "MOBILE_PHONE"],
    "IP_ADDRESS": ["IP", "IP_ADDRESS"],
    "DATE_TIME": ["DATE", "DATE_TIME"],
    "DOCUMENT_NUMBER": [
        "PASSPORT_NUMBER", "DOCUMENT_NUMBER", "SNILS", "TAX_IDENTIFICATION_NUMBER", "TIN",
        "MILITARY_NUMBER", "MILITARY_INDIVIDUAL_NUMBER", "VEHICLE_NUMBER",
    ],
    "CREDIT_CARD": ["CREDIT_CARD_NUMBER", "CREDIT_CARD", "PAYMENT_CARD"],
    "API_KEY": ["API_KEY", "SECRET", "SECRET_KEY"],
}

# Canonical label of a detection's entity type.
DETECTION_LABELS = {
    "person": ["PERSON", "PER"],
    "location": ["LOCATION", "LOC"],
    "organization": ["ORGANIZATION", "ORG"],
    "email": ["EMAIL_ADDRESS", "EMAIL"],
    "phone": ["PHONE_NUMBER", "PHONE"],
    "ip": ["IP_ADDRESS", "IP"],
    "date": ["DATE_TIME", "DATE"],
    "url": ["URL", "URI", "WEBSITE", "LINK"],
    "payment_card": ["CREDIT_CARD", "PAYMENT_CARD"],
    "secret": ["SECRET", "API_KEY"],
    "identifier": [
        "US_SSN", "IBAN_CODE", "SWIFT_CODE", "PASSPORT", "DOCUMENT_NUMBER", "SNILS", "TIN", "VEHICLE_NUMBER", "MILITARY_INDIVIDUAL_NUMBER",
    ],
}
# Parts of other entity types, first that fits.
DETECTION_PARTS = [
    ("email", ["EMAIL"]),
    ("phone", ["PHONE"]),
    ("ip", ["IP"]),
    ("date", ["DATE"]),
    ("url", ["URL", "URI"]),
    ("person", ["PERSON"]),
    ("organization", ["ORG"]),
    ("location", ["LOC", "ADDRESS", "CITY"]),
    ("payment_card", ["CARD"]),
    ("secret", ["SECRET", "KEY"]),
]

# predictions' labels; whole labels, then parts, rule by rule.
PREDICTION_RULES: list[tuple[str, list[str], list[str]]] = [
    ("person", ["person", "name", "full name", "first name", "middle name", "last name"], []),
    ("email", ["email", "email_address", "e-mail"], ["email"]),
    ("phone", ["phone", "phone_number", "phonenumber", "mobile_phone"], ["phone"]),
    ("location", ["address", "location", "city", "district", "street", "postal_code", "zip", "zipcode"], ["address", "location"]),
    ("date", ["date", "date_time", "datetime"], ["date"]),
    ("payment_card", ["credit_card", "credit_card_number", "card_number", "payment_card"], ["card"]),
    ("ip", ["ip_address", "ip"], []),
    ("url", ["url", "uri", "domain"], ["url"]),
    ("organization", ["organization", "org", "company"], ["organization"]),
    (
        "identifier",
        [],
        ["passport", "document", "snils", "inn", "ogrn", "ssn", "iban", "swift", "tin", "vehicle", "military", "vin", "id"],
    ),
    ("secret", [], ["secret", "api_key", "api key", "token", "jwt"]),
]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def normal_type(label: Column) -> Column:
    return F.replace(F.replace(F.upper(F.trim(label)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))


def collapse_type(label: Column) -> Column:
    """The entity type under which a label is detected and thresholded."""
    x = normal_type(label)
    out = F.when(F.startswith(x, F.lit("ADDRESS_")), "LOCATION")
    for name, labels in COLLAPSED.items():
        out = out.when(x.isin(labels), name)
    return out.otherwise(x)


def collapse_name(label: str) -> str:
    """``collapse_type`` for configuration, on the driver."""
    x = label.strip().upper().replace("-", "_").replace(" ", "_")
    return next((name for name, labels in COLLAPSED.items() if x in labels), "LOCATION" if x.startswith("ADDRESS_") else x)


def detection_label(entity_type: Column, own: dict[str, str] | None = None) -> Column:
    """Canonical label of an entity type; null if none fits. ``own`` maps upper-case types and comes first."""
    x = F.upper(F.trim(entity_type))
    out = F.when(x == "", F.lit(None).cast("string"))
    for name, label in (own or {}).items():
        if label:
            out = out.when(x == name, label)
    for name, labels in DETECTION_LABELS.items():
        out = out.when(x.isin(labels), name)
    for name, parts in DETECTION_PARTS:
        out = out.when(_any([F.contains(x, F.lit(p)) for p in parts]), name)
    return out


def detection_label_name(entity_type: str, own: dict[str, str] | None = None) -> str | None:
    x = entity_type.strip().upper()
    if x and (mapped := (own or {}).get(x)):
        return mapped
    if direct := next((n for n, labels in DETECTION_LABELS.items() if x in labels), None):
        return direct
    return next((n for n, parts in DETECTION_PARTS if any(p in x for p in parts)), None)


def known_label(label: Column) -> Column:
    """One of the canonical labels, trimmed and lower-cased, else null."""
    x = F.lower(F.trim(label))
    return F.when(x.isin(*CANONICAL), x)


def prediction_label(label: Column) -> Column:
    """Canonical label of a prediction that carries none."""
    x = F.lower(F.trim(label))
    out = F.when(x.isin(*CANONICAL), x)
    for name, whole, parts in PREDICTION_RULES:
        fits = _any([x.isin(whole)] if whole else []) | _any([F.contains(x, F.lit(p)) for p in parts])
        if name == "ip":
            fits = fits | F.startswith(x, F.lit("ip_"))
        out = out.when(fits, name)
    return out


def severity(score: Column) -> Column:
    return F.when(score >= 0.95, "critical").when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def by_label(label: Column, table: dict[str, float], default: float) -> Column:
    """A number by label, from a small table."""
    keys = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(keys, label), F.lit(default))
