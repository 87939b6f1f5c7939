"""Closed vocabularies, lookup tables and thresholds of the freight domain.

Every table in this module is a fixed value: results are only right when the
entries and their order are exactly these.  All of them are a few dozen entries
at most and are compiled into expressions, never joined.
"""

from __future__ import annotations

# --- fixed values: enumerations ------------------------------------------------
DOC_TYPES = ["rate_con", "bol", "pod", "invoice"]
UNKNOWN = "unknown"

JOB_STATUSES = [
    "queued", "classifying", "splitting", "extracting", "normalizing", "validating",
    "matching", "scoring", "needs_review", "complete", "failed", "needs_llm_capacity",
]
PROCESSING_STATUSES = [
    "classifying", "splitting", "extracting", "normalizing", "validating", "matching", "scoring",
]
TERMINAL_STATUSES = ["complete", "needs_review", "failed", "needs_llm_capacity"]
RESULT_STATUSES = ["complete", "needs_review"]
STAGE_TRACK = [
    "queued", "classifying", "splitting", "extracting", "normalizing", "validating",
    "matching", "scoring", "complete",
]
DISCREPANCY_FLAGS = [
    "none", "rate_delta", "missing_accessorial", "extra_accessorial",
    "weight_variance", "pieces_variance",
]
REVIEW_REASONS = [
    "low_confidence", "discrepancy", "classification_failed", "needs_llm_capacity",
    "validation_failed",
]
REVIEW_STATES = ["pending", "in_review", "resolved", "escalated"]
EXTRACTION_METHODS = ["rule", "llm_text", "llm_vision", "ocr"]

# --- fixed values: review state machine ----------------------------------------
REVIEW_TRANSITIONS = {
    "pending": ["in_review"],
    "in_review": ["resolved", "escalated"],
    "escalated": ["resolved"],
    "resolved": [],
}

# --- fixed values: classification evidence, weights in tenths -------------------
CLASS_PATTERNS = {
    "rate_con": [
        (r"RATE\s+CONFIRMATION", 10),
        (r"RATE\s+CON\b", 9),
        (r"CONFIRMED\s+RATE", 8),
        (r"BROKER.*RATE", 6),
        (r"LOAD\s+RATE", 5),
        (r"AGREED\s+RATE", 5),
        (r"FREIGHT\s+RATE\s+SHEET", 7),
        (r"TRIP\s+RATE", 4),
    ],
    "bol": [
        (r"BILL\s+OF\s+LADING", 10),
        (r"\bB\.?O\.?L\.?\b", 8),
        (r"BOL\s*#?\s*\d", 7),
        (r"SHIPPER.*CONSIGNEE", 4),
        (r"DESCRIPTION\s+OF\s+ARTICLES", 6),
        (r"NO\.\s+PKS", 4),
        (r"WEIGHT\s+.*\bLBS\b", 3),
        (r"TRAILER\s+NUMBER", 3),
    ],
    "pod": [
        (r"PROOF\s+OF\s+DELIVERY", 10),
        (r"\bP\.?O\.?D\.?\b", 8),
        (r"DELIVERY\s+RECEIPT", 7),
        (r"RECEIVED\s+IN\s+GOOD\s+ORDER", 6),
        (r"SIGNATURE\s+OF\s+RECEIVER", 5),
        (r"DELIVERY\s+CONFIRMATION", 6),
        (r"RECEIVED\s+BY", 4),
        (r"DAMAGE\s+NOTES?", 3),
    ],
    "invoice": [
        (r"CARRIER\s+INVOICE", 10),
        (r"FREIGHT\s+INVOICE", 9),
        (r"\bINVOICE\b", 7),
        (r"INVOICE\s*#?\s*\d", 8),
        (r"AMOUNT\s+DUE", 6),
        (r"REMIT\s+TO", 5),
        (r"PAYMENT\s+TERMS", 4),
        (r"TOTAL\s+AMOUNT\s+DUE", 7),
        (r"DUE\s+DATE", 4),
    ],
}

# --- fixed values: page header patterns, first match wins -----------------------
HEADER_PATTERNS = [
    (r"RATE\s+CONFIRMATION", "rate_con"),
    (r"BILL\s+OF\s+LADING", "bol"),
    (r"PROOF\s+OF\s+DELIVERY", "pod"),
    (r"CARRIER\s+INVOICE", "invoice"),
    (r"FREIGHT\s+INVOICE", "invoice"),
    (r"DELIVERY\s+RECEIPT", "pod"),
    (r"B\.?O\.?L\.?\s*#?\s*\d", "bol"),
    (r"P\.?O\.?D\.?\s*#?\s*\d", "pod"),
]

# --- fixed values: rule extraction patterns over upper-case text ----------------
LOAD_NUMBER_PATTERN = r"(?:LOAD\s*#?|BOL\s*#?|POD\s*#?|INVOICE\s*#?)\s*:?\s*([A-Z0-9\-]+)"
STRICT_LOAD_PATTERN = r"\bLOAD\s*#\s*:?\s*([A-Z0-9\-]+)"
MONEY_PATTERNS = {
    "linehaul_rate": r"LINEHAUL\s*(?:RATE)?\s*:?\s*\$?([\d,]+\.?\d*)",
    "fuel_surcharge": r"FUEL\s*SURCHARGE\s*:?\s*\$?([\d,]+\.?\d*)",
    "total_rate": r"TOTAL\s*(?:RATE|AMOUNT)\s*(?:DUE)?\s*:?\s*\$?([\d,]+\.?\d*)",
    "total_amount": r"TOTAL\s*AMOUNT\s*(?:DUE)?\s*:?\s*\$?([\d,]+\.?\d*)",
}
DATE_PATTERNS = {
    "pickup_date": r"PICKUP\s*(?:DATE)?\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})",
    "delivery_date": r"DELIVERY\s*(?:DATE)?\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})",
    "due_date": r"DUE\s*DATE\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})",
}
SIGNATURE_PATTERN = r"SIGNATURE|SIGNED|RECEIVED\s+BY"
RULE_CONFIDENCE = "0.950"
SIGNATURE_CONFIDENCE = "0.900"

# --- fixed values: canonical and required fields per document type --------------
CANONICAL_FIELDS = {
    "rate_con": [
        "load_number", "broker_name", "carrier_name", "shipper", "consignee", "pickup",
        "delivery", "linehaul_rate", "fuel_surcharge", "accessorials", "total_rate",
        "payment_terms",
    ],
    "bol": [
        "bol_number", "load_number", "shipper", "consignee", "pickup_date", "delivery_date",
        "freight_description", "weight", "pieces", "trailer_number", "signature_present",
    ],
    "pod": [
        "pod_number", "load_number", "delivery_date", "recipient_name", "signature_present",
        "condition_notes", "damage_flag",
    ],
    "invoice": [
        "invoice_number", "load_number", "carrier_name", "line_items", "total_amount",
        "due_date", "remit_to",
    ],
}
REQUIRED_FIELDS = {
    "rate_con": [
        "load_number", "broker_name", "carrier_name", "shipper", "consignee", "pickup",
        "delivery", "linehaul_rate", "total_rate",
    ],
    "bol": [
        "bol_number", "shipper", "consignee", "pickup_date", "freight_description", "weight",
        "pieces", "signature_present",
    ],
    "pod": ["delivery_date", "recipient_name", "signature_present"],
    "invoice": ["invoice_number", "load_number", "carrier_name", "line_items", "total_amount"],
}
DATE_FIELDS = ["pickup_date", "delivery_date", "due_date"]
MONEY_FIELDS = ["linehaul_rate", "fuel_surcharge", "total_rate", "total_amount"]

# --- fixed values: weight units in pounds ---------------------------------------
POUNDS_PER_UNIT = {
    "lbs": "1", "lb": "1", "pounds": "1", "pound": "1",
    "kg": "2.20462", "kgs": "2.20462", "kilograms": "2.20462", "kilogram": "2.20462",
    "tons": "2000", "ton": "2000", "oz": "0.0625", "ounces": "0.0625",
}

# --- fixed values: charge synonyms, order decides partial matches ---------------
CHARGE_TYPES = ["detention", "layover", "lumper", "stop_off", "tarp", "other"]
CHARGE_SYNONYMS = {
    "detention": "detention",
    "detention charge": "detention",
    "detention fee": "detention",
    "driver detention": "detention",
    "truck detention": "detention",
    "wait time": "detention",
    "waiting time": "detention",
    "demurrage": "detention",
    "layover": "layover",
    "layover charge": "layover",
    "layover fee": "layover",
    "overnight": "layover",
    "overnight stay": "layover",
    "overnight parking": "layover",
    "lumper": "lumper",
    "lumper fee": "lumper",
    "lumper charge": "lumper",
    "unloading fee": "lumper",
    "unloading charge": "lumper",
    "loading fee": "lumper",
    "loading charge": "lumper",
    "warehouse fee": "lumper",
    "hand unload": "lumper",
    "stop off": "stop_off",
    "stop-off": "stop_off",
    "stop off charge": "stop_off",
    "stop off fee": "stop_off",
    "stop fee": "stop_off",
    "extra stop": "stop_off",
    "additional stop": "stop_off",
    "multi-stop": "stop_off",
    "tarp": "tarp",
    "tarp charge": "tarp",
    "tarp fee": "tarp",
    "tarping": "tarp",
    "tarpaulin": "tarp",
    "tarps": "tarp",
}
SPINE_LINES = ["linehaul", "fuel_surcharge", "weight", "pieces"]

# --- fixed values: thresholds ---------------------------------------------------
MONEY_TOLERANCE = "0.02"
WEIGHT_TOLERANCE = "0.01"
PIECES_TOLERANCE = "0.00"
DOCUMENT_THRESHOLD = "0.80"
FIELD_THRESHOLD = "0.70"
BAND_WIDTH = "0.10"
MODEL_FIELD_CONFIDENCE = {"llm_text": "0.800", "ocr": "0.750"}
MODEL_CLASS_CONFIDENCE = "0.800"
HEADER_SPLIT_CONFIDENCE = "0.850"
LAYOUT_SPLIT_CONFIDENCE = "0.500"
LAYOUT_NO_SPLIT_CONFIDENCE = "0.300"
LAYOUT_HEADER_CONFIDENCE = "0.600"
MODEL_SPLIT_CONFIDENCE = "0.700"
SCAN_CHARS = 20
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 3600
IDEMPOTENCY_WINDOW_SECONDS = 86_400
CACHE_TTL_DAYS = 30
BUDGET_CEILING_PCT = 90
PROVIDER_DAILY_LIMITS = {"openrouter": 50, "gemini": 1500, "groq": 14400, "byok": 1000000}

# --- fixed values: request sizes in characters ----------------------------------
CLASSIFY_REQUEST_CHARS = 3000
EXTRACT_REQUEST_CHARS = 8000
VERIFY_REQUEST_CHARS = 2000
DIGEST_PAGE_CHARS = 500
DIGEST_CHARS = 8000

# --- fixed values: labels shown to users ----------------------------------------
FLAG_LABELS = {
    "none": "No discrepancy",
    "rate_delta": "Rate delta",
    "missing_accessorial": "Missing accessorial",
    "extra_accessorial": "Extra accessorial",
    "weight_variance": "Weight variance",
    "pieces_variance": "Pieces variance",
}
REASON_LABELS = {
    "low_confidence": "Low confidence",
    "discrepancy": "Discrepancy",
    "classification_failed": "Classification failed",
    "needs_llm_capacity": "Capacity limited",
    "validation_failed": "Validation failed",
}
METHOD_LABELS = {"rule": "rule", "llm_text": "LLM", "llm_vision": "vision", "ocr": "OCR"}
DOC_TYPE_LABELS = {
    "rate_con": "rate confirmation",
    "bol": "bill of lading",
    "pod": "proof of delivery",
    "invoice": "carrier invoice",
}
APPROVED_NOTE = "Approved — values accepted as-is"
ESCALATED_NOTE = "Escalated for manual intervention"
EVENT_BY_STATUS = {
    "complete": "job.completed",
    "needs_review": "job.needs_review",
    "failed": "job.failed",
}


# --- fixed values: messages ------------------------------------------------------
CLAIM_REFUSED = "Cannot transition from '{state}' to 'in_review'"
ESCALATE_REFUSED = "Cannot escalate from state '{state}'"
RESOLVE_REFUSED = "Cannot resolve from state '{state}'"
CORRECTIONS_MISSING = "corrected_fields is required for 'corrected' resolution"
REQUIRED_MESSAGE = "Required field '{field}' {how} for {doc_type}"
PICKUP_LATE = "Pickup date ({pickup}) is after delivery date ({delivery})"
DELIVERY_LATE = "Delivery date ({delivery}) is after invoice due date ({due})"
TOTAL_DIFFERS = (
    "Total ({total}) does not match sum of components ({expected}): linehaul={linehaul}"
    " + fuel={fuel} + accessorials={accessorials} (difference: {difference})"
)
LOADS_DIFFER = "Multiple different load numbers found across documents: "
