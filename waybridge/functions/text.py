"""Column functions over page and document text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions.values import trimmed

# Words a text must contain before a pattern can match.  A byte search is far
# cheaper than a regular expression and most texts fail it.
_NEEDED_WORD = {
    "RATE": ["RATE"],
    "BILL": ["LADING"],
    "BOL": ["BOL"],
    "SHIPPER": ["SHIPPER", "CONSIGNEE"],
    "DESCRIPTION": ["ARTICLES"],
    "NO\\.": ["PKS"],
    "WEIGHT": ["WEIGHT", "LBS"],
    "TRAILER": ["TRAILER"],
    "PROOF": ["DELIVERY"],
    "DELIVERY": ["DELIVERY"],
    "RECEIVED": ["RECEIVED"],
    "SIGNATURE": ["SIGNATURE"],
    "DAMAGE": ["DAMAGE"],
    "CARRIER": ["INVOICE"],
    "FREIGHT\\s+INVOICE": ["INVOICE"],
    "FREIGHT\\s+RATE": ["RATE"],
    "\\bINVOICE": ["INVOICE"],
    "INVOICE": ["INVOICE"],
    "AMOUNT": ["AMOUNT"],
    "REMIT": ["REMIT"],
    "PAYMENT": ["PAYMENT"],
    "TOTAL": ["AMOUNT"],
    "DUE": ["DUE"],
    "BROKER": ["BROKER", "RATE"],
    "CONFIRMED": ["CONFIRMED"],
    "LOAD": ["LOAD"],
    "AGREED": ["AGREED"],
    "TRIP": ["TRIP"],
}


def unicode_regex(pattern: str) -> str:
    """Let ``\\s``, ``\\b`` and ``\\d`` cover non-ASCII text."""
    return "(?U)" + pattern


def squeezed(text: Column) -> Column:
    """Upper case with every run of white space as one blank."""
    return F.trim(F.regexp_replace(F.upper(text), unicode_regex(r"\s+"), " "))


def matches(text: Column, pattern: str) -> Column:
    """``rlike`` behind a byte search for a word the pattern cannot do without."""
    heads = [h for h in _NEEDED_WORD if pattern.startswith(h)]
    found = text.rlike(unicode_regex(pattern))
    if not heads:
        return found
    words = _NEEDED_WORD[max(heads, key=len)]
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words]) & found


def class_hits(squeezed_text: Column, doc_type: str) -> Column:
    """Which patterns of a type match, one bit per pattern."""
    bits = [
        F.when(matches(squeezed_text, p), 1 << i).otherwise(0)
        for i, (p, _) in enumerate(vocab.CLASS_PATTERNS[doc_type])
    ]
    return reduce(lambda a, b: a + b, bits)


def class_score(hits: Column, doc_type: str) -> Column:
    """Best weight plus a tenth per further match, two at most; in tenths."""
    patterns = vocab.CLASS_PATTERNS[doc_type]
    best = F.when(hits == 0, 0)
    for weight in sorted({w for _, w in patterns}, reverse=True):
        mask = sum(1 << i for i, (_, w) in enumerate(patterns) if w == weight)
        best = best.when(hits.bitwiseAND(F.lit(mask)) != 0, weight)
    bonus = F.greatest(F.least(F.bit_count(hits) - 1, F.lit(2)), F.lit(0))
    return F.least(best + bonus, F.lit(10))


def header_type(header: Column) -> Column:
    """Document type named by a page header in any case, null when none is."""
    header, chain = F.upper(header), None
    for pattern, doc_type in vocab.HEADER_PATTERNS:
        hit = header.rlike(unicode_regex(pattern))
        chain = F.when(hit, doc_type) if chain is None else chain.when(hit, doc_type)
    return chain


def header_text(top_text: Column, lines: int = 8) -> Column:
    """First lines of the text at the top of a page, upper case."""
    return F.upper(F.substring_index(trimmed(top_text), "\n", lines))


def dense_length(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(text, unicode_regex(r"\s+"), ""))


def looks_garbled(text: Column) -> Column:
    """True when fewer than 3 in 10 words look like words, or there are none."""
    words = F.regexp_extract_all(text, F.lit(r"([a-zA-Z]{2,})"), 1)
    good = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike("[aeiouAEIOU]"))
    return F.coalesce(F.size(good) * 10 < F.size(words) * 3, F.lit(True)) | (F.size(words) == 0)


def first_group(upper_text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(upper_text, unicode_regex(pattern), 1), F.lit(""))


def rule_load_number(upper_text: Column, strict: bool = False) -> Column:
    """First number after LOAD, BOL, POD or INVOICE; ``strict`` takes only ``LOAD #``."""
    return first_group(
        upper_text, vocab.STRICT_LOAD_PATTERN if strict else vocab.LOAD_NUMBER_PATTERN
    )


def rule_amount(upper_text: Column, field: str) -> Column:
    """Digits of a money field, without separators."""
    return F.regexp_replace(first_group(upper_text, vocab.MONEY_PATTERNS[field]), ",", "")


def rule_date_text(upper_text: Column, field: str) -> Column:
    return first_group(upper_text, vocab.DATE_PATTERNS[field])


def rule_signature(upper_text: Column) -> Column:
    return upper_text.rlike(unicode_regex(vocab.SIGNATURE_PATTERN))


# --- fixed values: contact patterns --------------------------------------------
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(\+1[ .\-]?)?(\([0-9]{3}\) ?|\b[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}\b"


def redact_contacts(text: Column) -> Column:
    """Text with e-mail addresses and phone numbers masked."""
    no_mail = F.regexp_replace(text, EMAIL_PATTERN, "[EMAIL]")
    return F.regexp_replace(no_mail, PHONE_PATTERN, "[PHONE]")


def contact_counts(text: Column) -> tuple[Column, Column]:
    """(e-mail addresses, phone numbers) that :func:`redact_contacts` masks."""
    no_mail = F.regexp_replace(text, EMAIL_PATTERN, "[EMAIL]")
    return (
        F.regexp_count(text, F.lit(EMAIL_PATTERN)),
        F.regexp_count(no_mail, F.lit(PHONE_PATTERN)),
    )


def text_chunks(text: Column, size: int) -> Column:
    """The whole text as an array of (part_no, body) of at most ``size`` characters."""
    last = F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("part_no"), F.substring(text, i * size + 1, F.lit(size)).alias("body")
        ),
    )
