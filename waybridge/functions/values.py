"""Column functions that read dates, money, weights and charge names from text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybridge import vocab

MONEY = "decimal(12,2)"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"

# --- fixed values: month names ---------------------------------------------------
_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]


# --- fixed values: white space -----------------------------------------------------
WHITE_SPACE = (
    " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def quick_trimmed(text: Column) -> Column:
    """``trimmed`` for a plain column: a text between visible ASCII characters is taken as it is."""
    visible = [F.substring(text, at, 1).between("!", "~") for at in (1, -1)]
    return F.when(visible[0] & visible[1], text).otherwise(trimmed(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(text: Column, kind: str) -> Column:
    """Cast to ``kind``; anything that is not a plain number becomes null."""
    return bound(text, lambda t: F.when(t.rlike(_NUMBER), t.try_cast(kind)))


def iso_date(text: Column) -> Column:
    """A date from ``yyyy-mm-dd`` text, null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def _arranged(text: Column, pattern: str, template: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, template).try_cast("date"))


def normalize_date(text: Column) -> Column:
    """Read a date in any of the accepted layouts.

    Month comes before day unless that is no date; two-digit years lie in
    2000-2099; text behind a numeric date is ignored.
    """
    head, sep, tail = r"^(\d{1,2})", r"[/\-.]", r"(?s).*$"
    four = head + sep + r"(\d{1,2})" + sep + r"(\d{4})" + tail
    two = head + sep + r"(\d{1,2})" + sep + r"(\d{2})(?!\d)" + tail
    year_first = [r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"]
    named = r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    names = [p for i, m in enumerate(_MONTHS, 1) for p in (F.lit(m), F.lit(str(i)))]
    shorts = [
        p for i, m in enumerate(_MONTHS, 1) if len(m) > 3 for p in (F.lit(m[:3]), F.lit(str(i)))
    ]

    def spelled(p: Column) -> Column:
        # most names are written like this, and lowering takes longer than looking up
        capital = F.create_map(*[x for i, m in enumerate(_MONTHS, 1) for x in (F.lit(m.title()), F.lit(str(i)))])
        month = F.coalesce(
            F.try_element_at(capital, p[0]), F.try_element_at(F.create_map(*names, *shorts), F.lower(p[0]))
        )
        return F.concat(p[2], F.lit("-"), month, F.lit("-"), p[1]).try_cast("date")

    def read(v: Column) -> Column:
        numeric = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date")).otherwise(
            F.coalesce(
                *[_arranged(v, p, "$1-$2-$3") for p in year_first],
                _arranged(v, four, "$3-$1-$2"),
                _arranged(v, four, "$3-$2-$1"),
                _arranged(v, two, "20$3-$1-$2"),
                _arranged(v, two, "20$3-$2-$1"),
            )
        )
        parts = F.split(F.regexp_replace(v, named, "$1-$2-$3"), "-")
        return F.when(F.substring(v, 1, 1).between("0", "9"), numeric).when(
            v.rlike(named), bound(parts, spelled)
        )

    return bound(quick_trimmed(text), read)


# --- fixed values: amount with an optional currency code before or behind it -------
_AMOUNT = (
    r"(?i)^[(\-]?\s*(?:(?:USD|CAD|MXN)\b\s*)*"
    r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]{1,2})?)"
    r"\s*(?:\b(?:USD|CAD|MXN)\b\s*)*\)?$"
)


def normalize_amount(text: Column) -> Column:
    """Signed amount of a money text such as ``($1,250.00)`` or ``-980 USD``."""

    def read(bare: Column) -> Column:
        opened, closed = bare.startswith("("), bare.endswith(")")

        def signed(digits: Column) -> Column:
            # an empty text would be refused by an exception, which costs more than all the rest
            amount = F.when(digits != "", digits.try_cast(MONEY))
            return F.when(opened | bare.startswith("-"), F.negative(amount)).otherwise(amount)

        return F.when(opened == closed, bound(F.regexp_extract(bare, _AMOUNT, 1), signed))

    unmarked = F.translate(quick_trimmed(text), "$€£¥,", "")
    return bound(bound(unmarked, quick_trimmed), read)


def detected_currency(text: Column) -> Column:
    """Currency code written in the text, USD when there is none."""
    code = F.upper(F.regexp_extract(text, r"(?i)\b(USD|CAD|MXN)\b", 1))
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("USD"))


def normalize_money(text: Column) -> Column:
    """Money struct from a bare text or from a JSON object with amount and currency."""
    is_object = F.ltrim(text).startswith("{")
    kept = F.coalesce(F.get_json_object(text, "$.currency"), F.lit("USD"))
    inner = number(trimmed(F.get_json_object(text, "$.amount")), MONEY)
    amount = F.when(is_object, inner).otherwise(normalize_amount(text))
    currency = F.when(is_object, kept).otherwise(F.lit("USD"))
    return bound(
        amount,
        lambda a: F.when(a.isNotNull(), F.struct(a.alias("amount"), currency.alias("currency"))),
    )


def normalize_weight(text: Column, unit: Column | None = None) -> Column:
    """Weight in pounds; a missing or unknown unit counts as pounds."""
    shape = r"^([\d,]+\.?\d*)\s*([a-zA-Z]*)"
    one = F.lit(1).cast("decimal(10,5)")
    factors = F.create_map(
        *[
            p
            for u, f in vocab.POUNDS_PER_UNIT.items()
            for p in (F.lit(u), F.lit(f).cast("decimal(10,5)"))
        ]
    )

    def read(v: Column) -> Column:
        digits = F.translate(F.regexp_extract(v, shape, 1), ",", "")
        written = F.nullif(F.regexp_extract(v, shape, 2), F.lit(""))
        chosen = F.trim(written if unit is None else F.coalesce(unit, written))
        # most units are in lower case already, and lowering takes longer than looking up
        factor = F.coalesce(F.try_element_at(factors, chosen), F.try_element_at(factors, F.lower(chosen)), one)
        pounds = F.round(digits.try_cast("decimal(18,6)") * factor, 2).cast("decimal(18,2)")
        return F.when(F.substring(v, 1, 1).between(",", "9"), pounds)

    return bound(quick_trimmed(text), read)


def _by_type() -> dict[str, list[str]]:
    """Synonyms per charge type; the table lists all synonyms of a type together."""
    out: dict[str, list[str]] = {}
    for synonym, kind in vocab.CHARGE_SYNONYMS.items():
        out.setdefault(kind, []).append(synonym)
    return out


def charge_of(key: Column) -> Column:
    """Controlled charge name for a trimmed label in lower case, see :func:`charge_type`."""
    out = F.when(key.isNull() | (key == ""), "other")
    for kind, names in _by_type().items():
        out = out.when(key.isin(names), kind)
    for kind, names in _by_type().items():
        contained = key.rlike("|".join(names))
        out = out.when(contained | F.contains(F.lit("\x01".join(names)), key), kind)
    return out.otherwise("other")


def charge_type(label: Column) -> Column:
    """Controlled charge name for a free label.

    An exact synonym wins; otherwise the first synonym in table order that
    contains the label or is contained in it; otherwise ``other``.  The order
    only matters between types, so one alternation and one search per type do.
    """
    return bound(F.lower(quick_trimmed(label)), charge_of)


def joined_words(lowered: Column) -> Column:
    """A text in lower case with underscores for spaces and hyphens; empty for null."""
    return F.translate(F.coalesce(lowered, F.lit("")), " -", "__")


def snake(label: Column) -> Column:
    return joined_words(F.lower(label))


def amount_of(text: Column) -> Column:
    """Amount from a number, ``$1,234.50`` text or a JSON money object."""
    inner = F.get_json_object(text, "$.amount")
    plain = F.when(F.ltrim(text).startswith("{"), inner).otherwise(text)
    return number(trimmed(F.translate(plain, "$,", "")), MONEY)


def quantity_of(text: Column) -> Column:
    return number(trimmed(F.translate(text, ",", "")), "decimal(18,4)")


def money_text(amount: Column) -> Column:
    return amount.cast(MONEY).cast("string")


def quantity_text(value: Column) -> Column:
    """Whole numbers without a point, others without trailing zeros."""
    return bound(
        value,
        lambda q: F.when(q == F.floor(q), q.cast("bigint").cast("string")).otherwise(
            F.regexp_replace(q.cast("string"), "0+$", "")
        ),
    )


def worded(template: str, **columns: Column) -> Column:
    """A text with columns in place of the names in braces; null if one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces)
