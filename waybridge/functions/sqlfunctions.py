"""The scalar operations as temporary SQL functions.

Every function is built once from the column functions of this library; the text of that
expression becomes the body of ``CREATE TEMPORARY FUNCTION``.  A query in SQL and one in the
DataFrame API therefore run the same expression, and no Python code runs per row.

    register(spark)
    spark.sql("SELECT normalize_money(total).amount FROM invoices WHERE has_discrepancies(flags)")
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions import display, replies, scoring, text, values
from waybridge.functions.values import bound

CONFIDENCES = "map<string,decimal(4,3)>"
#: documents as ``should_route_to_hitl`` takes them
DOCUMENTS = f"array<struct<doc_type:string,document_confidence:decimal(4,3),fields:{CONFIDENCES}>>"


@dataclass(frozen=True)
class SqlFunction:
    """Parameters as (name, type, default or None) and the expression over them."""

    build: Callable[..., Column]
    parameters: tuple[tuple[str, str, str | None], ...]

    def column(self) -> Column:
        """The expression over columns named like the parameters."""
        return self.build(*(F.col(name) for name, _, _ in self.parameters))


FUNCTIONS: dict[str, SqlFunction] = {}


def _sql(parameters: str = ""):
    """Takes a function into FUNCTIONS; ``parameters`` are separated by ``;``, as in ``a int = 1``."""
    read = []
    for part in filter(None, (p.strip() for p in parameters.split(";"))):
        declared, _, default = (p.strip() for p in part.partition("="))
        name, _, kind = declared.partition(" ")
        read.append((name, kind, default or None))

    def take(build: Callable[..., Column]) -> Callable[..., Column]:
        FUNCTIONS[build.__name__] = SqlFunction(build, tuple(read))
        return build

    return take


# --- values --------------------------------------------------------------------------

_sql("value string")(values.normalize_date)
_sql("value string")(values.normalize_money)
_sql("value string")(values.normalize_amount)
_sql("value string; unit string = NULL")(values.normalize_weight)
_sql("value string")(values.detected_currency)
_sql("value string")(values.amount_of)
_sql("value string")(values.quantity_of)


@_sql("label string")
def normalize_accessorial(label: Column) -> Column:
    return values.charge_type(label)


@_sql("fields map<string,string>")
def normalize_extracted_fields(fields: Column) -> Column:
    """Every value of a document's fields in canonical form."""
    from waybridge.operators.normalize import normalized_value

    return F.transform_values(fields, normalized_value)


@_sql("field_name string; value string")
def normalize_field(name: Column, value: Column) -> Column:
    from waybridge.operators.normalize import normalized_value

    return normalized_value(name, value)


# --- texts ---------------------------------------------------------------------------


@_sql("content_length bigint; content binary; max_bytes bigint = 26214400")
def validate_pdf(length: Column, content: Column, limit: Column) -> Column:
    """Why an upload is refused; null when it is accepted."""
    from waybridge.sources.uploads import reject_code

    return reject_code(length, content, limit)


@_sql("page_text string")
def classify_document(page_text: Column) -> Column:
    """(doc_type, confidence, second_type, second_score, needs_model) of a text."""
    from waybridge.operators.classify import needs_model

    last = len(vocab.DOC_TYPES) - 1

    def entries(clean: Column) -> Column:
        """Scores in falling order, each four times its tenths plus its place from the end."""

        def entry(kind: str, place: int) -> Column:
            hits = text.class_hits(clean, kind)
            return bound(hits, lambda h: text.class_score(h, kind).cast("int") * 4 + place)

        scored = [entry(t, last - i) for i, t in enumerate(vocab.DOC_TYPES)]
        return F.sort_array(F.array(*scored), asc=False)

    def named(entry: Column) -> Column:
        names = F.array(*[F.lit(t) for t in reversed(vocab.DOC_TYPES)])
        return F.element_at(names, (entry % 4 + 1).cast("int"))

    def result(e: Column) -> Column:
        top, second = F.element_at(e, 1), F.element_at(e, 2)
        first_score, second_score = F.floor(top / 4) / 10.0, F.floor(second / 4) / 10.0
        return F.struct(
            F.when(first_score == 0, vocab.UNKNOWN).otherwise(named(top)).alias("doc_type"),
            first_score.alias("confidence"),
            named(second).alias("second_type"),
            second_score.alias("second_score"),
            needs_model(first_score, second_score).alias("needs_model"),
        )

    return bound(bound(text.squeezed(page_text), entries), result)


@_sql("page_text string")
def extract_document(page_text: Column) -> Column:
    """Fields that the fixed patterns find, by name; only those that were found."""

    def found(upper: Column) -> Column:
        read = {
            "load_number": text.rule_load_number(upper),
            **{n: text.rule_amount(upper, n) for n in vocab.MONEY_PATTERNS},
            **{n: text.rule_date_text(upper, n) for n in vocab.DATE_PATTERNS},
            "signature_present": F.when(text.rule_signature(upper), "true"),
        }
        pairs = F.map_from_arrays(F.array(*map(F.lit, read)), F.array(*read.values()))
        return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))

    return bound(F.upper(page_text), found)


_sql("header string")(text.header_type)
_sql("page_text string")(text.looks_garbled)
_sql("page_text string")(text.dense_length)
_sql("page_text string")(text.redact_contacts)


# --- checks --------------------------------------------------------------------------


@_sql("doc_type string; field_names array<string>")
def missing_required(doc_type: Column, names: Column) -> Column:
    """Required fields of the type that are not among the names."""
    chain = None
    for kind, needed in vocab.REQUIRED_FIELDS.items():
        lacking = F.array_except(F.array(*map(F.lit, needed)), names)
        hit = doc_type == kind
        chain = F.when(hit, lacking) if chain is None else chain.when(hit, lacking)
    return F.coalesce(chain, F.array().cast("array<string>"))


@_sql("stated decimal(12,2); components array<decimal(12,2)>")
def money_agrees(stated: Column, components: Column) -> Column:
    """Whether a total is the sum of its parts within the tolerance; null parts count as 0."""
    zero = F.lit(0).cast("decimal(22,2)")
    added = F.aggregate(
        components, zero, lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(22,2)")
    )
    return F.abs(stated - added) <= F.lit(vocab.MONEY_TOLERANCE).cast("decimal(3,2)")


@_sql("rate_con decimal(12,2); invoice decimal(12,2); optional boolean = true")
def match_line_item(agreed: Column, billed: Column, optional: Column) -> Column:
    """(discrepancy_flag, discrepancy_amount) of one charge line.

    ``optional`` is false for the line haul and the fuel surcharge, which may be missing on one side.
    """
    off = F.abs(billed - agreed) > F.lit(vocab.MONEY_TOLERANCE).cast("decimal(12,2)")
    flag = (
        F.when(off, "rate_delta")
        .when(optional & billed.isNull() & agreed.isNotNull(), "missing_accessorial")
        .when(optional & agreed.isNull() & billed.isNotNull(), "extra_accessorial")
        .otherwise("none")
    )
    amount = F.when(off, billed - agreed).when(optional & agreed.isNull(), billed)
    return F.struct(flag.alias("discrepancy_flag"), amount.cast("decimal(12,2)").alias("discrepancy_amount"))


@_sql("flags array<string>")
def has_discrepancies(flags: Column) -> Column:
    return F.coalesce(F.exists(flags, lambda f: f != "none"), F.lit(False))


# --- confidence ----------------------------------------------------------------------


@_sql(
    "extraction_method string; base_confidence decimal(4,3) = NULL;"
    " verification_agreed boolean = NULL; verification_certainty decimal(4,3) = NULL"
)
def score_field_confidence(method: Column, base: Column, agreed: Column, certainty: Column) -> Column:
    return scoring.field_confidence(method, base, agreed, certainty)


@_sql(f"doc_type string; confidences {CONFIDENCES}; classification_confidence decimal(4,3)")
def score_document_confidence(doc_type: Column, confidences: Column, given: Column) -> Column:
    """(document_confidence, lowest_field, lowest_confidence); equal values go to the first name."""
    one = scoring.conf("1.000")

    def weight(name: Column) -> Column:
        return F.when(scoring.is_required(doc_type, name), 2).otherwise(1)

    def added(value: Callable[[Column], Column]) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate(
            F.map_entries(confidences), zero, lambda a, e: a + F.coalesce(value(e), F.lit(0)).cast("bigint")
        )

    total = added(lambda e: scoring.thousandths(e["value"]) * weight(e["key"]))
    weights = added(lambda e: weight(e["key"]))
    low = F.array_min(
        F.transform(
            F.filter(F.map_entries(confidences), lambda e: e["value"] < one),
            lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")),
        )
    )
    mean = F.when(weights > 0, scoring.rounded_mean(total, weights))
    return F.struct(
        F.least(mean, given).alias("document_confidence"),
        low["key"].alias("lowest_field"),
        F.coalesce(low["value"], one).alias("lowest_confidence"),
    )


def _low_reasons(doc: Column) -> Column:
    def below(limit: str, value: Column, what: Column) -> Column:
        said = F.concat(F.lit("low_confidence: "), what, value.cast("string"), F.lit(f" < {float(limit)}"))
        return F.when(value < scoring.conf(limit), said)

    kind = doc["doc_type"]
    fields = F.transform(
        F.filter(F.map_entries(doc["fields"]), lambda e: scoring.is_required(kind, e["key"])),
        lambda e: below(
            vocab.FIELD_THRESHOLD, e["value"], F.concat(kind, F.lit("."), e["key"], F.lit(" confidence "))
        ),
    )
    whole = below(
        vocab.DOCUMENT_THRESHOLD, doc["document_confidence"], F.concat(kind, F.lit(" document confidence "))
    )
    none = F.array().cast("array<string>")
    return F.concat(F.array(whole), F.coalesce(fields, none))


@_sql(f"documents {DOCUMENTS}; discrepancies array<string> = array()")
def should_route_to_hitl(documents: Column, discrepancies: Column) -> Column:
    """(needs_review, reasons) of a job from its documents and its discrepancy reasons."""
    low = F.filter(F.flatten(F.transform(documents, _low_reasons)), lambda r: r.isNotNull())
    none = F.array().cast("array<string>")
    reasons = F.concat(F.coalesce(low, none), F.coalesce(discrepancies, none))
    return bound(
        reasons, lambda r: F.struct((F.size(r) > 0).alias("needs_review"), r.alias("reasons"))
    )


@_sql("reply string")
def verification_verdict(reply: Column) -> Column:
    """(agreed, certainty) of the reply to a verification request."""
    return replies.reply_verdict(reply)


_sql("reply string")(replies.reply_doc_type)
_sql("reply string")(replies.reply_segments)
_sql("reply string")(replies.reply_object)
_sql("score decimal(4,3)")(scoring.confidence_band)


# --- review --------------------------------------------------------------------------


@_sql("current_state string; target_state string")
def can_transition(current: Column, target: Column) -> Column:
    from waybridge.operators import review

    return review.can_transition(current, target)


def _moved(action: str, state: Column, filled: Column | None = None) -> Column:
    from waybridge.operators import review

    filled = F.lit(True) if filled is None else filled
    error = review.action_error(F.lit(action), state, filled)
    return bound(
        error,
        lambda e: F.struct(
            F.when(e.isNull(), review.TARGET_STATE[action]).otherwise(state).alias("state"),
            e.alias("error"),
        ),
    )


@_sql("state string")
def transition_to_in_review(state: Column) -> Column:
    """(state, error): the state after a claim, the old one with a message if it is not allowed."""
    return _moved("claim", state)


@_sql("state string")
def resolve_approved(state: Column) -> Column:
    return _moved("approve", state)


@_sql("state string; corrected_fields map<string,string>")
def resolve_corrected(state: Column, corrections: Column) -> Column:
    return _moved("correct", state, F.coalesce(F.size(corrections) > 0, F.lit(False)))


@_sql("state string")
def resolve_escalated(state: Column) -> Column:
    return _moved("escalate", state)


@_sql("reasons array<string>")
def classify_review_reason(reasons: Column) -> Column:
    from waybridge.operators.confidence import primary_reason

    return primary_reason(reasons)


@_sql("corrected_fields map<string,string>")
def build_field_corrections(corrections: Column) -> Column:
    """One (field_name, field_value, confidence) per corrected field, at full confidence."""
    return F.transform(
        F.map_entries(corrections),
        lambda e: F.struct(
            e["key"].alias("field_name"), e["value"].alias("field_value"), scoring.conf("1.000").alias("confidence")
        ),
    )


# --- display -------------------------------------------------------------------------

_sql("flag string")(display.flag_label)
_sql("reason string")(display.reason_label)
_sql("method string")(display.method_label)
_sql("amount decimal(12,2)")(display.signed_dollars)
_sql("status string")(display.status_group)
_sql("status string")(display.is_terminal)


# --- fixed numbers -------------------------------------------------------------------


@_sql()
def money_tolerance() -> Column:
    return F.lit(vocab.MONEY_TOLERANCE).cast("decimal(3,2)")


@_sql()
def document_confidence_threshold() -> Column:
    return scoring.conf(vocab.DOCUMENT_THRESHOLD)


@_sql()
def field_confidence_threshold() -> Column:
    return scoring.conf(vocab.FIELD_THRESHOLD)


# --- text of an expression -----------------------------------------------------------

#: a text or quoted name, or an operator or keyword that stands before its arguments
_CALLED = re.compile(r"('(?:[^'\\]|\\.)*'|`[^`]*`)|(?<![\w`.)])([-+*/%<>=!&|^~]+|and|or|not|in)\(")


def sql_text(column: Column) -> str:
    """A column expression as SQL.

    A column shows itself in SQL but for operators, which it writes like functions; between
    back quotes they are functions in SQL, too.
    """
    shown = str(column).removeprefix("Column<'").removesuffix("'>")
    return _CALLED.sub(lambda m: m[1] or f"`{m[2]}`(", shown)


def definition(spark: SparkSession, name: str) -> str:
    """The ``CREATE TEMPORARY FUNCTION`` statement of one function."""
    fn = FUNCTIONS[name]
    given = ", ".join(f"{p} {kind}" + (f" DEFAULT {d}" if d else "") for p, kind, d in fn.parameters)
    empty = spark.range(0).select(*(F.lit(None).cast(kind).alias(p) for p, kind, _ in fn.parameters))
    returns = empty.select(fn.column().alias("r")).schema["r"].dataType.simpleString()
    return (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {returns}"
        f" RETURN {sql_text(fn.column())}"
    )


def register(spark: SparkSession) -> list[str]:
    """Make all functions callable in ``spark.sql`` of this session; their names."""
    for name in FUNCTIONS:
        spark.sql(definition(spark, name))
    return list(FUNCTIONS)
