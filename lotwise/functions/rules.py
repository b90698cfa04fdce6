"""Rule engine as column expressions: numbers out of text, verdicts, explanations, review confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.canonical import join_texts, python_float
from lotwise.functions.let import let

# Fixed values of the evaluated domain.
GSTIN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]\b"
UNKNOWN_SCORE, DEFAULT_CONFIDENCE = 0.3, 0.87
CLEAN_PHRASES = ("not blacklisted", "not_blacklisted", "is not blacklisted", "are not blacklisted", "not debarred", "not_debarred", "is not debarred", "are not debarred",
    "not listed", "not_listed", "no blacklisting", "no debarment", "debarment: none", "not been blacklisted", "not been debarred", "hereby declare", "declares that")
FAIL_PHRASES = ("is blacklisted", "has been blacklisted", "was blacklisted", "is debarred", "has been debarred", "was debarred", "expired", "invalid", "blacklisted",
    "debarred", "cancelled", "revoked", "suspended", "not registered", "not valid", "lapsed", "does not hold", "not held", "not_held", "not yet", "not yet allotted",
    "not yet issued", "not yet been issued", "under process", "in process", "in_process", "pending", "applied for", "application pending", "yet to be", "not certified",
    "not currently certified", "no certification", "no valid certificate")
PASS_PHRASES = ("valid", "registered", "active", "compliant", "certified", "approved", "current", "clean")
TAX_LABELS = ("gst", "gstin", "tax")


#: Characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase occurs in c."""
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


def to_float(value: Column) -> Column:
    """The number in a text: mean of all where it lists several, the first otherwise; lakhs become crores; else null."""
    text = F.lower(strip(value.cast("string")))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+\.?\d*"), 0), lambda x: x.try_cast("double"))
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)
    found = F.when(text.contains("[") | text.contains(","), mean).otherwise(F.get(numbers, F.lit(0)))
    scaled = F.when(text.contains("lakh") | text.contains("lac"), F.round(found / 100.0, 4)).otherwise(found)
    return F.when(text.isin("none", "null", "nan", "") | (F.size(numbers) == 0), None).otherwise(scaled)


def is_gst(value: Column) -> Column:
    """Whether the text holds a GST identification number."""
    return F.upper(value).rlike(GSTIN)


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """value against threshold; an unknown or missing operator means at least."""
    op = _operator(operator)
    return F.when(op == "lte", value <= threshold).when(op == "gt", value > threshold).when(op == "lt", value < threshold).when(op == "eq",
        value == threshold).when(op == "neq", value != threshold).otherwise(value >= threshold)


#: Branches of the rules, in the order in which they are tried, and those that pass or fail; all others leave it unknown.
AMBIGUOUS, NOT_NUMERIC, ABOVE, BELOW, NOT_FOUND, TAX_NUMBER, CLEARED, BARRED, STATED, PRESENT, UNCLEAR = range(1, 12)
PASSING, FAILING = (ABOVE, TAX_NUMBER, CLEARED, STATED, PRESENT), (BELOW, BARRED)


def _operator(operator: Column) -> Column:
    return F.lower(strip(F.coalesce(F.nullif(operator, F.lit("")), F.lit("gte"))))


def branch(label: Column, ambiguous: Column, threshold: Column, operator: Column, value: Column) -> Column:
    """Which rule decides on a criterion's extracted value.

    Ambiguous criteria are unknown; a threshold compares numbers; else phrases decide, clean ones before failing ones,
    since the latter occur within the former.
    """
    text, number = strip(value), to_float(value)
    low = F.lower(text)
    tax = any_of(F.lower(F.coalesce(label, F.lit("unnamed"))), TAX_LABELS) & is_gst(text)
    numeric = F.when(number.isNull(), NOT_NUMERIC).when(compare(number, operator, threshold), ABOVE).otherwise(BELOW)
    worded = F.when(value.isNull(), NOT_FOUND).when(tax, TAX_NUMBER).when(any_of(low, CLEAN_PHRASES), CLEARED).when(any_of(low, FAIL_PHRASES), BARRED)
    worded = worded.when(any_of(low, PASS_PHRASES), STATED).when(low != "", PRESENT).otherwise(UNCLEAR)
    return F.when(F.coalesce(ambiguous, F.lit(False)), AMBIGUOUS).when(threshold.isNotNull(), numeric).otherwise(worded)


def verdict_of(taken: Column) -> Column:
    return F.when(taken.isin(*PASSING), "pass").when(taken.isin(*FAILING), "fail").otherwise("unknown")


def score_of(taken: Column, confidence: Column) -> Column:
    return F.when(taken.isin(*PASSING), F.round(confidence, 4)).when(taken.isin(*FAILING), 0.0).otherwise(UNKNOWN_SCORE).cast("double")


def explanation_of(taken: Column, label: Column, threshold: Column, operator: Column, value: Column) -> Column:
    """What a branch says of the value."""
    compared = join_texts("extracted=", python_float(to_float(value)), " ", _operator(operator), " threshold=", python_float(threshold))
    quoted = join_texts("'", value, "'")
    said = {
        AMBIGUOUS: F.lit("Criterion is ambiguous — cannot evaluate deterministically"), NOT_NUMERIC: F.lit("Value not found or not numeric in bidder document"), ABOVE: join_texts(compared, " → PASS"),
        BELOW: join_texts(compared, " → FAIL"), NOT_FOUND: F.lit("Not found in bidder document"), TAX_NUMBER: join_texts("Valid GST number found: ", strip(value)),
        CLEARED: join_texts("Compliant (not blacklisted/debarred): ", quoted), BARRED: join_texts("Non-compliant: ", quoted), STATED: join_texts("Compliant: ", quoted), PRESENT: join_texts("Value present: ", quoted),
        UNCLEAR: join_texts("Could not determine compliance from: ", quoted),
    }
    text = reduce(lambda got, kv: got.when(taken == kv[0], kv[1]), list(said.items())[1:], F.when(taken == AMBIGUOUS, said[AMBIGUOUS]))
    return join_texts("[", F.coalesce(label, F.lit("unnamed")), "] ", text)


def verdict(label: Column, ambiguous: Column, threshold: Column, operator: Column, value: Column, confidence: Column) -> Column:
    """struct(verdict, score, explanation) of one criterion on one extracted value."""
    def all_of(taken: Column) -> Column:
        return F.struct(verdict_of(taken).alias("verdict"), score_of(taken, confidence).alias("score"), explanation_of(taken, label, threshold, operator, value).alias("explanation"))

    return let(branch(label, ambiguous, threshold, operator, value), all_of)


def clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def review_confidence(verdict: Column, score: Column, extraction_confidence: Column, not_found: Column, has_threshold: Column, ambiguous: Column, has_snippet: Column, ocr_quality: Column) -> Column:
    """How sure a reviewer may be: the score where decided, else extraction confidence with penalties."""
    unsure = (
        F.coalesce(extraction_confidence, F.lit(0.20)) + F.when(ambiguous, 0.10).otherwise(0.0) - F.when(has_threshold & not_found, 0.10).otherwise(0.0)
        - F.when(has_snippet, 0.0).otherwise(0.05) - 0.15 * (1 - clip(ocr_quality))
    )
    return F.round(clip(F.when(verdict.isin("pass", "fail"), score).otherwise(unsure)), 4)


def canonical_key(key: Column, label: Column) -> Column:
    """Criterion key in lower case with underscores: of the id, else the label, else "unknown"."""
    raw = F.coalesce(F.nullif(key, F.lit("")), F.nullif(label, F.lit("")), F.lit("unknown"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(raw)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def parse_threshold(text: Column) -> Column:
    """The first plain number in a text, else null."""
    return F.nullif(F.regexp_extract(text, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
