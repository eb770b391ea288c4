"""Parsing, formatting and class-score expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedback_engine.functions.wordlists import UNCERTAIN_CONFIDENCE, UNCERTAIN_MARGIN
from feedback_engine.schemas import LABEL_INDEX, LABELS

LOCAL_ZONE = "America/Sao_Paulo"


def parse_timestamp(text: Column) -> Column:
    """Timestamp or null, never an error."""
    return F.try_to_timestamp(text)


def parse_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def local_timestamp(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant to the local wall clock."""
    return F.from_utc_timestamp(utc, zone)


def local_date(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(local_timestamp(utc, zone))


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def format_int(n: Column) -> Column:
    """Dot as the thousands separator."""
    return F.translate(F.format_number(n, 0), ",", ".")


def format_pct(share: Column) -> Column:
    """One decimal percent; null stays null (a format string would print the word)."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100))


def format_span(start: Column, end: Column) -> Column:
    return F.concat(format_date(start), F.lit(" ate "), format_date(end))


def bool_or_false(flag: Column) -> Column:
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def not_nan(value: Column) -> Column:
    """NaN to null for numeric columns read from files."""
    return F.when(~F.isnan(value), value)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when the whole is zero or missing."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(share, F.lit(0.0))


def label_index(label: Column) -> Column:
    pairs = [F.lit(x) for pair in LABEL_INDEX.items() for x in pair]
    return F.create_map(*pairs)[label]


def index_label(index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LABELS]), index.cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda may be inlined there and computed once per element; a
    lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def scaled_to_one(values: Column) -> Column:
    """Array divided by its Euclidean length; a zero array stays zero."""
    length = F.sqrt(array_sum(F.transform(values, lambda x: x * x)))
    safe = F.when(length > 0, length).otherwise(F.lit(1.0))
    return let(safe, lambda n: F.transform(values, lambda x: x / n))


def softmax(logits: Column) -> Column:
    """Shift by the maximum before the exponential, so that large logits do not overflow."""

    def shares(powers: Column) -> Column:
        return let(array_sum(powers), lambda total: F.transform(powers, lambda x: x / total))

    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, shares)


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def margin(values: Column) -> Column:
    ordered = F.sort_array(values, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def is_uncertain(probabilities: Column) -> Column:
    return (F.array_max(probabilities) < UNCERTAIN_CONFIDENCE) | (
        margin(probabilities) < UNCERTAIN_MARGIN
    )


def score_columns(probabilities: Column, names: Sequence[str] = ("neg", "neu", "pos")) -> list[Column]:
    return [F.get(probabilities, F.lit(i)).alias(f"score_{name}") for i, name in enumerate(names)]
