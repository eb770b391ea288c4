"""Ordered business rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedback_engine.functions import wordlists as W
from feedback_engine.functions.scalars import let
from feedback_engine.functions.text import format_keyword, transliterate
from feedback_engine.schemas import MIXED, NEGATIVE, NEUTRAL, NO_TEXT, OTHER_THEMES, POSITIVE


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def first_match(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """CASE WHEN over ordered (condition, value) pairs."""
    condition, value = rules[0]
    out = F.when(condition, value)
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def _substring_rules(text: Column, rules) -> list[tuple[Column, Column]]:
    return [(contains_any(text, markers), F.lit(value)) for markers, value in rules]


def classify_theme(
    text: Column,
    rules: Sequence[tuple[str, str]] = W.THEME_RULES,
    accent_sensitive: bool = False,
) -> Column:
    """First of the ordered regex rules that hits; null text and no hit have their own names.

    ``accent_sensitive`` matches the unaccented patterns on the lowered raw text, so that
    "crédito" misses; the default matches on the transliterated text.
    """
    haystack = F.lower(text) if accent_sensitive else transliterate(text)
    flags = "(?U)" if accent_sensitive else ""

    def first_theme(hay: Column) -> Column:
        hits = [(hay.rlike(flags + pattern), F.lit(name)) for name, pattern in rules]
        return first_match([(hay.isNull(), F.lit(NO_TEXT)), *hits], F.lit(OTHER_THEMES))

    return let(haystack, first_theme)


def theme_action(theme: Column, accent_sensitive: bool = False) -> Column:
    """Recommended action of a theme; ``accent_sensitive`` lets accented names miss their rule."""
    name = F.lower(theme) if accent_sensitive else transliterate(theme)
    return first_match(_substring_rules(name, W.THEME_ACTIONS), F.lit(W.DEFAULT_ACTION))


def _keyword_text(keywords: Column) -> Column:
    return F.lower(F.array_join(F.filter(keywords, lambda k: F.trim(k) != ""), " "))


def _first_two_keywords(keywords: Column) -> Column:
    """The first keyword and the next one that starts with another token."""
    cleaned = F.filter(
        F.transform(keywords, lambda k: F.trim(F.replace(k, F.lit("_"), F.lit(" ")))),
        lambda k: k != "",
    )

    def token(k: Column) -> Column:
        return F.lower(F.substring_index(k, " ", 1))

    def joined(words: Column) -> Column:
        head = F.get(words, F.lit(0))
        second = let(token(head), lambda first: F.get(F.filter(words, lambda k: token(k) != first), F.lit(0)))
        return F.concat_ws(" / ", format_keyword(head), let(second, format_keyword))

    return let(cleaned, joined)


def topic_label(keywords: Column) -> Column:
    """Label of a keyword list; its text is joined once per row, not once per marker."""
    fallback = let(
        _first_two_keywords(keywords), lambda f: F.when(f != "", f).otherwise(F.lit(W.NO_TOPIC_LABEL))
    )

    def labelled(text: Column) -> Column:
        card = contains_any(text, ["cartao"])
        rules = _substring_rules(text, W.TOPIC_LABELS) + [
            (card & contains_any(text, W.CARD_MARKERS), F.lit(W.CARD_BILL_LABEL)),
            (card, F.lit(W.CARD_USE_LABEL)),
            (
                contains_any(text, ["conta"]) & contains_any(text, W.ACCOUNT_MARKERS),
                F.lit(W.ACCOUNT_LABEL),
            ),
        ]
        return first_match(rules, fallback)

    return let(_keyword_text(keywords), labelled)


def refine_topic_label(topic: Column, signal: Column, keywords: Column) -> Column:
    """Adjust a label by the cluster's signal."""
    by_signal = {
        "credit": (W.CREDIT_OFFER_LABEL, W.CREDIT_LOAN_LABEL, W.CREDIT_ELIGIBILITY_LABEL),
        "card": (W.CARD_USE_LABEL, W.CARD_BILL_LABEL, W.CARD_SUPPORT_LABEL),
    }

    def pick(kind: str) -> Column:
        positive, negative, other = by_signal[kind]
        return (
            F.when(signal == POSITIVE, positive).when(signal == NEGATIVE, negative).otherwise(other)
        )

    def refined(text: Column, name: Column) -> Column:
        credit = contains_any(text, ["emprest", "credito"]) | name.startswith("Empréstimo")
        card = contains_any(text, ["cartao"]) | name.startswith("Cartão")
        access = contains_any(text, W.ACCESS_MARKERS) | (
            contains_any(text, ["conta"]) & (signal == NEGATIVE)
        )
        return first_match(
            [(credit, pick("credit")), (card, pick("card")), (access, F.lit(W.ACCESS_LABEL))], name
        )

    return let(_keyword_text(keywords), lambda text: let(F.trim(topic), lambda name: refined(text, name)))


def cluster_action(topic: Column, signal: Column) -> Column:
    def action(name: Column) -> Column:
        rules = [(signal == MIXED, F.lit(W.MIXED_ACTION))]
        return first_match([*rules, *_substring_rules(name, W.CLUSTER_ACTIONS)], F.lit(W.DEFAULT_ACTION))

    return let(F.lower(topic), action)


def cluster_signal(share_pos: Column, share_neg: Column) -> Column:
    def leads(a: Column, b: Column) -> Column:
        return (a >= W.SIGNAL_SHARE) & (a - b >= W.SIGNAL_MARGIN)

    return (
        F.when(leads(share_pos, share_neg), POSITIVE)
        .when(leads(share_neg, share_pos), NEGATIVE)
        .otherwise(MIXED)
    )


def predominant_label(share_pos: Column, share_neg: Column, share_neu: Column) -> Column:
    """Positive wins ties, also when all shares are zero."""
    return (
        F.when(share_pos >= F.greatest(share_neg, share_neu), POSITIVE)
        .when(share_neg >= F.greatest(share_pos, share_neu), NEGATIVE)
        .otherwise(NEUTRAL)
    )


def rating_to_label(rating: Column) -> Column:
    """1,2 negative; 3 neutral; 4,5 positive; anything else (4.5 too) is null."""
    return (
        F.when(rating.isin(1, 2), NEGATIVE)
        .when(rating == 3, NEUTRAL)
        .when(rating.isin(4, 5), POSITIVE)
    )


def noisy_neutral(label: Column, text: Column) -> Column:
    """A neutral row whose text hits exactly one of the two opinion term lists."""
    positive = F.coalesce(text.rlike("|".join(W.POSITIVE_NOISE)), F.lit(False))
    negative = F.coalesce(text.rlike("|".join(W.NEGATIVE_NOISE)), F.lit(False))
    return F.coalesce(label == NEUTRAL, F.lit(False)) & (positive != negative)
