"""Style measures of one text: density, capitals, dateline, sentences and tone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, once, strip, words

# Dateline pattern, tone weights and tone band edges.
DATELINE = rf"^[A-Z]{{2,}}[{WS}]?\([^\n]*?\)[{WS}]?\-[{WS}]?"
TONE_WEIGHTS = (0.4, 0.3, 0.3)
TONE_BANDS = ((0.25, "neutral"), (0.50, "slightly_biased"))
TOP_TONE = "highly_emotional"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def lexical_density(c: Column) -> Column:
    density = once(words(F.lower(c)), lambda t: _share(F.size(F.array_distinct(t)), F.size(t)))
    return F.coalesce(density, F.lit(0.0))


def caps_ratio(c: Column) -> Column:
    capitals = F.length(F.regexp_replace(c, r"[^\p{IsUppercase}]+", ""))
    return F.coalesce(_share(capitals, F.length(c)), F.lit(0.0))


def has_dateline(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 100).rlike(DATELINE), F.lit(False))


def sentences(c: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by white space."""
    return F.array_remove(F.split(strip(F.coalesce(c, F.lit(""))), rf"(?<=[.!?])[{WS}]+"), "")


def exclamation_ratio(sents: Column) -> Column:
    return _share(F.size(F.filter(sents, lambda s: s.endswith("!"))), F.size(sents))


def caps_word_ratio(c: Column) -> Column:
    def shouted(w: Column) -> Column:
        return (F.length(w) >= 3) & w.rlike(r"\p{IsUppercase}") & ~w.rlike(r"[\p{IsLowercase}\p{Lt}]")

    tokens = words(F.coalesce(c, F.lit("")))
    return once(tokens, lambda t: _share(F.size(F.filter(t, shouted)), F.size(t)))


def tone_score(subjectivity: Column, exclamations: Column, caps_words: Column) -> Column:
    a, b, c = TONE_WEIGHTS
    one = F.lit(1.0)
    raw = (
        F.lit(a) * subjectivity
        + F.lit(b) * F.least(exclamations * 2.0, one)
        + F.lit(c) * F.least(caps_words * 5.0, one)
    )
    return F.round(F.least(raw, one), 4)


def tone_band(score: Column) -> Column:
    (low, calm), (mid, biased) = TONE_BANDS
    return F.when(score < low, calm).when(score < mid, biased).otherwise(TOP_TONE)
