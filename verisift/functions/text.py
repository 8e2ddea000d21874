"""Text assembly, cleaning, canonical keys and leakage markers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Every character Python's str.strip() and \s treat as white space, and the same set
# as the inside of a character class that Java and RE2 both accept.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
    "       　"
)
WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# The same classes in another order: most characters are found in the first range, without a look at Unicode tables.
WORD_FAST = rf"a-z{WORD}"
NO_WORD = rf"[^a-z\x20-\x20{WORD}{WS}]"
# White space but for a single blank, which would only be replaced by itself.
SPACES = rf"(?:[{WS}&&[^\x20]]|\x20(?=[{WS}]))[{WS}]*"
# What stands between words, white space or not, but for a single blank.
BETWEEN_WORDS = rf"(?:[^\x20{WORD_FAST}]|\x20(?=[^{WORD_FAST}]))[^{WORD_FAST}]*"

# Publisher and markup patterns.
DATELINE_PREFIX = rf"^[A-Z{WS}]{{3,20}}[{WS}]?(?:\([^)]+\))?[{WS}]?[-—][{WS}]?"
LOCATION_PREFIX = rf"^[A-Z{WS}]{{3,20}}[{WS}]?(?:\([^)]+\))?[{WS}]?[-—]"
AGENCY_TAG = r"(?i)\(Reuters\)"
PHOTO_CREDIT = rf"(?i)Photo by [A-Za-z{WS}]+(/[A-Za-z{WS}]+)?"
READ_MORE = rf"(?i)Read more[:{WS}][^\n]*"
HANDLE = r"@[A-Za-z0-9_]{1,15}"
LINK = rf"http[^{WS}]+"
MARKUP = r"<[^\n]*?>"

# English stop words removed before model training.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Words the English tokenizer cuts in two.
SPLIT_WORDS = {
    "cannot": "can not",
    "gimme": "gim me",
    "gonna": "gon na",
    "gotta": "got ta",
    "lemme": "lem me",
    "wanna": "wan na",
}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times; lambdas in it would compute the value anew each time."""
    return F.transform(F.array(value), use)[0]


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACES, " "))


def words(c: Column) -> Column:
    """White-space separated tokens; an empty text has none."""
    return F.array_remove(F.split(strip(c), f"[{WS}]+"), "")


def full_text(title: Column, body: Column) -> Column:
    return strip(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def strip_publisher(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for pattern in (DATELINE_PREFIX, AGENCY_TAG, PHOTO_CREDIT, READ_MORE):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def normalize_punct(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"([!?]){2,}", "$1")
    return strip(F.regexp_replace(c, f"[{WS}]{{2,}}", " "))


def clean_light(c: Column) -> Column:
    """Keep case and punctuation; drop publisher marks, links and tags."""
    return collapse_spaces(_without_markup(c))


def _without_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_publisher(c), LINK, ""), MARKUP, "")


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; Spark has no built-in, so only non-ASCII texts travel to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def canonical_key(c: Column, normalize: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    if normalize:
        c = nfkc(c)
    # White space is collapsed once, together with all else that stands between words.
    return strip(F.regexp_replace(F.lower(_without_markup(c)), BETWEEN_WORDS, " "))


def ml_tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words without punctuation, stop words and single characters (before lemmas)."""
    stop_words = STOP_WORDS if stop_words is None else stop_words
    plain = F.regexp_replace(F.lower(clean_light(c)), NO_WORD, "")
    for whole, parts in SPLIT_WORDS.items():
        # The word comes first: it is searched for as a whole, and what stands before it is looked at where it is found.
        plain = F.regexp_replace(plain, rf"{whole}(?<![{WORD}]{whole})(?![{WORD}])", parts)
    return F.filter(
        words(plain), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words) if stop_words else F.length(w) > 1
    )


def clean_ml(c: Column, lemma=None, stop_words: list[str] | None = None) -> Column:
    """Model text: ``ml_tokens``, each passed through ``lemma`` (a column function), joined by spaces."""
    tokens = ml_tokens(c, stop_words)
    return F.array_join(F.transform(tokens, lemma) if lemma else tokens, " ")


def leakage_flags(c: Column) -> dict[str, Column]:
    """Marker columns; the score adds the three weights in a fixed order, at most 1."""
    c = F.coalesce(c, F.lit(""))
    tag = c.rlike(AGENCY_TAG)
    place = F.substring(c, 1, 100).rlike(LOCATION_PREFIX)
    handle = c.rlike(HANDLE)
    score = (
        F.when(tag, 0.6).otherwise(0.0) + F.when(place, 0.3).otherwise(0.0) + F.when(handle, 0.1).otherwise(0.0)
    )
    return {
        "has_reuters_tag": tag,
        "has_location_prefix": place,
        "has_twitter_handle": handle,
        "leakage_score": F.least(score, F.lit(1.0)),
    }


def leakage_clean(c: Column, score: Column) -> Column:
    return F.when(score > 0, normalize_punct(strip_publisher(c))).otherwise(c)


def leakage_message(score: Column, cleaned: Column) -> Column:
    found = F.concat(
        F.lit("Leakage Detected: Score "), score.cast("string"), F.lit("\nCleaned Text:\n"), cleaned
    )
    return F.when(score > 0, found).otherwise(
        F.lit("No significant leakage markers detected. Text is safe for ML.")
    )


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def drop_first_sentence(c: Column) -> Column:
    """Text after the first sentence end; empty when there is only one sentence."""
    c = strip(F.coalesce(c, F.lit("")))
    return strip(F.regexp_extract(c, rf"(?s)^.*?[.!?][{WS}]+(.*)$", 1))


def text_preview(raw: Column, fallback: Column, chars: int = 250) -> Column:
    return F.substring(F.coalesce(raw, fallback), 1, chars)
