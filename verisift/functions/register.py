"""SQL names for the text functions.

Each is a temporary SQL function, which Spark inlines into the calling query, so SQL users get the
same built-in expressions as DataFrame users.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import style, text


def _pattern(regex: str) -> str:
    return f"r'{regex}'"


def _replace(value: str, regex: str, by: str = "") -> str:
    return f"regexp_replace({value}, {_pattern(regex)}, '{by}')"


def _strip(value: str) -> str:
    chars = "".join(f"\\u{ord(ch):04x}" for ch in text.WHITESPACE)
    return f"btrim({value}, '{chars}')"


def _words(value: str) -> str:
    return f"array_remove(split({_strip(value)}, {_pattern(f'[{text.WS}]+')}), '')"


def _once(value: str, body: str) -> str:
    """``body`` over ``t``, the value, which is computed once."""
    return f"element_at(transform(array({value}), t -> {body}), 1)"


def _share(part: str, whole: str) -> str:
    return f"coalesce(CASE WHEN {whole} > 0 THEN {part} / {whole} END, 0D)"


def sql_functions() -> dict[str, tuple[str, str]]:
    """Function name to its return type and body over the parameter ``c``."""
    ws, word = text.WS, text.WORD
    published = "coalesce(c, '')"
    for regex in (text.DATELINE_PREFIX, text.AGENCY_TAG, text.PHOTO_CREDIT, text.READ_MORE):
        published = _replace(published, regex)
    published = _strip(published)
    light = _strip(_replace(_replace(_replace(published, text.LINK), text.MARKUP), text.SPACES, " "))
    plain = _replace(f"lower({light})", text.NO_WORD)
    for whole, parts in text.SPLIT_WORDS.items():
        plain = _replace(plain, f"{whole}(?<![{word}]{whole})(?![{word}])", parts)
    stop = ", ".join('"' + w + '"' for w in text.STOP_WORDS)
    lower_words = _words("lower(c)")
    flags = " + ".join(
        f"CASE WHEN {c} RLIKE {_pattern(regex)} THEN {weight}D ELSE 0D END"
        for c, regex, weight in (
            ("c", text.AGENCY_TAG, 0.6),
            ("substring(c, 1, 100)", text.LOCATION_PREFIX, 0.3),
            ("c", text.HANDLE, 0.1),
        )
    )
    capitals = "length(" + _replace("c", r"[^\p{IsUppercase}]+") + ")"
    host = f"regexp_extract({_strip('c')}, {_pattern(r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)')}, 1)"
    body = _strip("coalesce(c, '')")
    rest = f"regexp_extract({body}, {_pattern(rf'(?s)^.*?[.!?][{ws}]+(.*)$')}, 1)"
    return {
        "strip_publisher": ("STRING", published),
        "normalize_punct": (
            "STRING",
            _strip(_replace(_replace("coalesce(c, '')", r"([!?]){2,}", "$1"), f"[{ws}]{{2,}}", " ")),
        ),
        "clean_light": ("STRING", light),
        "clean_ml": (
            "STRING",
            f"array_join(filter({_words(plain)}, w -> length(w) > 1 AND w NOT IN ({stop})), ' ')",
        ),
        "leakage_score": ("DOUBLE", f"coalesce(least({flags}, 1D), 0D)"),
        "word_count": ("BIGINT", f"cast(size({_words('c')}) AS BIGINT)"),
        "lexical_density": ("DOUBLE", _once(lower_words, _share("size(array_distinct(t))", "size(t)"))),
        "caps_ratio": ("DOUBLE", _share(capitals, "length(c)")),
        "has_dateline": ("BOOLEAN", f"coalesce(substring(c, 1, 100) RLIKE {_pattern(style.DATELINE)}, false)"),
        "extract_domain": ("STRING", _replace(f"lower({host})", r"^www\.")),
        "drop_first_sentence": ("STRING", _strip(rest)),
    }


def register_functions(spark: SparkSession) -> list[str]:
    for name, (kind, body) in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(c STRING) RETURNS {kind} RETURN {body}")
    return list(sql_functions())
