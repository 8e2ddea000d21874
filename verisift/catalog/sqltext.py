"""SQL pieces for the query counterparts, written for an RE2 engine."""

from __future__ import annotations

from ..functions.text import STOP_WORDS, WS
from ..sources.demo import LEXICON
from .inputs import MODELS, SEED, SHARES

WORD = r"\p{L}\p{N}_"
UPPER = r"\p{Lu}Ⅰ-ⅯⒶ-Ⓩ🄰-🅉🅐-🅩🅰-🆉"
LOWER_OR_TITLE = r"\p{Ll}\p{Lt}ªºʰ-ʸˀˁˠ-ˤⅰ-ⅿⓐ-ⓩ"


def replace(value: str, regex: str, by: str = "") -> str:
    return f"regexp_replace({value}, '{regex}', '{by}', 'g')"


def strip(value: str) -> str:
    return replace(value, f"^[{WS}]+|[{WS}]+$")


def collapse(value: str) -> str:
    return strip(replace(value, f"[{WS}]+", " "))


def words(value: str) -> str:
    return f"list_filter(string_split_regex({strip(value)}, '[{WS}]+'), lambda w: w <> '')"


def strip_publisher(value: str) -> str:
    x = f"coalesce({value}, '')"
    x = replace(x, rf"^[A-Z{WS}]{{3,20}}[{WS}]?(?:\([^)]+\))?[{WS}]?[-—][{WS}]?")
    x = replace(x, r"(?i)\(Reuters\)")
    x = replace(x, rf"(?i)Photo by [A-Za-z{WS}]+(/[A-Za-z{WS}]+)?")
    return strip(replace(x, rf"(?i)Read more[:{WS}][^\n]*"))


def normalize_punct(value: str) -> str:
    x = replace(f"coalesce({value}, '')", r"([!?]){2,}", r"\1")
    return strip(replace(x, f"[{WS}]{{2,}}", " "))


def clean_light(value: str) -> str:
    return collapse(replace(replace(strip_publisher(value), f"http[^{WS}]+"), r"<[^\n]*?>"))


def canonical_key(value: str) -> str:
    return collapse(replace(f"lower({clean_light(value)})", f"[^{WORD}{WS}]", " "))


def ml_tokens(value: str) -> str:
    plain = replace(f"lower({clean_light(value)})", f"[^{WORD}{WS}]")
    cut = (
        f"list_transform({words(plain)}, lambda t: CASE t WHEN 'cannot' THEN 'can not' WHEN 'gimme' THEN 'gim me' "
        "WHEN 'gonna' THEN 'gon na' WHEN 'gotta' THEN 'got ta' WHEN 'lemme' THEN 'lem me' "
        "WHEN 'wanna' THEN 'wan na' ELSE t END)"
    )
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    return (
        f"list_filter(string_split(array_to_string({cut}, ' '), ' '), lambda t: length(t) > 1 AND t NOT IN ({stop}))"
    )


def lexical_density(value: str) -> str:
    w = words(f"lower({value})")
    return f"coalesce(CASE WHEN len({w}) > 0 THEN len(list_distinct({w}))::DOUBLE / len({w}) END, 0::DOUBLE)"


def caps_ratio(value: str) -> str:
    capitals = f"length({replace(value, f'[^{UPPER}]')})"
    return f"coalesce(CASE WHEN length({value}) > 0 THEN {capitals}::DOUBLE / length({value}) END, 0::DOUBLE)"


def has_dateline(value: str) -> str:
    pattern = rf"^[A-Z]{{2,}}[{WS}]?\([^\n]*?\)[{WS}]?\-[{WS}]?"
    return f"coalesce(regexp_matches(substring({value}, 1, 100), '{pattern}'), false)"


def sentences(value: str) -> str:
    marked = replace(strip(f"coalesce({value}, '')"), rf"([.!?])[{WS}]+", r"\1' || chr(1) || '")
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def exclamation_ratio(value: str) -> str:
    s = sentences(value)
    shouted = f"len(list_filter({s}, lambda s: ends_with(s, '!')))"
    return f"coalesce(CASE WHEN len({s}) > 0 THEN {shouted}::DOUBLE / len({s}) END, 0::DOUBLE)"


def caps_word_ratio(value: str) -> str:
    w = words(f"coalesce({value}, '')")
    shouted = (
        f"len(list_filter({w}, lambda w: length(w) >= 3 AND regexp_matches(w, '[{UPPER}]') "
        f"AND NOT regexp_matches(w, '[{LOWER_OR_TITLE}]')))"
    )
    return f"coalesce(CASE WHEN len({w}) > 0 THEN {shouted}::DOUBLE / len({w}) END, 0::DOUBLE)"


def drop_first_sentence(value: str) -> str:
    x = strip(f"coalesce({value}, '')")
    return strip(f"regexp_extract({x}, '(?s)^.*?[.!?][{WS}]+(.*)$', 1)")


def domain(value: str) -> str:
    host = f"regexp_extract({strip(value)}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
    return f"regexp_replace(lower({host}), '^www\\.', '')"


LEXICON_CTE = (
    "lexicon",
    "SELECT word, polarity::DOUBLE AS polarity, subjectivity::DOUBLE AS subjectivity FROM (VALUES "
    + ", ".join(f"('{w}', {p}, {s})" for w, p, s in LEXICON)
    + ") AS v(word, polarity, subjectivity)",
)


def lexicon_words(value: str) -> str:
    return f"regexp_extract_all(lower({value}), '[{WORD}]+')"


def terms(value: str) -> str:
    """Unigrams then bigrams as one list."""
    t = f"regexp_extract_all(lower({value}), '[{WORD}]{{2,}}')"
    pairs = f"list_transform(list_zip({t}[1:len({t}) - 1], {t}[2:len({t})]), lambda p: p[1] || ' ' || p[2])"
    return f"list_concat({t}, {pairs})"


TITLE_SQL = "CASE WHEN d.lang = 'de' THEN NULL ELSE d.source END"

LABELLED_CTE = (
    "labelled",
    f"""SELECT d.doc_id, l.quality AS label, d.lang, d.source, {TITLE_SQL} AS title, d.text,
 {strip("coalesce(d.text, '')")} AS raw_text
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)

VARIANT_CTES = (
    LABELLED_CTE,
    (
        "variants",
        """SELECT doc_id * 4 AS doc_id, label, text AS raw_text FROM labelled
 UNION ALL SELECT doc_id * 4 + 1, label, replace(text, ' ', '  ') || ' !!' FROM labelled
 UNION ALL SELECT doc_id * 4 + 2, label, regexp_replace(text, '[^!?.]', '', 'g') FROM labelled
 UNION ALL SELECT doc_id * 4 + 3, label, ' ' || chr(10) || ' ' FROM labelled""",
    ),
)


def canonical_ctes(source: str) -> tuple:
    """CTEs ending in ``kept(doc_id, label, raw_text, dedup_key)``: the first row of every canonical key of ``source``."""
    return (
        ("filled", f"SELECT doc_id, label, {strip('raw_text')} AS raw_text FROM {source}"),
        ("keyed", f"SELECT *, {canonical_key('raw_text')} AS dedup_key FROM filled WHERE raw_text <> ''"),
        (
            "kept",
            """SELECT doc_id, label, raw_text, dedup_key FROM (
 SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY label, doc_id) AS rn FROM keyed WHERE dedup_key <> '')
 WHERE rn = 1""",
        ),
    )


CANONICAL_CTES = (*VARIANT_CTES, *canonical_ctes("variants"))


def split_ctes(source: str, shares: tuple[float, float, float] = SHARES, seed: int = SEED) -> tuple:
    """CTEs ending in ``splits(doc_id, label, split)`` over ``source(doc_id, label)``."""
    _, val, test = shares
    held, test_share = val + test, 1 - val / (val + test)

    def allot(part: str, total: str, drawn: str) -> str:
        return f"{part}::DOUBLE / {total} * {drawn}"

    return (
        (
            "sizes0",
            f"""SELECT label, n, total, total - ceil(total * {held!r}::DOUBLE)::BIGINT AS train_total FROM (
 SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY label)""",
        ),
        ("sizes1", f"SELECT *, {allot('n', 'total', 'train_total')} AS e FROM sizes0"),
        (
            "sizes2",
            """SELECT *, floor(e)::BIGINT + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, label)
 <= train_total - sum(floor(e)::BIGINT) OVER () THEN 1 ELSE 0 END AS n_train FROM sizes1""",
        ),
        (
            "sizes3",
            f"""SELECT *, n - n_train AS rest, total - train_total AS temp_total,
 total - train_total - ceil((total - train_total) * {test_share!r}::DOUBLE)::BIGINT AS val_total FROM sizes2""",
        ),
        ("sizes4", f"SELECT *, {allot('rest', 'temp_total', 'val_total')} AS e2 FROM sizes3"),
        (
            "sizes",
            """SELECT label, n, n_train, floor(e2)::BIGINT + CASE WHEN row_number() OVER (ORDER BY e2 - floor(e2) DESC, label)
 <= val_total - sum(floor(e2)::BIGINT) OVER () THEN 1 ELSE 0 END AS n_val FROM sizes4""",
        ),
        (
            "splits",
            f"""SELECT r.doc_id, r.label, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val
 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, label,
 row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || doc_id)) AS rn FROM {source}) r
 JOIN sizes s ON r.label = s.label""",
        ),
    )


def feature_cte(name: str, source: str, extra: str = "") -> tuple[str, str]:
    return (
        name,
        f"""SELECT doc_id, label, {extra} round({lexical_density('raw_text')}, 4) AS lexical_density,
 round({caps_ratio('raw_text')}, 4) AS caps_ratio, len({words('raw_text')}) AS n_words FROM {source}""",
    )


def score_cte(name: str, source: str, keep: str) -> tuple[str, str]:
    """Long scores of the fixed models over a feature CTE."""
    parts = []
    for i, (model, (b, weights)) in enumerate(MODELS.items(), 1):
        z = " + ".join([f"{b!r}::DOUBLE"] + [f"{w!r}::DOUBLE * {c}" for c, w in weights.items()])
        parts.append(
            f"SELECT {keep}, label AS y_true, '{model}' AS model, {i} AS model_order, "
            f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))), 4) AS y_score FROM {source}"
        )
    return name, "SELECT *, (y_score >= 0.5)::INTEGER AS y_pred FROM (" + " UNION ALL ".join(parts) + ")"


SCORE_CTES = (
    LABELLED_CTE,
    *split_ctes("labelled"),
    feature_cte("features", "labelled"),
    ("split_features", "SELECT f.*, s.split FROM features f JOIN splits s ON f.doc_id = s.doc_id"),
    score_cte("scores", "split_features", "doc_id, split"),
)


def metric_ctes(source: str, keys: str, name: str = "metrics") -> tuple:
    """CTEs ending in ``name(keys, accuracy, precision, recall, f1, auc_roc)``."""
    on = " AND ".join(f"c.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    p = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END"
    r = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END"
    return (
        (
            f"{name}_cells",
            f"""SELECT {keys}, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
 count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
 count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM {source} GROUP BY {keys}""",
        ),
        (
            f"{name}_ranks",
            f"""SELECT {keys}, y_true, rank() OVER (PARTITION BY {keys} ORDER BY y_score)
 + (count(*) OVER (PARTITION BY {keys}, y_score) - 1) / 2.0::DOUBLE AS r FROM {source}""",
        ),
        (
            f"{name}_auc",
            f"""SELECT {keys}, round(CASE WHEN count(*) FILTER (y_true = 1) > 0 AND count(*) FILTER (y_true = 0) > 0
 THEN (sum(r) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2.0::DOUBLE)
 / (count(*) FILTER (y_true = 1)::DOUBLE * count(*) FILTER (y_true = 0)) END, 4) AS auc_roc
 FROM {name}_ranks GROUP BY {keys}""",
        ),
        (
            f"{name}_pr",
            f"""SELECT {cols}, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS acc, {p} AS p, {r} AS r, auc_roc
 FROM {name}_cells c JOIN {name}_auc a ON {on}""",
        ),
        (
            name,
            f"""SELECT {keys}, round(acc, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
 round(CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0 END, 4) AS f1, auc_roc FROM {name}_pr""",
        ),
    )
