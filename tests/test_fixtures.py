"""Text and verdict rules on small written inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verisift.functions import credibility, style, text
from verisift.operators import lemmas, sentiment, tools, verdict
from verisift.operators.reputation import with_credibility
from verisift.sources import html
from verisift.sources.demo import demo_lexicon

REAL = (
    "WASHINGTON (Reuters) - The central bank kept rates unchanged on Wednesday. Officials were cautiously optimistic. "
    "The decision was widely expected by markets."
)
FAKE = "EXPOSED: Officials Caught RED-HANDED hiding a SECRET!!! They have been LYING to us for DECADES!!! Share this!!!"


def values(spark, function, inputs):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "id int, t string")
    return [r.v for r in rows.select("id", function(F.col("t")).alias("v")).orderBy("id").collect()]


def test_publisher_marks(spark):
    got = values(
        spark,
        text.strip_publisher,
        [
            "WASHINGTON (Reuters) - Body.",
            "NEW YORK (Reuters) - Body.",
            "Title first WASHINGTON (Reuters) - Body.",
            "LONDON — Body.",
            "Text. Photo by Some One/Agency",
            "Keep. Read more: gone\nkept",
            "",
            None,
        ],
    )
    assert got == ["Body.", "Body.", "Title first WASHINGTON  - Body.", "Body.", "Text.", "Keep. \nkept", "", ""]


def test_light_and_model_text(spark):
    assert values(spark, text.clean_light, ["See http://x.y/z <b>bold</b>  @handle"]) == ["See bold @handle"]
    got = values(spark, text.clean_ml, ["I cannot gonna see the Café's 2 a-b cats!", None])
    assert got == ["gon na see cafés ab cats", ""]


def test_punctuation_and_first_sentence(spark):
    assert values(spark, text.normalize_punct, ["Really?!? Yes!!  now"]) == ["Really? Yes! now"]
    got = values(spark, text.drop_first_sentence, ["One sentence only.", "A. B! C?", " \n", None])
    assert got == ["", "B! C?", "", ""]
    assert values(spark, style.sentences, ["A. B! C?", ""]) == [["A.", "B!", "C?"], []]


def test_canonical_key_folds_compatibility_forms(spark):
    got = values(spark, text.canonical_key, ["Ｆｕｌｌ ﬁne, “Test”", "full fine test", "?!.", "full fine tests"])
    assert got == ["full fine test", "full fine test", "", "full fine tests"]


def test_leakage(spark):
    rows = spark.createDataFrame([("WASHINGTON (Reuters) - by @x",), ("plain",), (None,)], "t string")
    flags = text.leakage_flags(F.col("t"))
    got = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in flags.items()]).collect()]
    assert got[0][:3] == (True, True, True) and got[0][3] == pytest.approx(1.0)
    assert got[1] == (False, False, False, 0.0) == got[2]


def test_dateline_needs_one_word_and_a_hyphen(spark):
    got = values(spark, style.has_dateline, [REAL, "NEW YORK (Reuters) - x", "LONDON (AP) — x", "", None])
    assert got == [True, False, False, False, False]


def test_style_shares(spark):
    assert values(spark, style.caps_ratio, ["ABcd", "", None]) == [0.5, 0.0, 0.0]
    assert values(spark, style.lexical_density, ["a A b b", " "]) == [0.5, 0.0]
    assert values(spark, style.caps_word_ratio, ["ABC DE fgh A1B", ""]) == [0.5, 0.0]


def test_tone_of_awkward_texts(spark):
    docs = spark.createDataFrame([(1, REAL), (2, FAKE), (3, ""), (4, None)], "doc_id long, text string")
    lexicon = demo_lexicon(spark)
    rows = {r.doc_id: r for r in sentiment.with_style_and_tone(docs, "doc_id", "text", lexicon).collect()}
    narrow = sentiment.article_scores(docs, "doc_id", "text", lexicon).collect()
    assert all(r[c] == rows[r.doc_id][c] for r in narrow for c in sentiment.SCORES)
    assert rows[2].emotional_tone != "neutral" and rows[2].exclamation_ratio == 1.0
    assert rows[3].tone_score == 0.0 and rows[4].sentence_count == 0 and rows[4].sub_variance == 0.0


def test_lexicon_of_any_size(spark):
    words = spark.range(50_000).selectExpr("concat('w', id) AS word", "0.5D AS polarity", "0.25D AS subjectivity")
    docs = spark.createDataFrame([(1, "w1 w49999. other w7"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: r for r in sentiment.style_and_tone(docs, "doc_id", "text", words).collect()}
    assert (got[1].overall_polarity, got[1].mean_subjectivity, got[1].sub_variance) == (0.5, 0.25, 0.0)
    assert got[2].overall_polarity == 0.0


def test_credibility(spark):
    urls = [
        "https://www.reuters.com/article/test",
        "https://infowars.com/story/123",
        "https://unknown-blog.xyz/post",
        "http://foxnews.com:8080/x",
        "https://foxnews.com/x",
        "",
        None,
    ]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    got = [(r.domain, r.credibility_tier, r.is_known_source) for r in with_credibility(rows, "url").orderBy("id").collect()]
    assert got == [
        ("reuters.com", "high", True),
        ("infowars.com", "very_low", True),
        ("unknown-blog.xyz", "low", False),
        ("foxnews.com:8080", "low", False),
        ("foxnews.com", "moderate", True),
        ("", "unknown", False),
        ("", "unknown", False),
    ]
    assert len(credibility.REPUTATION) == 14


def test_lemmas(spark):
    vocabulary = spark.createDataFrame([(t,) for t in ("isis", "boxes", "women", "stories", "bus", "run")], "token string")
    nouns = spark.createDataFrame([(t,) for t in ("isis", "isi", "box", "woman", "story", "bus", "run")], "word string")
    table = lemmas.build_lemma_table(vocabulary, nouns)
    assert {r.token: r.lemma for r in table.collect()} == {
        "isis": "isi",
        "boxes": "box",
        "women": "woman",
        "stories": "story",
    }
    docs = spark.createDataFrame([(1, "Isis women run boxes, women!"), (2, "")], "doc_id long, raw_text string")
    wanted = [(1, "isi woman run box woman"), (2, "")]
    got = lemmas.with_clean_ml(docs, table).select("doc_id", "text_ml")
    assert sorted(map(tuple, got.collect())) == wanted


def test_page_text(spark):
    long_a, long_b = "a" * 25, "b" * 30
    pages = {
        f"<body><nav><p>{'n' * 40}</p></nav><article><p>{long_a}</p><p>short</p><p>{long_b}</p></article></body>": f"{long_a} {long_b}",
        f"<body><div id='content'><p> {long_a} &amp; x</p></div></body>": f"{long_a} & x",
        "<body><main>Only <b>text</b> here</main></body>": "Only text here",
        f"<div class='x story-body y'><p>{long_b}</p></div>": long_b,
        "<p>nothing</p>": "",
        "": "",
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "id int, html string")
    columns = html.with_main_text(rows).orderBy("id").collect()
    assert [r.main_text for r in columns] == list(pages.values())


def test_page_elements_end_at_their_own_depth(spark):
    a, b = "first " * 5, "second " * 5
    pages = {
        f"<div id='content'><div><p>{a}</p></div><p>{b}</p></div><p>after {a}</p>": f"{a.strip()} {b.strip()}",
        f"<article><p>{a}</p><article><p>{b}</p></article><p>{a}</p></article><p>after {a}</p>": (
            f"{a.strip()} {b.strip()} {a.strip()}"
        ),
        f"<ul id=content><li><p>{a}</p></li></ul>": a.strip(),
        f"<article><p>it&rsquo;s caf&eacute; &#8212; &#x2014; &hellip; &amp;lt; &unknown; A&B &#0; {a}</p></article>": (
            f"it’s café — — … &lt; &unknown; A&B &#0; {a.strip()}"
        ),
        f"<section role=main><p>{a}<p>{b}</section>": f"{a.strip()} {b.strip()}",
        f"<article>{'<p>' * 1500}{a}": a.strip(),
        f"<input id='content'><body><p>{a}</p></body>": a.strip(),
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "id int, html string")
    got = html.with_main_text(rows).orderBy("id").collect()
    assert [r.main_text for r in got] == list(pages.values())


def test_usable_text_needs_more_than_the_minimum(spark):
    assert values(spark, html.usable_status, ["x" * 80, "x" * 81, None]) == ["too_short", "ok", "too_short"]


@pytest.mark.parametrize(
    "final_text, score, label, reasoning",
    [
        ('```json\n{"label": "real", "confidence": 0.8, "reasoning": "ok"}\n```', 0.8, "REAL", "ok"),
        ('```json {"confidence": "0.25"} ```', 0.25, "FAKE", '```json {"confidence": "0.25"} ```'),
        ('```json {"label": "REAL"} ```', 0.5, "REAL", '```json {"label": "REAL"} ```'),
        ("no block", 0.5, "UNKNOWN", "Failed to parse final JSON output. Raw output:\nno block"),
        ('```json {"label": } ```', 0.5, "FAKE", "Failed to perform LLM analysis: invalid JSON"),
        ('```json {"label": 3} ```', 0.5, "FAKE", "Failed to perform LLM analysis: invalid JSON"),
        ('```json {"label": null} ```', 0.5, "FAKE", "Failed to perform LLM analysis: invalid JSON"),
    ],
)
def test_verdict_parsing(spark, final_text, score, label, reasoning):
    row = verdict.with_parsed_verdict(spark.createDataFrame([(final_text,)], "final_text string")).first()
    assert (row.llm_score, row.llm_label, row.llm_reasoning) == (score, label, reasoning)


def test_blend_edges(spark):
    rows = [
        (1, 0.82, "REAL", 0.7, "real", 0.7),
        (2, 0.82, "REAL", 0.9, "FAKE", 0.3),
        (3, 0.5, "REAL", 0.5, "UNKNOWN", None),
        (4, 0.2, "UNKNOWN", 0.5, "UNKNOWN", 0.29),
    ]
    df = spark.createDataFrame(rows, "id int, ml_score double, ml_label string, llm_score double, llm_label string, eval_score double")
    out = {r.id: r for r in verdict.with_summary(verdict.with_blend(df.withColumn("llm_reasoning", F.lit("why")))).collect()}
    assert (out[1].ml_weight, out[2].ml_weight, out[3].ml_weight, out[4].llm_weight) == (0.5, 0.6, 0.7, 0.3)
    assert out[1].eval_agreement and not out[2].eval_agreement and not out[4].eval_agreement
    assert out[1].final_score == pytest.approx(0.76)
    assert out[2].p_real_final == pytest.approx(0.6 * 0.82 + 0.4 * 0.1)
    assert out[3].final_label == "REAL"
    assert out[2].summary.endswith("(ML: REAL, AI: FAKE)")


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, 10, "cross_reference_tool", {"article_title": ""}),
            (1, 1, 11, "cross_reference_tool", {"article_title": "Second"}),
            (1, 2, 12, None, {}),
            (2, 0, 13, "other_tool", {}),
        ],
        "article_id long, pos long, call_id long, name string, args map<string,string>",
    )
    results = spark.createDataFrame([(1, 10, "first\nmore"), (1, 12, "z")], "article_id long, call_id long, content string")
    paired = tools.pair_tool_results(calls, results)
    assert {(r.article_id, r.pos): (r.name, r.result) for r in paired.collect()} == {
        (1, 0): ("cross_reference_tool", "first\nmore"),
        (1, 1): ("cross_reference_tool", ""),
        (1, 2): ("unknown", "z"),
        (2, 0): ("other_tool", ""),
    }
    articles = spark.createDataFrame([(1, "Own"), (2, "Own two")], "article_id long, title string")
    got = {r.article_id: r for r in tools.first_tool_query(articles, paired).collect()}
    assert (got[1]["query"], got[1].shown_query, got[1].result_first_line) == ("Second", "(none)", "first")
    assert (got[2]["query"], got[2].shown_query) == ("Own two", None)
    counts = {r.name: r.times for r in tools.tool_call_counts(calls.filter("name IS NOT NULL")).collect()}
    assert counts["cross_reference_tool"] == 2 and counts["fetch_url_tool"] == 0 and counts["other_tool"] == 1
