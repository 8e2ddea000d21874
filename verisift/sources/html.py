"""Main text of raw web pages, made of column expressions.

A page is cut before every tag. An element runs from its opening tag to the closing tag that brings the depth of its own
tag name back to zero, or to the end of the page; a paragraph is the span up to the next paragraph tag.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip

# Tags thrown away, places to look for the article body, and length limits.
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "iframe", "button"]
MAIN_SELECTORS = [
    "main",
    "[role='main']",
    "#content",
    "#main-content",
    ".article-body",
    ".story-body",
    ".story-details",
    ".article_content",
    ".article_body",
]
MIN_PARAGRAPH = 20
MIN_USABLE = 80

# Tags that never hold content.
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()

#: Named character references of the public HTML standard, those that end with a semicolon.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}


def _opening(selector: str) -> str:
    """Pattern of the tag, at the start of a piece, that opens an element of the selector."""
    if selector.isalpha():
        return rf"(?i)^<{selector}(?:[{WS}/][^>]*)?>"
    if selector.startswith("#"):
        attribute = rf"""id=(?:["']{selector[1:]}["']|{selector[1:]}(?=[{WS}>]))"""
    elif selector.startswith("."):
        name = rf"""["'](?:[^"']*[{WS}])?{selector[1:]}(?:[{WS}][^"']*)?["']"""
        attribute = rf"""class=(?:{name}|{selector[1:]}(?=[{WS}>]))"""
    else:
        attribute = r"""role=["']?main["']?"""
    return rf"(?i)^<(?!(?:{'|'.join(VOID_TAGS)})[{WS}])[a-z][a-z0-9]*[{WS}](?:[^>]*[{WS}])?{attribute}[^>]*>"


def _main_part(df: DataFrame, page: str, out: str) -> DataFrame:
    """Add the inside of the main element: ``article``, the first selector that is found, or the body."""
    df = df.withColumn("_pieces", F.split(page, "(?=<)"))
    df = df.withColumn(
        "_names", F.transform("_pieces", lambda p: F.lower(F.regexp_extract(p, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1)))
    )

    def rank(piece: Column, name: Column) -> Column:
        """The first selector that the piece opens, null if none; most pieces only have their name compared."""
        named, attributes = F.lit(None).cast("int"), F.lit(None).cast("int")
        for at, selector in reversed(list(enumerate(["article", *MAIN_SELECTORS, "body"]))):
            opened = piece.rlike(_opening(selector))
            if selector.isalpha():
                named = F.when((name == selector) & opened, at).otherwise(named)
            else:
                attributes = F.when(opened, at).otherwise(attributes)
        attributes = F.when(~name.startswith("/") & piece.rlike(rf"(?i)[{WS}](?:id|class|role)="), attributes)
        return F.least(named, attributes)

    # One pass over the pieces: the least selector, and its first piece.
    zipped = F.arrays_zip(F.col("_pieces").alias("p"), F.col("_names").alias("n"))
    ranks = F.transform(zipped, lambda x, i: F.struct(rank(x["p"], x["n"]).alias("rank"), (i + 1).alias("at")))
    best = F.array_min(F.filter(ranks, lambda r: r["rank"].isNotNull()))
    df = df.withColumn("_first", best["at"].cast("int")).withColumn("_tag", F.element_at("_names", F.coalesce("_first", F.lit(1))))

    def close(state: Column, name: Column) -> Column:
        step = F.when(name == F.col("_tag"), 1).when(name == F.concat(F.lit("/"), F.col("_tag")), -1).otherwise(0)
        depth = state["depth"] + step
        return F.when(state["depth"] == 0, state).otherwise(
            F.struct(depth.alias("depth"), (state["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"))
        )

    rest = F.slice("_names", F.col("_first") + 1, F.size("_names"))
    state = F.aggregate(rest, F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n")), close)
    inside = F.array_join(F.slice("_pieces", F.col("_first"), state["n"]), "")
    main = F.when(F.col("_first").isNull(), "").otherwise(F.regexp_replace(inside, "^<[^>]*>", ""))
    return df.withColumn(out, main).drop("_pieces", "_names", "_first", "_tag")


def decode_entities(c: Column) -> Column:
    """Character references with a semicolon, named and numeric; anything else stays as it is."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def resolve(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 9).cast("int")).when(
            name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 9), 16, 10).cast("int")
        )
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        text = F.when(name.startswith("#"), numeric).when(name != "", F.try_element_at(named, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(text.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(text, rest))

    pieces = F.split(c, "&")
    resolved = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), resolve)
    return F.when(c.contains("&"), F.concat(pieces[0], F.array_join(resolved, ""))).otherwise(c)


def _inner_text(fragment: Column) -> Column:
    """Text runs between tags, each stripped."""
    return F.array_remove(F.transform(F.split(fragment, r"<[^>]*>"), lambda run: strip(decode_entities(run))), "")


def with_main_text(df: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """Add the main text, in steps so that no page is cleaned or cut twice."""
    clean = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in NOISE_TAGS:
        clean = F.regexp_replace(clean, rf"(?is)<{tag}(?:[{WS}][^>]*)?>.*?</{tag}[{WS}]*>", "")
    starts = F.split("_main", rf"(?i)<p(?:[{WS}][^>]*)?>")
    paragraphs = F.transform(
        F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
        lambda p: F.array_join(_inner_text(F.split(p, "(?i)</p>").getItem(0)), ""),
    )
    text = F.when(F.size("_kept") > 0, F.array_join("_kept", " ")).otherwise(
        F.array_join(_inner_text(F.col("_main")), " ")
    )
    return (
        _main_part(df.withColumn("_clean", clean), "_clean", "_main")
        .withColumn("_kept", F.filter(paragraphs, lambda p: F.length(p) > MIN_PARAGRAPH))
        .withColumn(out, text)
        .drop("_clean", "_main", "_kept")
    )


def usable_status(text: Column) -> Column:
    """``ok`` only above the minimum length; exactly the minimum is already too short."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) > MIN_USABLE, "ok").otherwise("too_short")
