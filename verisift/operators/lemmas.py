"""Noun lemmas: the table is made from suffix rules and a noun list, then applied to tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ml_tokens
from .sentiment import IN_ROW

# Noun endings and what replaces them, in the order they are tried.
NOUN_SUFFIXES = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)


def lemma_candidates(token: Column) -> Column:
    """The token itself and every form a noun ending leads to, as ``(place, form)`` structs."""
    forms = [F.struct(F.lit(0).alias("place"), token.alias("form"))]
    for place, (ending, stem) in enumerate(NOUN_SUFFIXES, 1):
        cut = F.concat(F.left(token, F.length(token) - len(ending)), F.lit(stem))
        forms.append(F.when(token.endswith(ending), F.struct(F.lit(place).alias("place"), cut.alias("form"))))
    return F.filter(F.array(*forms), lambda f: f.isNotNull())


def build_lemma_table(vocabulary: DataFrame, nouns: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(token, lemma)`` for the tokens that change: the shortest listed form, first rule on a tie.

    ``vocabulary`` has ``token``, ``nouns`` has ``word``, ``exceptions`` has ``token, lemma``.
    """
    forms = vocabulary.select("token").distinct().select("token", F.explode(lemma_candidates(F.col("token"))).alias("f"))
    forms = forms.select("token", "f.place", "f.form").join(
        nouns.select(F.col("word").alias("form")).distinct(), "form"
    )
    if exceptions is not None:
        special = exceptions.select("token", F.lit(0).alias("place"), F.col("lemma").alias("form"))
        keep = [F.col(c) for c in ("token", "place", "form")]
        forms = forms.select(*keep).join(special.select("token"), "token", "left_anti").unionByName(special)
    best = forms.groupBy("token").agg(
        F.min(F.struct(F.length("form").alias("n"), F.col("place"), F.col("form"))).alias("best")
    )
    return best.select("token", F.col("best.form").alias("lemma")).filter("token <> lemma")


def _swapped_in_row(lemmas: dict[str, str]):
    """A function from a row's tokens to its text, tokens replaced by their lemmas."""
    token, lemma = pa.array(list(lemmas), type=pa.string()), pa.array(list(lemmas.values()), type=pa.string())

    @F.arrow_udf("string")
    def swapped(rows: pa.Array) -> pa.Array:
        tokens = rows.flatten()
        found = pc.coalesce(pc.take(lemma, pc.index_in(tokens, value_set=token)), tokens)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(ends, found), " ")

    return swapped


def with_clean_ml(df: DataFrame, lemmas: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """Add ``text_ml``: tokens that have a lemma are replaced by it.

    Tokens are looked up where their row is, so nothing is shuffled, as long as the lemmas fit a task's memory; a larger
    table is joined with distinct tokens, and those that change go back to their row. ``lemmas`` has one row per token, ids
    are unique; rows without an id keep their tokens.
    """
    tokenized = df.withColumn("_tokens", ml_tokens(F.col(text_col)))
    listed = lemmas.select("token", "lemma").limit(IN_ROW + 1).collect()
    if len(listed) <= IN_ROW:
        known = {token: lemma for token, lemma in listed if token is not None and lemma is not None}
        plain = F.array_join("_tokens", " ")
        text = F.when(F.col(id_col).isNull(), plain).otherwise(_swapped_in_row(known)("_tokens"))
        return tokenized.withColumn("text_ml", text).drop("_tokens")
    changed = (
        tokenized.select(id_col, F.explode(F.array_distinct("_tokens")).alias("token"))
        .join(lemmas, "token")
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas"))
    )
    swapped = F.transform("_tokens", lambda t: F.coalesce(F.try_element_at(F.col("_lemmas"), t), t))
    text = F.array_join(F.when(F.col("_lemmas").isNull(), F.col("_tokens")).otherwise(swapped), " ")
    return tokenized.join(changed, id_col, "left").withColumn("text_ml", text).drop("_tokens", "_lemmas")
