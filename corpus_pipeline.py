"""From raw documents to training tokens: five stages, each written as Parquet and read again by the next.

``STAGES`` holds (name, function) in order; a function takes (spark, docs, sf_dir), works on all of ``docs`` and returns
a DataFrame. All but the last return the columns of ``documents``. Rows with null texts, repeated rows and empty tables
go through as the stages' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import langid, minhash, mixing, toxicity
from verisift.llm.common import table, written
from verisift.llm.queries import bpe_digests, crc_mod

#: A document is toxic from this probability on, and has no language below this pooled probability.
TOXIC, LANGUAGE = 0.7, 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC``; null and empty texts stay."""

    def held_out(ident: Column) -> Column:
        return crc_mod(ident, 3) == 1

    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), held_out, into="_toxicity")
    text = F.coalesce(F.col("text"), F.lit(""))
    return scored.filter((F.col("_toxicity") < TOXIC) | (text == "")).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: texts without letters or of no clear language go.

    With nothing to learn from, only texts without letters go.
    """

    def held_out(ident: Column) -> Column:
        return crc_mod(ident, 5) == 0

    network = langid.fit(docs, held_out, "doc_id", "text", "lang")
    if not network.languages:
        return langid.with_letters(docs)
    found = langid.label_languages(docs, network, into=("_lang", "_score"))
    return found.filter((F.col("_lang") != langid.UNDETERMINED) & (F.col("_score") >= LANGUAGE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id, and of rows with one id the least row.

    Rows without id belong to no group and stay.
    """
    kept = minhash.near_duplicates(docs, width=5, similarity=0.8).filter("kept").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    others = [c for c in docs.columns if c != "doc_id"]
    one = chosen.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row"))
    return one.select("doc_id", "row.*").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources weigh 5, 2, 1 in turn and share 150% of all words."""
    return mixing.repeat_by_mix(mixing.mix(docs, into="_mix"), into="_mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that the mix took."""
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Trained models and MinHash are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
