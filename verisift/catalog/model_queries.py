"""Fitted models over the labelled documents: training, tuning, ablations and saved bundles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, models
from ..operators.corpus import class_counts
from ..operators.features import NUMERIC_COLUMNS, apply_features, feature_values, fit_features
from ..operators.metrics import binary_metrics, classification_report, confusion_matrix, roc_points
from ..operators.ranking import rank_candidates
from ..operators.similarity import similar_train_matches, similarity_thresholds
from ..plans.audit_report import report_lines
from ..plans.build_corpus import build_corpus
from ..plans.train_and_select import train_and_select
from ..sources.artifacts import load_model
from ..sources.demo import demo_lexicon
from . import audit_queries, inputs, sentiment_queries
from . import sqltext as q
from .base import Query, scratch_dir, with_ctes

# Plural forms that occur in real articles; the synthetic texts rarely hold them.
LEMMAS = (("isis", "isi"), ("articles", "article"), ("women", "woman"), ("stories", "story"), ("sources", "source"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The clean split corpus of all labelled documents, written and read back."""
    lexicon = demo_lexicon(spark)
    lemmas = spark.createDataFrame(list(LEMMAS), "token string, lemma string")
    rows = inputs.labelled(spark, sf).select("doc_id", "label", "seq", "raw_text")
    built, _ = build_corpus(rows, lemmas, lexicon, f"{scratch_dir(spark)}/corpus", *inputs.SHARES, seed=inputs.SEED)
    return built


def built_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return class_counts(corpus(spark, sf))


def built_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the corpus, its two long texts as digests."""
    digests = [F.md5(c).alias(f"{c}_md5") for c in ("raw_text", "text_llm", "text_ml")]
    return corpus(spark, sf).select("doc_id", "label", "split", *digests, *NUMERIC_COLUMNS)


def _trainer(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return models.fit_candidates(corpus(spark, sf), names).metrics

    return build


def tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Grid search of every family over three folds."""
    trained = models.fit_candidates(corpus(spark, sf), models.CANDIDATES, tune=True)
    return models.tuning_table(spark, trained).join(trained.metrics.filter("split = 'validation'"), "model")


def feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf)
    fitted, names = fit_features(rows.filter("split = 'train'"))
    last = vector_to_array(F.col("features"))
    return apply_features(fitted, rows, ["doc_id", "split"]).select(
        "doc_id", "split", F.size(last).cast("long").alias("n_features"), F.lit(len(names)).cast("long").alias("n_names")
    )


def assembled_values(spark: SparkSession, sf: str) -> DataFrame:
    """All features of all rows by name; those that are 0 at four decimals are left out, as vectors do."""
    rows = corpus(spark, sf)
    fitted, names = fit_features(rows.filter("split = 'train'"))
    values = feature_values(apply_features(fitted, rows, ["doc_id", "split"]), names, ["doc_id", "split"])
    return values.withColumn("value", F.round("value", 4)).filter("value <> 0")


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates fitted, the winner chosen on validation, everything saved and the models read back."""
    rows = corpus(spark, sf)
    trained, paths = train_and_select(rows, f"{scratch_dir(spark)}/bundle", models.CANDIDATES)
    saved = {name: paths[name] for name in trained.models}
    saved["missing_model"] = f"{paths['features']}/nothing"
    measured, failed = models.evaluate_families(spark, paths["features"], saved, rows, measure=binary_metrics)
    return measured.withColumn("selected", F.col("model") == paths["winner"]).withColumn("failed", F.lit(",".join(failed)))


def family_measures(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked metrics, confusion cells, report rows and ROC points, told apart by ``part``; other columns are null."""
    ranked = rank_candidates(models.with_model_order(binary_metrics(scores, keys, score_digits=None))).drop("model_order")
    parts = {
        "metrics": ranked,
        "confusion": confusion_matrix(scores, keys),
        "report": classification_report(scores, keys),
        "roc": roc_points(scores, keys, score_digits=None),
    }
    named = [rows.withColumn("part", F.lit(name)) for name, rows in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def evaluated_families(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf)
    trained, paths = train_and_select(rows, f"{scratch_dir(spark)}/bundle", models.CANDIDATES)
    saved = {name: paths[name] for name in trained.models}
    return models.evaluate_families(spark, paths["features"], saved, rows, measure=family_measures)[0]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A saved winner applied to its articles."""
    rows = corpus(spark, sf)
    _, paths = train_and_select(rows, f"{scratch_dir(spark)}/bundle", models.CANDIDATES)
    name = paths["winner"]
    out = models.score_table(name, load_model(spark, paths[name]), load_model(spark, paths["features"]), rows)
    return out.select("doc_id", "split", "ml_score", "ml_label", "ml_model_name")


def predictive_terms(spark: SparkSession, sf: str) -> DataFrame:
    return audit.top_predictive_terms(corpus(spark, sf))


def first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ablate_first_sentence(corpus(spark, sf))


def feature_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """The families that the versions compare: the SVM and the network."""
    rows = corpus(spark, sf)
    return audit.ablate_features(rows, "svm").unionByName(audit.ablate_features(rows, "neural_network"))


def audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The whole written audit: sizes, near-duplicates, predictive terms and the ablation."""
    rows = corpus(spark, sf)
    matches = similarity_thresholds(similar_train_matches(*audit_queries.sides_of(rows)))
    return report_lines(
        "V2", class_counts(rows), matches, audit.top_predictive_terms(rows), audit.ablate_first_sentence(rows)
    )


_LEMMA_CASES = " ".join(f"WHEN '{token}' THEN '{lemma}'" for token, lemma in LEMMAS)
#: CTEs ending in ``corpus``, the rows of ``build_corpus``.
_CORPUS_CTES = (
    q.LABELLED_CTE,
    *q.canonical_ctes("labelled"),
    *q.split_ctes("kept"),
    ("texts", "SELECT k.doc_id, k.label, s.split, k.raw_text AS text FROM kept k JOIN splits s ON k.doc_id = s.doc_id"),
    q.LEXICON_CTE,
    sentiment_queries.doc_hits("texts"),
    *sentiment_queries.sentence_ctes("texts"),
    (
        "corpus",
        f"""SELECT d.doc_id, d.label, d.split, d.text AS raw_text, {q.clean_light('d.text')} AS text_llm,
 array_to_string(list_transform({q.ml_tokens('d.text')}, lambda t: CASE t {_LEMMA_CASES} ELSE t END), ' ') AS text_ml,
 round(v, 4) AS sub_variance, subj4 AS mean_subjectivity, round({q.lexical_density('d.text')}, 4) AS lexical_density,
 round({q.caps_ratio('d.text')}, 4) AS caps_ratio, {q.has_dateline('d.text')}::INTEGER AS has_dateline
 FROM texts d JOIN doc_avg a ON d.doc_id = a.doc_id JOIN variance v ON d.doc_id = v.doc_id""",
    ),
)
_FEATURE_CTES = (
    *_CORPUS_CTES,
    ("toks", f"SELECT doc_id, label, split, {q.terms('text_ml')} AS t FROM corpus"),
    *audit_queries.TERM_CTES,
)


def _scaled(column: str) -> str:
    """The z-score of a column by the train rows, in long form."""
    moments = f"SELECT avg({column}) AS m, stddev_pop({column}) AS s FROM corpus WHERE split = 'train'"
    deviation = "CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE s END"
    return f"SELECT doc_id, split, '{column}' AS name, ({column} - m) / {deviation} AS value FROM corpus, ({moments})"


QUERIES = [
    Query(
        "build_corpus",
        built_corpus,
        with_ctes("SELECT split, label, count(*) AS n_rows FROM corpus GROUP BY split, label", *_CORPUS_CTES),
    ),
    Query(
        "build_corpus_rows",
        built_rows,
        with_ctes(
            "SELECT doc_id, label, split, md5(raw_text) AS raw_text_md5, md5(text_llm) AS text_llm_md5, "
            f"md5(text_ml) AS text_ml_md5, {', '.join(NUMERIC_COLUMNS)} FROM corpus",
            *_CORPUS_CTES,
        ),
    ),
    Query(
        "assemble_features",
        feature_vectors,
        with_ctes(
            f"""SELECT doc_id, split, (SELECT count(*) FROM vocab) + {len(NUMERIC_COLUMNS)} AS n_features,
 (SELECT count(*) FROM vocab) + {len(NUMERIC_COLUMNS)} AS n_names FROM corpus""",
            *_FEATURE_CTES,
        ),
    ),
    Query(
        "assembled_values",
        assembled_values,
        with_ctes(
            "SELECT * FROM (SELECT doc_id, split, name, round(value, 4) AS value FROM "
            "(SELECT doc_id, split, term AS name, w AS value FROM w UNION ALL "
            + " UNION ALL ".join(_scaled(c) for c in NUMERIC_COLUMNS)
            + ")) WHERE value <> 0",
            *_FEATURE_CTES,
        ),
    ),
    Query("train_logreg", _trainer("logistic_regression")),
    Query("train_svm_calibrated", _trainer("svm")),
    Query("train_forest", _trainer("random_forest")),
    Query("train_mlp", _trainer("neural_network")),
    Query("fit_candidates", _trainer(*models.CANDIDATES)),
    Query("tune_candidates", tuned),
    Query("score_table", scored),
    Query("select_and_bundle", selected),
    Query("evaluate_saved_families", evaluated_families),
    Query("top_predictive_terms", predictive_terms),
    Query("ablate_features", feature_ablation),
    Query("ablate_first_sentence", first_sentence),
    Query("audit_report", audit_lines),
]
