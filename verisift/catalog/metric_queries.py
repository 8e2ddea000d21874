"""Metrics, curves, rankings and version tables over the scores of the three fixed models."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, metrics, ranking
from . import inputs
from . import sqltext as q
from .base import Query, with_ctes


def _test_scores(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.scores(spark, sf).filter("split = 'test'")


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.scores(spark, sf)


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_all(spark, sf), ["split", "model"])


def binary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(_all(spark, sf), ["split", "model"])


def auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc_exact(_all(spark, sf), ["split", "model"])


def auc_two_level(spark: SparkSession, sf: str) -> DataFrame:
    """The same area by two-level running counts, for scores of any precision."""
    return metrics.auc_exact(_all(spark, sf), ["model"], score_digits=None)


def report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.classification_report(_test_scores(spark, sf), ["model"])


def roc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_points(_all(spark, sf), ["model"])


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    scores = inputs.scores(spark, sf)
    measured = metrics.binary_metrics(scores.filter("split = 'test'"), ["model"])
    base = corpus.majority_baseline(inputs.split_corpus(spark, sf).select("label", "split"))
    return metrics.evaluation_table(measured, base)


def _with_order(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in inputs.MODELS])
    return df.withColumn("model_order", F.array_position(names, F.col("model")))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    measured = metrics.binary_metrics(inputs.scores(spark, sf).filter("split = 'validation'"), ["model"])
    return ranking.rank_candidates(_with_order(measured))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("model", *metrics.METRICS, "place", "selected")


def winners(spark: SparkSession, sf: str) -> DataFrame:
    test = metrics.binary_metrics(_test_scores(spark, sf), ["model"])
    return ranking.winner_and_runner_up(_ranked(spark, sf), test)


def _version_metrics(spark: SparkSession, sf: str, canonical: bool) -> DataFrame:
    """Test metrics on the corpus of one version: v1 removes exact copies, v2 canonical ones."""
    rows = inputs.labelled_variants(spark, sf)
    kept = corpus.dedup_canonical(rows) if canonical else corpus.dedup_exact(rows)
    scored = inputs.score_rows(inputs.split_features(kept).filter("split = 'test'"), ["doc_id"])
    return metrics.binary_metrics(scored, ["model"])


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.union_versions(_version_metrics(spark, sf, False), _version_metrics(spark, sf, True))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf)


def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.metrics_side_by_side(_versions(spark, sf))


def exploded(spark: SparkSession, sf: str) -> DataFrame:
    measured = metrics.binary_metrics(_test_scores(spark, sf), ["model"]).withColumn("version", F.lit("v1"))
    return ranking.explode_metrics(ranking.metrics_map(measured))


def families(spark: SparkSession, sf: str) -> DataFrame:
    """All models on the test split in one pass: ranked metrics with their confusion cells."""
    scores = _test_scores(spark, sf)
    measured = ranking.rank_candidates(_with_order(metrics.binary_metrics(scores, ["model"])))
    cells = metrics.confusion_matrix(scores, ["model"]).groupBy("model").agg(
        F.max(F.when(F.col("y_true") == 1, F.col("pred_1"))).alias("tp"),
        F.max(F.when(F.col("y_true") == 0, F.col("pred_1"))).alias("fp"),
    )
    return measured.join(cells, "model").select("model", *metrics.METRICS, "place", "tp", "fp")


_TEST = ("test_scores", "SELECT * FROM scores WHERE split = 'test'")
_VALIDATION = ("val_scores", "SELECT * FROM scores WHERE split = 'validation'")
_COLUMNS = ", ".join(metrics.METRICS)
_ORDER = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(inputs.MODELS, 1)) + " END"
_RANK = f"row_number() OVER (ORDER BY f1 DESC, auc_roc DESC, accuracy DESC, {_ORDER})"

_VERSION_CTES = (
    *q.CANONICAL_CTES,
    (
        "exact_rows",
        """SELECT doc_id, label, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY raw_text
 ORDER BY label, doc_id) AS rn FROM filled WHERE raw_text <> '') WHERE rn = 1""",
    ),
)


def _version_ctes(version: str, source: str) -> tuple:
    """Split, feature, score and metric CTEs of one version, with the version in every name."""
    ctes = (
        *q.split_ctes(source),
        q.feature_cte("features", source),
        (
            "test_features",
            "SELECT f.* FROM features f JOIN splits s ON f.doc_id = s.doc_id WHERE s.split = 'test'",
        ),
        q.score_cte("vscores", "test_features", "doc_id"),
        *q.metric_ctes("vscores", "model", "vmetrics"),
    )
    own = sorted((name for name, _ in ctes), key=len, reverse=True)

    def rename(text: str) -> str:
        return re.sub(r"\b(" + "|".join(own) + r")\b", lambda m: f"{version}_{m.group(1)}", text)

    return tuple((f"{version}_{name}", rename(body)) for name, body in ctes)


_BOTH = (*_VERSION_CTES, *_version_ctes("v1", "exact_rows"), *_version_ctes("v2", "kept"))
_UNION = (
    f"SELECT model, {_COLUMNS}, 'v1' AS version FROM v1_vmetrics "
    f"UNION ALL SELECT model, {_COLUMNS}, 'v2' AS version FROM v2_vmetrics"
)

QUERIES = [
    Query(
        "confusion_matrix",
        confusion,
        with_ctes(
            """SELECT split, model, t AS y_true, count(*) FILTER (y_true = t AND y_pred = 0) AS pred_0,
 count(*) FILTER (y_true = t AND y_pred = 1) AS pred_1 FROM scores, (VALUES (0), (1)) AS v(t)
 GROUP BY split, model, t""",
            *q.SCORE_CTES,
        ),
    ),
    Query(
        "binary_metrics",
        binary,
        with_ctes(
            f"SELECT split, model, {_COLUMNS} FROM metrics",
            *q.SCORE_CTES,
            *q.metric_ctes("scores", "split, model"),
        ),
    ),
    Query(
        "auc_exact",
        auc,
        with_ctes(
            "SELECT split, model, auc_roc FROM metrics", *q.SCORE_CTES, *q.metric_ctes("scores", "split, model")
        ),
    ),
    Query(
        "auc_two_level",
        auc_two_level,
        with_ctes("SELECT model, auc_roc FROM metrics", *q.SCORE_CTES, *q.metric_ctes("scores", "model")),
    ),
    Query(
        "classification_report",
        report,
        with_ctes(
            """SELECT model, class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM (
 SELECT model, class, p, r, f, s AS support FROM per_class
 UNION ALL SELECT model, 'accuracy', a, a, a, n FROM (SELECT model,
  avg((y_true = y_pred)::INTEGER) AS a, count(*) AS n FROM test_scores GROUP BY model)
 UNION ALL SELECT model, 'macro avg', avg(p), avg(r), avg(f), sum(s)::BIGINT FROM per_class GROUP BY model
 UNION ALL SELECT model, 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s),
  sum(s)::BIGINT FROM per_class GROUP BY model)""",
            *q.SCORE_CTES,
            _TEST,
            (
                "hits",
                """SELECT model, k, count(*) FILTER (y_true = k AND y_pred = k) AS hit,
 count(*) FILTER (y_pred = k) AS predicted, count(*) FILTER (y_true = k) AS s
 FROM test_scores, (VALUES (0), (1)) AS v(k) GROUP BY model, k""",
            ),
            (
                "rates",
                """SELECT model, k::VARCHAR AS class, s,
 CASE WHEN predicted > 0 THEN hit::DOUBLE / predicted ELSE 0 END AS p,
 CASE WHEN s > 0 THEN hit::DOUBLE / s ELSE 0 END AS r FROM hits""",
            ),
            ("per_class", "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rates"),
        ),
    ),
    Query(
        "roc_points",
        roc,
        with_ctes(
            """SELECT model, t AS threshold, round(fp / neg, 4) AS fpr, round(tp / pos, 4) AS tpr FROM (
 SELECT a.model, a.y_score AS t,
  sum(count(*) FILTER (y_true = 0)) OVER (PARTITION BY a.model ORDER BY a.y_score DESC)::DOUBLE AS fp,
  sum(count(*) FILTER (y_true = 1)) OVER (PARTITION BY a.model ORDER BY a.y_score DESC)::DOUBLE AS tp
  FROM scores a GROUP BY a.model, a.y_score) s
 JOIN (SELECT model, count(*) FILTER (y_true = 0)::DOUBLE AS neg, count(*) FILTER (y_true = 1)::DOUBLE AS pos
  FROM scores GROUP BY model) n USING (model)
 UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM scores""",
            *q.SCORE_CTES,
        ),
    ),
    Query(
        "evaluation_run_table",
        run_table,
        with_ctes(
            f"""SELECT model, {_COLUMNS} FROM metrics UNION ALL
 SELECT 'majority_baseline', (SELECT round(avg((label = m)::INTEGER), 4) FROM splits WHERE split = 'test'),
 NULL, NULL, NULL, NULL FROM (SELECT label AS m FROM splits WHERE split = 'train' GROUP BY label
 ORDER BY count(*) DESC, label LIMIT 1)""",
            *q.SCORE_CTES,
            _TEST,
            *q.metric_ctes("test_scores", "model"),
        ),
    ),
    Query(
        "rank_candidates",
        ranked,
        with_ctes(
            f"SELECT model, {_COLUMNS}, {_RANK} AS place, {_RANK} = 1 AS selected FROM metrics",
            *q.SCORE_CTES,
            _VALIDATION,
            *q.metric_ctes("val_scores", "model"),
        ),
    ),
    Query(
        "winner_and_runner_up",
        winners,
        with_ctes(
            """SELECT w.model AS winner_model, w.f1 AS winner_f1, w.auc_roc AS winner_auc_roc,
 r.model AS runner_up_model, r.f1 AS runner_up_f1, r.auc_roc AS runner_up_auc_roc, """
            + ", ".join(f"t.{m} AS test_{m}" for m in metrics.METRICS)
            + " FROM ranked w JOIN ranked r ON w.place = 1 AND r.place = 2 JOIN tmetrics t ON t.model = w.model",
            *q.SCORE_CTES,
            _VALIDATION,
            _TEST,
            *q.metric_ctes("val_scores", "model"),
            *q.metric_ctes("test_scores", "model", "tmetrics"),
            ("ranked", f"SELECT *, {_RANK} AS place FROM metrics"),
        ),
    ),
    Query("union_versions", versions, with_ctes(_UNION, *_BOTH)),
    Query(
        "metrics_side_by_side",
        side_by_side,
        with_ctes("SELECT a.model, a.f1 AS v1, b.f1 AS v2 FROM v1_vmetrics a JOIN v2_vmetrics b USING (model)", *_BOTH),
    ),
    Query(
        "explode_metrics",
        exploded,
        with_ctes(
            f"SELECT 'v1' AS version, model, {_COLUMNS} FROM metrics",
            *q.SCORE_CTES,
            _TEST,
            *q.metric_ctes("test_scores", "model"),
        ),
    ),
    Query(
        "evaluate_families",
        families,
        with_ctes(
            f"""SELECT model, {_COLUMNS}, {_RANK} AS place, tp, fp FROM metrics
 JOIN (SELECT model, tp, fp FROM metrics_cells) c USING (model)""",
            *q.SCORE_CTES,
            _TEST,
            *q.metric_ctes("test_scores", "model"),
        ),
    ),
]
