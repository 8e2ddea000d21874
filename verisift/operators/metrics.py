"""Classification metrics over a long score table ``(keys..., y_true, y_pred, y_score)``.

Every operator groups by the key columns, so all models (and splits, versions) are measured in one
pass. Label 1 is the positive class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import sums_before

METRICS = ("accuracy", "precision", "recall", "f1", "auc_roc")


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))


def _cells(scores: DataFrame, keys: list[str]) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return scores.groupBy(*keys).agg(
        _n(t & p).alias("tp"), _n(~t & p).alias("fp"), _n(t & ~p).alias("fn"), _n(~t & ~p).alias("tn")
    )


def confusion_matrix(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows per key (true label) and one column per predicted label; absent cells are 0."""
    rows = F.array(
        F.struct(F.lit(0).alias("y_true"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
        F.struct(F.lit(1).alias("y_true"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")),
    )
    return _cells(scores, keys).select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def _per_score(scores: DataFrame, keys: list[str], score_digits: int | None) -> DataFrame:
    """Cell counts at every distinct score; all that the metrics need of the score table."""
    score = F.col("y_score") if score_digits is None else F.round("y_score", score_digits)
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return scores.groupBy(*keys, score.alias("score")).agg(
        _n(t).alias("pos"), _n(~t).alias("neg"), _n(t & p).alias("tp"), _n(~t & p).alias("fp")
    )


def running_counts(scores: DataFrame, keys: list[str], score_digits: int | None = 4) -> DataFrame:
    """Per distinct score: its counts, and positives and negatives of all lower scores.

    Scores rounded to ``score_digits`` decimals have at most ``10**digits + 1`` values per key, so a
    plain window is bounded. With ``score_digits=None`` scores are dealt by ranges; each range needs only what the
    ranges before it add up to, so no task sees more than a range, however many scores differ.
    """
    at = _per_score(scores, keys, score_digits)
    sums = {"pos_below": "pos", "neg_below": "neg"}
    if score_digits is None:
        return sums_before(at, [*keys, "score"], keys, sums)
    lower = W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = (F.coalesce(F.sum(c).over(lower), F.lit(0).cast("long")).alias(into) for into, c in sums.items())
    return at.select(*keys, "score", "pos", "neg", "tp", "fp", *below)


def _auc() -> Column:
    """Pair counting over ``running_counts`` rows of one key; null when a class is absent."""
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.round(F.when(pairs > 0, won / pairs), 4)


def auc_exact(scores: DataFrame, keys: list[str], score_digits: int | None = 4) -> DataFrame:
    """Area under the ROC curve, ties half."""
    return running_counts(scores, keys, score_digits).groupBy(*keys).agg(_auc().alias("auc_roc"))


def binary_metrics(scores: DataFrame, keys: list[str], score_digits: int | None = 4) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC at four decimals, one row per key.

    All five come from the per-score counts, so the score table is aggregated once.
    """
    cells = (
        running_counts(scores, keys, score_digits)
        .groupBy(*keys)
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("fp").alias("fp"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            _auc().alias("auc_roc"),
        )
    )
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("pos"))
    right = F.col("tp") + F.col("neg") - F.col("fp")
    return cells.select(
        *keys,
        F.round(right / (F.col("pos") + F.col("neg")), 4).alias("accuracy"),
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(_f1(p, r), 4).alias("f1"),
        "auc_roc",
    )


def classification_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per class, accuracy, macro and weighted rows, all from the four cell counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    per_class = []
    for hit, false_hit, miss in ((tn, fn, fp), (tp, fp, fn)):
        p, r = _ratio(hit, hit + false_hit), _ratio(hit, hit + miss)
        per_class.append((p, r, _f1(p, r), hit + miss))
    (p0, r0, f0, s0), (p1, r1, f1, s1) = per_class

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            F.round(p, 4).alias("precision"),
            F.round(r, 4).alias("recall"),
            F.round(f, 4).alias("f1"),
            s.alias("support"),
        )

    accuracy = (tp + tn) / total
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        row(
            "weighted avg",
            (p0 * s0 + p1 * s1) / total,
            (r0 * s0 + r1 * s1) / total,
            (f0 * s0 + f1 * s1) / total,
            total,
        ),
    )
    return _cells(scores, keys).select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def roc_points(scores: DataFrame, keys: list[str], score_digits: int | None = 4) -> DataFrame:
    """False and true positive rate at every distinct score, from the start point (0, 0)."""
    counts = running_counts(scores, keys, score_digits)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    points = counts.join(F.broadcast(totals), keys).select(
        *keys,
        F.col("score").alias("threshold"),
        F.round(_ratio(F.col("all_neg") - F.col("neg_below"), F.col("all_neg")), 4).alias("fpr"),
        F.round(_ratio(F.col("all_pos") - F.col("pos_below"), F.col("all_pos")), 4).alias("tpr"),
    )
    start = totals.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def evaluation_table(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metric rows plus a baseline row whose other metrics stay null."""
    row = baseline.select(F.lit("majority_baseline").alias("model"), "accuracy")
    return metrics.select("model", *METRICS).unionByName(row, allowMissingColumns=True)
