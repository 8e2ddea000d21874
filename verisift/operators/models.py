"""The four candidate classifiers, their tuning, scoring, and saved bundles.

A fitted candidate is a ``PipelineModel`` over a ``features`` column. The linear SVM has no
probability of its own: it is fitted on each fold's complement and calibrated on the fold by a
one-dimensional logistic fit, and its probability is the mean over the folds.

A search over settings reads its rows as few times as it can: the linear families fit all folds and settings in the same
passes, the forests of all folds and settings grow together, and the networks of all settings and folds train next to each
other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import new_path, stored
from ..sources.artifacts import load_model, save_model
from .corpus import split_key
from .features import apply_features, fit_features
from .forest import ForestModel, Growth, fit_forest, forest_f1
from .linear import Problem, fit_together, held_out_f1
from .metrics import binary_metrics
from .network import ReluNetworkModel, fit_network, in_tasks, network_f1
from .passes import sparse_rows
from .ranking import rank_candidates

CANDIDATES = ("logistic_regression", "svm", "random_forest", "neural_network")

# Model and search settings.
C = 1.0
LR_ITERATIONS = 1000
TOLERANCE = 1e-4  # relative change of the objective at which a linear fit stops; the usual default for these models
SVM_ITERATIONS = 1000
SVM_FOLDS = 3
TREES, MAX_TREE_DEPTH = 300, 30  # 30 is also the deepest tree of Spark's forest
HIDDEN_LAYERS, EPOCHS, ALPHA = (256, 128), 20, 1e-4
GRID_C, GRID_SOLVER = (0.5, 1.0, 2.0), ("liblinear", "lbfgs")
GRID_TREES, GRID_DEPTH, GRID_LEAF = (200, 300), (MAX_TREE_DEPTH, 20), (1, 2)
GRID_LAYERS, GRID_ALPHA = ((128,), (64, 128)), (1e-4, 1e-3)
CV_FOLDS, PARALLEL_FITS = 3, 4
#: Vector entries that a task of a linear solver works through at each step: some hundredths of a second, 240 MB.
SOLVER_ENTRIES = 20_000_000


def solver_rows(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` in as many partitions as its vectors need for a solver step, and its row count.

    A linear solver takes hundreds of steps, and every step shuffles a gradient per task, a number per feature, which stays
    on disk until the driver collects garbage; a single task shuffles none. So tasks are counted by entries, not by cores.
    """
    entries = F.size(F.unwrap_udt("features")["values"])
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(entries.cast("long")).alias("entries")).first()
    return table.coalesce(max(1, -(-(size["entries"] or 0) // SOLVER_ENTRIES))), size["rows"]


def _regularization(c: float, n_rows: int) -> float:
    """Spark divides the loss by the row count, so strength C becomes ``1 / (C * n)``."""
    return 1.0 / (c * max(n_rows, 1))


def logistic_regression(n_rows: int, c: float = C, solver: str = "lbfgs") -> list:
    """Stages of a logistic regression; with ``liblinear`` the intercept is a weight and regularised like the others."""
    bound = solver == "liblinear"
    fit = LogisticRegression(
        featuresCol="features_and_one" if bound else "features",
        fitIntercept=not bound,
        regParam=_regularization(c, n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=LR_ITERATIONS,
        tol=TOLERANCE,
    )
    if not bound:
        return [fit]
    one = SQLTransformer(statement="SELECT *, 1.0D AS one FROM __THIS__")
    return [one, VectorAssembler(inputCols=["features", "one"], outputCol="features_and_one"), fit]


def linear_svm(n_rows: int, c: float = C) -> LinearSVC:
    return LinearSVC(
        regParam=_regularization(c, n_rows), standardization=False, maxIter=SVM_ITERATIONS, tol=TOLERANCE
    )


def random_forest(
    train: DataFrame,
    n_features: int,
    seed: int = 42,
    trees: int = TREES,
    depth: int = MAX_TREE_DEPTH,
    leaf: int = 1,
    id_col: str = "doc_id",
) -> ForestModel:
    """Bootstrapped trees whose nodes choose from the root of the features."""
    rows = stored(sparse_rows(train, id_col).hint("rebalance"), "sparse")
    return fit_forest(rows, n_features, trees, depth, leaf, seed)


def neural_network(
    train: DataFrame,
    n_features: int,
    seed: int = 42,
    hidden: tuple[int, ...] = HIDDEN_LAYERS,
    alpha: float = ALPHA,
    id_col: str = "doc_id",
) -> ReluNetworkModel:
    """Rectified layers, Adam, L2 strength ``alpha``; ends early by held-out rows."""
    rows = stored(sparse_rows(train, id_col).hint("rebalance"), "sparse").persist()
    try:
        return ReluNetworkModel(fit_network(in_tasks(rows), n_features, hidden, alpha, EPOCHS, seed), n_features, hidden)
    finally:
        rows.unpersist()


def without_summary(model: Model, spark: SparkSession) -> Model:
    """``model`` saved and read back.

    A classifier fresh from its fit keeps a training summary, and with it the session, in every job that scores. A session
    that has observed a query cannot be sent to tasks, so such jobs would fail.
    """
    return type(model).load(save_model(model, new_path(spark, "model")))


def with_fold(df: DataFrame, folds: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Folds whose sizes differ by one row at most within every label: rows in the order of a seeded hash take turns.

    The order is that of hash ranges: rows are counted per label and range, and ranked within their range only.
    """
    key = split_key(F.col(id_col), seed)
    ranged = df.withColumn("_range", F.conv(F.substring(key, 1, 3), 16, 10).cast("int")).withColumn("_key", key)
    before = W.partitionBy("label").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("label", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("label", "_range").orderBy("_key", id_col))
    placed = ranged.withColumn("_within", within).join(counts, ["label", "_range"])
    fold = F.pmod(F.col("_before") + F.col("_within") - 1, F.lit(folds)).cast("int")
    return placed.withColumn("fold", fold).select(*df.columns, "fold")


def _calibration_rows(df: DataFrame, margin: str) -> DataFrame:
    """Two weighted rows per input row, which fits the smoothed targets of sigmoid calibration."""
    n = df.agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count(F.lit(1)).alias("all")).first()
    pos, neg = n["pos"] or 0, (n["all"] or 0) - (n["pos"] or 0)
    target = F.when(F.col("label") == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1.0 - target).alias("w"))
    )
    return df.select(margin, F.explode(both).alias("t")).select(margin, "t.label", "t.w")


def fit_calibrated_svm(
    train: DataFrame, seed: int = 42, c: float = C, id_col: str = "doc_id"
) -> PipelineModel:
    """Mean of the calibrated probabilities of one SVM per fold; strength ``c`` refers to the rows each one sees."""
    folded = stored(with_fold(train, SVM_FOLDS, seed, id_col).hint("rebalance"), "folds").persist()

    def fold_stages(k: int) -> list:
        rows, n_rows = solver_rows(folded.filter(F.col("fold") != k))
        svc = linear_svm(n_rows, c).setRawPredictionCol(f"raw_{k}").setPredictionCol(f"svc_{k}")
        fitted = without_summary(svc.fit(rows), train.sparkSession)
        margin = VectorSlicer(inputCol=f"raw_{k}", outputCol=f"margin_{k}", indices=[1])
        held = margin.transform(fitted.transform(folded.filter(F.col("fold") == k)))
        sigmoid = LogisticRegression(
            featuresCol=f"margin_{k}",
            weightCol="w",
            probabilityCol=f"probability_{k}",
            rawPredictionCol=f"sigmoid_{k}",
            predictionCol=f"pred_{k}",
            standardization=False,
        ).fit(_calibration_rows(held, f"margin_{k}"))
        return [fitted, margin, without_summary(sigmoid, train.sparkSession)]

    # The folds are independent jobs over the same kept table, so they share the cluster.
    try:
        with ThreadPool(SVM_FOLDS) as pool:
            return PipelineModel([stage for stages in pool.map(fold_stages, range(SVM_FOLDS)) for stage in stages])
    finally:
        folded.unpersist()


def p_real(name: str) -> Column:
    """Probability of the positive class in the output of candidate ``name``."""
    if name.startswith("svm"):
        parts = [vector_to_array(F.col(f"probability_{k}"))[1] for k in range(SVM_FOLDS)]
        return sum(parts[1:], parts[0]) / SVM_FOLDS
    return vector_to_array(F.col("probability"))[1]


def fit_candidate(name: str, train: DataFrame, n_features: int, seed: int = 42, id_col: str = "doc_id", **params) -> PipelineModel:
    if name == "svm":
        return fit_calibrated_svm(train, seed, params.get("c", C), id_col)
    if name == "neural_network":
        return PipelineModel([neural_network(train, n_features, seed, id_col=id_col, **params)])
    if name == "logistic_regression":
        rows, n_rows = solver_rows(train)
        *before, fitted = Pipeline(stages=logistic_regression(n_rows, **params)).fit(rows).stages
        return PipelineModel([*before, without_summary(fitted, train.sparkSession)])
    if name == "random_forest":
        return PipelineModel([random_forest(train, n_features, seed, id_col=id_col, **params)])
    raise ValueError(f"unknown candidate {name}")


def score_with(name: str, model: PipelineModel, table: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep..., model, y_pred, y_score)``; the class is decided on the unrounded probability."""
    scored = model.transform(table).withColumn("y_score", p_real(name))
    return scored.select(
        *keep, F.lit(name).alias("model"), (F.col("y_score") > 0.5).cast("int").alias("y_pred"), "y_score"
    )


def score_table(name: str, classifier: PipelineModel, features: PipelineModel, articles: DataFrame) -> DataFrame:
    """Articles with ``ml_score`` (four decimals), ``ml_label`` and the model name; map-only."""
    scored = classifier.transform(apply_features(features, articles)).withColumn("ml_score", F.round(p_real(name), 4))
    return scored.select(
        *articles.columns,
        "ml_score",
        F.when(p_real(name) >= 0.5, "REAL").otherwise("FAKE").alias("ml_label"),
        F.lit(name).alias("ml_model_name"),
    )


@dataclass
class Trained:
    """Fitted feature stages and candidates with their metrics on each evaluated split."""

    features: PipelineModel
    feature_names: list[str]
    models: dict[str, PipelineModel]
    metrics: DataFrame
    tuning: dict[str, tuple[str, float]] = field(default_factory=dict)


def _split(table: DataFrame, split: str) -> DataFrame:
    return table.filter(F.col("split") == split)


def metrics_of(models: dict[str, PipelineModel], table: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Metrics of every model on every named split, from one long score table."""
    scored = None
    rows = table.filter(F.col("split").isin(*splits))
    for name, model in models.items():
        part = score_with(name, model, rows, ["split", F.col("label").alias("y_true")])
        scored = part if scored is None else scored.unionByName(part)
    return binary_metrics(scored, ["split", "model"], score_digits=None)


def fit_candidates(
    corpus: DataFrame,
    names: tuple[str, ...] = CANDIDATES,
    seed: int = 42,
    text_col: str = "text_ml",
    numeric: tuple[str, ...] | None = None,
    tune: bool = False,
) -> Trained:
    """Fit the candidates on the train split of ``(doc_id, label, split, text, numerics...)``.

    The feature table is kept for all fits; lost blocks are rebuilt from the corpus.
    """
    train = _split(corpus, "train")
    kwargs = {} if numeric is None else {"numeric": numeric}
    features, feature_names = fit_features(train, text_col, **kwargs)
    # Every solver step is a job with one task per partition: these are sized by bytes, whatever the corpus had.
    table = apply_features(features, corpus, ["doc_id", "label", "split"]).hint("rebalance")
    table = stored(table, "features").persist()
    try:
        fit_on = _split(table, "train")
        found = search(names, fit_on, len(feature_names), seed) if tune else {}
        tuning = {name: (_described(params), score) for name, (params, score) in found.items()}
        models = {
            name: fit_candidate(name, fit_on, len(feature_names), seed, **found.get(name, ({}, None))[0]) for name in names
        }
        metrics = metrics_of(models, table, ("validation", "test"))
        # One row per model and split.
        metrics = corpus.sparkSession.createDataFrame(metrics.collect(), metrics.schema)
    finally:
        table.unpersist()
    return Trained(features, feature_names, models, metrics, tuning)


def grid_of(name: str) -> list[dict]:
    """The settings that are tried for a family."""
    if name == "logistic_regression":
        return [{"c": c, "solver": solver} for c in GRID_C for solver in GRID_SOLVER]
    if name == "svm":
        return [{"c": c} for c in GRID_C]
    if name == "random_forest":
        return [{"trees": t, "depth": d, "leaf": m} for d in GRID_DEPTH for m in GRID_LEAF for t in GRID_TREES]
    return [{"hidden": hidden, "alpha": alpha} for hidden in GRID_LAYERS for alpha in GRID_ALPHA]


def _described(params: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in params.items())


def linear_scores(names: tuple[str, ...], rows: DataFrame, n_features: int, folds: int) -> dict[str, list[list[float]]]:
    """F1 per setting and fold of the linear families, fitted in the same passes."""
    problems, owners = [], []
    for name in names:
        for at, params in enumerate(grid_of(name)):
            for fold in range(folds):
                loss = "hinge" if name == "svm" else "log"
                problems.append(Problem(loss, params["c"], fold, params.get("solver") == "liblinear"))
                owners.append((name, at))
    weights, _ = fit_together(rows, problems, n_features, TOLERANCE)
    scores: dict[str, list[list[float]]] = {name: [[] for _ in grid_of(name)] for name in names}
    for (name, at), f1 in zip(owners, held_out_f1(rows, problems, weights), strict=True):
        scores[name][at].append(f1)
    return scores


def forest_scores(rows: DataFrame, n_features: int, folds: int, seed: int) -> list[list[float]]:
    """F1 per setting and fold; a forest of fewer trees or less depth is part of a larger one, and all grow together."""
    growths = [Growth(max(GRID_TREES), leaf, fold) for leaf in GRID_LEAF for fold in range(folds)]
    found = forest_f1(rows, n_features, growths, GRID_DEPTH, GRID_TREES, seed)
    return [
        [float(found[m * folds + fold, d, t]) for fold in range(folds)]
        for d in range(len(GRID_DEPTH))
        for m in range(len(GRID_LEAF))
        for t in range(len(GRID_TREES))
    ]


def network_scores(rows: DataFrame, n_features: int, folds: int, seed: int) -> list[list[float]]:
    """F1 per setting and fold; the fits are independent jobs over the same kept rows, so they share the cluster."""
    tasks = [(params, fold) for params in grid_of("neural_network") for fold in range(folds)]
    rows = in_tasks(rows)

    def scored(task: tuple[dict, int]) -> float:
        params, fold = task
        weights = fit_network(rows, n_features, params["hidden"], params["alpha"], EPOCHS, seed, fold)
        return network_f1(rows, [(weights, params["hidden"], fold)], n_features)[0]

    with ThreadPool(PARALLEL_FITS) as pool:
        found = pool.map(scored, tasks)
    return [found[at : at + folds] for at in range(0, len(found), folds)]


def search(
    names: tuple[str, ...], train: DataFrame, n_features: int, seed: int = 42, folds: int = CV_FOLDS
) -> dict[str, tuple[dict, float]]:
    """Per family the settings of the highest mean F1 over the folds (of equal ones the first) and that mean."""
    folded = stored(with_fold(train, folds, seed).hint("rebalance"), "folds").persist()
    rows = stored(sparse_rows(folded), "sparse").persist()
    try:
        linear = tuple(n for n in names if n in ("logistic_regression", "svm"))
        scores = linear_scores(linear, rows, n_features, folds) if linear else {}
        if "random_forest" in names:
            scores["random_forest"] = forest_scores(rows, n_features, folds, seed)
        if "neural_network" in names:
            scores["neural_network"] = network_scores(rows, n_features, folds, seed)
    finally:
        folded.unpersist()
        rows.unpersist()
    best = {}
    for name in names:
        means = [sum(s) / len(s) for s in scores[name]]
        at = max(range(len(means)), key=lambda i: (means[i], -i))
        best[name] = (grid_of(name)[at], round(float(means[at]), 4))
    return best


def tuning_table(spark: SparkSession, trained: Trained) -> DataFrame:
    """``(model, best_params, cv_f1)``; untuned candidates say ``default`` without a score."""
    rows = [(n, *trained.tuning.get(n, ("default", None))) for n in trained.models]
    return spark.createDataFrame(rows, "model string, best_params string, cv_f1 double")


def with_model_order(metrics: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(n) for n in CANDIDATES]), F.col("model"))
    return metrics.withColumn("model_order", order)


def select_and_bundle(trained: Trained, path: str) -> dict[str, str]:
    """Choose by validation metrics only; save feature stages, all candidates and the metric table."""
    validation = with_model_order(trained.metrics.filter(F.col("split") == "validation"))
    winner = rank_candidates(validation, use_accuracy=False).filter("selected").first()["model"]
    paths = {name: save_model(model, f"{path}/models/{name}") for name, model in trained.models.items()}
    save_model(trained.features, f"{path}/features")
    trained.metrics.withColumn("selected", F.col("model") == winner).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/metrics"
    )
    return {"winner": winner, "features": f"{path}/features", **paths}


def evaluate_families(
    spark: SparkSession,
    features_path: str,
    model_paths: dict[str, str],
    corpus: DataFrame,
    split: str = "test",
    measure: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Long score table of all saved models on one split, or ``measure`` of it, and the models that
    could not be loaded."""
    features = load_model(spark, features_path)
    if features is None:
        raise ValueError(f"no feature stages at {features_path}")
    table = apply_features(features, _split(corpus, split), ["doc_id", "label", "split"])
    scored, failed = None, []
    for name, path in model_paths.items():
        try:
            model = load_model(spark, path)
        except (PySparkException, Py4JJavaError, OSError, ValueError):
            model = None
        if model is None:
            failed.append(name)
            continue
        part = score_with(name, model, table, ["doc_id", F.col("label").alias("y_true")])
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("no model could be loaded")
    return (measure(scored, ["model"]) if measure else scored), failed

