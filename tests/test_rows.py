"""Round trips, invariants and brute-force comparisons."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
import time
import tracemalloc
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from verisift.catalog import all_queries
from verisift.functions import style, text
from verisift.operators import corpus, crossref, forest, lemmas, linear, metrics, models, network, passes, prefix, sentiment, similarity
from verisift.operators.vocabulary import ngram_terms, term_stats
from verisift.operators.features import apply_features, feature_values, fit_features
from verisift.plans.train_and_select import train_and_select
from verisift.session import stored
from verisift.sources import artifacts, tables
from verisift.sources.tables import require_columns

QUERIES = {q.name: q for q in all_queries()}
ROOT = Path(__file__).resolve().parent.parent


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_split_sizes_match_the_published_ones(spark):
    counts = spark.createDataFrame([(0, 17900), (1, 20928)], "label int, n long")
    sized = corpus.split_sizes(counts, 0.70, 0.20, 0.10).agg(*[F.sum(c).alias(c) for c in ("n_train", "n_val", "n_test")])
    assert tuple(sized.first()) == (27179, 7765, 3884)


def test_split_equals_full_ranking(spark):
    rows = [(i, int(i % 3 == 0)) for i in range(997)]
    df = spark.createDataFrame(rows, "doc_id long, label int")
    got = corpus.stratified_split(df, 0.7, 0.2, 0.1, seed=7).collect()
    assert len(got) == len({r.doc_id for r in got}) == 997
    keyed = df.withColumn("key", corpus.split_key(F.col("doc_id"), 7)).collect()
    sizes = {r.label: r for r in corpus.split_sizes(df.groupBy("label").agg(F.count("*").alias("n")), 0.7, 0.2, 0.1).collect()}
    for label in (0, 1):
        ordered = [r.doc_id for r in sorted((r for r in keyed if r.label == label), key=lambda r: r.key)]
        s = sizes[label]
        by_split = {n: {r.doc_id for r in got if r.label == label and r.split == n} for n in corpus.SPLITS}
        assert by_split["train"] == set(ordered[: s.n_train])
        assert by_split["validation"] == set(ordered[s.n_train : s.n_train + s.n_val])


def test_split_shares_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        corpus.stratified_split(spark.createDataFrame([(1, 0)], "doc_id long, label int"), 0.5, 0.2, 0.2)


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["label"])


def test_metrics_edges(spark):
    rows = [("perfect", i % 2, i % 2, float(i % 2)) for i in range(10)]
    rows += [("one_class", i % 2, 1, 0.7) for i in range(10)]
    rows += [("no_positive", 0, 0, 0.1 * i) for i in range(5)]
    scores = spark.createDataFrame(rows, "model string, y_true int, y_pred int, y_score double")
    for digits in (4, None):
        got = {r.model: r for r in metrics.binary_metrics(scores, ["model"], digits).collect()}
        assert tuple(got["perfect"])[1:] == (1.0, 1.0, 1.0, 1.0, 1.0)
        assert tuple(got["one_class"])[1:] == (0.5, 0.5, 1.0, 0.6667, 0.5)
        assert tuple(got["no_positive"])[1:] == (1.0, 0.0, 0.0, 0.0, None)


def _vectors(spark, n, seed, copies):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        terms = np.sort(rng.choice(60, size=rng.integers(0, 12), replace=False))
        weights = rng.random(len(terms)) + 0.1
        rows.append((i, terms, weights))
    for j in range(copies):
        _, terms, weights = rows[j % 5]
        if j % 2 and len(weights):
            weights = weights * np.where(np.arange(len(weights)) == 0, 1.02, 1.0)
        rows.append((n + j, terms, weights))
    out = []
    for i, terms, weights in rows:
        norm = math.sqrt(float((weights**2).sum())) or 1.0
        out.append((i, [int(t) for t in terms], [float(w / norm) for w in weights]))
    return out


def _brute(test, train):
    best = {}
    for i, terms, weights in test:
        left = dict(zip(terms, weights))
        scored = [(-round(sum(left.get(t, 0.0) * w for t, w in zip(ts, ws)), 9), j) for j, ts, ws in train]
        top = min(scored)
        best[i] = (top[1], round(-top[0], 6))
    return best


@pytest.mark.parametrize("tile", [3, 512])
def test_similarity_equals_brute_force(spark, tile):
    test, train = _vectors(spark, 40, 1, 30), _vectors(spark, 60, 1, 30)
    schema = "id long, terms array<int>, weights array<double>"
    left, right = spark.createDataFrame(test, schema), spark.createDataFrame(train, schema)
    brute = _brute(test, train)
    got = {r.test_id: (r.train_id, round(r.similarity, 6)) for r in similarity.nearest_train_match(left, right, tile=tile).collect()}
    assert got == brute
    close = {r.test_id: (r.train_id, round(r.similarity, 6)) for r in similarity.similar_train_matches(left, right, 0.95, tile).collect()}
    assert close == {i: b for i, b in brute.items() if b[1] > 0.95}


def test_prefix_tiles_are_exact(spark):
    """The prefix path itself, which small tables would not choose."""
    test, train = _vectors(spark, 40, 3, 30), _vectors(spark, 60, 3, 30)
    schema = "id long, terms array<int>, weights array<double>"
    left, right = spark.createDataFrame(test, schema), spark.createDataFrame(train, schema)
    brute = _brute(test, train)
    for threshold in (0.95, 0.5):
        found = similarity._best_per_row(similarity._prefix_tiles(left, right, threshold, tile=8)).collect()
        got = {r.test_id: (r.train_id, round(r.similarity, 6)) for r in found}
        assert got == {i: b for i, b in brute.items() if b[1] > threshold}


@pytest.mark.parametrize("long_list", [1, 256])
def test_scans_of_train_rows_return_a_row_per_task_and_test_row(spark, monkeypatch, long_list):
    """Rows that share a common term with all rows meet in no tile of their own."""
    monkeypatch.setattr(similarity, "LONG_LIST", long_list, raising=False)
    rnd = np.random.default_rng(11)

    def rows(n):
        out = []
        for i in range(n):
            weights = np.append(rnd.random(2), 3.0)
            terms = [*sorted(rnd.choice(20, 2, replace=False).tolist()), 20]
            out.append((i, terms, (weights / np.linalg.norm(weights)).tolist()))
        return out

    schema = "id long, terms array<int>, weights array<double>"
    test, train = rows(12), rows(200)
    left, right = spark.createDataFrame(test, schema), spark.createDataFrame(train, schema).repartition(2)
    found = similarity._prefix_tiles(left, right, 0.95, 8).collect()
    assert max(Counter(r.test_id for r in found).values()) <= 2
    want = {i: b for i, b in _brute(test, train).items() if b[1] > 0.95}
    got = {r.test_id: (r.train_id, round(r.similarity, 6)) for r in similarity.similar_train_matches(left, right, 0.95, 8).collect()}
    assert len(want) == 12 and got == want


def _toy(spark):
    rows = []
    for i in range(240):
        label = i % 2
        word = "senate budget report said" if label else "shocking secret exposed watch"
        rows.append((i, label, ("train", "train", "validation", "test")[(i // 2) % 4], f"{word} common w{i % 5}", label * 0.5, 0.1, 0.6, 0.1, 0))
    return spark.createDataFrame(
        rows,
        "doc_id long, label int, split string, text_ml string, sub_variance double, mean_subjectivity double, "
        "lexical_density double, caps_ratio double, has_dateline int",
    )


@pytest.mark.parametrize("name", models.CANDIDATES)
def test_candidates_separate_a_toy_corpus(spark, name):
    trained = models.fit_candidates(_toy(spark), (name,))
    got = {r.split: r for r in trained.metrics.collect()}
    assert got["validation"].f1 >= 0.99 and got["test"].auc_roc >= 0.99


@pytest.mark.parametrize(
    ("name", "params"), [("logistic_regression", {}), ("svm", {}), ("random_forest", {"trees": 3, "depth": 2})]
)
def test_candidates_score_in_a_session_that_observed(spark, name, params):
    seen = Observation()
    assert spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).count() == 10 and seen.get == {"n": 10}
    toy = _toy(spark)
    fitted, names = fit_features(toy)
    rows = apply_features(fitted, toy, ["doc_id", "label"])
    model = models.fit_candidate(name, rows, len(names), **params)
    scored = models.score_with(name, model, rows, ["doc_id", "label"]).collect()
    assert len(scored) == 240 and sum(r.y_pred == r.label for r in scored) >= 238


def _mixed_rows(spark, n=400):
    rnd, rows = np.random.default_rng(1), []
    for i in range(n):
        x = {int(j): round(float(rnd.random()), 3) + 0.1 for j in rnd.choice(12, 4, replace=False)}
        x[12] = float(rnd.normal())
        rows.append((i, int(x.get(0, 0) + x.get(1, 0) * x.get(2, 0) + x[12] / 2 + rnd.normal() * 0.3 > 0.4), Vectors.sparse(14, x)))
    kinds = {"doc_id": LongType(), "label": IntegerType(), "features": VectorUDT()}
    return spark.createDataFrame(rows, StructType([StructField(*kind) for kind in kinds.items()]))


def _chances(model, rows):
    return np.array([r.probability[1] for r in model.transform(rows).orderBy("doc_id").collect()])


def test_a_tree_of_all_features_equals_the_one_of_spark(spark):
    rows = _mixed_rows(spark)
    for depth in (3, 7):
        own = forest.fit_forest(passes.sparse_rows(rows), 14, 1, depth, taken=14, bootstrap=False)
        other = DecisionTreeClassifier(maxDepth=depth, maxBins=forest.BINS).fit(rows)
        assert len(own.trees.feature) == other.numNodes
        assert _chances(own, rows) == pytest.approx(_chances(other, rows), abs=1e-12)


def test_a_forest_does_not_depend_on_partitions(spark):
    rows = _mixed_rows(spark)
    found = [_chances(models.fit_candidate("random_forest", rows.repartition(n), 14, trees=6, depth=9), rows) for n in (1, 5)]
    assert np.array_equal(*found) and found[0].std() > 0.1


def test_a_cut_forest_is_the_one_grown_to_that_depth(spark):
    rows = models.with_fold(_mixed_rows(spark), 2)
    sparse = passes.sparse_rows(rows)
    splits = forest.find_splits(sparse, 14)
    table = forest.binned(sparse, splits)
    growths = [forest.Growth(4, 1, 0), forest.Growth(4, 3, 1)]
    deep, flat = (forest.grow(table, splits.zero, growths, depth) for depth in (9, 4))
    for at in range(2):
        (one, a), (two, b) = (grown.finished(at, 4) for grown in (deep, flat))
        assert np.array_equal(a, b) and all(np.array_equal(getattr(one, f), getattr(two, f)) for f in ("feature", "cut", "left"))
    assert forest.forest_f1(sparse, 14, growths, (9, 4), (2, 4)).min() > 0.6


def test_solver_steps_over_few_entries_shuffle_nothing(spark, monkeypatch):
    toy = _toy(spark)
    fitted, names = fit_features(toy)
    rows = stored(apply_features(fitted, toy, ["doc_id", "label"]).repartition(8), "solver")
    assert rows.rdd.getNumPartitions() == 8
    spark.sparkContext.setJobGroup("solver", "a logistic fit")
    try:
        models.fit_candidate("logistic_regression", rows, len(names))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup("solver")]
    # The count of rows and entries shuffles a row per task; steps do not.
    assert sum(n > 1 for n in stages) <= 2 < sum(n == 1 for n in stages)
    monkeypatch.setattr(models, "SOLVER_ENTRIES", 300)
    several, n_rows = models.solver_rows(rows)
    assert n_rows == 240 and 1 < several.rdd.getNumPartitions() <= 8


def test_features_are_normed_and_scaled(spark):
    toy = _toy(spark)
    fitted, names = fit_features(toy.filter("split = 'train'"))
    row = apply_features(fitted, toy, ["doc_id"]).orderBy("doc_id").first()
    vector = row.features.toArray()
    assert len(vector) == len(names) and abs(np.linalg.norm(vector[:-5]) - 1.0) < 1e-9
    assert vector[-5] == pytest.approx(-1.0)


def test_feature_values_of_sparse_dense_and_empty_vectors(spark):
    kinds = [
        (1, Vectors.sparse(3, {0: 1.5, 2: -2.0})),
        (2, Vectors.dense([0.0, 4.0, 5.0])),
        (3, Vectors.sparse(3, {})),
        (1, Vectors.sparse(3, {0: 1.5, 2: -2.0})),
        (None, None),
    ]
    rows = spark.createDataFrame(kinds, StructType([StructField("doc_id", LongType()), StructField("features", VectorUDT())]))
    got = sorted((r.doc_id, r["name"], r.value) for r in feature_values(rows, ["a", "b", "c"], ["doc_id"]).collect())
    once = [(1, "a", 1.5), (1, "c", -2.0)]
    assert got == sorted([*once, *once, (2, "a", 0.0), (2, "b", 4.0), (2, "c", 5.0)])
    assert feature_values(rows.limit(0), ["a", "b", "c"], ["doc_id"]).collect() == []


def test_bundle_of_all_families_round_trip(spark, tmp_path):
    toy = _toy(spark)
    trained, paths = train_and_select(toy, str(tmp_path), models.CANDIDATES)
    assert paths["winner"] in models.CANDIDATES
    saved = {name: paths[name] for name in models.CANDIDATES} | {"gone": str(tmp_path / "gone")}
    got, failed = models.evaluate_families(spark, paths["features"], saved, toy, measure=metrics.binary_metrics)
    before = trained.metrics.filter("split = 'test'").drop("split")
    assert failed == ["gone"] and rows_of(got) == rows_of(before) and all(r.f1 >= 0.99 for r in got.collect())
    scored = models.score_table(
        paths["winner"],
        artifacts.load_model(spark, paths[paths["winner"]]),
        artifacts.load_model(spark, paths["features"]),
        toy,
    )
    assert scored.filter("(ml_score >= 0.5) <> (ml_label = 'REAL')").count() == 0
    assert artifacts.load_model(spark, str(tmp_path / "gone")) is None


def test_stream_equals_batch(spark, sf_dir):
    batch = QUERIES["score_articles"].build(spark, sf_dir)
    stream = QUERIES["stream_score_articles"].build(spark, sf_dir)
    assert rows_of(batch) == rows_of(stream)


def test_stream_in_batches_with_a_restart_equals_batch(spark, sf_dir, tmp_path):
    from verisift.catalog.verdict_queries import _SCORER, _VERDICT_COLUMNS, arriving_articles
    from verisift.plans.score_articles import fixed_scorer
    from verisift.sources.demo import demo_lexicon
    from verisift.streaming.score_stream import ARRIVING, read_article_stream, start_scoring

    rows = arriving_articles(spark, sf_dir).select(*(f.name for f in ARRIVING.fields))
    lexicon, scorer = demo_lexicon(spark), fixed_scorer(*_SCORER)

    def run() -> None:
        stream = read_article_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        start_scoring(stream, lexicon, scorer, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()

    for part in (0, 1):
        half = rows.filter(F.pmod(F.xxhash64("article_id"), F.lit(2)) == part)
        half.repartition(2, "article_id").write.mode("append").parquet(str(tmp_path / "in"))
        run()
    # The last batch again, as after a failure between its output and its commit.
    last = max((tmp_path / "offsets" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert int(last.name) == 3
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink()
    run()
    out = spark.read.parquet(str(tmp_path / "out")).select(*_VERDICT_COLUMNS)
    assert rows_of(out) == rows_of(QUERIES["score_articles"].build(spark, sf_dir).select(*_VERDICT_COLUMNS))


def test_folds_are_even_within_labels(spark):
    rows = spark.range(200).selectExpr("id AS doc_id", "cast(id % 7 = 0 AS int) AS label")
    sizes = models.with_fold(rows, 3).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_two_csv_sources_have_unique_ids(spark, tmp_path):
    for name, texts in (("fake", ["a, b", "c"]), ("true", ["d", 'e "f"\ng'])):
        spark.createDataFrame([(t, t) for t in texts], "title string, text string").write.option("header", True).option(
            "escape", '"'
        ).csv(str(tmp_path / name))
    both = tables.read_labelled_sources(*(tables.read_articles_csv(spark, str(tmp_path / n)) for n in ("fake", "true")))
    rows = both.collect()
    assert len({r.doc_id for r in rows}) == 4 and sorted(r.label for r in rows) == [0, 0, 1, 1]


@pytest.mark.parametrize("name", ["tune_candidates", "select_and_bundle", "evaluate_saved_families", "score_table", "ablate_features"])
def test_model_queries_ask_for_all_families(spark, monkeypatch, name):
    asked = []

    class Asked(Exception):
        pass

    def fit(corpus, names=models.CANDIDATES, *rest, **more):
        asked.extend(names)
        if name != "ablate_features":
            raise Asked
        metrics = spark.createDataFrame([("test", n) for n in names], "split string, model string")
        return models.Trained(None, [], {}, metrics)

    for module in ("operators.models", "operators.audit", "plans.train_and_select"):
        monkeypatch.setattr(sys.modules[f"verisift.{module}"], "fit_candidates", fit)
    monkeypatch.setattr(sys.modules["verisift.catalog.model_queries"], "corpus", lambda spark, sf: None)
    if name == "ablate_features":
        rows = QUERIES[name].build(spark, "").collect()
        assert len(rows) == 4 and set(asked) == {"svm", "neural_network"}
    else:
        with pytest.raises(Asked):
            QUERIES[name].build(spark, "")
        assert tuple(asked) == models.CANDIDATES


def test_saved_families_get_all_measures(spark):
    from verisift.catalog.model_queries import family_measures

    rows = [(m, i, i % 2, (i + k) % 2 if i < 4 * k else i % 2, (i % 2 + 0.1 * k) / 2) for k, m in enumerate(models.CANDIDATES) for i in range(20)]
    scores = spark.createDataFrame(rows, "model string, doc_id long, y_true int, y_pred int, y_score double")
    got = family_measures(scores, ["model"]).collect()
    for model in models.CANDIDATES:
        own = [r.part for r in got if r.model == model]
        assert own.count("metrics") == 1 and own.count("confusion") == 2 and own.count("report") > 2 and own.count("roc") == 3
    assert [r.model for r in got if r.selected] == ["logistic_regression"]


def test_search_fits_full_grids_and_separates(spark):
    trained = models.fit_candidates(_toy(spark), models.CANDIDATES, tune=True)
    assert all(score >= 0.99 for _, score in trained.tuning.values())
    sizes = [len(models.grid_of(name)) for name in models.CANDIDATES]
    assert sizes == [6, 3, 8, 4]


def _toy_rows(spark):
    toy = _toy(spark)
    fitted, names = fit_features(toy)
    folded = models.with_fold(apply_features(fitted, toy, ["doc_id", "label"]), 3)
    return folded, passes.sparse_rows(folded), len(names)


def test_problems_fitted_together_equal_single_fits(spark):
    folded, rows, n = _toy_rows(spark)
    problems = [linear.Problem("log", c, fold) for c in (0.5, 2.0) for fold in (-1, 1)]
    weights, turns = linear.fit_together(rows, problems, n, 1e-9)
    assert turns < linear.PASSES
    for problem, found in zip(problems, weights, strict=True):
        part = folded.filter(f"fold <> {problem.fold}")
        fit = models.logistic_regression(part.count(), problem.c)[0].setTol(1e-9).fit(part)
        assert found[:-1] == pytest.approx(fit.coefficients.toArray(), abs=5e-3)
        assert found[-1] == pytest.approx(fit.intercept, abs=5e-3)


def test_network_steps_need_no_whole_copies():
    """A step of the solver works in place, with the same sums as Adam on whole arrays."""
    rnd = np.random.default_rng(4)
    n, n_features, hidden = 130, 30_000, (16,)
    batch = SimpleNamespace(
        n=n,
        row=np.repeat(np.arange(n), 5),
        index=np.concatenate([rnd.choice(n_features, 5, replace=False) for _ in range(n)]),
        value=rnd.random(5 * n),
        label=rnd.integers(0, 2, n).astype(float),
        fold=np.full(n, -1),
        key=np.full(n, 500),
    )
    shapes = network.shapes_of(n_features, hidden)
    weights = network.start_of(shapes, 3)
    state = np.concatenate([weights, np.zeros(2 * len(weights))])
    tracemalloc.start()
    got = network._epoch(iter([batch]), state, 0, -1, 0.1, 7, shapes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Weights, moments and gradient, and the sums that leave the task.
    assert peak < 8.5 * weights.nbytes

    order = np.random.default_rng([7, 0]).permutation(np.arange(n))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step, at in enumerate(range(0, n, network.BATCH), 1):
        rows = order[at : at + network.BATCH]
        taken = np.concatenate([np.flatnonzero(batch.row == r) for r in rows])
        place = np.repeat(np.arange(len(rows)), 5)
        layers = network.split(weights, shapes)
        g = network.gradient(place, batch.index[taken], batch.value[taken], batch.label[rows], layers, 0.1, shapes)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        rate = network.RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        weights = weights - rate * first / (np.sqrt(second) + 1e-8)
    assert got[: len(weights)] / n == pytest.approx(weights, abs=1e-9)


def _files(folder):
    return {f for f in Path(folder).rglob("shuffle_*.data")}


def test_shuffles_of_a_pass_are_gone_when_it_ends(spark, monkeypatch):
    """Sums of many tasks are shuffled; the files of one pass are not there in the next."""
    monkeypatch.setattr(passes, "DIRECT", 10)
    _, rows, _ = _toy_rows(spark)
    rows = stored(rows.repartition(4), "passes")
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    before = {f for d in folder for f in _files(d)}
    total = passes.summed(rows, lambda batches: sum(np.array([b.n, b.label.sum(), 1.0] * 10) for b in batches), 30)
    assert total.tolist()[:2] == [240, 120]
    until = time.time() + 10
    while (left := {f for d in folder for f in _files(d)} - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_network_tasks_are_counted_by_entries(spark, monkeypatch):
    _, rows, n = _toy_rows(spark)
    rows = stored(rows.repartition(8), "entries")
    assert network.in_tasks(rows).rdd.getNumPartitions() == 1 < rows.rdd.getNumPartitions()
    assert network.in_tasks(rows.limit(0)).rdd.getNumPartitions() <= 1
    entries = rows.select(F.sum(F.size("indices"))).first()[0]
    monkeypatch.setattr(network, "TASK_ENTRIES", -(-entries // 3))
    assert network.in_tasks(rows).rdd.getNumPartitions() == 3


def test_a_pass_of_one_task_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(passes, "DIRECT", 10)
    _, rows, _ = _toy_rows(spark)
    rows = stored(rows.coalesce(1), "one")
    spark.sparkContext.setJobGroup("one", "a pass")
    try:
        passes.summed(rows, lambda batches: sum(np.full(30, float(b.n)) for b in batches), 30)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    assert all(len(tracker.getJobInfo(job).stageIds) == 1 for job in tracker.getJobIdsForGroup("one"))


def test_the_driver_keeps_no_moments_while_an_epoch_runs(spark, monkeypatch):
    _, rows, n = _toy_rows(spark)
    size, held = sum(r * c + c for r, c in network.shapes_of(n, (8,))), []

    def counted(rows, of, length):
        names = sys._getframe(1).f_locals
        held.append(max(len(v if v.base is None else v.base) for v in names.values() if isinstance(v, np.ndarray) and v.ndim))
        return passes.summed(rows, of, length)

    monkeypatch.setattr(network, "summed", counted)
    best = network.fit_network(stored(rows, "moments"), n, (8,), 1e-4, 2)
    assert len(best) == size and best.base is None and max(held) == size and len(held) == 3


def test_network_gradient_equals_differences():
    shapes = network.shapes_of(5, (4, 3))
    weights = network.start_of(shapes, 1)
    rows, index = np.array([0, 0, 1, 3, 3, 3]), np.array([0, 3, 1, 0, 2, 4])
    value, label = np.array([1.0, 0.5, 2.0, 1.0, 1.0, 0.3]), np.array([1.0, 0.0, 0.0, 1.0])

    def loss(flat):
        layers = network.split(flat, shapes)
        p = network.forward(rows, index, value, 4, layers)[-1][:, 0]
        bound = sum((w**2).sum() for w, _ in layers)
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean() + 0.1 / 2 / 4 * bound

    got = network.gradient(rows, index, value, label, network.split(weights, shapes), 0.1, shapes)
    want = [(loss(weights + 1e-6 * e) - loss(weights - 1e-6 * e)) / 2e-6 for e in np.eye(len(weights))]
    assert got == pytest.approx(np.array(want), abs=1e-7)


def test_running_counts_of_many_scores(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "a").alias("model"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("y_true"),
        F.lit(1).alias("y_pred"),
        F.round(F.pmod(F.xxhash64(F.col("id") + 7), F.lit(10**6)) / 1e6, 6).alias("y_score"),
    )
    by_ranges, by_window = (metrics.running_counts(rows, ["model"], digits) for digits in (None, 6))
    assert rows_of(by_ranges) == rows_of(by_window.select(*by_ranges.columns))


def test_positions_spread_a_hot_group(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    placed = prefix.positions(rows, ["g", F.desc("id")], ["g"], "place").collect()
    hot = sorted((r.place, -r.id) for r in placed if r.g == "hot")
    assert len(placed) == 5_000 and [p for p, _ in hot] == list(range(len(hot))) and hot == sorted(hot, key=lambda x: x[1])
    assert all(r.place == 0 for r in placed if r.g != "hot")


def test_sentiment_does_not_depend_on_partitions(spark):
    from verisift.operators import sentiment
    from verisift.sources.demo import demo_lexicon

    words = "good bad the and of that with was for la le secret massive".split()
    docs = [(i, ". ".join(" ".join(words[(i * k + j) % 13] for j in range(k % 9)) for k in range(60))) for i in range(40)]
    results = []
    for parts in (1, 8, 50):
        table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        lexicon = demo_lexicon(spark).repartition(parts)
        results.append(rows_of(sentiment.style_and_tone(table, "doc_id", "text", lexicon)))
    assert results[0] == results[1] == results[2]


def _nearest(test, train):
    out = {}
    for i, a in test:
        out[i] = max((round(float(a @ b), 9), -j) for j, b in train)
    return {i: (-j, s) for i, (s, j) in out.items()}


def _random_sparse(rnd, n, terms=60):
    rows = []
    for i in range(n):
        chosen = sorted(rnd.choice(terms, size=rnd.integers(0, 9), replace=False).tolist())
        w = rnd.random(len(chosen)) + 0.05
        rows.append((i, chosen, (w / np.linalg.norm(w)).tolist() if chosen else []))
    return rows


@pytest.mark.parametrize("tile", [512, 7])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, tile):
    rnd = np.random.default_rng(tile)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", tile)
    sides = [_random_sparse(rnd, 60), _random_sparse(rnd, 90)]
    sides[1] += [(1000 + i, *r[1:]) for i, r in enumerate(sides[1][:5])]
    frames = [spark.createDataFrame(s, "id long, terms array<int>, weights array<double>") for s in sides]

    def dense(rows):
        return [(i, np.bincount(t, w, 60) if t else np.zeros(60)) for i, t, w in rows]

    want = _nearest(*map(dense, sides))
    got = {r.test_id: (r.train_id, r.similarity) for r in similarity.nearest_train_match(*frames, tile=tile).collect()}
    assert got == {i: (j, pytest.approx(s, abs=2e-9)) for i, (j, s) in want.items()}
    top = [r.test_id for r in similarity.top_matches(*frames, k=8, tile=tile).collect()]
    assert top == [i for _, i in sorted((-s, i) for i, (_, s) in want.items())[:8]]
    everything = similarity.top_matches(*frames, k=500, tile=tile)
    assert everything.count() == 60


def test_visits_leave_in_small_batches(spark, monkeypatch):
    """Rows that must visit every part leave a batch per few rows, not one of all rows times all parts."""
    rnd = np.random.default_rng(6)
    vectors = [(v / np.linalg.norm(v)).tolist() for v in rnd.normal(size=(200, 4))]
    schema = "id long, embedding array<double>, part long, known double"
    rows = spark.createDataFrame([(i, v, 0, None) for i, v in enumerate(vectors)], schema).coalesce(1)
    balls = spark.createDataFrame([(p, v, 2.0) for p, v in enumerate(vectors[:5])], "part long, centre array<double>, radius double")
    sizes = []

    def kept(df, run, schema):
        batch = df.coalesce(1).toArrow().combine_chunks().to_batches()[0]
        sizes.extend(out.num_rows for out in run(iter([batch])))
        return df

    monkeypatch.setattr(type(rows), "mapInArrow", kept)
    similarity._visits(rows, balls)
    assert sum(sizes) == 200 * 4 and max(sizes) <= 64 * 4


@pytest.mark.parametrize("tile", [512, 16])
def test_nearest_dense_rows_equal_brute_force(spark, tile):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 8))
    train = [(i, centres[i % 6] + rnd.normal(size=8) * 0.2) for i in range(150)] + [(500, np.zeros(8)), (501, centres[0])]
    train += [(600 + i, centres[1]) for i in range(40)]
    test = [(i, centres[i % 6] + rnd.normal(size=8) * 0.3) for i in range(40)] + [(900, np.zeros(8)), (901, -centres.sum(axis=0))]
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in s], "id long, embedding array<double>") for s in (test, train)]

    def unit(rows):
        return [(i, v / (np.linalg.norm(v) or 1.0)) for i, v in rows]

    want = _nearest(unit(test), unit(train))
    got = {r.test_id: (r.train_id, r.similarity) for r in similarity.nearest_dense_match(*frames, tile=tile).collect()}
    assert {i: s for i, (_, s) in got.items()} == {i: pytest.approx(s, abs=2e-9) for i, (_, s) in want.items()}
    assert similarity.nearest_dense_match(frames[0], frames[1].limit(0)).collect() == []


def test_related_rows_with_a_common_term_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    docs = [(i, " ".join(["common"] * int(i % 3 > 0) + [f"t{int(w)}" for w in rnd.integers(0, 40, 6) ** 2 // 40])) for i in range(300)]
    queries = [(0, "common t1 t7"), (1, "common"), (2, "nothing here"), (3, "common t0 t38 t2 t3"), (4, "t39")]
    frames = [spark.createDataFrame(d, s) for d, s in ((queries, "query_id long, query string"), (docs, "doc_id long, text string"))]
    got = sorted((r.query_id, r.place, r.doc_id, r.relevancy) for r in crossref.related_articles(*frames, len(docs)).collect())
    sets = {i: set(t.split()) for i, t in docs}
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    want = []
    for q, text in queries:
        terms = set(text.split()) & set(df)
        scores = [(-round(sum(np.log(301 / (1 + df[t])) + 1 for t in terms & s), 9), i) for i, s in sets.items() if terms & s]
        want += [(q, place, i, -s) for place, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_the_rest_runs_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "verisift"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'op1_minhash_dedup' not in e.oracle_sql(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["Good news. BAD day! The worst of it", "", None, "no listed word here", "Good. Good! bad?", "the the. Und nicht.  É good", "Good news. BAD day! The worst of it"]


def test_style_and_tone_is_computed_in_the_row(spark, monkeypatch):
    docs = spark.createDataFrame([(i, 10 * i, t) for i, t in enumerate(TEXTS)], "place long, id long, text string")
    listed = [("good", 0.7, 0.61), ("good", None, 0.3), ("bad", -0.71, None), ("the", 0.01, 0.11), ("worst", -0.9, 0.9), (None, 1.0, 1.0)]
    lexicon = spark.createDataFrame(listed, "word string, polarity double, subjectivity double")
    wide = sentiment.with_style_and_tone(docs, "id", "text", lexicon)
    assert "Exchange" not in plan_of(wide) and "Join" not in plan_of(wide)
    narrow = sentiment.style_and_tone(docs, "id", "text", lexicon)
    assert "Join" not in plan_of(narrow)
    in_row = rows_of(wide), rows_of(narrow)
    assert len(in_row[0]) == len(in_row[1]) == len(TEXTS)
    monkeypatch.setattr(sentiment, "IN_ROW", 3)
    by_join = [f(docs, "id", "text", lexicon) for f in (sentiment.with_style_and_tone, sentiment.style_and_tone)]
    assert "Join" in plan_of(by_join[1])
    assert in_row == tuple(map(rows_of, by_join))


def test_lemmas_are_looked_up_in_the_row(spark, monkeypatch):
    texts = ["Women read articles daily", "", None, "nothing changes", "women women articles"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "women")], "doc_id long, raw_text string")
    table = spark.createDataFrame([("women", "woman"), ("articles", "article"), (None, "x")], "token string, lemma string")
    done = lemmas.with_clean_ml(docs, table)
    assert "Exchange" not in plan_of(done) and "Join" not in plan_of(done)
    got = {r.doc_id: r.text_ml for r in done.collect()}
    assert got == {0: "woman read article daily", 1: "", 2: "", 3: "nothing changes", 4: "woman woman article", None: "women"}
    monkeypatch.setattr(lemmas, "IN_ROW", 1)
    assert got == {r.doc_id: r.text_ml for r in lemmas.with_clean_ml(docs, table).collect()}


def test_values_used_several_times_are_computed_once(spark):
    docs = spark.createDataFrame([("A b, ab CD",)], "text string")
    c = F.col("text")
    for column, costly in ((ngram_terms(c), "regexp_extract_all("), (style.lexical_density(c), "split("), (style.caps_word_ratio(c), "split(")):
        plan = docs.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(costly) == 1


def test_term_stats_build_no_row_per_term_before_the_explode(spark):
    docs = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["a", None, None],), (["b c"],)], "terms array<string>")
    stats = term_stats(docs)
    assert "lambda" not in plan_of(stats)
    assert {tuple(r) for r in stats.collect()} == {("a", 3, 2), ("b", 1, 1), ("b c", 1, 1), (None, 2, 1)}


def test_faster_patterns_say_the_same(spark):
    chars = [chr(i) for i in range(1, 0x3100)] + [" a", "a ", " ", "  ", " \t", "\t ", "a b", "a  b", "a\u2003b"]
    words = [a + w + b for w in text.SPLIT_WORDS for a in ("", " ", "x", "\u00e9", "-") for b in ("", " ", "y", "1")]
    rows = spark.createDataFrame([(s,) for s in (*chars, *words, *(f"x{ch}y" for ch in chars))], "s string")
    pairs = [(text.NO_WORD, f"[^{text.WORD}{text.WS}]", "#"), (text.SPACES, f"[{text.WS}]+", " "), (f"[{text.WORD_FAST}]", f"[{text.WORD}]", "#")]
    for whole in text.SPLIT_WORDS:
        new, old = rf"{whole}(?<![{text.WORD}]{whole})(?![{text.WORD}])", rf"(?<![{text.WORD}]){whole}(?![{text.WORD}])"
        pairs.append((new, old, "#"))
    for new, old, by in pairs:
        # The patterns for words follow the lower-casing of the text.
        s = F.lower("s") if by == "#" else F.col("s")
        assert rows.filter(F.regexp_replace(s, new, by) != F.regexp_replace(s, old, by)).count() == 0


def test_keys_that_are_not_empty_are_computed_once(spark, tmp_path):
    texts = [(1, "Same text!", "en", "a"), (2, "?!", "en", "b"), (3, None, "de", "c"), (4, "Größe", "de", "d"), (5, "no label", "de", "e")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES["drop_empty_key"].build(spark, str(tmp_path))
    # The pattern of photo credits stands once in every key.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Photo by") == 1
    assert sorted(map(tuple, found.collect())) == [(4, "same text"), (5, "same text"), (16, "größe"), (17, "größe")]


def test_canonical_keys_collapse_white_space_and_marks_in_one_pass(spark):
    texts = ["a b", " A  -  b ", "a\x85b  c", "..a..b", "a_b1", "ΟΔΟΣ - ΣΑΣ", "\U0001d400x \U0001f600 y", "İ i̇", "-", "", None, "a <b\n> c <d> e"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for normalize in (True, False):
        plain = F.coalesce(F.col("t"), F.lit(""))
        plain = text.nfkc(plain) if normalize else plain
        two = text.collapse_spaces(F.regexp_replace(F.lower(text.clean_light(plain)), text.NO_WORD, " "))
        both = rows.select(text.canonical_key(F.col("t"), normalize).alias("one"), two.alias("two"))
        assert all(r.one == r.two for r in both.collect())
        key = text.canonical_key(F.col("t"), normalize)
        replaced = rows.select(key.alias("k"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
        assert replaced == 7
