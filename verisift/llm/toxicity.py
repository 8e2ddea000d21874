"""Toxicity scores from class-conditional Kneser-Ney models.

A word counts in a class by its distinct left neighbours there (its continuations), but no more than by the texts that
have it: copies and repeated passages add no neighbours, bursts no texts. Each class discounts its counts and gives the discounted mass to a backoff that both classes share,
the pooled continuation counts::

    p_c(w) = max(n_c(w) - D_c, 0) / N_c + lambda_c * (n_0(w) + n_1(w)) / (N_0 + N_1)

``D_c`` is ``DISCOUNT`` in the smaller class and grows with the class, so an expression that is rare in both has only
its shared backoff, and the same likelihood in both but for the constant ``lambda_1 / lambda_0``, which is left out. The
model is therefore only the words above the discount. Over a text's distinct words, the differences for and against
label 1 are summed and normalised by length in two ways; a logistic curve over these sums, fitted on rows that no count
has seen, gives the probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .shingles import WordHashes, scramble

#: Count that a word of the smaller class needs before the class has a say on it.
DISCOUNT = 6.0
#: Labelled rows of either class that the models are fitted on, at most; chosen by a hash of the id.
MAX_FIT_ROWS = {0: 24_000, 1: 12_000}
#: One in so many fitted rows is kept from the counts and calibrates.
CALIBRATION = 4
#: Share of label 1 that the calibration assumes.
PRIOR = 0.3
#: ASCII other than letters, digits and underscore is white space; A to Z become lower case.
_FOLD = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() or chr(b) == "_" else 32 for b in range(128)) + bytes(
    range(128, 256)
)


def _words(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.hash_words((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def fit_rows(labels: DataFrame, id_col: str, label_col: str, held_out: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, label, calibrates) of at most ``MAX_FIT_ROWS`` rows a class that are not held out.

    Repeated label rows count once, the higher label wins. The size of the result is bounded, so it may be broadcast.
    """
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("label"))
        .filter(~held_out(F.col("doc_id")))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("label") == 1, F.lit(min(1.0, 0.99 * MAX_FIT_ROWS[1] / max(1, counts.get(1, 0))))).otherwise(
        F.lit(min(1.0, 0.99 * MAX_FIT_ROWS[0] / max(1, counts.get(0, 0))))
    )
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATION)) == 0
    return known.filter(place < share).withColumn("calibrates", calibrates).limit(sum(MAX_FIT_ROWS.values()))


def continuation_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1): of each hashed word of ``rows(text, label)`` and class, the lesser of left neighbours and texts."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            labels = batch.column("label").to_pylist()
            texts = [_words(t.as_py(), hashes) for t in batch.column("text")]
            for label in (0, 1):
                own = [w for w, y in zip(texts, labels, strict=True) if y == label and len(w)]
                if not own:
                    continue
                words = np.concatenate(own)
                pair = np.concatenate([scramble(np.concatenate([np.zeros(1, np.uint64), w[:-1]])) + w for w in own])
                pair, first = np.unique(pair, return_index=True)
                word, texts_with = np.unique(np.concatenate([np.unique(w) for w in own]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([words[first], word]).view(np.int64)),
                        pa.array(np.concatenate([pair, word]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(len(pair), np.int32), texts_with.astype(np.int32)])),
                        pa.array(np.full(len(pair) + len(word), label, dtype=np.int32)),
                    ],
                    names=["word", "pair", "texts", "label"],
                )

    found = rows.select("text", "label").mapInArrow(pairs, "word long, pair long, texts int, label int")
    is_pair = F.col("texts") == 0
    types = found.groupBy("word", "pair", "label", is_pair.alias("is_pair")).agg(F.sum("texts").alias("texts"))
    count = [
        F.least(
            F.sum((F.col("is_pair") & (F.col("label") == c)).cast("long")),
            F.sum(F.when(F.col("label") == c, F.col("texts")).otherwise(0)),
        ).alias(f"n{c}")
        for c in (0, 1)
    ]
    return types.groupBy("word").agg(*count)


def log_ratios(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-likelihood differences of the words above a class's discount, sorted by hash.

    At most ``N_0 / D_0 + N_1 / D_1`` words, each one with many neighbours, come to the driver.
    """
    counts = written(counts, "words")
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return np.empty(0, dtype=np.uint64), np.empty(0)
    n = np.array([total["n0"], total["n1"]], dtype=float)
    d = DISCOUNT * n / n.min()
    mass = counts.agg(F.sum(F.least("n0", F.lit(d[0]))).alias("m0"), F.sum(F.least("n1", F.lit(d[1]))).alias("m1")).first()
    shared = np.array([mass["m0"], mass["m1"]]) / n
    heavy = counts.filter((F.col("n0") > d[0]) | (F.col("n1") > d[1])).toPandas()
    pooled = (heavy["n0"] + heavy["n1"]).to_numpy() / n.sum()
    own = [np.maximum(heavy[f"n{c}"].to_numpy() - d[c], 0) / n[c] / shared[c] for c in (0, 1)]
    ratio = np.log((own[1] + pooled) / (own[0] + pooled))
    words = heavy["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], ratio[order]


FEATURES = ("for_root", "against_root", "for_mean", "against_mean", "log_length")


def differences(texts: pa.Array, words: np.ndarray, ratio: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """Per text: differences for and against label 1, by the root of the number of words and by it, and its logarithm."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        own = np.unique(_words(text.as_py(), hashes))
        if len(own):
            at = np.minimum(np.searchsorted(words, own), max(0, len(words) - 1))
            found = ratio[at[words[at] == own]] if len(words) else np.zeros(0)
            sides = np.array([found[found > 0].sum(), found[found < 0].sum()])
            out[i] = [*(sides / np.sqrt(len(own))), *(sides / len(own)), np.log(len(own) + 1)]
    return out


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve over the columns, cut at their outer hundredths: low, high, mean, scale, slope; the intercept."""
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    x = np.clip(x, low, high)
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([(x - middle) / spread, np.ones((len(x), 1))], axis=1)
    weight = np.where(y == 1, PRIOR / max(y.mean(), 1e-9), (1 - PRIOR) / max(1 - y.mean(), 1e-9))
    b = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([low, high, middle, spread, b])


def probability(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    low, high, middle, spread, slope = curve[:-1].reshape(5, -1)
    z = (np.clip(x, low, high) - middle) / spread @ slope + curve[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    into: str = "toxicity",
) -> DataFrame:
    """``docs`` with a column ``into``: the probability, from 0 to 1, that the label is 1.

    Labels are learned from rows for which ``held_out(id)`` is false; the score itself reads nothing but the text.
    Null and empty texts get the score that the curve gives to no evidence at no length. Without labels of both classes
    every score is 0. Words are runs of letters, digits and underscore; repeated rows get equal scores. Other columns
    stay; one called ``into`` is replaced.
    """
    spark = docs.sparkSession
    chosen = fit_rows(labels, id_col, label_col, held_out)
    # The broadcast side has MAX_FIT_ROWS rows of an id, an int and a boolean at most.
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    words, ratio = log_ratios(continuation_counts(sample.filter(~F.col("calibrates"))))
    model = spark.sparkContext.broadcast((words, ratio))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            x = differences(batch.column("text"), *model.value, hashes)
            columns = [pa.array(x[:, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], names=[*FEATURES, "label"])

    seen = sample.filter("calibrates").select("text", "label")
    seen = seen.mapInArrow(features, ", ".join(f"{f} double" for f in FEATURES) + ", label int").toPandas()
    y = seen["label"].to_numpy(dtype=float)
    curve = calibrate(seen[list(FEATURES)].to_numpy(), y) if 0 < y.sum() < len(y) and len(words) else None

    kept = [c for c in docs.columns if c != into]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, text_col):
            if curve is None:
                p = np.zeros(batch.num_rows)
            else:
                p = probability(differences(batch.column(text_col), *model.value, hashes), curve)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*kept, into])

    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())])
    return rows.mapInArrow(score, schema)
