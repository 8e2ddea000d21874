"""Quality rules: base statistics of texts, and robust multivariate outliers per language and source.

Statistics of the texts that pass the base rules become a vector. For every (language, source) the minimum covariance
determinant estimate is approached by concentration steps: distances under the present mean and covariance, the share
``CORE`` of the group with the least ones, mean and covariance of these. Each step is two aggregations per group over a
narrow table, so a group of any size is summed up by all tasks. Steps start from two estimates and go on until no
determinant falls any more; of both ends the one of lesser determinant holds. A text is rejected if its Mahalanobis
distance is above ``CUTOFF``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .shingles import WordHashes, scramble

#: Share of a group that the estimate is made from, and the fall of a log-determinant below which steps end.
CORE, FALL = 0.75, 1e-4
#: For five normal statistics: covariance of all over that of the ``CORE`` nearest, which is CORE / P(chi2(7) <= q) with
#: q the CORE quantile of chi2(5); and the distance that one in a thousand exceeds, the root of chi2(5) at 0.999.
CONSISTENCY, CUTOFF = 1.412071, 4.529349
#: Transformed statistics, and the standard deviation that each has at least: below it, differences mean nothing.
FLOORS = {"word_length": 0.03, "symbols": 0.1, "dup_lines": 0.05, "repeats": 0.05, "upper": 0.02}
_SYMBOLS = b"#*$%&|<>"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def text_statistics(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_upper (A to Z)."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    parts = raw.split()
    spaces = len(raw) - sum(map(len, parts))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if len(parts) > 3:
        words = hashes.hash_words(parts)
        windows = scramble(scramble(words[:-2] + np.uint64(1)) + words[1:-1])
        windows = scramble(windows + words[2:])
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        starts = times[which] > 1
        covered = np.zeros(len(parts), dtype=bool)
        for k in range(3):
            covered[k : k + len(starts)] |= starts
        repeated = int(covered.sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(parts), len(text) - spaces, symbols, dup, repeated, lines, upper


def with_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(doc_id, lang, source, the statistics) of whole texts."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
    )
    names = [c.split()[0] for c in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            found = [text_statistics(t.as_py(), hashes) for t in batch.column("text")]
            columns = [pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)]
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["doc_id", "lang", "source", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, {_STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistics, in the order of ``FLOORS``."""
    words, lines = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("n_lines", F.lit(1)).cast("double")
    return [
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.log1p(F.lit(20.0) * F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_upper") / F.greatest("word_chars", F.lit(1))),
    ]


def _estimates(sums: pd.DataFrame, d: int) -> pd.DataFrame:
    """Mean, inverse covariance and log-determinant from the sums of a group's core.

    In units of ``FLOORS``, the variance is at least 1 in every direction.
    """
    out = []
    floor = np.array(list(FLOORS.values()))
    units = np.outer(floor, floor)
    for row in sums.itertuples(index=False):
        n, first, second = row.n, np.array(row.first), np.array(row.second)
        mean, cov = first / n, np.zeros((d, d))
        cov[np.triu_indices(d)] = second / n
        cov = CONSISTENCY * (cov + cov.T - np.diag(cov.diagonal()) - np.outer(mean, mean))
        size, axes = np.linalg.eigh(cov / units)
        size = np.maximum(size, 1.0)
        log_det = float(np.log(size).sum() + 2 * np.log(floor).sum())
        out.append((row.g, row.start, mean.tolist(), ((axes / size) @ axes.T / units).ravel().tolist(), log_det))
    return pd.DataFrame(out, columns=["g", "start", "mean", "inverse", "log_det"])


def _fit(summed: DataFrame) -> DataFrame:
    """(g, start, mean, inverse, log_det) of (g, start, n, first, second): one small row per group and start."""
    d = len(FLOORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _estimates(batch, d)

    return summed.mapInPandas(run, "g long, start int, mean array<double>, inverse array<double>, log_det double")


def _sums(rows: DataFrame) -> DataFrame:
    d = len(FLOORS)
    x = [F.col(f"x{i}") for i in range(d)]
    return rows.groupBy("g", "start").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(c) for c in x)).alias("first"),
        F.array(*(F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d))).alias("second"),
    )


def distance() -> Column:
    """Squared Mahalanobis distance of x0, x1... from the columns ``mean`` and ``inverse``."""
    d = len(FLOORS)
    off = [F.col(f"x{i}") - F.col("mean")[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + F.lit(1.0 if i == j else 2.0) * F.col("inverse")[i * d + j] * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def core_estimates(points: DataFrame) -> DataFrame:
    """(g, mean, inverse, log_det) of ``points(g, x0, x1...)``: the concentration steps from both starts."""
    d = len(FLOORS)
    quartiles = points.groupBy("g").agg(
        *(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(d))
    )
    # Start 0: medians and quartile ranges; start 1: mean and covariance of everything.
    spread = [
        F.greatest(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2), F.lit(f**2))
        for i, f in enumerate(FLOORS.values())
    ]
    robust = quartiles.select(
        "g",
        F.lit(0).alias("start"),
        F.array(*(F.col(f"q{i}")[1] for i in range(d))).alias("mean"),
        F.array(*(1 / spread[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d))).alias("inverse"),
    )
    classical = _fit(_sums(points.withColumn("start", F.lit(1)))).drop("log_det")
    # A start has no core yet, so that the first step's determinant counts as a fall.
    now = robust.unionByName(classical).withColumns({"log_det": F.lit(float("inf")), "falls": F.lit(True)})
    now = written(now, "estimates")
    while now.filter("falls").limit(1).count():
        near = points.join(now.filter("falls").drop("log_det", "falls"), "g").withColumn("distance", distance())
        cut = near.groupBy("g", "start").agg(F.percentile_approx("distance", CORE, 1000).alias("cut"))
        cut = written(cut, "cuts")
        core = near.join(cut, ["g", "start"]).filter("distance <= cut")
        step = _fit(_sums(core)).select("g", "start", F.struct("mean", "inverse", "log_det").alias("next"))
        falls = F.col("falls") & F.coalesce(F.col("next.log_det") < F.col("log_det") - FALL, F.lit(False))
        new = [F.when(falls, F.col(f"next.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "inverse", "log_det")]
        now = written(now.join(step, ["g", "start"], "left").select("g", "start", *new, falls.alias("falls")), "estimates")
    return now.groupBy("g").agg(
        F.min_by(F.struct("mean", "inverse", "log_det"), F.struct("log_det", "start")).alias("best")
    ).select("g", "best.*")


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Null and empty texts have no words and fail the base rules. ``distance`` is null for texts that do; the others are
    kept if it is at most ``CUTOFF``. Null languages and sources are groups of their own; a group of one or of equal
    texts has distance 0. Repeated rows count as often as they stand and agree; other columns are not carried.
    """
    rows = written(with_statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    group = F.xxhash64(F.struct(F.col("lang").isNull(), "lang", F.col("source").isNull(), "source")).alias("g")
    names = [f"x{i}" for i in range(len(FLOORS))]
    points = (f.alias(n) for f, n in zip(features(), names, strict=True))
    measured = rows.select("*", base_failed().alias("base_failed"), group, *points)
    estimates = written(core_estimates(measured.filter("NOT base_failed").select("g", *names)), "estimates")
    far = F.when(~F.col("base_failed"), F.sqrt(distance()))
    return measured.join(estimates, "g", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        far.alias("distance"),
        (~F.col("base_failed") & F.coalesce(far <= CUTOFF, F.lit(False))).alias("kept"),
    )
