"""Hard negatives by exact integer scores, computed as float32 matrix products modulo small primes.

Inner products of integer vectors are wanted exactly, but the fast matrix product is that of float32, exact only below
2^24. In a residue number system it suffices: vectors are reduced modulo a few primes so small that a product of residues
summed over a vector stays below 2^24, each prime's product is reduced again, and the signed score is put together by
Chinese remaindering (balanced mixed radix). As many primes are taken as the Cauchy-Schwarz bound of the scores asks for.

Anchors are dealt into chunks of bounded size; each chunk is broadcast and meets all candidates where they are, in blocks,
so no candidate is shuffled and no pair of rows is: a task gives at most ``k`` rows per anchor window. What a first look
at a part of the candidates finds is a floor for the rest, so that tasks return few rows however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Anchors of a chunk about; scores that a block holds; the share of candidates looked at first is 1 in ``FIRST_LOOK``.
CHUNK, BLOCK_SCORES, FIRST_LOOK = 16_384, 2_000_000, 16
#: Dimensions summed at a time at most: longer vectors are multiplied in pieces, so that primes need not shrink.
DEPTH = 1024
_LEAST, _MOST = -(2**63), 2**63 - 1


def primes_below(limit: int) -> Iterator[int]:
    """Odd primes from ``limit`` down."""
    for n in range(limit - 1 + limit % 2, 2, -2):
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            yield n


def residue_primes(dims: int, bound: int) -> list[int]:
    """Primes whose balanced residues give exact float32 sums over ``dims``, with a product above ``2 * bound``."""
    half = int((2**24 / min(dims, DEPTH)) ** 0.5) - 1
    found, product = [], 1
    for p in primes_below(2 * half + 1):
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    return found


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` between ``-(p - 1) / 2`` and ``(p - 1) / 2``."""
    half = (p - 1) // 2
    return (x + half) % p - half


class ResidueMatrix:
    """Rows of longs, reduced modulo each prime, for products of float32."""

    def __init__(self, rows: np.ndarray, primes: list[int]) -> None:
        self.primes = primes
        # Reduced first: the half that balancing adds could leave the longs.
        self.parts = [_balanced(rows % p, p).astype(np.float32) for p in primes]

    def scores(self, other: "ResidueMatrix") -> np.ndarray:
        """Inner products of the rows with those of ``other`` as longs; one that no long holds wraps around."""
        total = None
        digits: list[np.ndarray] = []
        weight = 1
        for at, p in enumerate(self.primes):
            a, b = self.parts[at], other.parts[at]
            rest = np.zeros((len(a), len(b)), dtype=np.int64)
            for begin in range(0, a.shape[1], DEPTH):
                rest += (a[:, begin : begin + DEPTH] @ b[:, begin : begin + DEPTH].T).astype(np.int64)
            # The next digit: what is left after the digits so far, divided by their weight, modulo p.
            known = np.zeros_like(rest)
            place = 1
            for q, digit in zip(self.primes, digits, strict=False):
                known += digit * (place % p)
                place *= q
            digit = _balanced((rest - known) % p * pow(place, -1, p), p)
            digits.append(digit)
            step = digit * np.int64((weight + 2**63) % 2**64 - 2**63)
            total = step if total is None else total + step
            weight *= p
        return total


class _Best:
    """The first ``k`` of every window, best score first and of equal ones the smaller id."""

    def __init__(self, windows: int, k: int) -> None:
        self._k = k
        self.window = np.zeros(0, dtype=np.int64)
        self.score, self.ident = self.window, self.window
        self.kth = np.full(windows, _LEAST)

    def add(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        window, score, ident = (
            np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.ident, ident))
        )
        # Ids rise before the stable sort by falling score, complemented as the least long has no negative.
        order = np.lexsort((ident, ~score, window))
        window = window[order]
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(window) else np.zeros(0, int)
        place = np.arange(len(window)) - np.repeat(starts, np.diff(np.append(starts, len(window))))
        kept = place < self._k
        self.window, self.score, self.ident = window[kept], score[order][kept], ident[order][kept]
        full = np.flatnonzero(place[kept] == self._k - 1)
        self.kth[self.window[full]] = self.score[full]


_SCHEMA = "window long, candidate_id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _search(candidates: DataFrame, chunk: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(window, candidate_id, score): per task the first ``k`` candidates of every window of ``chunk``.

    ``chunk`` is (window, anchor, anchor_id, label, vector, low, high) with a bounded number of rows, ``candidates`` (vec_id,
    label, vector). A window takes the candidates of other ids, of its own label or of all others, whose score is within
    its limits. Vectors of different lengths have no score.
    """
    table = chunk.toArrow()
    lengths = pc.list_value_length(table["vector"])
    by_length = {}
    for n in pc.unique(lengths).to_pylist():
        part = table.filter(pc.equal(lengths, n)).combine_chunks()
        columns = {c: part[c].to_numpy() for c in ("window", "anchor", "anchor_id", "label", "low", "high")}
        by_length[n] = columns | {"vector": _matrix(part["vector"].combine_chunks())}
    shared = candidates.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: _Search(part, k, same_label) for n, part in shared.value.items()}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector"))
            for n, search in searches.items():
                own = batch.filter(pc.equal(lengths, n))
                for begin in range(0, own.num_rows, search.block):
                    search.add(own.slice(begin, search.block))
        for search in searches.values():
            yield search.result()

    return candidates.mapInArrow(run, _SCHEMA)


class _Search:
    """Windows of one length of vectors against blocks of candidates."""

    def __init__(self, part: dict[str, np.ndarray], k: int, same_label: bool) -> None:
        # Windows of one anchor share a row of scores.
        self._part, self._same = part, same_label
        _, first, self._row = np.unique(part["anchor"], return_index=True, return_inverse=True)
        self._vectors = part["vector"][first]
        self._norm = float(np.sqrt((self._vectors.astype(np.float64) ** 2).sum(axis=1).max()))
        self._best = _Best(len(part["window"]), k)
        self._reduced: dict[tuple[int, ...], ResidueMatrix] = {}
        self.block = max(16, BLOCK_SCORES // len(part["window"]))

    def add(self, batch: pa.RecordBatch) -> None:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        vectors = _matrix(batch.column("vector"))
        norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
        bound = int(self._norm * norm * (1 + 1e-9)) + 1
        primes = residue_primes(vectors.shape[1], bound)
        anchors = self._reduced.get(tuple(primes))
        if anchors is None:
            self._reduced = {tuple(primes): ResidueMatrix(self._vectors, primes)}
            anchors = self._reduced[tuple(primes)]
        scores = anchors.scores(ResidueMatrix(vectors, primes))[self._row]
        part = self._part
        least = np.maximum(part["low"], self._best.kth)
        fits = (scores >= least[:, None]) & (scores <= part["high"][:, None])
        fits &= (part["label"][:, None] == labels[None, :]) == self._same
        fits &= part["anchor_id"][:, None] != ids[None, :]
        window, at = np.nonzero(fits)
        if len(window):
            self._best.add(window, scores[window, at], ids[at])

    def result(self) -> pa.RecordBatch:
        best = self._best
        columns = (self._part["window"][best.window], best.ident, best.score)
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=_SCHEMA.split()[::2])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("window").orderBy(F.col("score").desc(), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_windows(candidates: DataFrame, windows: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(window, candidate_id, score, rank): the first ``k`` of every window, by two looks at the candidates."""
    windows = written(windows, "windows")
    n = windows.count()
    chunks = -(-n // CHUNK)
    first = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(FIRST_LOOK)) == 0
    looks = [candidates.filter(first), candidates.filter(~first)]
    found = None
    for number in range(chunks):
        chunk = windows
        if chunks > 1:
            # Windows of one anchor come together; a chunk has its share of the anchors.
            chunk = windows.filter(F.pmod(F.xxhash64("anchor"), F.lit(chunks)) == number)
        sighted = written(_search(looks[0], chunk, k, same_label), "first-look")
        kth = _first(sighted, k).filter(F.col("rank") == k).select("window", F.col("score").alias("kth"))
        floored = chunk.join(kth, "window", "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low")))
        rest = written(_search(looks[1], floored.drop("kth"), k, same_label), "other-look")
        both = sighted.unionByName(rest)
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = candidates.sparkSession.createDataFrame([], _SCHEMA)
    return _first(found, k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; a score is the inner product with the anchor; higher scores come first, of
    equal ones the smaller id. An anchor's positives are the first ``positives`` rows of its label and another id. Of the
    rows of other labels, the negatives of a positive are the first ``negatives`` with ``share[0] * positive_score <=
    share[1] * score <= share[1] * positive_score``; a negative positive score has none.

    Rows whose id, label or vector is null, whose vector is empty or that hold null or non-finite components take no
    part. Repeated anchors are one anchor, rows of one id with other vectors or labels are anchors each; repeated rows
    are candidates each. Vectors of different lengths have no score with each other. Components beyond a long are cut to
    it, and scores beyond one wrap around. An empty table gives no row. Other columns are not read.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & (F.size(x) > 0) & sound).select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = written(rows, "vectors")
    candidates = rows.select("vec_id", "label", "vector")
    anchors = rows.filter("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "vector").distinct()
    anchors = written(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    whole = anchors.select(
        F.col("anchor").alias("window"), "*", F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")
    )
    near = _in_windows(candidates, whole, positives, True)
    near = near.select(
        (F.col("window") * positives + F.col("rank") - 1).alias("window"),
        F.col("window").alias("anchor"),
        F.col("candidate_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    near = written(near, "positives")
    few, all_ = share
    score = F.col("positive_score")
    # few * score / all_, rounded up, without leaving the longs.
    low = F.expr(f"positive_score div {all_} * {few} + CAST(ceil(positive_score % {all_} * {few} / {all_}D) AS BIGINT)")
    pairs = (
        near.filter(score >= 0)
        .join(anchors, "anchor")
        .select("window", "anchor", "anchor_id", "label", "vector", low.alias("low"), score.alias("high"))
    )
    far = _in_windows(candidates, pairs, negatives, False)
    named = near.join(anchors.select("anchor", "anchor_id"), "anchor")
    return far.join(named, "window").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("candidate_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
