"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

1. A document's set of word shingles gives its size, a fingerprint of the set and a signature of ``coordinates`` minima.
   Documents of equal sets are one class from here on, represented by the least id.
2. A class is posted under each (coordinate, value) pair that another class has too. Two classes that are as alike as
   asked agree in at least ``matches`` coordinates, but for a chance below ``MISS``. So pairs are sorted
   by how many classes share them, and only the rarest ``coordinates - matches + 1`` of each class, its prefix, are
   posted: two classes with enough collisions meet there, and the common pairs are skipped. Postings are split by bands
   of set size, because sets of very different size cannot be alike.
3. Classes that meet under a posting form clusters. A cluster is cut into blocks of bounded weight, and a task gets two
   blocks with the texts: it counts the collisions of whole signatures, drops pairs below ``matches`` and confirms the
   others on the full sets. It returns a forest over the confirmed links, never the pairs.
4. The components of these forests are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components
from .shingles import MinHashes, WordHashes, scramble, shingle_set

#: Weight of a block: shingles of its sets, and so many more per set.
BLOCK_WEIGHT, ROW_WEIGHT = 400_000, 200
SEED = 1


#: The chance at most that two sets just as alike as asked agree in fewer coordinates than they are looked up by.
MISS = 1e-6


def least_matches(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The most coordinates that sets of that similarity agree in but for a chance of ``miss``, from the binomial tail."""
    below = 0.0
    for matches in range(coordinates + 1):
        below += math.comb(coordinates, matches) * similarity**matches * (1 - similarity) ** (coordinates - matches)
        if below > miss:
            return max(1, matches)
    return coordinates


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def set_table(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): two fingerprint halves and the signature, null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, minima = _hashes(), MinHashes(coordinates, SEED)
        for batch in slices(batches, "text"):
            sets = [shingle_set(words.of(t.as_py()), width) for t in batch.column("text")]
            full = [s for s in sets if len(s)]
            signatures = iter(minima.of(full) if full else ())
            rows = [next(signatures) if len(s) else None for s in sets]
            halves = [
                (int(scramble(s).sum().view(np.int64)), int(scramble(s + np.uint64(1)).sum().view(np.int64)))
                if len(s)
                else (None, None)
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([h[0] for h in halves], type=pa.int64()),
                    pa.array([h[1] for h in halves], type=pa.int64()),
                    pa.array(rows, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, signature array<long>"
    )


def postings(classes: DataFrame, coordinates: int, matches: int, similarity: float) -> DataFrame:
    """(posting, rep): each class under the coordinate-value pairs of its prefix, in both size bands it can meet."""
    tokens = classes.select("rep", "n_shingles", F.posexplode("signature").alias("k", "value")).select(
        "rep", "n_shingles", F.xxhash64("k", "value").alias("pair")
    )
    shared = tokens.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    prefix = F.slice(
        F.array_sort(F.collect_list(F.struct("n", "pair"))),
        F.lit(1),
        # Pairs that no other class has come first and take their places in the prefix.
        F.greatest(F.count("*") - F.lit(matches - 1), F.lit(0)).cast("int"),
    )
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(similarity)) + F.lit(1e-9))
    return (
        tokens.join(shared, "pair")
        .groupBy("rep", "n_shingles")
        .agg(prefix.alias("prefix"))
        .select("rep", band.alias("band"), F.explode("prefix.pair").alias("pair"))
        .select("rep", "pair", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
        .select("rep", "band", F.xxhash64("pair", "band").alias("posting"))
    )


def clusters(posted: DataFrame) -> DataFrame:
    """(rep, cluster): classes that meet under a posting, directly or by others of their band, are one cluster."""
    node = F.xxhash64("rep", "band")
    posted = posted.withColumn("node", node)
    least = posted.groupBy("posting").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    met = posted.join(least.filter("first <> last").select("posting", "first"), "posting")
    met = written(met.select("rep", "node", "first"), "met")
    found = components(met.select(F.col("first").alias("a"), F.col("node").alias("b")))
    return met.select("rep", "node").distinct().join(found, "node").select("rep", F.col("component").alias("cluster"))


def tiles(members: DataFrame) -> DataFrame:
    """(rep, set_a, cluster, low, high, block): the pairs of blocks of its cluster that a class takes part in."""
    weight = F.col("n_shingles") + F.lit(ROW_WEIGHT)
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum(weight) / F.lit(BLOCK_WEIGHT)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.col("rep"), F.lit(SEED)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        members.join(blocks, "cluster")
        .withColumn("block", block)
        .select("rep", "set_a", "cluster", "block", other.alias("other"))
        .select(
            "rep",
            "set_a",
            "cluster",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
        )
    )


def _forest(sets: list[np.ndarray], blocks: np.ndarray, coordinates: int, share: int) -> list[tuple[int, int]]:
    """Links between the sets whose similarity is at least ``share`` percent, as a forest of index pairs.

    Where there are two blocks, only pairs across them are compared: each block has a tile of its own.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    signatures = MinHashes(coordinates, SEED).of(sets)
    matches = least_matches(coordinates, share / 100)
    _, items = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *sizes[:-1]])
    mark = np.zeros(items.max() + 1, dtype=np.int64)
    group = np.arange(n)
    two = blocks.min() != blocks.max()
    links = []
    for i in range(n):
        near = np.flatnonzero((signatures == signatures[i]).sum(axis=1) >= matches)
        near = near[group[near] != group[i]]
        near = near[100 * np.minimum(sizes[near], sizes[i]) >= share * np.maximum(sizes[near], sizes[i])]
        near = near[near > i]
        if two:
            near = near[blocks[near] != blocks[i]]
        if not len(near):
            continue
        own = items[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        for j in near:
            if group[j] != group[i]:
                common = int(mark[items[starts[j] : starts[j] + sizes[j]]].sum())
                if 100 * common >= share * (sizes[i] + sizes[j] - common):
                    links.append((i, int(j)))
                    group[group == group[j]] = group[i]
        mark[own] = 0
    return links


def confirmed(tiled: DataFrame, texts: DataFrame, width: int, coordinates: int, share: int) -> DataFrame:
    """Edges (a, b) of the forests of all tiles."""

    def link(tile: pd.DataFrame) -> pd.DataFrame:
        words = _hashes()
        reps, sets, blocks = [], [], []
        tile = tile.sort_values(["rep", "set_a"])
        for rep, block, text, set_a in zip(tile["rep"], tile["block"], tile["text"], tile["set_a"], strict=True):
            found = shingle_set(words.of(text), width)
            # Of rows that share an id, those of another set have a class of their own.
            if len(found) and int(scramble(found).sum().view(np.int64)) == set_a:
                if reps and reps[-1] == rep and len(sets[-1]) == len(found) and (sets[-1] == found).all():
                    continue
                reps.append(rep)
                sets.append(found)
                blocks.append(block)
        links = _forest(sets, np.array(blocks), coordinates, share) if len(sets) > 1 else []
        return pd.DataFrame([(reps[i], reps[j]) for i, j in links], columns=["a", "b"]).astype("int64")

    return (
        tiled.join(texts, tiled["rep"] == texts["doc_id"])
        .select("rep", "set_a", "cluster", "low", "high", "block", "text")
        .groupBy("cluster", "low", "high")
        .applyInPandas(link, "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    coordinates: int = 32,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least id reachable over links of at least ``similarity`` (in whole percent), the row's own
    included; ``kept`` marks the rows whose id is that. Words are lower-cased A to Z and cut at ASCII white space; a
    text of fewer than ``width`` words is one shingle. Null and empty texts have no shingles and link with nothing. Rows
    of one id are one document, linked by any of their texts; repeated rows stay and agree. A row without id cannot be
    named by a component: it has null ``component_id`` and ``kept`` and links nothing. An empty table gives no rows;
    other columns are not carried.
    """
    share = round(100 * similarity)
    matches = least_matches(coordinates, similarity)
    rows = written(set_table(docs, id_col, text_col, width, coordinates), "sets")
    classes = (
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    )
    classes = written(classes, "classes")
    members = clusters(postings(classes, coordinates, matches, similarity)).join(
        classes.select("rep", "set_a", "n_shingles"), "rep"
    )
    members = written(members, "members")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    edges = confirmed(tiles(members), texts, width, coordinates, share)
    # Rows of one id with different sets are tied by the id.
    tied = rows.filter("n_shingles > 0").groupBy("doc_id").agg(
        F.min(F.struct("set_a", "set_b", "n_shingles")).alias("one"),
        F.max(F.struct("set_a", "set_b", "n_shingles")).alias("other"),
    )
    tied = tied.filter("one <> other").select("doc_id")
    same = rows.join(tied, "doc_id", "left_semi").join(classes, ["set_a", "set_b", "n_shingles"])
    edges = edges.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    labelled = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component_id")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(labelled, ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
