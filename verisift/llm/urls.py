"""URL filter: allow and block rules, and a character language-model ratio for the URLs that no rule fits.

Two variable-order Markov models over characters are counted on the URLs that rules allow and on those they block. A
character is predicted by its longest seen contexts, orders mixed as ``(count + W * shorter order) / (seen + W)``. The
log-likelihood difference of a URL, divided by its length, is compared with a threshold that is calibrated on a part of
the ruled URLs that no count has seen.

Counts are a table with a row per context and per context and character, keyed by 64 bits. URLs are scored in blocks of
bounded size: a block's distinct keys meet the table by an equi-join, and the block is scored with the counts it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import scramble

#: Characters of context at most; weight of shorter orders.
ORDER, WEIGHT = 4, 4.0
#: Characters of the URLs that are counted at a time, and of those that are scored in one block.
BLOCK_CHARS = 100_000
#: One in so many of the ruled URLs calibrates, and thresholds are found on a grid of this step.
CALIBRATION, GRID = 4, 0.01
_U = np.uint64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for null and without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """``urls`` with ``rule`` and ``verdict`` of the longest rule that fits, null where none does.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's. URLs
    meet rules by an equi-join on the suffixes of their host, which has a few labels, so the number of rules is free.
    The longest rule has the most characters; between equal ones block wins.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1))
    )
    asked = urls.select(key, path.alias("path"), F.explode(F.when(host != "", suffixes)).alias("rule_host"))
    named = rules.select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    fits = asked.join(named, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy(key).agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("best")
    )
    return best.select(key, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def _keys(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of (context, character) and of the context alone, both (orders, characters), and each character's URL.

    Contexts have 0 to ORDER characters and are hashed in 64 bits. A start mark precedes the first character, so that
    shorter contexts at the start are their own.
    """
    sizes = np.array([len(u) + 1 for u in urls], dtype=np.int64)
    codes = np.frombuffer("".join("\x02" + u for u in urls).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = codes.astype(_U) + _U(1)
    owner = np.repeat(np.arange(len(urls)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = place > 0
    joint = np.empty((ORDER + 1, int(real.sum())), dtype=_U)
    alone = np.empty_like(joint)
    context = np.zeros(len(codes), dtype=_U)
    for order in range(ORDER + 1):
        if order:
            before = np.concatenate([np.zeros(order, dtype=_U), codes])[: len(codes)]
            before[place < order] = 0
            context = scramble(context * _U(31) + before + _U(order))
        joint[order] = scramble(context + codes * _U(0x9E3779B97F4A7C15))[real]
        alone[order] = scramble(context ^ _U(0x5BD1E995))[real]
    return joint, alone, owner[real]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``BLOCK_CHARS`` of the column ``url``, and at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column("url")), 0).to_numpy(zero_copy_only=False)
        ends = (np.cumsum(sizes) - 1).clip(0) // BLOCK_CHARS
        starts = np.flatnonzero(np.diff(ends, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def count_keys(urls: DataFrame) -> DataFrame:
    """(key, n0, n1) over ``urls(url, label)``: how often blocked (0) and allowed (1) URLs have a key.

    Tasks add up the keys of a bounded piece of URLs first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            joint, alone, owner = _keys([u or "" for u in batch.column("url").to_pylist()])
            label = batch.column("label").to_numpy(zero_copy_only=False)[owner]
            keys, which = np.unique(np.concatenate([joint.ravel(), alone.ravel()]), return_inverse=True)
            allowed = np.bincount(which, np.tile(label, 2 * (ORDER + 1)), len(keys)).astype(np.int64)
            every = np.bincount(which, minlength=len(keys))
            columns = [pa.array(c) for c in (keys.view(np.int64), every - allowed, allowed)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n0", "n1"])

    parts = urls.select("url", "label").mapInArrow(run, "key long, n0 long, n1 long")
    return parts.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def differences(urls: list[str], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Allowed minus blocked log-likelihood per character of each URL; 0 for empty ones.

    ``counts`` (2, keys) are those of the ``keys`` in ascending order; other keys have no count.
    """
    joint, alone, owner = _keys(urls)
    keys = np.append(keys, _U(2**64 - 1))
    counts = np.concatenate([counts, np.zeros((2, 1))], axis=1)

    def at(wanted: np.ndarray) -> np.ndarray:
        place = np.searchsorted(keys[:-1], wanted)
        return np.where(keys[place] == wanted, place, len(keys) - 1)

    both = [(at(joint[order]), at(alone[order])) for order in range(ORDER + 1)]
    total = np.zeros(joint.shape[1])
    for label, sign in ((1, 1.0), (0, -1.0)):
        p = np.full(joint.shape[1], 1 / 256)
        for found, context in both:
            p = (counts[label][found] + WEIGHT * p) / (counts[label][context] + WEIGHT)
        total += sign * np.log(p)
    sizes = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, total, len(urls)) / np.maximum(sizes, 1)


def url_differences(urls: DataFrame, counts: DataFrame, into: str) -> DataFrame:
    """(url, difference) of the distinct ``urls(url)``, none of them null, from the counts of ``count_keys``.

    URLs are dealt to blocks of about ``BLOCK_CHARS`` by their hash. Only the distinct keys of a block are looked up.
    """
    chars = urls.agg(F.sum(F.length("url"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    placed = urls.select("url", F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block")).repartition(blocks, "block")

    def wanted(rows: pd.DataFrame) -> pd.DataFrame:
        joint, alone, _ = _keys(rows["url"].tolist())
        keys = np.unique(np.concatenate([joint.ravel(), alone.ravel()]))
        return pd.DataFrame({"block": rows["block"].iloc[0], "key": keys.view(np.int64)})

    def score(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = found["key"].to_numpy(dtype=np.int64).view(_U)
        order = np.argsort(keys)
        counts = found[["n0", "n1"]].to_numpy(dtype=np.float64).T[:, order]
        urls = rows["url"].tolist()
        return pd.DataFrame({"url": urls, into: differences(urls, keys[order], counts)})

    asked = placed.groupBy("block").applyInPandas(wanted, "block long, key long")
    found = asked.join(counts, "key").select("block", "key", "n0", "n1").repartition(blocks, "block")
    return placed.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(score, f"url string, {into} double")


def calibrated_threshold(scored: DataFrame) -> float:
    """The difference on the grid at which the shares of allowed URLs below and of blocked URLs above it are least.

    ``scored``: (difference, label). Only a histogram is collected: the difference lies within a bounded range. With
    one label only, the threshold lies beyond its URLs; without any it is 0.
    """
    step = F.floor(F.col("difference") / F.lit(GRID)).cast("long")
    bins = scored.groupBy(step.alias("step")).agg(
        F.sum((F.col("label") == 0).cast("long")).alias("n0"), F.sum((F.col("label") == 1).cast("long")).alias("n1")
    )
    bins = bins.toPandas().sort_values("step")
    if bins.empty:
        return 0.0
    edges = np.append(bins["step"].to_numpy(), bins["step"].iloc[-1] + 1)
    below = np.concatenate([[0], bins["n1"].cumsum()]) / max(1, bins["n1"].sum())
    above = (bins["n0"].sum() - np.concatenate([[0], bins["n0"].cumsum()])) / max(1, bins["n0"].sum())
    loss = below + above
    best = np.flatnonzero(loss == loss.min())
    return float(edges[best[len(best) // 2]] * GRID)


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Per row: page_id, url, host, path, rule, verdict, difference.

    ``rules``: (host, path, verdict) with verdict allow or block. The longest rule that fits decides; other URLs are
    allowed if the models' difference reaches the calibrated threshold. A null or empty URL has no rule, difference 0
    and the verdict that 0 gets. If no rule fits any URL, everything else is allowed. Repeated rows agree; other columns
    are not carried; an empty table gives no rows.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    # One URL is judged once, however often it is listed.
    distinct = written(urls.select("url").filter("url IS NOT NULL").distinct(), "urls")
    host, path = host_and_path(F.col("url"))
    ruled = rule_for(host, path, rules, distinct, "url")
    judged = written(distinct.join(ruled, "url", "left"), "ruled-urls")
    known = judged.filter("verdict IS NOT NULL").select(
        "url",
        (F.col("verdict") == "allow").cast("int").alias("label"),
        (F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0).alias("calibrates"),
    )
    learned = known.filter("NOT calibrates")
    chars = learned.agg(F.sum(F.length("url"))).first()[0] or 0
    learned = learned.repartition(-(-chars // BLOCK_CHARS) or 1, "url")
    counts = written(count_keys(learned), "url-counts")
    scored = written(url_differences(judged.select("url"), counts, "difference"), "url-differences")
    threshold = calibrated_threshold(known.filter("calibrates").join(scored, "url"))
    judged = judged.join(scored, "url")
    by_model = F.when(F.coalesce("difference", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return urls.join(judged, "url", "left").select(
        "page_id",
        "url",
        host.alias("host"),
        path.alias("path"),
        "rule",
        F.coalesce("verdict", by_model).alias("verdict"),
        F.coalesce("difference", F.lit(0.0)).alias("difference"),
    )
