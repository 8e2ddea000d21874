"""Corpus preparation: empty rows, duplicates, stratified splits and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_key, strip
from ..session import stored

SPLITS = ("train", "validation", "test")
_HASH_PREFIX = 4  # hex digits: 65,536 buckets per label


def drop_empty(df: DataFrame, col: str = "raw_text") -> DataFrame:
    return df.withColumn(col, strip(F.coalesce(F.col(col), F.lit("")))).filter(F.col(col) != "")


def with_dedup_key(df: DataFrame, col: str = "raw_text", normalize: bool = True) -> DataFrame:
    return df.withColumn("dedup_key", canonical_key(F.col(col), normalize))


def first_rows(df: DataFrame, key: Column, order_col: str = "seq") -> DataFrame:
    """``order_col`` of the first row of every non-empty key.

    Keys are hashed before the shuffle, copies collapse on the map side, and each key sends one long
    per task, so a text that fills a third of the table is no hot spot. Empty keys form one group that
    is dropped by its aggregated length: a filter on the key itself would be pushed down and compute
    every key twice.
    """
    keyed = df.select(order_col, key.alias("_key"))
    first = keyed.groupBy(F.sha2("_key", 256).alias("k")).agg(
        F.min(order_col).alias(order_col), F.max(F.length("_key")).alias("n")
    )
    return first.filter("n > 0").select(order_col)


def dedup(df: DataFrame, key: Column, order_col: str = "seq") -> DataFrame:
    """Keep the first row of every non-empty key; rows are matched back on the unique order column."""
    return df.join(first_rows(df, key, order_col), order_col, "left_semi")


def dedup_exact(df: DataFrame) -> DataFrame:
    rows = df.withColumn("raw_text", strip(F.coalesce("raw_text", F.lit(""))))
    return dedup(rows, F.col("raw_text"))


def dedup_canonical(df: DataFrame, normalize: bool = True) -> DataFrame:
    """Rows with an empty text or key are dropped as well; the key stays as ``dedup_key``."""
    rows = df.withColumn("raw_text", strip(F.coalesce("raw_text", F.lit(""))))
    return with_dedup_key(dedup(rows, canonical_key(F.col("raw_text"), normalize)), normalize=normalize)


def _shares(train: float, val: float, test: float) -> tuple[float, float]:
    if round(train + val + test, 10) != 1.0:
        raise ValueError("train, validation and test shares must sum to 1")
    return val + test, 1 - val / (val + test)


def _allot(counts: DataFrame, part: str, n_total: Column, n_drawn: Column) -> DataFrame:
    """Share ``n_drawn`` rows over the labels by largest remainder (ties: smaller label first)."""
    exact = F.col(part) / n_total * n_drawn
    floor = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    whole = W.partitionBy()
    missing = n_drawn - F.sum("_floor").over(whole)
    place = F.row_number().over(W.orderBy(F.desc("_rest"), "label"))
    return floor.withColumn("_drawn", F.col("_floor") + F.when(place <= missing, 1).otherwise(0))


def split_sizes(counts: DataFrame, train: float, val: float, test: float) -> DataFrame:
    """``(label, n, n_train, n_val, n_test)`` from ``(label, n)``; one row per label.

    Each step holds out the rounded-up share of all rows and shares both sides over the labels.
    """
    held_out, test_share = _shares(train, val, test)
    whole = W.partitionBy()
    sized = counts.withColumn("_all", F.sum("n").over(whole))
    sized = sized.withColumn("_train", F.col("_all") - F.ceil(F.col("_all") * F.lit(held_out)))
    sized = _allot(sized, "n", F.col("_all"), F.col("_train")).withColumnRenamed("_drawn", "n_train")
    sized = sized.withColumn("_temp", F.col("_all") - F.col("_train")).withColumn("_left", F.col("n") - F.col("n_train"))
    sized = sized.withColumn("_val", F.col("_temp") - F.ceil(F.col("_temp") * F.lit(test_share)))
    sized = _allot(sized, "_left", F.col("_temp"), F.col("_val")).withColumnRenamed("_drawn", "n_val")
    return sized.select(
        "label",
        "n",
        F.col("n_train").cast("long"),
        F.col("n_val").cast("long"),
        (F.col("_left") - F.col("n_val")).cast("long").alias("n_test"),
    )


def split_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def stratified_split(
    df: DataFrame,
    train: float = 0.70,
    val: float = 0.10,
    test: float = 0.20,
    seed: int = 42,
    id_col: str = "doc_id",
    label_col: str = "label",
) -> DataFrame:
    """Add ``split`` with exact, repeatable sizes per label.

    Rows are ordered by a seeded hash of their id. Instead of ranking all rows of a label in one
    window, a histogram over hash prefixes finds the two buckets that hold the cut rows, only those
    buckets are ranked, and every row is then placed by comparing its hash with the cut values: the
    wide rows are never shuffled.
    """
    key = split_key(F.col(id_col), seed)
    slim = df.select(F.col(label_col).alias("label"), key.alias("key")).withColumn(
        "bucket", F.substring("key", 1, _HASH_PREFIX)
    )
    histogram = slim.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    sizes = split_sizes(histogram.groupBy("label").agg(F.sum("rows").alias("n")), train, val, test)
    running = histogram.withColumn("upto", F.sum("rows").over(W.partitionBy("label").orderBy("bucket")))
    cuts = sizes.select(
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("cut"), F.col("n_train").alias("place")),
                F.struct(F.lit("validation").alias("cut"), (F.col("n_train") + F.col("n_val")).alias("place")),
            )
        ).alias("c"),
    ).select("label", "c.cut", "c.place")
    wanted = (
        running.join(F.broadcast(cuts), "label")
        .filter((F.col("place") > F.col("upto") - F.col("rows")) & (F.col("place") <= F.col("upto")))
        .select("label", "bucket", "cut", (F.col("place") - F.col("upto") + F.col("rows")).alias("nth"))
    )
    ranked = slim.join(F.broadcast(wanted), ["label", "bucket"]).withColumn(
        "rn", F.row_number().over(W.partitionBy("label", "bucket", "cut").orderBy("key"))
    )
    edges = (
        ranked.filter("rn = nth")
        .groupBy("label")
        .agg(
            F.max(F.when(F.col("cut") == "train", F.col("key"))).alias("_train_edge"),
            F.max(F.when(F.col("cut") == "validation", F.col("key"))).alias("_val_edge"),
        )
        .withColumnRenamed("label", "_edge_label")
    )
    # A label with no train or validation row has no edge: nothing lies at or below it.
    split = (
        F.when(key <= F.coalesce("_train_edge", F.lit("")), "train")
        .when(key <= F.coalesce("_val_edge", "_train_edge", F.lit("")), "validation")
        .otherwise("test")
    )
    joined = df.join(F.broadcast(edges), df[label_col].eqNullSafe(F.col("_edge_label")), "left")
    return joined.withColumn("split", split).drop("_edge_label", "_train_edge", "_val_edge")


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def class_proportions(df: DataFrame) -> DataFrame:
    """Share of each label within its split; the window runs over one row per split and label."""
    total = F.sum("n_rows").over(W.partitionBy("split"))
    return class_counts(df).withColumn("share", F.round(F.col("n_rows") / total, 4))


def class_proportion_maps(df: DataFrame) -> DataFrame:
    return (
        class_proportions(df)
        .groupBy("split")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "share")))).alias("class_proportions"))
    )


_PARTS = {"train": "train", "val": "validation", "test": "test"}


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def raw_counters() -> list[Column]:
    """Aggregates over raw labelled rows that have ``dedup_key``."""
    filled = strip(F.coalesce(F.col("raw_text"), F.lit(""))) != ""
    keyed = filled & (F.col("dedup_key") != "")
    return [
        _n(F.col("label") == 0).alias("raw_fake_rows"),
        _n(F.col("label") == 1).alias("raw_true_rows"),
        F.count(F.lit(1)).alias("raw_total_rows"),
        _n(~filled).alias("empty_rows_removed"),
        _n(filled & ~keyed).alias("empty_key_rows_removed"),
        _n(keyed).alias("_keyed"),
    ]


def final_counters() -> list[Column]:
    """Aggregates over the split rows."""
    return [
        F.count(F.lit(1)).alias("final_rows_after_preprocessing"),
        *[_n(F.col("split") == split).alias(f"{name}_rows") for name, split in _PARTS.items()],
        *[
            F.round(
                F.avg(F.when(F.col("split") == split, (F.col("label") == label).cast("double"))), 4
            ).alias(f"{name}_share_{label}")
            for name, split in _PARTS.items()
            for label in (0, 1)
        ],
    ]


def preprocess_summary(spark: SparkSession, raw: dict, final: dict) -> DataFrame:
    """One row of counters, from what the writing jobs of both stages observed."""
    row = {**raw, **final}
    row["duplicate_rows_removed"] = row.pop("_keyed") - row["final_rows_after_preprocessing"]
    kinds = [f"{name} {'double' if '_share_' in name else 'long'}" for name in row]
    return spark.createDataFrame([tuple(row.values())], ", ".join(kinds))


def build_and_count(
    labelled: DataFrame, train: float = 0.70, val: float = 0.10, test: float = 0.20, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The split of the rows that stay (``doc_id``, ``label``, ``split``) and the summary of how they came about.

    Keys are computed once, in the job that writes them; that job and the one that writes the split count their rows on
    the way, so counting costs no pass. Both count in the stage that writes, where a repeated task counts once.
    """
    before, after = Observation(), Observation()
    keyed = stored(with_dedup_key(labelled).observe(before, *raw_counters()), "keyed")
    kept = stored(dedup(keyed, F.col("dedup_key")).select("doc_id", "label"), "kept")
    split = stored(stratified_split(kept, train, val, test, seed).observe(after, *final_counters()), "split")
    return split, preprocess_summary(labelled.sparkSession, before.get, after.get)


def majority_baseline(df: DataFrame) -> DataFrame:
    """Most frequent train label (tie: smaller label, the one stacked first) and its test accuracy."""
    counts = class_counts(df)
    best = counts.filter("split = 'train'").agg(
        F.min_by("label", F.struct(-F.col("n_rows"), F.col("label"))).alias("majority_label")
    )
    test = counts.filter("split = 'test'").agg(
        F.collect_list(F.struct("label", "n_rows")).alias("by_label"), F.sum("n_rows").alias("n")
    )
    both = best.unionByName(test, allowMissingColumns=True).agg(
        F.max("majority_label").alias("majority_label"),
        F.max_by("by_label", F.col("n")).alias("by_label"),
        F.max("n").alias("n"),
    )
    right = F.aggregate(
        F.filter("by_label", lambda x: x["label"] == F.col("majority_label")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x["n_rows"],
    )
    return both.select("majority_label", F.round(right / F.col("n"), 4).alias("accuracy"))
