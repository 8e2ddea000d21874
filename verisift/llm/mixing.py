"""Mix sources to target weights by Pareto order sampling, with DataFrame expressions only.

Every source has a target in words. Within a source a document is expected ``e = min(cap, c * preference)`` times,
where ``c`` makes the expected words meet the target. ``floor(e)`` copies are certain; the rest is an inclusion
probability ``p``. Documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` uniform from a hash, and the
first ones are taken until the words that the certain copies leave open are filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import word_count, written

#: A document of at least 2^k words, k up to this, is preferred by another tenth.
LENGTH_STEPS = 10
#: Ranks are cut at one of so many buckets per source; only the bucket of the cut is sorted.
RANK_BUCKETS = 65536


def length_level(size: Column) -> Column:
    """0 to 10: how many powers of two the size reaches."""
    level = F.lit(0)
    for k in range(1, LENGTH_STEPS + 1):
        level = level + (size >= F.lit(2**k)).cast("int")
    return level


def length_preference(level: Column) -> Column:
    """Longer texts carry repetition better: from 1 to 2."""
    return (F.lit(10) + level).cast("double") / F.lit(10.0)


def uniform(seed: int, *keys: Column) -> Column:
    """A number between 0 and 1, both excluded, that only depends on the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """(no_source, source_key, source_size) to the same with ``target``.

    Sources are ordered by code point, null last, and take the weights in turn. A target is ``min(cap * size, c *
    weight)``: what a source cannot take goes to the others by weight until none is above its cap.
    """
    order = Window.orderBy("no_source", "source_key")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight)
    tightest = Window.orderBy(F.lit(float(cap)) * F.col("source_size") / F.col("weight"), "no_source", "source_key")
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - (
        F.sum(F.lit(float(cap)) * F.col("source_size")).over(tightest) - F.lit(float(cap)) * F.col("source_size")
    )
    rest = F.sum("weight").over(everything) - (F.sum("weight").over(tightest) - F.col("weight"))
    full = F.col("source_size") * F.lit(float(cap))
    # The level rises while sources are full and falls after that, so its maximum is the level that holds.
    level = F.max("level_here").over(everything)
    filled = ranked.withColumn("level_here", left / rest)
    target = F.least(full, level * F.col("weight"))
    return filled.withColumn("target", target).select("no_source", "source_key", "source_size", "target")


def expected_copies(levels: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Per source and level: the certain copies, the inclusion probability of one more and the words left to sample."""
    each = levels.join(targets, ["no_source", "source_key"]).withColumn("preference", length_preference(F.col("level")))
    by_preference = Window.partitionBy("no_source", "source_key").orderBy(F.col("preference").desc())
    whole = Window.partitionBy("no_source", "source_key")
    words = F.col("level_size").cast("double")
    pull = F.col("preference") * words
    before = F.lit(float(cap)) * (F.sum(words).over(by_preference) - words)
    rest = F.sum(pull).over(whole) - (F.sum(pull).over(by_preference) - pull)
    factor = F.when(rest > 0, (F.col("target") - before) / rest)
    # As with sources: the factor is largest where the levels that are not at their cap begin.
    each = each.withColumn("factor_here", factor).withColumn("factor", F.max("factor_here").over(whole))
    expected = F.least(F.lit(float(cap)), F.coalesce(F.col("factor") * F.col("preference"), F.lit(float(cap))))
    certain = F.floor(expected + F.lit(1e-9))
    each = each.withColumn("certain", certain).withColumn("chance", F.greatest(expected - certain, F.lit(0.0)))
    sure = F.sum(F.col("certain") * words).over(whole)
    return each.withColumn("open_words", F.greatest(F.col("target") - sure, F.lit(0.0))).select(
        "no_source", "source_key", "level", "source_size", "target", "certain", "chance", "open_words"
    )


def pareto_rank(chance: Column, u: Column) -> Column:
    """Random odds by inclusion odds; null where the chance is 0."""
    return F.when(chance > 0, (u / (F.lit(1.0) - u)) / (chance / (F.lit(1.0) - chance)))


def rank_cuts(ranked: DataFrame) -> DataFrame:
    """Per source the last rank whose running total of words stays within ``open_words``, and one document more.

    The total over rank buckets finds the bucket of the cut, and only that is sorted. Rows of equal rank (the same id,
    source and size) share one fate. The last place goes to the later document whose size fits the gap best, if that
    brings the total nearer.
    """
    source = ["no_source", "source_key"]
    ranked = ranked.filter(F.col("rank").isNotNull())
    bucketed = ranked.withColumn(
        "bucket", F.floor(F.lit(float(RANK_BUCKETS)) * F.col("rank") / (F.lit(1.0) + F.col("rank")))
    )
    up_to = Window.partitionBy(*source).orderBy("bucket")
    totals = (
        bucketed.groupBy(*source, "bucket", "open_words")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(up_to))
        .withColumn("before", F.col("upto") - F.col("words"))
    )
    # The first bucket that passes the open words; without one, everything is taken.
    cut = totals.filter((F.col("upto") > F.col("open_words")) & (F.col("before") <= F.col("open_words")))
    cut = written(cut.select(*source, "bucket", "before"), "mix-cut")
    units = (
        bucketed.join(cut, [*source, "bucket"])
        .groupBy(*source, "rank", "open_words", "before", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy(*source).orderBy("rank")))
    )
    inside = units.groupBy(*source).agg(
        # Ranks up to and with last_rank are taken: those of earlier buckets in any case.
        F.max(F.when(F.col("upto") <= F.col("open_words"), F.col("rank"))).alias("last_inside"),
        F.max(F.when(F.col("upto") <= F.col("open_words"), F.col("upto"))).alias("upto_inside"),
        F.min("rank").alias("first_rank"),
        F.first("before").alias("before"),
        F.first("open_words").alias("open_words"),
    )
    inside = inside.select(
        *source,
        (F.col("open_words") - F.coalesce("upto_inside", "before")).alias("gap"),
        F.col("last_inside"),
        F.col("first_rank"),
    )
    inside = written(inside, "mix-inside")
    later = ranked.join(inside, source).filter(
        F.when(F.col("last_inside").isNull(), F.col("rank") >= F.col("first_rank")).otherwise(
            F.col("rank") > F.col("last_inside")
        )
        & (F.col("size") < 2 * F.col("gap"))
        & (F.col("size") > 0)
    )
    fill = (
        later.groupBy(*source, "rank", "gap")
        .agg(F.sum("size").alias("words"))
        .filter(F.col("words") < 2 * F.col("gap"))
        .groupBy(*source)
        .agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), F.col("rank"))).alias("best"))
        .select(*source, F.col("best.rank").alias("fill_rank"))
    )
    return inside.join(fill, source, "left").select(*source, "last_inside", "first_rank", "fill_rank")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    into: str = "mix",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 8,
) -> DataFrame:
    """``docs`` with a struct column ``into``: size, source_size, target, copies, taken.

    ``share`` times all words are spread over the sources by ``weights``; no source or document is taken more than
    ``cap`` times. A null source is a source of its own. Null and empty texts have size 0 and never add words. Rows with
    the same id, source and size share one fate. Reruns agree whatever the partitions. An empty table stays empty; an
    existing column called ``into`` is replaced, all others stay.
    """
    key = [
        F.col(source_col).isNull().cast("int").alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source_key"),
    ]
    size = word_count(F.col(text_col))
    narrow = written(
        docs.select(*key, size.alias("size"), uniform(seed, F.col(id_col), size).alias("u")), "mix-sizes"
    ).withColumn("level", length_level(F.col("size")))
    levels = narrow.groupBy("no_source", "source_key", "level").agg(F.sum("size").alias("level_size"))
    levels = written(levels, "mix-levels")
    sizes = levels.groupBy("no_source", "source_key").agg(F.sum("level_size").alias("source_size"))
    plan = written(expected_copies(levels, source_targets(sizes, weights, share, cap), cap), "mix-plan")
    ranked = narrow.join(plan, ["no_source", "source_key", "level"]).withColumn(
        "rank", pareto_rank(F.col("chance"), F.col("u"))
    )
    cuts = rank_cuts(ranked)
    plan = written(plan.join(cuts, ["no_source", "source_key"], "left"), "mix-plan")

    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != into)).alias("row"))
    text, source, ident = (F.col(f"row.`{c}`") for c in (text_col, source_col, id_col))
    row = row.select(
        "row",
        source.isNull().cast("int").alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source_key"),
        word_count(text).alias("size"),
    )
    row = row.withColumn("level", length_level(F.col("size"))).withColumn("u", uniform(seed, ident, F.col("size")))
    row = row.join(plan, ["no_source", "source_key", "level"])
    rank = pareto_rank(F.col("chance"), F.col("u"))
    early = (
        F.when(F.col("first_rank").isNull(), F.lit(True))
        .when(F.col("last_inside").isNull(), rank < F.col("first_rank"))
        .otherwise(rank <= F.col("last_inside"))
    )
    more = rank.isNotNull() & (early | F.coalesce(rank == F.col("fill_rank"), F.lit(False)))
    copies = F.col("certain") + F.when(more, 1).otherwise(0)
    return row.select(
        "row.*",
        F.struct(
            F.col("size"),
            F.col("source_size"),
            F.col("target"),
            copies.alias("copies"),
            (copies * F.col("size")).cast("long").alias("taken"),
        ).alias(into),
    )


def repeat_by_mix(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """Each row as many times as the mix takes it, without the mix column."""
    copies = F.array_repeat(F.lit(1), F.col(f"{into}.copies").cast("int"))
    kept = [c for c in mixed.columns if c != into]
    return mixed.select(*(F.col(f"`{c}`") for c in kept), F.explode(copies).alias(into)).drop(into)
