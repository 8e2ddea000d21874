"""Shards that all hold the mixture of sources: proportional stratified interleaving.

Rows of a source are shuffled by a seeded draw and ranked; a row's fractional rank ``(rank + 1/2) / rows of the source``
says how far through its source it lies. The table in order of fractional ranks has every source spread evenly, so equal
cuts of it hold the sources in their proportions, at most one row of a source more or less than another cut but for
ties. Counts of shards differ by one at most (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import positions
from .common import written

LAW = "rows"


def shard_rows(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 12,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, ``keep``, size, text_crc32, source, shard, slot): one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one and ``text_crc32`` their checksum, both without bytes for a null or
    empty text. Slots count from 0 in each shard. The draw is a hash of seed, id, checksum and size, so a rerun gives
    the same shards; rows that agree in all of these, repeated rows above all, are interchangeable. Rows with null ids
    or sources are rows like others (null is a source of its own), an empty table gives none, and fewer rows than
    shards leave shards empty. Only these narrow columns are sorted, never texts, and by ranges: a source of any size
    is spread over tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    seeded = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), "text_crc32", "size")
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        *(F.col(c).alias(f"_keep_{c}") for c in keep),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).alias("_source"),
    )
    rows = narrow.select(
        "*",
        F.col("_source").isNull().cast("int").alias("_no_source"),
        F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("_source_key"),
        F.conv(F.substring(F.md5(seeded), 1, 13), 16, 10).cast("long").alias("_draw"),
        # The last word on order, so that a row repeated without end still falls into many ranges.
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(rows, "shard-tickets")
    source = ["_no_source", "_source_key"]
    sizes = rows.groupBy(*source).agg(F.count(F.lit(1)).alias("_in_source"))
    ranked = positions(rows, [*source, "_draw", "_id", "text_crc32", "size", "_row"], source, "_rank").join(sizes, source)
    fraction = (F.col("_rank") * 2 + 1).cast("double") / (F.col("_in_source") * 2).cast("double")
    ranked = ranked.withColumn("_fraction", fraction).drop("_in_source")
    placed = positions(ranked.withColumn("_all", F.lit(0)), ["_all", "_fraction", *source, "_rank"], ["_all"], "_place")
    total = max(1, rows.count())
    begin = F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", F.expr(f"_place * {shards} div {total}L")).select(
        F.col("_id").alias(id_col),
        *(F.col(f"_keep_{c}").alias(c) for c in keep),
        "size",
        "text_crc32",
        F.col("_source").alias(source_col),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - begin).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, **columns) -> None:
    """All rows of ``docs`` as Parquet under ``path/shard=N``, in order of ``slot`` within and between its files.

    Rows are numbered in a stored copy and joined to their shard by that number, so repeated rows are written each; a
    shard of any size is written by many tasks.
    """
    numbered = written(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    places = shard_rows(numbered, shards, keep=("_number",), **columns).select("_number", "shard", "slot")
    taken = numbered.drop(*(c for c in ("shard", "slot") if c in docs.columns)).join(places, "_number").drop("_number")
    ordered = taken.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
