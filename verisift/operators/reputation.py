"""Source reputation of a URL column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import credibility as cr


def with_credibility(df: DataFrame, url_col: str, reputation: DataFrame | None = None) -> DataFrame:
    """Add domain, score, tier, known flag and warning; an unknown domain keeps the neutral score.

    Without a table of the caller's own, the built-in list is used. Spark chooses the join from the table's size.
    """
    table = cr.reputation_table(df.sparkSession) if reputation is None else reputation
    found = df.withColumn("domain", cr.extract_domain(F.col(url_col))).join(table, "domain", "left")
    return (
        found.withColumn("is_known_source", F.col("score").isNotNull())
        .withColumn("credibility_score", cr.credibility_score(F.col("score")))
        .withColumn("credibility_tier", cr.credibility_tier(F.col("domain"), F.col("credibility_score")))
        .withColumn("warning", cr.credibility_warning(F.col("domain"), F.col("credibility_tier")))
        .drop("score")
    )
