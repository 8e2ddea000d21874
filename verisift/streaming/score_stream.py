"""Score articles as they arrive: every micro-batch goes through the batch plan.

Scores of an article depend on that article and on static tables alone, so a batch of arrivals is a batch like any
other. Each one is written to a folder of its own, which a repeated batch overwrites: a restart neither loses nor
doubles verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.score_articles import Scorer, score_articles

ARRIVING = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("input_type", T.StringType()),
        T.StructField("raw_input", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("final_text", T.StringType()),
        T.StructField("judge_score", T.DoubleType()),
    ]
)


def read_article_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_scoring(
    arriving: DataFrame,
    lexicon: DataFrame,
    scorer: Scorer,
    out_path: str,
    checkpoint_path: str,
    lemmas: DataFrame | None = None,
) -> StreamingQuery:
    """Write verdicts to parquet, in ``batch`` folders, until all arrived files are scored."""

    def score(batch: DataFrame, number: int) -> None:
        verdicts = score_articles(batch, lexicon, scorer, lemmas=lemmas)
        verdicts.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        arriving.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
