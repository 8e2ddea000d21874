"""Small word tables to start with; real lexicons come in as tables of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A starter lexicon: word, polarity, subjectivity.
LEXICON = (
    ("good", 0.712358, 0.613213),
    ("great", 0.813217, 0.753214),
    ("best", 0.913452, 0.314562),
    ("bad", -0.713452, 0.667893),
    ("worst", -0.912347, 0.912348),
    ("terrible", -0.913254, 0.913217),
    ("shocking", -0.512347, 0.813457),
    ("finally", 0.013257, 0.913245),
    ("massive", 0.012347, 0.713456),
    ("secret", -0.313257, 0.713256),
    ("optimistic", 0.213457, 0.813452),
    ("cautiously", -0.013257, 0.413257),
    ("the", 0.011237, 0.113257),
    ("and", 0.023417, 0.212357),
    ("of", -0.031247, 0.087131),
    ("that", -0.113257, 0.412357),
    ("with", 0.213247, 0.331247),
    ("was", -0.113427, 0.271313),
    ("for", 0.172313, 0.151317),
    ("la", 0.131723, 0.351319),
    ("le", -0.171317, 0.231713),
    ("des", 0.051713, 0.171931),
    ("que", 0.091317, 0.291713),
    ("der", -0.131719, 0.191371),
    ("nicht", -0.371319, 0.571913),
    ("sch", 0.071319, 0.131917),
    ("para", 0.191373, 0.311917),
    ("no", -0.251713, 0.471319),
    ("los", 0.031713, 0.111973),
)


def demo_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "word string, polarity double, subjectivity double")
