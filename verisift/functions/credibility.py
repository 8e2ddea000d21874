"""Source domain, credibility tier and warning of an article URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip

# Known sources and their scores, neutral score, tier edges and warnings.
REPUTATION = {
    "reuters.com": 0.95,
    "apnews.com": 0.95,
    "bbc.com": 0.93,
    "nytimes.com": 0.90,
    "washingtonpost.com": 0.90,
    "theguardian.com": 0.88,
    "wsj.com": 0.90,
    "cnn.com": 0.80,
    "foxnews.com": 0.65,
    "nbcnews.com": 0.80,
    "infowars.com": 0.10,
    "breitbart.com": 0.25,
    "theonion.com": 0.05,
    "babylonbee.com": 0.05,
}
NEUTRAL_SCORE = 0.5
HIGH, MODERATE, LOW = 0.8, 0.6, 0.2
WARN_MODERATE = "Source '%s' has moderate credibility. Cross-check claims."
WARN_LOW = "Source '%s' has low credibility. Treat claims with skepticism."
WARN_VERY_LOW = "Source '%s' is a known unreliable site. Do not trust."
WARN_NO_URL = "No URL provided."


def reputation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REPUTATION.items()), "domain string, score double")


def extract_domain(url: Column) -> Column:
    """Lower-case host with its port, without one leading ``www.``; empty when there is none."""
    host = F.regexp_extract(strip(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def credibility_score(known: Column) -> Column:
    return F.coalesce(known, F.lit(NEUTRAL_SCORE))


def credibility_tier(domain: Column, score: Column) -> Column:
    return (
        F.when(domain == "", "unknown")
        .when(score >= HIGH, "high")
        .when(score >= MODERATE, "moderate")
        .when(score >= LOW, "low")
        .otherwise("very_low")
    )


def credibility_warning(domain: Column, tier: Column) -> Column:
    return (
        F.when(tier == "unknown", WARN_NO_URL)
        .when(tier == "moderate", F.format_string(WARN_MODERATE, domain))
        .when(tier == "low", F.format_string(WARN_LOW, domain))
        .when(tier == "very_low", F.format_string(WARN_VERY_LOW, domain))
    )
