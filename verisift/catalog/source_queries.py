"""Reading, page extraction, saving and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators.corpus import class_counts, majority_baseline
from ..operators.metrics import binary_metrics
from ..session import stored
from ..sources import artifacts, html, reports
from ..sources.tables import read_articles_csv, read_labelled_sources, read_table, require_columns, source_counts
from . import inputs
from . import sqltext as q
from .base import Query, scratch_dir, with_ctes


def _two_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.labelled(spark, sf).select("doc_id", "label", "title", "text")
    fake, true = (rows.filter(F.col("label") == label).drop("label") for label in (0, 1))
    return read_labelled_sources(fake, true, "doc_id")


def labelled_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _two_sources(spark, sf).select("doc_id", "label", "raw_text")


def counted_sources(spark: SparkSession, sf: str) -> DataFrame:
    return source_counts(_two_sources(spark, sf))


def csv_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Both sources written as CSV and read back with the explicit schema."""
    folder = scratch_dir(spark)
    rows = inputs.labelled(spark, sf).select("label", "title", "text")
    parts = []
    for label in (0, 1):
        path = f"{folder}/source_{label}"
        part = rows.filter(F.col("label") == label).drop("label")
        part.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
        parts.append(read_articles_csv(spark, path))
    stacked = stored(read_labelled_sources(*parts), "csv-sources")
    # Over both sources: as many ids as rows.
    ids = stacked.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_ids"))
    counts = stacked.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("raw_text")).cast("long").alias("n_chars")
    )
    return counts.crossJoin(ids)


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return html.with_main_text(inputs.pages(spark, sf)).select("page_id", "main_text")


def text_gate(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.documents(spark, sf).select("doc_id", html.usable_status(F.col("text")).alias("status"))


def metrics_csv(spark: SparkSession, sf: str) -> DataFrame:
    metrics = binary_metrics(inputs.scores(spark, sf).filter("split = 'test'"), ["model"])
    path = reports.write_metrics_csv(metrics, f"{scratch_dir(spark)}/metrics")
    return spark.read.schema(metrics.schema).option("header", True).csv(path)


def saved_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits written once, reused by the second call, and read back one folder at a time."""
    path = f"{scratch_dir(spark)}/splits"
    rows = inputs.split_texts(spark, sf).select("doc_id", "label", "split")
    artifacts.reuse_or_build(spark, path, lambda: rows)
    saved, reused = artifacts.reuse_or_build(spark, path, lambda: rows)
    return class_counts(saved).withColumn("reused", F.lit(reused))


def _report_rows(spark: SparkSession, sf: str) -> DataFrame:
    corpus = inputs.split_texts(spark, sf).select("label", "split")
    counts = class_counts(corpus).groupBy("split").agg(F.sum("n_rows").alias("n"))
    place = F.array_position(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("split"))
    sizes = counts.select(place.cast("long").alias("line_no"), F.format_string("%s rows: %d", "split", "n").alias("line"))
    base = majority_baseline(corpus).select(
        F.lit(4).cast("long").alias("line_no"),
        F.format_string("majority class: %d, accuracy %.4f", "majority_label", "accuracy").alias("line"),
    )
    return sizes.unionByName(base)


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _report_rows(spark, sf)


def written_report(spark: SparkSession, sf: str) -> DataFrame:
    path = reports.write_report(_report_rows(spark, sf), f"{scratch_dir(spark)}/report")
    return spark.read.text(path).select(F.col("value").alias("line"))


def checked_columns(spark: SparkSession, sf: str) -> DataFrame:
    table = require_columns(read_table(spark, sf, "labels"), ["doc_id", "quality"])
    return table.groupBy("quality").agg(F.count(F.lit(1)).alias("n_rows"))


def _main_text_parts() -> tuple[tuple, str]:
    """CTEs ending in ``blocks`` and the main text as an expression over it."""
    x = q.replace("html", "(?s)<!--.*?-->")
    for tag in "script style nav footer header aside form iframe button".split():
        x = q.replace(x, rf"(?is)<{tag}(?:[{WS}][^>]*)?>.*?</{tag}[{WS}]*>")
    main = rf"regexp_extract(x, '(?is)<article(?:[{WS}][^>]*)?>(.*?)(?:</article[{WS}]*>|$)', 1)"
    decoded = "r"
    references = ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0")
    for entity, char in (*references, ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        decoded = "replace({}, '{}', '{}')".format(decoded, entity, char.replace("'", "''"))
    shown = q.strip(decoded)

    def inner(fragment: str, glue: str) -> str:
        runs = f"list_transform(string_split_regex({fragment}, '<[^>]*>'), lambda r: {shown})"
        return f"array_to_string(list_filter({runs}, lambda r: r <> ''), '{glue}')"

    body = inner("string_split_regex(p, '(?i)</p>')[1]", "")
    value = f"CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE {inner('main', ' ')} END"
    return (
        ("clean_pages", f"SELECT page_id, {x} AS x FROM pages"),
        ("mains", f"SELECT page_id, {main} AS main FROM clean_pages"),
        (
            "blocks",
            f"""SELECT page_id, main, list_filter(list_transform(
 string_split_regex(main, '(?i)<p(?:[{WS}][^>]*)?>')[2:], lambda p: {body}), lambda b: length(b) > 20) AS kept
 FROM mains""",
        ),
    ), value


MAIN_TEXT_CTES, MAIN_TEXT_VALUE = _main_text_parts()
_FULL_TEXT = q.strip("coalesce(title, '') || ' ' || coalesce(text, '')")
_SPLIT_COUNTS = (q.LABELLED_CTE, *q.split_ctes("labelled"))

_REPORT_SQL = with_ctes(
            """SELECT line_no, line FROM (
 SELECT CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS line_no,
  split || ' rows: ' || count(*) AS line FROM splits GROUP BY split
 UNION ALL SELECT 4, 'majority class: ' || m || ', accuracy ' || printf('%.4f', round(
  (SELECT count(*) FILTER (label = m)::DOUBLE / count(*) FROM splits WHERE split = 'test'), 4))
  FROM (SELECT label AS m FROM splits WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1))""",
            *_SPLIT_COUNTS,
        )

QUERIES = [
    Query(
        "read_labelled_sources",
        labelled_sources,
        with_ctes(
            f"SELECT doc_id, label, {_FULL_TEXT} AS raw_text FROM labelled",
            q.LABELLED_CTE,
        ),
    ),
    Query("source_counts", counted_sources, "SELECT quality AS label, count(*) AS n_rows FROM labels GROUP BY 1"),
    Query(
        "read_articles_csv",
        csv_sources,
        with_ctes(
            f"""SELECT label, count(*) AS n_rows, CAST(sum(length({_FULL_TEXT})) AS BIGINT) AS n_chars,
 (SELECT count(*) FROM labelled) AS n_ids FROM labelled GROUP BY label""",
            q.LABELLED_CTE,
        ),
    ),
    Query("html_main_text", page_text, with_ctes(f"SELECT page_id, {MAIN_TEXT_VALUE} AS main_text FROM blocks", *MAIN_TEXT_CTES)),
    Query(
        "usable_text_gate",
        text_gate,
        f"SELECT doc_id, CASE WHEN length({q.strip('text')}) > 80 THEN 'ok' ELSE 'too_short' END AS status FROM documents",
    ),
    Query(
        "write_metrics_csv",
        metrics_csv,
        with_ctes(
            "SELECT model, accuracy, precision, recall, f1, auc_roc FROM metrics",
            *q.SCORE_CTES,
            ("test_scores", "SELECT * FROM scores WHERE split = 'test'"),
            *q.metric_ctes("test_scores", "model"),
        ),
    ),
    Query(
        "persist_artifacts",
        saved_splits,
        with_ctes(
            "SELECT split, label, count(*) AS n_rows, true AS reused FROM splits GROUP BY split, label", *_SPLIT_COUNTS
        ),
    ),
    Query("write_report", report_lines, _REPORT_SQL),
    Query("write_report_round_trip", written_report, f"SELECT line FROM ({_REPORT_SQL})"),
    Query("require_columns", checked_columns, "SELECT quality, count(*) AS n_rows FROM labels GROUP BY quality"),
]
