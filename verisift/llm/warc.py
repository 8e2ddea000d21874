"""Not-modified revisits of web archives: each is resolved to the latest earlier full response of its canonical URL.

A record is (record_id, kind, target_uri, fetched, headers, payload): ``kind`` is response or revisit, ``fetched`` a
timestamp, ``headers`` a map. The as-of join runs in two levels, so that a URL with any number of captures is spread:
captures of one URL and time slot are put in order by a window, and the slots of a URL, which have one row each, carry
the last response on to later slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Seconds of a time slot.
SLOT = 600
#: Headers of a 304 answer that replace those of the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(uri: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, ``/`` for an empty path; other strings unchanged."""
    head = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(head == "", uri).otherwise(F.concat(host, path))


def _lower_keys(headers: Column) -> Column:
    """The map with names in lower case; of names that differ in case only, the last one's value."""
    entries = F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(
        lowered,
        F.expr("cast(map() as map<string,string>)"),
        lambda done, e: F.map_concat(
            F.map_filter(done, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))
        ),
    )


def _validators(headers: Column) -> tuple[Column, Column]:
    """Entity tag without its weak mark, and the date of the last change."""
    return F.regexp_replace(headers["etag"], "^W/", ""), headers["last-modified"]


def latest_responses(captures: DataFrame) -> DataFrame:
    """``captures(record_id, url, micros, is_response)`` of revisits with ``response_id``, null without one."""
    slotted = captures.withColumn("slot", F.floor(F.col("micros") / F.lit(SLOT * 1_000_000)))
    response = F.when(F.col("is_response"), F.struct("micros", "record_id"))
    slots = slotted.groupBy("url", "slot").agg(F.max(response).alias("latest"))
    before = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("url", "slot", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    earlier = Window.partitionBy("url", "slot").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    near = slotted.withColumn("near", F.max(response).over(earlier)).filter(~F.col("is_response"))
    return near.join(slots, ["url", "slot"]).select(
        "record_id", F.coalesce("near.record_id", "carried.record_id").alias("response_id")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per revisit: record_id, url, response_id, status, headers, payload.

    The response is the one of the same canonical URL fetched last before the revisit (at equal times the greater id).
    Status: ``validated`` if entity tags agree (weakly), or without one in the revisit the dates of the last change;
    ``mismatch`` if they do not, ``unverified`` if the revisit has neither, ``no_response`` without a response. Headers
    are those of the response with the permitted ones of the revisit on top, and the payload is the response's; with
    ``mismatch`` and ``no_response`` they are the revisit's own headers and null. Names of headers become lower case.
    A null URL or time finds no response; null headers are none. Record ids must be unique; repeated rows of a
    response count once, those of a revisit stay. Other columns are not carried; an empty table gives no rows.
    """
    kept = records.select(
        "record_id",
        "kind",
        canonical_url(F.col("target_uri")).alias("url"),
        F.unix_micros("fetched").alias("micros"),
        F.col("headers"),
        F.col("payload"),
    )
    captures = kept.filter("url IS NOT NULL AND micros IS NOT NULL").select(
        "record_id", "url", "micros", (F.col("kind") == "response").alias("is_response")
    )
    found = latest_responses(captures).groupBy("record_id").agg(F.max("response_id").alias("response_id"))
    revisits = kept.filter("kind = 'revisit'").select("record_id", "url", _lower_keys(F.col("headers")).alias("own"))
    responses = (
        kept.filter("kind = 'response'")
        .select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("payload"))
        .dropDuplicates(["response_id"])
    )
    joined = (
        revisits.join(found, "record_id", "left")
        .join(responses, "response_id", "left")
        .withColumn("stored", F.when(F.col("response_id").isNotNull(), _lower_keys(F.col("stored"))))
    )
    tag, changed = _validators(F.col("own"))
    stored_tag, stored_changed = _validators(F.col("stored"))
    agrees = F.when(tag.isNotNull(), F.coalesce(tag == stored_tag, F.lit(False))).otherwise(
        F.coalesce(changed == stored_changed, F.lit(False))
    )
    status = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(tag.isNull() & changed.isNull(), "unverified")
        .when(agrees, "validated")
        .otherwise("mismatch")
    )
    updates = F.map_filter("own", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(updates, k)), updates)
    usable = F.col("status").isin("validated", "unverified")
    return joined.withColumn("status", status).select(
        "record_id",
        "url",
        "response_id",
        "status",
        F.when(usable, merged).otherwise(F.col("own")).alias("headers"),
        F.when(usable, F.col("payload")).alias("payload"),
    )
