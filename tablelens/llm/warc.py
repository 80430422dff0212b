"""Not-modified revisits of a web archive resolved to the full responses they stand for (7).

A revisit record says "as before". It takes the latest earlier full response of the same
canonical URL, if its validators agree (entity tag; without one on both sides, the
modification date), and that response's headers updated by those a 304 may change.

The as-of join works on keys only: all records are range-partitioned by (URL, time, id), so
a URL that holds a third of the records spans many partitions. Inside a partition a
window carries the last full response forward; between partitions one row per (partition,
URL) does. Bodies move once, for the responses that are referred to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import register, table, written

#: header fields that a not-modified answer doesn't update (HTTP caching rules; connection fields included)
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
               "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a closing slash, sorted query without utm_ fields; no scheme or fragment."""
    plain = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))


def _tag(headers: str) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    new = F.map_filter(fresh, lambda k, v: ~k.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, at, refers_to, outcome, headers, body.

    ``records`` has record_id, url, at (orderable), kind ('response' or 'revisit'), headers
    (map with lower-case names) and body. "Earlier" goes by (at, record_id). Every revisit row has its own
    result, also where records repeat; full responses that repeat, equal but for the body, count as one
    with the smallest body. outcome is
    'resolved', 'validator_mismatch', 'no_validator' or 'no_earlier_response'; only
    'resolved' has refers_to, headers and body. Null URL or time: no earlier response;
    null headers count as none. Other columns are ignored; empty table: empty result.
    """
    rows = records.select("record_id", "url", "at", "kind",
                          F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "body")
    # tells records of one id apart; equal rows share it
    copy = F.xxhash64("url", "at", "kind", F.array_sort(F.map_entries("headers")))
    rows = rows.select("record_id", copy.alias("copy"), canonical_url(F.col("url")).alias("canonical_url"), "at", "kind", "headers", "body")
    keys = rows.select("record_id", "copy", "canonical_url", "at", (F.col("kind") == "response").alias("full"),
                       _tag("headers").alias("tag"), F.element_at("headers", "last-modified").alias("modified"))
    timed = keys.where("canonical_url IS NOT NULL AND at IS NOT NULL")
    placed = written(timed.repartitionByRange("canonical_url", "at", "record_id").withColumn("part", F.spark_partition_id()))
    here = F.when(F.col("full"), F.struct("record_id", "copy", "tag", "modified"))
    inside = Window.partitionBy("part", "canonical_url").orderBy("at", "record_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("found", F.last(here, ignorenulls=True).over(inside)).where(~F.col("full"))
    ends = placed.groupBy("part", "canonical_url").agg(F.max_by(here, F.when(F.col("full"), F.struct("at", "record_id", "copy"))).alias("end"))
    earlier = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select("part", "canonical_url", "carried")
    # rows that repeat a record lie in one partition: one of them stands for all
    seen = (local.dropDuplicates(["part", "record_id", "copy"]).join(carried, ["part", "canonical_url"])
            .withColumn("found", F.coalesce("found", "carried"))
            .select("record_id", "copy", F.col("found.record_id").alias("of"), F.col("found.copy").alias("of_copy"),
                    F.col("found.tag").alias("of_tag"), F.col("found.modified").alias("of_modified")))
    revisits = rows.where("kind = 'revisit'").select(
        "record_id", "copy", "canonical_url", "at", F.col("headers").alias("own"), _tag("headers").alias("tag"),
        F.element_at("headers", "last-modified").alias("modified"))
    same_record = F.col("record_id").eqNullSafe(F.col("seen_id")) & F.col("copy").eqNullSafe(F.col("seen_copy"))
    judged = revisits.join(seen.withColumnsRenamed({"record_id": "seen_id", "copy": "seen_copy"}), same_record, "left")
    by_tag = F.col("tag").isNotNull() & F.col("of_tag").isNotNull()
    by_date = F.col("modified").isNotNull() & F.col("of_modified").isNotNull()
    same = F.when(by_tag, F.col("tag") == F.col("of_tag")).when(by_date, F.col("modified") == F.col("of_modified"))
    outcome = (F.when(F.col("of").isNull(), "no_earlier_response").when(same.isNull(), "no_validator")
               .when(same, "resolved").otherwise("validator_mismatch"))
    resolved = F.col("outcome") == "resolved"
    judged = judged.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "at", "outcome", "own", F.when(resolved, F.col("of")).alias("refers_to"),
        F.when(resolved, F.col("of_copy")).alias("of_copy"))
    stored = (rows.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("copy").alias("of_copy"))
              .agg(F.first("headers").alias("kept"), F.min("body").alias("body")))
    out = judged.join(stored, ["refers_to", "of_copy"], "left")
    return out.select("record_id", "canonical_url", "at", "refers_to", "outcome",
                      F.when(F.col("refers_to").isNotNull(), merged_headers(F.col("kept"), F.col("own"))).alias("headers"), "body")


def capture_records(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl of ``pages``: each page answered in full, most asked again later, some before.

    Times and validators follow from the page id: every fifth revisit carries a stale tag, every
    third only a modification date.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (p % 97).cast("string"))
    full = pages.select((p * 4).alias("record_id"), "url", (p * 10).alias("at"), F.lit("response").alias("kind"), F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("etag", "last-modified", "content-type", "content-length", "cache-control")]),
        F.array(tag, day, F.lit("text/html"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("max-age=60"))).alias("headers"),
        F.col("html").alias("body"))

    def again(number: int, at: Column, which: Column) -> DataFrame:
        date = F.concat(F.lit("at "), at.cast("string"))
        tagged = F.map_from_arrays(F.array(F.lit("etag"), F.lit("content-length"), F.lit("cache-control"), F.lit("date")),
                                   F.array(F.when(p % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("0"), F.lit("max-age=120"), date))
        dated = F.map_from_arrays(F.array(F.lit("last-modified"), F.lit("content-length"), F.lit("date")), F.array(day, F.lit("0"), date))
        return pages.where(which).select((p * 4 + number).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), at.alias("at"),
                                         F.lit("revisit").alias("kind"), F.when(p % 3 == 0, dated).otherwise(tagged).alias("headers"),
                                         F.lit(None).cast("string").alias("body"))

    return full.unionByName(again(1, p * 10 + 5 + (p % 7) * 10_000, p % 4 != 0)).unionByName(again(2, p * 10 - 1, p % 6 == 1))


ORACLE_SQL = r"""
WITH c AS (SELECT page_id AS p, html, regexp_replace(url, '#.*$', '') AS u FROM pages),
h AS (SELECT p, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM c),
k AS (SELECT p, html, host, regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS f FROM h),
r AS (SELECT p, html, host || path || CASE WHEN len(f) > 0 THEN '?' || array_to_string(f, '&') ELSE '' END AS curl,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || CAST(p % 97 AS VARCHAR) AS day FROM k),
fulls AS (SELECT p * 4 AS id, curl, p * 10 AS ts, tag, day, html FROM r),
again AS (SELECT p * 4 + 1 AS id, curl, p * 10 + 5 + (p % 7) * 10000 AS ts, p, tag, day FROM r WHERE p % 4 <> 0
    UNION ALL SELECT p * 4 + 2, curl, p * 10 - 1, p, tag, day FROM r WHERE p % 6 = 1),
a AS (SELECT id, curl, ts, CASE WHEN p % 3 = 0 THEN NULL WHEN p % 5 = 0 THEN '"stale"' ELSE tag END AS tag,
    CASE WHEN p % 3 = 0 THEN day END AS day FROM again),
m AS (SELECT a.id, a.curl, a.ts, a.tag, a.day, max_by(fulls.id, (fulls.ts, fulls.id)) AS fid
    FROM a LEFT JOIN fulls ON a.curl = fulls.curl AND (fulls.ts < a.ts OR (fulls.ts = a.ts AND fulls.id < a.id)) GROUP BY ALL),
j AS (SELECT m.*, fulls.tag AS ftag, fulls.day AS fday, fulls.html, CASE WHEN m.fid IS NULL THEN 'no_earlier_response'
    WHEN m.tag IS NOT NULL THEN CASE WHEN m.tag = fulls.tag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN m.day = fulls.day THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
    FROM m LEFT JOIN fulls ON m.fid = fulls.id)
SELECT id AS record_id, curl AS canonical_url, ts AS captured_at, CASE WHEN outcome = 'resolved' THEN fid END AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || CASE WHEN tag IS NULL THEN 'max-age=60' ELSE 'max-age=120' END
    || chr(10) || 'content-length: ' || CAST(coalesce(strlen(html), 0) AS VARCHAR) || chr(10) || 'content-type: text/html'
    || chr(10) || 'date: at ' || CAST(ts AS VARCHAR) || chr(10) || 'etag: ' || CASE WHEN tag IS NULL THEN ftag ELSE 'W/' || tag END
    || chr(10) || 'last-modified: ' || fday END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5 FROM j
"""


@register("op7_warc_revisits", ORACLE_SQL)
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(capture_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "canonical_url", F.col("at").alias("captured_at"), "refers_to", "outcome", lines.alias("headers"),
                      F.when(F.col("refers_to").isNotNull(), F.md5(F.col("body").cast("binary"))).alias("payload_md5"))
