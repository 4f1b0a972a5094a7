"""Resolution of not-modified revisits in web archives.

A revisit record holds no body: the server answered 304. Its body is that of the latest earlier full
response for the same canonical URL, if the validators agree. The as-of join works on narrow
rows. Time is cut into stretches; a window sees one URL in one stretch, and the last response
of earlier stretches comes from a window over one row per URL and stretch. Bodies join last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.session import cut

#: Query parameters that track visitors and do not name a resource.
TRACKING = ("ref", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "sessionid", "sid")
#: Fields of a 304 answer that describe its own message and never replace stored ones.
OWN_FIELDS = (
    "content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, tracking parameters and last slash.

    The host is lower-cased and the parameters are sorted. NULL, and NULL for texts without ``//host``.
    """
    pattern = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#\s]*)([^?#]*)(?:\?([^#]*))?"
    scheme, host, path, params = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3, 4))
    host = F.regexp_replace(F.lower(F.regexp_replace(host, "^.*@", "")), r"^www\.", "")
    port = F.when(F.lower(scheme) == "http", F.lit(":80")).when(F.lower(scheme) == "https", F.lit(":443")).otherwise(F.lit(":"))
    host = F.regexp_replace(host, F.concat(port, F.lit("$")), F.lit(""))
    kept = F.filter(
        F.split(params, "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"),
    )
    query = F.array_join(F.array_sort(kept), "&")
    path = F.regexp_replace(F.rtrim(path), "/+$", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.regexp_extract(url, pattern, 2) != "", whole)


def status_code(http: Column) -> Column:
    """The status of an HTTP message head; NULL if there is none."""
    found = F.regexp_extract(http, r"^HTTP/\S+\s+(\d{3})", 1)
    return F.when(found != "", found.cast("int"))


def headers(http: Column) -> Column:
    """Fields of an HTTP message head as a map; names in lower case, repeated fields joined by commas."""
    lines = F.filter(F.split(F.coalesce(http, F.lit("")), "\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(
        lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


def merged(stored: Column, fresh: Column) -> Column:
    """Stored fields updated with the permitted fields of the 304 answer."""
    update = F.map_filter(fresh, lambda k, v: ~k.isin(*OWN_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def _bare_tag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def latest_before(rows: DataFrame, stretch_seconds: int = 3600) -> DataFrame:
    """``rows(record_id, url, at, full, ...)`` with ``prior``: id of the latest full row of that url before ``at``.

    ``at`` is in microseconds. Of full rows with one time the largest id counts; rows at the same
    time as the revisit are not earlier.
    """
    rows = rows.withColumn("stretch", F.floor(F.col("at") / F.lit(stretch_seconds * 1_000_000)))
    here = F.when(F.col("full"), F.struct("at", "record_id"))
    inside = Window.partitionBy("url", "stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(here).over(inside))
    lasts = rows.groupBy("url", "stretch").agg(F.max(here).alias("last"))
    before = Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("url", "stretch", F.max("last").over(before).alias("far"))
    joined = rows.join(lasts, ["url", "stretch"])
    return joined.withColumn("prior", F.coalesce("near", "far")["record_id"]).drop("near", "far", "stretch")


def resolve_revisits(records: DataFrame, stretch_seconds: int = 3600) -> DataFrame:
    """``record_id, target_uri, date, prior, verdict, head, payload`` for every revisit record.

    ``records(record_id, warc_type, target_uri, date, http, payload)``. Full responses are
    ``response`` records of status 200. A revisit is ``resolved`` if the entity tags of both
    agree (weak comparison), or, where one lacks a tag, the Last-Modified fields; ``mismatch`` if they differ;
    ``unverified`` if they share no validator; ``missing`` if there is no earlier full response
    or no usable URL. ``head`` is then the merged fields and ``payload`` the stored body of resolved records, else
    NULL. NULL dates are never earlier and see nothing earlier. Repeated revisit rows all come
    back; record ids of full responses name one response, repeated rows count once. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = records.select(
        F.col("record_id").cast("string").alias("record_id"), "warc_type", "target_uri", "date",
        canonical_url(F.col("target_uri")).alias("url"), F.unix_micros(F.col("date").cast("timestamp")).alias("at"),
        headers(F.col("http")).alias("head"), status_code(F.col("http")).alias("status"), "payload",
    )
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    narrow = rows.where("warc_type in ('response', 'revisit')").select(
        "record_id", "warc_type", "target_uri", "date", "url", "at", F.coalesce(full, F.lit(False)).alias("full"),
        F.when(F.col("warc_type") == "revisit", F.col("head")).alias("fresh"),
    )
    known = F.col("url").isNotNull() & F.col("at").isNotNull()
    placed = latest_before(narrow.where(known).where("full or warc_type = 'revisit'"), stretch_seconds)
    columns = ["record_id", "target_uri", "date", "fresh", "prior"]
    visits = placed.where("warc_type = 'revisit'").select(*columns)
    lost = narrow.where(~known & (F.col("warc_type") == "revisit")).withColumn("prior", F.lit(None).cast("string"))
    visits = cut(visits.unionByName(lost.select(*columns)))
    stored = rows.where(full).select(F.col("record_id").alias("prior"), F.col("head").alias("stored"), F.col("payload").alias("body"))
    stored = stored.dropDuplicates(["prior"])
    both = visits.join(stored, "prior", "left")
    tag, other_tag = (_bare_tag(F.col(c)["etag"]) for c in ("fresh", "stored"))
    time, other_time = (F.col(c)["last-modified"] for c in ("fresh", "stored"))
    verdict = (
        F.when(F.col("stored").isNull(), "missing")
        .when(tag.isNotNull() & other_tag.isNotNull(), F.when(tag == other_tag, "resolved").otherwise("mismatch"))
        .when(time.isNotNull() & other_time.isNotNull(), F.when(time == other_time, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    both = both.withColumn("verdict", verdict)
    resolved = F.col("verdict") == "resolved"
    return both.select(
        "record_id", "target_uri", "date", "prior", "verdict",
        F.when(resolved, merged(F.col("stored"), F.col("fresh"))).alias("head"), F.when(resolved, F.col("body")).alias("payload"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two archive records per page: the full response, and a 304 revisit of the same URL a day later.

    Captures follow the page ids minute by minute. The tag is a digest of the body, so a revisit
    whose URL has meanwhile returned another page does not match.
    """
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    full = pages.select(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"),
        captured.alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: "), tag, F.lit("\r\nCache-Control: max-age=60\r\nContent-Length: "),
            F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"),
        ).alias("http"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), F.lit("revisit").alias("warc_type"),
        F.concat(F.col("url"), F.lit("#again")).alias("target_uri"), (captured + F.expr("interval 1 day")).alias("date"),
        F.concat(
            F.lit("HTTP/1.1 304 Not Modified\r\nETag: W/"), tag,
            F.lit("\r\nCache-Control: max-age=600\r\nContent-Length: 0\r\nAge: "), (F.col("page_id") % 60).cast("string"), F.lit("\r\n\r\n"),
        ).alias("http"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)
