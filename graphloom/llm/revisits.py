"""Resolution of not-modified revisits in web archives.

A capture with status 304 has no body of its own: it stands for the latest earlier full response (status 200) of
the same canonical URL. This is an as-of join. It keeps hot URLs out of single tasks: quantiles of the time over
all captures cut the time into SLICES slices of equal numbers of captures, the last response of each URL in each
slice is carried on to the URL's next slices (at most SLICES rows a URL), and inside a slice a window looks back
to the last response or else to the one carried in.

Then validators are checked (a 304's ETag by weak comparison, else its Last-Modified; without either the
response is taken as it is), and the header fields that a 304 may renew are merged into the response's.

Outcomes: ``merged``, ``changed`` (a validator differs), ``orphan`` (no earlier response).

Cases: an earlier response is one with a smaller time; of several at one time the one with the largest
record_id; a null URL or time makes an orphan; null headers are none; names of fields are compared in lower case
and may repeat; repeated revisits come back as often as they stand; an empty table gives no rows. Captures that
are neither 200 nor 304 take no part. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 512
#: Fixed values (HTTP caching, RFC 9111 section 3.2): fields that a 304 does not renew.
NOT_RENEWED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade",
)
#: Parameters of URLs that only track visitors.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|ref)="


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, fragment, tracking parameters and a slash at the end; the host in lower case;
    parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _field(headers: str, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def _lowered(headers: Column) -> Column:
    return F.transform(F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))


def earlier_response(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """``captures(record_id, key, ts, status)`` with response_id for each revisit: the as-of join."""
    rows = captures.select("record_id", "key", "ts", "status").where("key IS NOT NULL AND ts IS NOT NULL")
    cuts = rows.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 10 * slices).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # the number of cuts at or below ts, by halves
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    at = F.array(*[F.lit(c).cast("long") for c in cuts])
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, w: F.when(F.get(at, low + w - 1) <= F.col("ts"), low + w).otherwise(low)) if cuts else F.lit(0)
    rows = rows.withColumn("slice", place)
    is_response = F.col("status") == 200
    response = F.when(is_response, F.struct("ts", "record_id"))
    last = rows.where(is_response).groupBy("key", "slice").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    needed = rows.where(~is_response).select("key", "slice").distinct()
    both = last.join(needed, ["key", "slice"], "full")
    carried = both.select("key", "slice", F.last("last", True).over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = Window.partitionBy("key", "slice").orderBy("ts", F.when(is_response, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.select("record_id", "key", "ts", "status", "slice", F.last(response, True).over(before).alias("seen")).where(~is_response)
    return seen.join(carried, ["key", "slice"], "left").select("record_id", "key", "ts", F.coalesce("seen", "carried")["record_id"].alias("response_id"))


def resolve(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """record_id, key, response_id, outcome, headers, payload of every revisit in ``captures(record_id, url, ts
    long, status, headers array<struct<name, value>>, payload)``. Record ids tell captures apart."""
    all_of = captures.where(F.col("status").isin(200, 304)).select("record_id", canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "status", _lowered(F.col("headers")).alias("headers"), "payload")
    revisits = all_of.where("status = 304")
    found = earlier_response(all_of, slices).where("response_id IS NOT NULL").select("record_id", "response_id").distinct()
    responses = all_of.where("status = 200").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), F.col("payload").alias("body")).dropDuplicates(["response_id"])
    joined = revisits.select("record_id", "key", "headers").join(found, "record_id", "left").join(responses, "response_id", "left")
    strong = lambda x: F.regexp_replace(F.trim(x), "^W/", "")
    tag, since = _field("headers", "etag"), _field("headers", "last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(strong(tag) == strong(_field("stored", "etag")), F.lit(False))).when(since.isNotNull(), F.coalesce(since == _field("stored", "last-modified"), F.lit(False))).otherwise(True)
    outcome = F.when(F.col("response_id").isNull(), "orphan").when(same, "merged").otherwise("changed")
    renewing = F.filter("headers", lambda h: ~h["name"].isin(*NOT_RENEWED))
    names = F.transform(renewing, lambda h: h["name"])
    merged = F.array_sort(F.concat(F.filter("stored", lambda h: ~F.array_contains(names, h["name"])), renewing))
    ok = F.col("outcome") == "merged"
    return joined.withColumn("outcome", outcome).select("record_id", "key", "response_id", "outcome", F.when(ok, merged).otherwise(F.array_sort("headers")).alias("headers"), F.when(ok, F.col("body")).alias("payload"))
