"""WARC: resolution of not-modified revisits.

A revisit record of the profile server-not-modified holds only headers. It stands for the
latest full response of the same canonical URL captured before it (an as-of join), provided
that a validator agrees: entity tags if the revisit sends one (weak comparison), else the time
of last modification. The resolved record has the response's payload and its headers, of which
the revisit overrides those that a 304 response may carry.

The as-of join has two levels, so that no URL's whole history meets in one task: within a
bucket of time a window carries the last response forward; across buckets the last response of
each bucket, one row each, is carried the same way.

Defined cases: a null URL has no canonical form, and such a revisit stays unresolved (`no-url`);
one without an earlier response is `no-response`; without a validator of its own `no-validator`,
and where the validators differ or the response has none `mismatch`. A null time sorts before all
others; equal times are ordered by record id, then by digest, length and headers. Headers that are null count as none; header names are compared in
lower case (the last of equal names, in order of their spelling, counts). Repeated rows are each resolved. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Header fields that a 304 response may carry.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track, and prefixes of hosts that name the same site; patterns that a caller may replace.
TRACKING, SAME_SITE = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)", r"(?:www\.|m\.)+"


def canonical_url(url: Column, tracking: str = TRACKING, same_site: str = SAME_SITE) -> Column:
    """Without scheme, user, a prefix of the host like www., its scheme's default port, fragment, tracking parameters and a trailing slash; host in lower case, parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    for scheme, port in (("http", 80), ("https", 443)):
        u = F.regexp_replace(u, rf"^((?i:{scheme})://[^/?]*):{port}([/?].*)?$", "$1$2")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", "")
    host = F.lower(F.regexp_extract(u, r"^//(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(host, f"^(?:{same_site})", "")
    rest = F.regexp_replace(u, r"^//[^/?]*", "")
    path = F.regexp_replace(F.split(rest, r"\?", 2)[0], "/+$", "")
    params = F.filter(F.split(F.coalesce(F.try_element_at(F.split(rest, r"\?", 2), F.lit(2)), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{tracking})(?:=|$)"))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lowered(headers: Column) -> Column:
    """A header map with names in lower case."""
    pairs = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(pairs, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(pairs, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, last)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, bucket_seconds: int = 86_400, tracking: str = TRACKING, same_site: str = SAME_SITE) -> DataFrame:
    """Every revisit among `records` (record_id, url, captured_at, kind, status, headers, digest, length), resolved.

    kind is "response" or "revisit"; only responses with status 200 count as full.
    Returns record_id, canonical, outcome (resolved by "etag" or "last-modified", else why
    not), refers_to, status, headers, digest and length of the response where resolved."""
    bucket = F.coalesce(F.floor(F.unix_timestamp("captured_at") / bucket_seconds), F.lit(-(2**62)))
    rows = records.select("record_id", canonical_url(F.col("url"), tracking, same_site).alias("canonical"), "captured_at", "kind", "status", _lowered(F.col("headers")).alias("headers"), "digest", "length").filter("kind = 'revisit' or (kind = 'response' and status = 200)")
    rows = rows.withColumn("bucket", bucket)
    full = F.when(F.col("kind") == "response", F.struct("record_id", "status", "headers", "digest", "length"))
    known = rows.filter("canonical is not null").withColumn("full", full)
    tie = F.struct("digest", "length", F.array_sort(F.map_entries("headers")).alias("h"))
    order = [F.col("captured_at").asc_nulls_first(), F.col("record_id").asc_nulls_first(), tie]
    inside = Window.partitionBy("canonical", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("inside", F.last("full", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    ends = known.filter("kind = 'response'").groupBy("canonical", "bucket").agg(F.max_by("full", F.struct(F.col("captured_at").isNotNull(), "captured_at", "record_id", tie)).alias("end"))
    needed = near.filter("inside is null").select("canonical", "bucket").distinct()
    steps = ends.unionByName(needed, allowMissingColumns=True).groupBy("canonical", "bucket").agg(F.first("end", ignorenulls=True).alias("end"))
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("carried is not null").select("canonical", "bucket", "carried")
    found = near.join(carried, ["canonical", "bucket"], "left").withColumn("r", F.coalesce("inside", "carried"))
    lost = rows.filter("kind = 'revisit' and canonical is null").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    columns = ["record_id", "canonical", "headers", "r"]
    found = found.select(columns).unionByName(lost.select(columns))
    own, past = F.col("headers"), F.col("r.headers")
    tag, time = own["etag"], own["last-modified"]
    by = F.when(tag.isNotNull() & (_strong(tag) == _strong(past["etag"])), "etag").when(tag.isNull() & (time == past["last-modified"]), "last-modified")
    outcome = F.when(F.col("canonical").isNull(), "no-url").when(F.col("r").isNull(), "no-response").when(tag.isNull() & time.isNull(), "no-validator").otherwise(F.coalesce(by, F.lit("mismatch")))
    found = found.withColumn("outcome", outcome)
    done = F.col("outcome").isin("etag", "last-modified")
    sent = F.map_filter(own, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(past, lambda k, v: ~F.array_contains(F.map_keys(sent), k)), sent)
    return found.select("record_id", "canonical", "outcome", *[F.when(done, c).alias(n) for n, c in (("refers_to", F.col("r.record_id")), ("status", F.col("r.status")), ("headers", merged), ("digest", F.col("r.digest")), ("length", F.col("r.length")))])


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """The resolved revisits with the payload of the response that each refers to."""
    return resolved.filter("refers_to is not null").join(records.select(F.col("record_id").alias("refers_to"), "payload"), "refers_to")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from the table pages, whose rows have no times or headers of their own and hardly a URL twice.

    Page ids are minutes; every third page or so is a revisit. The first number in a URL is taken modulo 20, so that
    URLs recur; entity tags and times of last modification follow from it, so that some agree and some do not."""
    mark = (F.col("page_id") % 999_983) * 7_919 % 104_729
    number = F.coalesce(F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("long"), F.lit(0))
    revisit = mark % 3 == 0
    tag = F.when(mark % 5 < 3, F.concat(F.when(mark % 2 == 0, F.lit("W/")).otherwise(F.lit("")), F.lit('"'), (number % 4 + mark % 2).cast("string"), F.lit('"')))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    entries = F.array(
        entry("ETag", tag),
        entry("Last-Modified", F.when(mark % 7 < 4, (number % 3 + mark % 2).cast("string"))),
        entry("Date", F.col("page_id").cast("string")),
        entry("Content-Type", F.when(revisit, "text/plain").otherwise("text/html")),
    )
    return pages.select(
        F.col("page_id").alias("record_id"),
        F.regexp_replace(F.col("url"), F.lit("/[0-9]+"), F.concat(F.lit("/"), (number % 20).cast("string"))).alias("url"),
        F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("page_id")).alias("captured_at"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, 304).otherwise(200).alias("status"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("headers"),
        F.sha2("html", 256).alias("digest"),
        F.octet_length("html").cast("long").alias("length"),
    )
