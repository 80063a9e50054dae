"""Resolution of not-modified revisits in web archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textorbit.session import cut

#: Header fields that a not-modified answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: A range of the sorted records has about so many.
RANGE_ROWS = 1_000_000


def canonical_url(url: Column) -> Column:
    """Host, path and query in one form, so that spellings of an address agree.

    The scheme, ``www.``, default ports, fragment, ``utm_`` parameters and a path's last slash
    go; the host is in lower case and parameters are sorted.  Null where there is no host.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(plain, "[?](.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, fresh: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """Stored header fields, with the permitted ones of the fresh answer in their place."""
    fresh = F.map_filter(fresh, lambda k, v: k.isin(*permitted))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, fresh)


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Join each revisit to the latest earlier full response of its address.

    ``records`` has ``record_id`` (long), ``url``, ``date`` (timestamp), ``kind`` ("response" or
    "revisit") and ``headers`` (map from lower-case names).  Returns a row per revisit:
    ``record_id``, ``url_key``, ``date``, ``response_id``, ``response_date``, ``status`` and ``headers``.

    ``status`` is ``resolved`` if the validators agree: the entity tag, compared weakly, or
    where the revisit has none the last-modified date.  It is ``mismatch`` if they differ or
    the response has none to compare, ``no_validator`` if the revisit has none,
    ``no_response`` if no earlier response is there, ``no_key`` if the address or date is null
    or has no host.  Only a resolved revisit has ``headers``: the response's, renewed by
    the permitted ones of the revisit.  Earlier means an earlier date; of responses at one
    date the largest id counts.  Repeated rows are revisits or responses of their own, other kinds and
    columns don't matter, null headers are none, and an empty table gives no row.

    Records are dealt into ranges of address and date, so an address with a third of all
    records spans many ranges.  Each range is scanned for itself; what its first address
    had in earlier ranges comes from one row per range.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        F.col("date"),
        (F.col("kind") == "response").alias("full"),
        F.coalesce("headers", empty).alias("headers"),
    )
    keyed = rows.where("url_key is not null and date is not null")
    ranges = max(1, records.count() // RANGE_ROWS, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["url_key", "date", "full", "record_id"]
    keyed = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    keyed = cut(keyed.withColumn("part", F.spark_partition_id()))
    answer = F.struct("record_id", "date", "headers")
    before = Window.partitionBy("part", "url_key").orderBy("date", "full", "record_id")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    found = keyed.withColumn("near", F.last(F.when(F.col("full"), answer), ignorenulls=True).over(before))
    ends = keyed.groupBy("part").agg(F.min("url_key").alias("first"), F.max("url_key").alias("last"))
    ends = cut(ends)
    last = ends.select("part", F.col("last").alias("url_key"))
    tails = keyed.where("full").join(last, ["part", "url_key"]).groupBy("part", "url_key")
    tails = tails.agg(F.max_by(answer, F.struct("date", "record_id")).alias("tail"))
    heads = ends.select("part", F.col("first").alias("url_key"), F.lit(None).cast(tails.schema["tail"].dataType).alias("tail"))
    earlier = Window.partitionBy("url_key").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    far = heads.unionByName(tails).withColumn("far", F.last("tail", ignorenulls=True).over(earlier))
    far = far.groupBy("part", "url_key").agg(F.max_by("far", "far.date").alias("far"))
    found = found.where("not full").join(far, ["part", "url_key"], "left")
    found = found.withColumn("answer", F.coalesce("near", "far"))
    # a response at the revisit's own date sorts after it, so both are strictly earlier
    lost = rows.where("not full and (url_key is null or date is null)")
    lost = lost.withColumn("answer", F.lit(None).cast(found.schema["answer"].dataType))
    columns = ["record_id", "url_key", "date", "headers", "answer"]
    out = found.select(*columns).unionByName(lost.select(*columns))
    tag, theirs = F.col("headers")["etag"], F.col("answer.headers")["etag"]
    since, dated = F.col("headers")["last-modified"], F.col("answer.headers")["last-modified"]
    same = F.when(tag.isNotNull(), _weak(tag) == _weak(theirs)).otherwise(since == dated)
    status = (
        F.when(F.col("url_key").isNull() | F.col("date").isNull(), "no_key")
        .when(F.col("answer").isNull(), "no_response")
        .when(tag.isNull() & since.isNull(), "no_validator")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    merged = merged_headers(F.col("answer.headers"), F.col("headers"), permitted)
    return out.withColumn("status", status).select(
        "record_id",
        "url_key",
        "date",
        F.col("answer.record_id").alias("response_id"),
        F.col("answer.date").alias("response_date"),
        "status",
        F.when(F.col("status") == "resolved", merged).alias("headers"),
    )
