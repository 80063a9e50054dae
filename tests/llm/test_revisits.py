import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textorbit.llm import revisits

SCHEMA = "record_id long, url string, date timestamp_ntz, kind string, headers map<string,string>"
DAY = datetime(2024, 1, 1)


def plain(rows):
    """Last earlier response and status of each revisit; keys are given, not computed."""
    out = {}
    for rid, key, date, kind, headers in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        full = [r for r in rows if r[3] == "response" and r[1] == key and r[2] and date and r[2] < date] if key else []
        best = max(full, key=lambda r: (r[2], r[0]), default=None)
        stored = dict((best and best[4]) or {})
        tag, since = headers.get("etag"), headers.get("last-modified")
        if not key or not date:
            status = "no_key"
        elif not best:
            status = "no_response"
        elif tag is None and since is None:
            status = "no_validator"
        elif tag is not None:
            theirs = stored.get("etag")
            status = "resolved" if theirs and tag.removeprefix("W/") == theirs.removeprefix("W/") else "mismatch"
        else:
            status = "resolved" if since == stored.get("last-modified") else "mismatch"
        merged = stored | {k: v for k, v in headers.items() if k in revisits.PERMITTED}
        out[rid] = (best and best[0], status, merged if status == "resolved" else None)
    return out


def got(rows):
    return {r.record_id: (r.response_id, r.status, r.headers) for r in rows.collect()}


def test_hot_address_over_many_ranges(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        key = rng.choice(["hot.example/a"] * 6 + ["b.example", "c.example/x?y=1"])
        headers = {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "last-modified": rng.choice("mn"), "content-length": "5"}
        headers = {k: v for k, v in headers.items() if rng.random() < 0.7}
        kind = rng.choice(["response"] + ["revisit"] * 4)
        rows.append((i, key, DAY + timedelta(minutes=rng.randrange(200)), kind, headers))
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as near", "3 as full").repartition(5)
    assert got(revisits.resolve_revisits(table)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, "a.example", DAY, "response", None),
        (2, "a.example", DAY, "revisit", {"etag": "x"}),
        (3, "a.example", None, "revisit", {"etag": "x"}),
        (4, None, DAY, "revisit", None),
        (5, "", DAY, "revisit", None),
        (6, "a.example", DAY + timedelta(1), "revisit", {"etag": "x"}),
        (7, "a.example", DAY + timedelta(1), "revisit", None),
        (8, "a.example", None, "response", {"etag": "x"}),
        (9, "a.example", DAY + timedelta(2), "request", None),
        (10, "b.example", DAY, "response", {"etag": "y"}),
        (11, "b.example", DAY, "response", {"etag": "z", "vary": "a"}),
        (12, "b.example", DAY + timedelta(1), "revisit", {"etag": "W/z", "vary": "b", "connection": "close"}),
        (12, "b.example", DAY + timedelta(1), "revisit", {"etag": "W/z", "vary": "b", "connection": "close"}),
    ]
    result = revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA))
    assert result.count() == 8
    assert got(result) == plain(rows)
    assert got(result)[12] == (11, "resolved", {"etag": "W/z", "vary": "b"})
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_addresses(spark):
    same = ["http://a.example/x/", "HTTPS://www.A.example:443/x#top", "a.example/x?utm_source=f", " http://A.EXAMPLE:80/x "]
    other = ["http://a.example/X", "http://a.example:81/x", "http://a.example/x?b=2&a=1", "http://a.example/x?a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in same + other], "u string")
    keys = {r.u: r.k for r in rows.withColumn("k", revisits.canonical_url(F.col("u"))).collect()}
    assert {keys[u] for u in same} == {"a.example/x"}
    assert [keys[u] for u in other] == ["a.example/X", "a.example:81/x", "a.example/x?a=1&b=2", "a.example/x?a=1&b=2"]
