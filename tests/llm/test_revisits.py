import datetime as dt
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from foliant.llm import revisits, warc
from tests.llm.conftest import same_rows

SCHEMA = "record_id long, url string, captured_at timestamp, kind string, status int, headers map<string,string>, digest string, length long, payload string, outcome string"


def test_canonical_url(spark):
    cases = {
        "HTTP://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#top": "example.com/a/b?a=1&b=2",
        "https://m.example.com/": "example.com",
        "https://user@Example.com/A?ref=1": "example.com/A",
        "//example.com:8080/x": "example.com:8080/x",
        "": "",
    }
    frame = spark.createDataFrame([*((k,) for k in cases), (None,)], "url string").select("url", revisits.canonical_url(F.col("url")).alias("c"))
    assert {r["url"]: r["c"] for r in frame.collect()} == {**cases, None: None}


def test_canonical_rules_are_parameters_and_ports_belong_to_schemes(spark):
    cases = {"http://m.a.com:443/?ref=1": "m.a.com:443?ref=1", "https://www.a.com:443/?utm_x=1": "a.com", "HTTPS://a.com:443": "a.com", "https://a.com:80/x": "a.com:80/x", "http://a.com:8080": "a.com:8080"}
    frame = spark.createDataFrame([(k,) for k in cases], "url string").select("url", revisits.canonical_url(F.col("url"), "utm_[a-z]+", r"www\.").alias("c"))
    assert {r["url"]: r["c"] for r in frame.collect()} == cases


def test_equal_ids_and_times_have_an_order(spark):
    at = dt.datetime(2024, 1, 1)
    full = [(1, "u", at, "response", 200, {"etag": "a"}, d, n, "p", "x") for d, n in (("d2", 1), ("d1", 7), ("d2", 2), (None, 9))]
    rows = [*full, (2, "u", at, "revisit", 304, {"etag": "a"}, "", 0, "", ""), (3, "u", at + dt.timedelta(days=9), "revisit", 304, {"etag": "a"}, "", 0, "", "")]
    for n in (1, 2, 5):
        found = revisits.resolve(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()
        assert {(r["record_id"], r["digest"], r["length"]) for r in found} == {(2, "d2", 2), (3, "d2", 2)}


def record(kind, uri, date, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{uri}:{date}>", "WARC-Target-URI": uri, "WARC-Date": date, **more, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    payloads = [bytes(range(256)) * 40, b"", b"caf\xc3\xa9\r\n\r\nmore", b"x" * 70_000]
    http = lambda status, tag, body=b"": f"HTTP/1.1 {status} X\r\nETag: {tag}\r\nSet-Cookie: a\r\nset-cookie: b\r\nX-Long: one\r\n  two\r\n\r\n".encode() + body
    records = [record("warcinfo", "", "2024-01-01T00:00:00Z", b"software: x\r\n")]
    for k, body in enumerate(payloads):
        records.append(record("response", f"http://h/{k}", f"2024-01-02T00:00:0{k}Z", http(200, f'"{k}"', body)))
        records.append(record("revisit", f"http://h/{k}", f"2024-01-03T00:00:0{k}Z", http(304, f'W/"{k}"'), **{"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/server-not-modified"}))
    records.append(record("revisit", "http://h/0", "2024-01-04T00:00:00Z", b"", **{"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}))
    (tmp_path / "a.warc").write_bytes(b"".join(records[:4]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[4:])))
    (tmp_path / "empty.warc").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1000", before):  # cut into many splits, and whole
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = warc.read_records(spark, str(tmp_path))
        rows = found.collect()
        assert len(rows) == len(records) and all(r["whole"] and r["version"] == "1.0" for r in rows)
        captures = warc.captures(found)
        held = {r["url"]: r for r in captures.filter("kind = 'response'").collect()}
        assert {u: bytes(r["payload"]) for u, r in held.items()} == {f"http://h/{k}": p for k, p in enumerate(payloads)}
        assert held["http://h/0"]["headers"] == {"etag": '"0"', "set-cookie": "a, b", "x-long": "one two"} and held["http://h/0"]["digest"] == "sha1:" + hashlib.sha1(payloads[0]).hexdigest()
        done = {r["record_id"]: r for r in revisits.resolve(captures).collect()}
        assert {(r["outcome"], r["refers_to"], r["length"]) for r in done.values()} == {("etag", f"<urn:http://h/{k}:2024-01-02T00:00:0{k}Z>", len(p)) for k, p in enumerate(payloads)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def brute(rows):
    low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
    order = lambda r: (r[2] is not None, r[2] or dt.datetime.min, r[0])
    weak = lambda t: t.strip().removeprefix("W/") if t is not None else None
    for r in rows:
        if r[3] != "revisit":
            continue
        own, past = low(r[5]), sorted((x for x in rows if x[1] is not None and x[1] == r[1] and x[3] == "response" and x[4] == 200 and order(x) < order(r)), key=order)
        p = past[-1] if past else None
        old = low(p[5]) if p else {}
        tag, time = own.get("etag"), own.get("last-modified")
        if r[1] is None:
            out = "no-url"
        elif not p:
            out = "no-response"
        elif tag is None and time is None:
            out = "no-validator"
        elif tag is not None:
            out = "etag" if old.get("etag") is not None and weak(tag) == weak(old["etag"]) else "mismatch"
        else:
            out = "last-modified" if time == old.get("last-modified") else "mismatch"
        done = out in ("etag", "last-modified")
        merged = old | {k: v for k, v in own.items() if k in revisits.PERMITTED and v is not None}
        yield r[0], out, p[0] if done else None, tuple(sorted(merged.items())) if done else None, p[6] if done else None


def test_resolution_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        headers = {k: v for k, v in (("ETag", r.choice(['"a"', 'W/"a"', '"b"', None])), ("Last-Modified", r.choice(["1", "2"])), ("Date", str(i)), ("Content-Type", "x")) if r.random() < 0.7}
        rows.append((i, r.choice(["u", "v", "w", None]), None if r.random() < 0.03 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(400)), r.choice(["revisit", "response", "request"]), r.choice([200, 200, 404]), None if r.random() < 0.05 else headers, f"d{i}", i, f"p{i}", "clash"))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = revisits.resolve(frame)
    got = [(x["record_id"], x["outcome"], x["refers_to"], tuple(sorted(x["headers"].items())) if x["headers"] is not None else None, x["digest"]) for x in found.collect()]
    wanted = list(brute(rows))
    assert len({w[1] for w in wanted}) == 6
    same_rows(got, wanted)
    assert {x["refers_to"]: x["payload"] for x in revisits.with_payload(found, frame).collect()} == {w[2]: f"p{w[2]}" for w in wanted if w[2] is not None}
    assert revisits.resolve(frame.limit(0)).count() == 0
