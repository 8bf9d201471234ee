"""WARC records against plain loops and a plain parser: round trips, revisits, predicates, gzip, broken files, nulls, repeats, empty tables."""

import gzip
import hashlib
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

PAGES = "page_id long, url string, html string, payload string, record_id string, last string, copies long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "r", "l", 1, "k") for r in rows], PAGES)


LONG = "<p>" + "é" * 600 + "</p>"
ROWS = [
    (1, "http://a/1", LONG), (9, "http://a/9", LONG), (4, None, LONG), (None, "http://n", LONG), (9, "http://again", LONG), (5, "http://x\r\nWARC-Type: fake", "x" * 999),
    (6, "http://y", "x" * 999), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (10, "u", None), (11, "u", ""), (12, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 60),
    (13, "u", "y" * 3_000_000), (None, None, None),
]


def loop(rows):
    out = []
    last = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000:
            last[p] = max(last.get(p, -1), -1 if i is None else i)
    told = set()
    for i, _, html in rows:
        p = (html or "").encode()
        again = p in last and ((-1 if i is None else i) != last[p] or p in told)
        if p in last and not again:
            told.add(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again and last[p] >= 0 else None))
    return out


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(frame(spark, ROWS)), path, compression=compression, maxFileBytes="2000")
    got = warc.read(spark, path)
    page = lambda c: warc.page_key(F.col(c)).cast("long")
    rows = got.select(page("record_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to")).collect()
    assert Counter(map(tuple, rows)) == Counter(loop(ROWS))
    whole = {(r.page, r.payload.decode()) for r in got.where("record_type = 'response'").select(page("record_id").alias("page"), "payload").collect()}
    assert whole >= {(i, t or "") for i, _, t in ROWS if i not in (1, 4, 9, 7, None)}
    urls = Counter(r.target_uri for r in got.select("target_uri").collect())
    assert urls == Counter(u.replace("\r", "%0D").replace("\n", "%0A") if u else u for _, u, _ in ROWS)
    names = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(names) > 3 and all(f.endswith(".warc.gz" if compression == "gzip" else ".warc") for f in names)


def test_predicates_reach_the_source(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(frame(spark, ROWS)), path)
    columns = "record_type string, target_uri string, refers_to string, payload_bytes long"
    every = spark.createDataFrame(warc.read(spark, path, columns).collect(), columns)
    for test in ("record_type = 'revisit'", "target_uri LIKE 'http://a%'", "target_uri IS NULL", "record_type IN ('revisit', 'x') AND refers_to IS NOT NULL", "target_uri <> 'u'",
                 "NOT (record_type <=> 'revisit')", "target_uri > 'http://n' OR payload_bytes > 5", "payload_bytes = 999 AND record_type = 'response'"):
        assert Counter(map(tuple, warc.read(spark, path, columns, test).collect())) == Counter(map(tuple, every.where(test).collect())), test
    reader = warc.SelectiveReader({"path": path}, ["record_type", "payload"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3), EqualTo(("headers", "x"), "y")]))
    assert left == [GreaterThan(("payload_bytes",), 3), EqualTo(("headers", "x"), "y")] and len(reader.wanted) == 1


def test_branches_keep_their_own_predicates(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(frame(spark, ROWS)), path)
    for one in (warc.read(spark, path, "record_type string, record_id string"), warc.read(spark, path, "record_type string, record_id string", "record_type <> 'x'")):
        parts = [one.where(F.col("record_type") == k) for k in ("response", "revisit")]
        assert parts[0].count() + parts[1].count() == one.count() == len(ROWS)
        assert Counter(map(tuple, parts[0].unionByName(parts[1]).collect())) == Counter(map(tuple, one.collect()))
        assert parts[0].alias("a").join(one.alias("b"), "record_id").count() == parts[0].count()


def test_unwanted_payloads_are_not_read(tmp_path):
    """With the predicate, the bytes read from a file are its headers, not its payloads."""
    import io

    writer = warc.WarcWriter({"path": str(tmp_path)}, False)
    body = b"".join(writer.record({"record_id": f"urn:{i}", "record_type": "response" if i % 50 else "warcinfo", "payload": b"z" * 500_000}) for i in range(100))

    class Counted(io.BytesIO):
        seen = 0

        def readinto(self, into):
            n = super().readinto(into)
            Counted.seen += n
            return n

    test = warc.predicate(warc.EqualTo(("record_type",), "warcinfo"))
    stream = io.BufferedReader(Counted(body), 4096)
    rows = list(warc.records(stream, ["record_id", "payload"], [test], "x"))
    assert [r[0] for r in rows] == ["urn:0", "urn:50"] and len(rows[0][1]) == 500_000
    assert Counted.seen < 3_000_000 < len(body)


def test_foreign_files(spark, tmp_path):
    """Files of other writers: no manifest, folded headers, other record types, bodies that are no HTTP."""
    one = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nX-Note: a\r\n  b\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Type: application/http\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = warc.read(spark, str(tmp_path)).collect()
    assert Counter((r.record_type, r.record_id, bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got) == Counter(
        {("warcinfo", "urn:1", b"hello", 5, None): 2, ("response", None, b"abc", 3, "00" * 20): 2}
    )
    assert {r.headers["X-Note"] for r in got if r.record_id} == {"a b"}


@pytest.mark.parametrize("tail", [b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort", b"no record\r\n"])
@pytest.mark.parametrize("columns", ["record_type string", "payload binary"])
def test_broken_files_are_told(spark, tmp_path, tail, columns):
    (tmp_path / "a.warc").write_bytes(tail)
    with pytest.raises(Exception, match="a.warc"):
        warc.read(spark, str(tmp_path), columns).collect()


def test_only_listed_files_count(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(frame(spark, ROWS[:2])), path)
    (tmp_path / "w" / "part-lost.warc").write_bytes(b"left by a lost task")
    assert warc.read(spark, path, "record_type string").count() == 2
    warc.write(warc.page_records(frame(spark, ROWS[:1])), path)
    assert warc.read(spark, path, "record_type string").count() == 3
    warc.write(warc.page_records(frame(spark, ROWS[:1])), path, mode="overwrite")
    assert warc.read(spark, path, "record_type string").count() == 1
    assert sum(len(json.loads((tmp_path / "w" / f).read_bytes())) for f in os.listdir(path) if f.startswith("_manifest-")) == 1


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(frame(spark, [])), path)
    assert warc.read(spark, path).collect() == []
