from __future__ import annotations

import base64
import hashlib
import random

import duckdb
import pytest

from gleanery.llm import warc
from gleanery.llm.common import fresh_path


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def test_loser_tree_merge():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(9), i, j) for j in range(rng.randrange(20))) for i in range(k)]
        got = list(warc.loser_tree_merge(runs, lambda x: x))
        assert got == sorted(x for r in runs for x in r)


def test_ties_keep_the_order_of_runs():
    runs = [[(1, "a"), (1, "b")], [(1, "c")], [(0, "d")]]
    assert [x[1] for x in warc.loser_tree_merge(runs, lambda x: x[0])] == ["d", "a", "b", "c"]


def test_record_round_trip():
    payload = b"<p>\r\n\r\n</p>" * 3
    got = warc.parse(warc.record("response", 7, "http://a.b/c d", "2024-01-01T00:00:00Z", digest(payload), payload, None))
    assert (got["page_id"], got["payload"], got["payload_bytes"], got["url"]) == (7, payload, len(payload), "http://a.b/cd")
    got = warc.parse(warc.record("revisit", 3, None, "2024-01-01T00:00:00Z", digest(payload), payload, 7))
    assert (got["refers_to"], got["payload"], got["payload_bytes"], got["payload_digest"]) == (7, None, len(payload), digest(payload))
    with pytest.raises(ValueError, match="another payload"):
        warc.parse(warc.record("response", 7, "u", "t", digest(b"other"), payload, None))


def test_url_keys():
    assert warc.url_key("https://www.Example.com/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key(None) == ""
    assert warc.url_key("http://u:p@b.org:80?q") == "org,b)/?q"
    assert warc.url_key("No scheme") == "no scheme"


def test_streams_are_ascending_and_whole():
    rng = random.Random(2)
    captures = [("r%d" % rng.randrange(3), (rng.choice("abc"), "t", rng.choice([None, 1, 2]), "k", "d", "f", i, 1)) for i in range(300)]
    found = warc.streams(captures)
    assert all(warc.order_of(a) <= warc.order_of(b) for s in found for a, b in zip(s, s[1:], strict=False))
    assert sorted(map(str, (c for s in found for c in s))) == sorted(str(c) for _, c in captures)
    merged = list(warc.loser_tree_merge([iter(s) for s in found], warc.order_of))
    assert merged == sorted((c for _, c in captures), key=warc.order_of)


PAGES = [
    (1, "http://a.example.com/x", "same"), (2, "http://b.example.com/y", "same"), (3, "http://a.example.com/x", "other"), (4, None, None), (5, "http://c.example.com/", ""),
    (6, "http://a.example.com/x", "same"), (6, "http://a.example.com/x", "same"), (None, "http://n.example.com", "lost"), (8, "http://z.example.com/é?q=1", "é日本" * 5000),
    (1, "http://a.example.com/x", "twice"), (9, "http://a.example.com/x", "twice"), (9, "http://q.example.com/", "once"),
]


def archive(spark, rows, **more):
    pages = spark.createDataFrame(
        [(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, digest string, answer string, offset int"
    )
    folder = fresh_path(spark, "archives")
    runs = warc.write_archives(warc.with_capture_time(pages.repartition(3)), folder, **more)
    return warc.merged_index(runs, 4), warc.read_archives(spark, folder)


def test_archives_and_index(spark):
    index, records = archive(spark, PAGES, file_bytes=500, run_rows=2)
    got = records.collect()
    assert len(got) == len(PAGES)
    want = []
    for i, _, html in PAGES:  # each row by itself: a page id may come with several payloads
        payload = (html or "").encode()
        answer = max((j for j, _, h in PAGES if j is not None and (h or "") == (html or "")), default=None)
        response = i is None or i == answer
        want.append(
            (
                str(i), "response" if response else "revisit", digest(payload), len(payload), None if response else answer,
                payload if response else None
            )
        )
    assert sorted(map(str, want)) == sorted(
        str(
            (str(r.page_id), r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload))
        ) for r in got
    )
    rows = sorted(index.collect(), key=lambda r: r.capture_no)
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys) and [r.capture_no for r in rows] == list(range(len(PAGES)))
    assert {(r.file, r.offset) for r in rows} == {(r.file, r.offset) for r in got}
    assert len({r.file for r in rows}) > 1


def test_small_payloads_are_responses(spark):
    _, records = archive(spark, PAGES, least_bytes=5)
    assert all(r.record_type == "response" for r in records.collect() if r.payload_bytes < 5)


def test_no_pages(spark):
    index, records = archive(spark, [])
    assert index.count() == 0 and records.count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = warc.op4_warc(spark, sf)
    want = con.execute(warc.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
