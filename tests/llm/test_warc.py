from __future__ import annotations

import hashlib

from tests.llm.oracle import same
from souk.llm import queries, warc
from souk.llm.common import Workspace


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op3_warc(spark, sf), queries.OP3_SQL, sf)


def test_edges(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 3 + "é \u0085\x0c\n\n\r"
    long = "y" * 300_000
    rows = [(1, "http://a/b?c#d", tricky), (2, None, tricky), (3, "http://a/\r\nX: y", "short"), (4, "nonsense", "short"), (5, "http://z", None), (6, "", ""), (7, "u", long), (8, "u", long), (8, "u", long), (9, "v", "z" * 100), (9, "v", "z" * 100), (10, "v", "z" * 99), (11, "v", "z" * 99)]
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], "page_id long, url string, html string, id string, bytes int").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()))
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    want = []
    for i, _, h in rows:
        b, old = (h or "").encode(), first.get(h, i) != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if old else "response", first[h] if old else None))
    assert sorted(want, key=str) == sorted(got, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_nested_rows_keep_payloads_and_sides(spark):
    df = spark.createDataFrame([(1, "http://h/p?q=1", "é" * 80), (None, "http://h/", "é" * 80)], "page_id long, url string, html string")
    path = Workspace(spark).path("w")
    warc.write(df, path)
    rows = {r.page_id: r for r in warc.transactions(warc.records(spark, path)).collect()}
    assert bytes(rows[1].response.block).decode() == "é" * 80 and rows[1].response.type == "response" and rows[1].url == "http://h/p?q=1"
    assert rows[None].response.type == "revisit" and rows[None].response.refers_to == rows[1].id
    assert rows[1].request is not None and rows[1].metadata.page_id == 1


def test_foreign_archive(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\n\x00bin"
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n") + gzip.compress(rec))
    rows = warc.records(spark, str(tmp_path)).collect()
    assert [r.type for r in rows] == ["warcinfo", "response"] and bytes(rows[1].block) == b"\xff\xfe\n\x00bin"
    one = warc.transactions(warc.records(spark, str(tmp_path))).first()
    assert one.request is None and one.metadata is None and one.page_id is None


def test_ids_beyond_doubles(spark):
    ids = [(1 << 53) + 1, (1 << 53) + 3, None]
    df = spark.createDataFrame([(i, f"http://h/{i}", "x" * 200) for i in ids], "page_id long, url string, html string").coalesce(1)
    out = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert set(out) == set(ids) and out[ids[1]].refers_to == ids[0]
