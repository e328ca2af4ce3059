import gzip
import hashlib

import pytest

from lociframe.llm import warc
from lociframe.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(ORACLES["op7_warc"])
    want = {r["page_id"]: r for r in (dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall())}
    got = {r["page_id"]: r.asDict() for r in QUERIES["op7_warc"](spark, SF).collect()}
    assert got == want


def test_records_round_trip():
    payload = "<p>é\r\n\r\nWARC/1.1</p>".encode()
    raw = warc.write_record(7, "http://a.b/c d\r\nX: y", payload, None)
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and gzip.decompress(raw).endswith(b"\r\n\r\n")
    found = warc.read_record(raw)
    assert found == {"page_id": 7, "payload_bytes": len(payload), "payload_digest": warc.digest_of(payload), "record_type": "response", "refers_to": None, "html": payload.decode()}
    again = warc.read_record(warc.write_record(3, None, payload, 7))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["html"]) == ("revisit", 7, len(payload), None)
    with pytest.raises(ValueError):
        warc.read_record(gzip.compress(gzip.decompress(raw).replace(b"</p>", b"</q>")))


@pytest.mark.parametrize("url,key", [("https://www.Example.com/a/B?x=1#f", "com,example,www)/a/B?x=1"), ("http://a.b?q", "b,a)?q"), ("a.b", "b,a)"), ("", ""), (None, "")])
def test_keys(url, key):
    assert warc.reversed_key(url) == key


def test_lookups_read_only_what_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 300)
    monkeypatch.setattr(warc, "BLOCK", 16)
    pages = [(i, f"http://h{i % 40}.example.org/{i % 200}", f"<p>{i % 90}</p>" * (1 + i % 3)) for i in range(1500)]
    pages += [(2000 + i, "http://hot.example.org/", f"hot {i}") for i in range(700)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"key": F.lit("x"), "file": F.lit(1), "original": F.lit(2)})
    folder, places = warc.write_archives(table)
    directory = warc.build_index(folder, places)
    assert directory.count() > 30 and directory.select("file").distinct().count() > 2
    wanted = ["http://hot.example.org/", "http://h3.example.org/3", "http://h3.example.org/43", "http://none.example.org/"]
    got = warc.lookup(folder, directory, spark.createDataFrame([(u,) for u in wanted], "url string")).collect()
    want = {p: h for p, u, h in pages if u in wanted}
    assert sorted(r["page_id"] for r in got) == sorted(want)
    top = {}
    for p, _, h in pages:
        top[h] = max(top.get(h, -1), p)
    for r in got:
        h = want[r["page_id"]]
        assert r["payload_digest"] == warc.digest_of(h.encode()) and r["payload_bytes"] == len(h)
        assert (r["record_type"], r["refers_to"], r["html"]) == (("response", None, h) if top[h] == r["page_id"] else ("revisit", top[h], None))


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "u://x", ""), (None, "u://x", "z"), (3, "u://x", "z"), (3, "u://x", "z"), (4, "u://y", "long " * 100_000), (5, "", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, places = warc.write_archives(table)
    out = warc.lookup(folder, warc.build_index(folder, places), table.select("url").distinct()).collect()
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out)
    assert got == [(-1, "revisit", 3, 1), (1, "revisit", 5, 0), (2, "revisit", 5, 0), (3, "response", None, 1), (3, "response", None, 1), (4, "response", None, 500_000), (5, "response", None, 0)]
    assert {r["payload_digest"] for r in out if r["payload_bytes"] == 0} == {warc.base64.b32encode(hashlib.sha1(b"").digest()).decode()}
    folder, places = warc.write_archives(table.limit(0))
    assert warc.lookup(folder, warc.build_index(folder, places), table.select("url")).count() == 0
    folder, places = warc.write_archives(table, least=1)
    out = warc.lookup(folder, warc.build_index(folder, places), table.select("url").distinct()).collect()
    assert sorted(r["page_id"] for r in out if r["record_type"] == "response") == [1, 2, 3, 3, 4, 5]
