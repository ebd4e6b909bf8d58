"""Archives: exact round trips, plain restatements of the revisits, and bytes that an own reader cuts alike."""

import glob
import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from voltline.llm import common, warc


def plain(rows):
    """(id, bytes, sha256, type, refers_to) of each (id, url, body)."""
    groups, out = {}, []
    for i, url, body in rows:
        groups.setdefault(body or b"", []).append((i is None, i, url is None, url))
    for body, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1] or 0, m[2], m[3] or ""))
        for k, m in enumerate(members):
            again = k > 0 and len(body) >= 100
            out.append((m[1], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", members[0][1] if again else None))
    return Counter(out)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None if b is None else bytearray(b), "x", 1) for i, u, b in rows], "page_id bigint, url string, html binary, type string, id int")


LONG = b"<p>" + b"long text " * 20
ROWS = [
    (5, "http://a/b?c=d", LONG),
    (2, "http://a/x y\r\nWARC-Type: fake", LONG),
    (2, "http://a/x y\r\nWARC-Type: fake", LONG),
    (2, "http://b", LONG),
    (None, None, LONG),
    (7, "http://c", b"short"),
    (8, "http://c", b"short"),
    (8, "http://c", b"short"),
    (9, "", None),
    (10, None, b""),
    (11, "http://d/é%20", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 9),
    (12, "http://d", b"\r\n\r\n" * 60),
    (13, "http://d", bytes(range(256)) * 3),
    (14, "http://d", "é中".encode() * 100 + b"\n"),
    (None, "http://e", b"\xef\xbb\xbf" + b"z" * 3_000_000),
]


def test_awkward_pages(spark):
    found = warc.archived_pages(pages(spark, ROWS), common.fresh_path(spark, "warc")).collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == plain(ROWS)
    assert all(r.request.startswith("GET ") and r.request.endswith(" HTTP/1.1") and r.request.count(" ") == 2 for r in found)


def test_empty_table(spark):
    assert warc.archived_pages(pages(spark, []), common.fresh_path(spark, "warc")).count() == 0


def test_payloads_come_back(spark):
    folder = warc.write_archives(pages(spark, ROWS), common.fresh_path(spark, "warc"))
    found = [bytes(r.payload) for r in warc.read_archives(spark, folder).where("type = 'response'").collect()]
    assert set(found) == {b or b"" for _, _, b in ROWS}


def test_files_are_warc(spark):
    """An own reader walks the files by version line, headers and Content-Length, with nothing left over."""
    folder = warc.write_archives(pages(spark, ROWS), common.fresh_path(spark, "warc"))
    kinds, ids = Counter(), Counter()
    for path in glob.glob(f"{folder}/*.gz"):
        data = gzip.open(path).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            headers = dict(x.split(": ", 1) for x in lines[1:])
            n = int(headers["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n" and headers["WARC-Date"] and headers["WARC-Record-ID"]
            kinds[headers["WARC-Type"]] += 1
            ids[headers["WARC-Record-ID"]] += 1
            data = rest[n + 4 :]
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(ROWS)
    assert set(ids.values()) == {1}


def test_transactions_of_foreign_records(spark):
    rows = [("response", "r1", None, b"x"), ("request", "q1", "r1", b"a"), ("request", "q0", "r1", b"b"), ("metadata", "m1", "r9", b"c"), ("warcinfo", "w", None, b""), ("revisit", "r2", None, b"")]
    df = spark.createDataFrame([(t, i, c, bytearray(p)) for t, i, c, p in rows], "type string, record_id string, concurrent_to string, payload binary")
    found = {r.capture_id: r for r in warc.transactions(df).collect()}
    assert set(found) == {"r1", "r2"}
    assert found["r1"].request.record_id == "q0" and found["r1"].n_requests == 2 and found["r1"].metadata is None and found["r1"].n_metadata == 0
    assert found["r2"].capture.type == "revisit" and found["r2"].request is None


def test_parser_skips_what_is_cut_short():
    parser = warc.Parser()
    whole = b"junk\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\nab\ncd"
    found = [x for line in whole.splitlines(keepends=True) if (x := parser.feed(line))]
    assert [x["payload"] for x in found] == [b"ab\nc"]
    assert parser.feed(b"WARC/1.0\r\n") is None and parser.feed(b"Content-Length: 9\r\n") is None and parser.feed(b"\r\n") is None and parser.feed(b"abc") is None


def test_whole_table_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html.encode() if r.html is not None else None) for r in df.collect()]
    found = warc.archived_pages(df.withColumn("html", F.col("html")), common.fresh_path(spark, "warc")).collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == plain(rows)
