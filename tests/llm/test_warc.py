import gzip
import hashlib

import pyarrow.fs as pafs

from ratelake.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")


BIG, OTHER = "<p>é</p>" * 200, "x" * 1000
ROWS = [
    (1, "http://www.b.example.com/z?q=1", BIG, "clash"),
    (2, "http://b.example.com/z?q=1", BIG, None),
    (9, "https://a.example.org", BIG, None),
    (3, "http://a.example.org:80/p", OTHER, None),
    (3, "http://a.example.org:80/p", OTHER, None),
    (4, None, None, None),
    (5, "not a url\r\nX: y", "small", None),
    (6, "http://c.example.com/", "small", None),
    (None, "http://d.example.com/\t", OTHER, None),
]


def test_round_trip(spark):
    table = pages(spark, ROWS)
    archive = warc.write_archive(table, block=2)
    found = warc.look_up(archive, table).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str)
    want = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        refers = {1: 9, 2: 9}.get(page)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)
    bodies = {(r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response"}
    assert (9, BIG.encode()) in bodies and (4, b"") in bodies


def test_archives_are_plain_gzip_members(spark):
    archive = warc.write_archive(pages(spark, ROWS))
    for r in archive.captures.select("file").distinct().collect():
        fs, path = pafs.FileSystem.from_uri(r["file"])
        with fs.open_input_file(path) as f:
            assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == archive.captures.where(archive.captures.file == r["file"]).count()


def test_look_up_of_some_and_of_unknown(spark):
    archive = warc.write_archive(pages(spark, ROWS), block=1)
    asked = spark.createDataFrame([("http://b.example.com/z?q=1", 2), ("http://b.example.com/z?q=1", 2), ("http://b.example.com/z?q=1", 77), ("http://nowhere.example/", 1)], "url string, page_id bigint")
    assert [r["page_id"] for r in warc.look_up(archive, asked).collect()] == [2]


def test_hot_url_and_empty_table(spark):
    many = spark.range(3000).selectExpr("id AS page_id", "'http://a.example/' AS url", "repeat('y', 1200) AS html")
    found = warc.look_up(warc.write_archive(many, block=64), many, with_payload=False)
    assert found.where("record_type = 'revisit' AND refers_to = 2999").count() == 2999
    none = many.where("false")
    assert warc.look_up(warc.write_archive(none), none).count() == 0


def test_keys():
    assert warc.surt("https://www2.News.example.com:443/A?b=C") == "com,example,news)/a?b=c"
    assert warc.surt("http://example.com:8080") == "com,example:8080)/"
    assert warc.surt(None) == ")/"
