"""Archives: round trips, the index against all records, awkward rows."""

import gzip
import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shardloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n_bytes string, best string"


@pytest.fixture(scope="module")
def pages(spark):
    same, other = "<p>same</p>" * 20, "<p>other</p>" * 20
    data = [(1, "http://a.example.org/x?b=1#top", same), (2, "http://b.example.org:8080/", same), (2, "http://b.example.org:8080/", same), (None, "http://c.example.org", same)]
    data += [(7, "http://a.example.org/x?b=1", other), (7, "http://a.example.org/x?b=1", other), (7, "http://z.example.org", other), (8, None, other)]
    data += [(9, "not a url\r\nX-Page: 77", "small"), (10, "http://é.example.org/ü ö", "small"), (11, None, None), (12, "", ""), (13, "http://1.2.3.4/x", "é\r\n\r\nWARC/1.1\r\n" * 9)]
    data += [(14, "http://long.example.org", "<p>long é</p>" * 400_000)]
    data += [(100 + i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i} " * 30) for i in range(400)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA).repartition(5)


def expected(table):
    groups = {}
    for page, url, html in table:
        groups.setdefault((html or "").encode(), []).append(((page is None, page or 0), (url is None, url or ""), page, url))
    out = []
    for payload, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            revisit = len(payload) >= 100 and i > 0
            out.append((m[2], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", members[0][2] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(pages):
    return warc.write_archive(pages)


def test_round_trip(pages, archive):
    got = warc.read_records(archive, warc.lookup(archive, warc.keys_of(pages)))
    assert rows(got.drop("html")) == expected([tuple(r)[:3] for r in pages.collect()])
    kept = {(r["page_id"], r["html"]) for r in got.where("record_type = 'response'").collect()}
    assert (11, "") in kept and (13, "é\r\n\r\nWARC/1.1\r\n" * 9) in kept and (14, "<p>long é</p>" * 400_000) in kept
    assert all(r["html"] is None for r in got.where("record_type = 'revisit'").collect())


def test_large_directories_are_joined_and_large_groups_shuffled(pages, archive, monkeypatch):
    keys = warc.keys_of(pages)
    assert rows(warc.lookup(archive, keys, most=0)) == rows(warc.lookup(archive, keys))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows(warc.records(pages).groupBy("page_id", "revisit").count()) == rows(_broadcast(pages))


def _broadcast(pages):
    warc.BROADCAST_ROWS = 50_000
    return warc.records(pages).groupBy("page_id", "revisit").count()


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_lookup_finds_all_captures_of_a_url(spark, pages, lines, monkeypatch):
    monkeypatch.setattr(warc, "LINES", lines)  # one key over many blocks
    archive = warc.write_archive(pages)
    url = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert sorted(r["page_id"] for r in warc.pages_at(archive, url("https://A.example.org:443/x?b=1")).collect()) == [1, 7, 7]
    assert sorted(r["page_id"] for r in warc.pages_at(archive, url("http://h3.example.com/3", "http://nowhere.org", "http://zzz.zz/")).collect()) == [100 + i for i in range(400) if i % 7 == 3 and i % 50 == 3]
    assert {r["page_id"] for r in warc.pages_at(archive, url(None)).collect()} == {8, 11, 12}


def test_keys():
    assert warc.capture_key("http://www.Example.org:80/a?b#c") == "org,example,www)/a?b"
    assert warc.capture_key("https://u:p@1.2.3.4:81") == "1.2.3.4:81)/"
    assert warc.capture_key(None) == "" and "\n" not in warc.capture_key("x\ny") and " " not in warc.capture_key("http://a/b c")


def test_files_are_gzip_members_with_one_response_per_payload(spark, archive):
    files = spark.read.format("binaryFile").load(f"{archive.folder}/records").select("content").collect()
    whole = b"".join(gzip.decompress(f["content"]) for f in files)
    assert whole.count(b"\r\n\r\n<p>same</p>") == 1 and whole.count(b"WARC-Type: revisit") == 6
    ids = [x.split(b"\r\n")[0] for x in whole.split(b"WARC-Record-ID: ")[1:]]
    assert len(ids) == len(set(ids))
    refers = {x.split(b"\r\n")[0] for x in whole.split(b"WARC-Refers-To: ")[1:]}
    assert refers <= set(ids)


def test_damaged_record_is_noticed():
    member = warc.record(1, "http://a", b"payload", 7, hashlib.sha256(b"other").hexdigest(), None, warc.record_id(1))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(member)


def test_empty_table(pages):
    archive = warc.write_archive(pages.where("false"))
    assert rows(warc.read_records(archive, warc.lookup(archive, warc.keys_of(pages)))) == []
    assert archive.directory.agg(F.count("*")).first()[0] == 0
