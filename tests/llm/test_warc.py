import gzip
import hashlib

from pyarrow import fs

from relscope.llm import warc
from relscope.llm.common import scratch

SCHEMA = "page_id long, url string, html string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA)


def test_round_trip(spark):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "http://a/ b\n", big), (2, "http://b", big), (3, None, big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90_000), (None, "n", big)]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for i, r in got.items():
        assert (r.payload_bytes, r.payload_digest) == (len(html[i]), hashlib.sha1(html[i]).hexdigest())
        assert (r.record_type == "revisit") == (i in (1, 2)) == (r.payload is None)
        assert r.refers_to == (3 if i in (1, 2) else None)
        assert r.payload is None or bytes(r.payload) == html[i]
    assert got[1].url == "http://a/%20b%0A" and got[3].url is None


def test_selected_records_by_ranges(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 50 + 1)) for i in range(500)]
    folder = scratch(spark, "warc")
    index = warc.write_archives(warc.plan_records(pages(spark, rows)), folder)
    assert index.count() == 500
    some = index.where("page_id % 7 = 0")
    got = warc.read_archives(some, folder, gap=0, most=4096).collect()
    assert sorted(r.page_id for r in got) == list(range(0, 500, 7))
    assert all(bytes(r.payload).decode() == rows[r.page_id][2] for r in got)
    assert warc.byte_ranges(index).count() < warc.byte_ranges(some, gap=0).count()
    store, top = fs.FileSystem.from_uri(folder)
    one = index.first()
    raw = store.open_input_file(f"{top}/archives/{one.file}").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == index.where(index.file == one.file).count()


def test_hot_payload(spark):
    rows = [(i, "u", "h" * 2000 if i % 3 else f"{i}" * 500) for i in range(6000)]
    got = warc.plan_records(pages(spark, rows)).where("refers_to is not null").collect()
    assert len(got) == 3999 and {r.refers_to for r in got} == {5999}


def test_repeated_ids(spark):
    big, other = "a" * 1200, "b" * 1200
    rows = [(1, "u", big), (1, "u", other), (2, "u", big), (2, "u", big), (3, "u", other), (3, "u", "c")]
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_digest) for r in warc.round_trip(pages(spark, rows)).collect())
    a, b, c = (hashlib.sha1(x.encode()).hexdigest() for x in (big, other, "c"))
    assert got == sorted([(1, "revisit", 2, a), (1, "revisit", 3, b), (2, "response", 0, a), (2, "response", 0, a), (3, "response", 0, b), (3, "response", 0, c)])


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
