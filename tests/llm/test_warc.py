import base64
import hashlib

from evalframe.llm import warc
from evalframe.llm.queries import op7_warc

PAGES = [
    (5, "http://a.example/x?y", "<p>é</p>"), (3, "http://a.example/", "<p>é</p>"), (9, None, None), (8, "u", ""),
    (4, "http://b.example", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"), (4, "http://b.example", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"),
    (6, "http://c.example/\r\n", "x\n\n\r\n\r\ny" * 2000), (7, "http://c.example/", "\x00\x01 tail "), (3, "http://a.example/2", "<p>é</p>"),
]


def want(pages):
    out = []
    for key, url, html in pages:
        raw = (html or "").encode()
        first = min(k for k, _, h in pages if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        path = "/" + (url or "").replace("\r\n", "").split("://")[-1].partition("/")[2]
        out.append((key, len(raw), digest, "response" if key == first else "revisit", None if key == first else first, 3, "GET", path))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    df.repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, op7_warc(spark, str(tmp_path)).collect()), key=str) == want(PAGES)


def test_round_trip_of_payloads(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.write_archives(df, warc.Settings(records_per_file=4))
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(PAGES)
    full = {(r.page_id, r.response.payload) for r in got if r.response.kind == "response"}
    assert full == {(k, h or "") for k, _, h in PAGES if k not in (5, 9)}
    for r in got:
        assert r.request.id and r.metadata.fields["pageId"] == str(r.page_id)
    empty = warc.write_archives(df.limit(0))
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")], "page_id long, url string, html string")
    path = warc.write_archives(df, warc.Settings(min_revisit_bytes=3))
    kinds = {r.page_id: r.response.kind for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_revisits_name_a_record_and_lost_requests_show(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    records = warc.read_records(spark, warc.write_archives(df))
    ids = {r.record_id for r in records.where("kind = 'response'").collect()}
    rows = warc.with_referred(warc.assemble(records)).collect()
    told = [r.response.refers_to for r in rows if r.response.kind == "revisit"]
    assert told and set(told) <= ids
    without = warc.assemble(records.where("kind <> 'request' or concurrent_to <> %r" % told[0])).collect()
    assert len(without) == len(PAGES) and {r.request is None for r in without} == {r.response.record_id == told[0] for r in without}


def test_large_payloads_get_files_of_their_own(spark):
    df = spark.createDataFrame([(i, "http://h/", str(i) * n) for i, n in enumerate((10, 3_000_000, 20, 2_000_000))], "page_id long, url string, html string")
    path = warc.write_archives(df.repartition(1), warc.Settings(large_bytes=1000))
    sizes = sorted(r.length for r in spark.read.format("binaryFile").load(path).select("length").collect())
    assert sizes[-2] < 2_100_000 and sizes[-1] < 3_100_000
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    assert {(r.page_id, len(r.response.payload)) for r in rows} == {(0, 10), (1, 3_000_000), (2, 20), (3, 2_000_000)}
    assert all(r.request.fields["path"] == "/" and r.request.fields["protocol"] == "HTTP/1.1" for r in rows)
