import pytest

from ledgerlens.llm import warc

PAGES = "page_id long, url string, html string, payload string"


def run(spark, rows, **kw):
    pages = spark.createDataFrame(rows, PAGES)
    path = warc.archive_path(spark)
    warc.write_archives(warc.resolve_revisits(pages, **kw), path, records_per_file=3)
    return warc.read_archives(spark, path)


def test_round_trip_and_revisits(spark):
    odd = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é€😀\n" + "x" * 300_000
    rows = [(5, "u5", odd, "clash"), (3, "u3", odd, ""), (4, "http://x/\r\n y", "b", None), (7, None, None, None), (8, "u8", "", None),
            (9, "u9", None, None), (None, "n", "b", None), (4, "http://x/\r\n y", "b", None)]
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in run(spark, rows).collect())
    n = len(odd.encode())
    assert got == [(-1, "response", None, 1), (3, "response", None, n), (4, "response", None, 1), (4, "response", None, 1),
                   (5, "revisit", 3, n), (7, "response", None, 0), (8, "revisit", 7, 0), (9, "revisit", 7, 0)]
    back = {r.page_id: bytes(r.payload) for r in run(spark, rows).where("record_type = 'response'").collect()}
    assert back[3] == odd.encode() and all(r.intact for r in run(spark, rows).collect())


def test_min_bytes_and_empty(spark):
    rows = [(1, "a", "xy", None), (2, "b", "xy", None), (3, "c", "x" * 9, None), (4, "d", "x" * 9, None)]
    got = {r.page_id: r.record_type for r in run(spark, rows, min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert run(spark, []).count() == 0


def test_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"))
