import hashlib

from tidewire.llm.warc import archive_round_trip, read_archives, resolved, write_archives
from tidewire.settings import scratch_path


def sha(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


BIG = "é" * 600
LONG = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40_000
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (7, "http://c/", BIG), (3, None, "small"),
    (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "u", LONG), (9, "u", LONG), (10, "u", "z" * 1000),
    (10, "v", "z" * 1000), (11, "u", "z" * 1000), (10, "w", "y" * 1200), (None, "u", BIG), (None, "u", BIG),
]
EXPECTED = sorted(
    [
        (1, 1200, sha(BIG), "revisit", 7), (2, 1200, sha(BIG), "revisit", 7), (7, 1200, sha(BIG), "response", None),
        (3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None),
        (5, 0, sha(""), "response", None), (6, 0, sha(""), "response", None),
        (8, len(LONG), sha(LONG), "revisit", 9), (9, len(LONG), sha(LONG), "response", None),
        (10, 1000, sha("z" * 1000), "revisit", 11), (10, 1000, sha("z" * 1000), "revisit", 11),
        (11, 1000, sha("z" * 1000), "response", None), (10, 1200, sha("y" * 1200), "response", None),
        (None, 1200, sha(BIG), "response", None), (None, 1200, sha(BIG), "response", None),
    ],
    key=str,
)
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, kept int")


def test_round_trip(spark):
    got = archive_round_trip(pages(spark)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == EXPECTED


def test_repeated_row_of_the_response(spark):
    rows = [(1, "u", BIG), (5, "u", BIG), (5, "u", BIG)]
    got = archive_round_trip(pages(spark, rows)).select(*COLUMNS).collect()
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["refers_to"] is not None)
    assert kinds == [(1, "revisit", 5), (5, "revisit", 5)] and len(got) == 3


def test_payloads_come_back(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(pages(spark), path)
    records = read_archives(spark, path, payloads=True).collect()
    kept = sorted(r["payload"].decode() for r in records if r["record_type"] == "response")
    assert kept == sorted([BIG, BIG, BIG, "small", "small", "", "", LONG, "z" * 1000, "y" * 1200])
    assert all(r["stored_bytes"] == 0 for r in records if r["record_type"] == "revisit")
    assert {r["url"] for r in records if r["page_id"] == 2} == {"http://b/%0A%0AX: y"}
    assert len({r["record_id"] for r in records if r["page_id"] not in (10, None)}) == 10


def test_a_revisit_without_original(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(pages(spark, ROWS[:3]), path)
    records = read_archives(spark, path).filter("page_id <> 7")
    rows = resolved(records).collect()
    assert {(r["page_id"], r["refers_to"], r["payload_bytes"]) for r in rows} == {(1, None, 1200), (2, None, 1200)}


def test_empty_table(spark):
    assert archive_round_trip(pages(spark).limit(0)).count() == 0
