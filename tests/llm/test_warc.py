"""WARC archives: exact round trips."""
import hashlib
import uuid

from hotspots.llm import warc
from hotspots.session import scratch_dir


def round_trip(spark, df, chunk=warc.CHUNK, payload="html"):
    path = f"{scratch_dir(spark, 'warc-test')}/{uuid.uuid4().hex}"
    warc.write_archives(df, path, payload=payload, chunk=chunk)
    return path, warc.read_archives(spark, path)


def sha(t):
    return hashlib.sha1((t or "").encode()).hexdigest()


NASTY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
PAGES = [
    (1, "x" * 1500), (2, "x" * 1500), (9, "x" * 1500), (3, None), (4, ""), (5, "é" * 600), (6, "é" * 600),
    (7, NASTY), (8, NASTY * 40), (10, "WARC/1.1\r\n"), (11, "y" * 999), (12, "y" * 999), (13, "日本🎉" * 500),
    (14, "\r\n\r\n"), (15, "WARCWARC/1.1\r\nWARC/1.1\r\n"),
]


def test_round_trip_and_revisits(spark):
    df = spark.createDataFrame(PAGES, "page_id long, html string").selectExpr("*", "'z' AS record", "1 AS id", "'q' AS chunk")
    for chunk in (warc.CHUNK, 7):
        _, table = round_trip(spark, df, chunk)
        got = {int(r.id): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
               for r in warc.summarise(table).collect()}
        last = {}
        for i, t in PAGES:
            if len((t or "").encode()) >= 1000:
                last[sha(t)] = max(i, last.get(sha(t), i))
        want = {i: (len((t or "").encode()), sha(t), "revisit" if last.get(sha(t), i) != i else "response",
                    str(last[sha(t)]) if last.get(sha(t), i) != i else None) for i, t in PAGES}
        assert got == want


def test_chunks_are_small_and_give_the_text_back(spark):
    df = spark.createDataFrame([(1, "日本🎉" * 100), (2, NASTY * 9)], "page_id long, html string")
    _, table = round_trip(spark, df, 64)
    rows = sorted(table.collect(), key=lambda r: (r.id, r.chunk_no))
    assert all(len(r.chunk) <= 64 and "WARC/1.1\r\n" not in r.chunk for r in rows)
    assert {i: "".join(r.chunk for r in rows if r.id == i) for i in ("1", "2")} == {"1": "日本🎉" * 100, "2": NASTY * 9}
    assert [r.chunk_no for r in rows if r.id == "1"] == list(range(5)) and rows[0].n_chunks == 5


def test_mark_at_the_end_of_a_payload_or_chunk(spark):
    pages = [(1, "WARC/1.1"), (2, "x WARC/1.1"), (3, "WARC/1.1abc"), (4, "WARC/1.1WARC/1.1"), (5, "WARC/1.1" * 200),
             (6, "WARC/1.1\r"), (7, "WARC/1.1\n" * 3)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    for chunk in (warc.CHUNK, 8):
        _, table = round_trip(spark, df, chunk)
        rows = sorted(table.collect(), key=lambda r: (r.id, r.chunk_no))
        assert {i: "".join(r.chunk for r in rows if r.id == str(i)) for i, _ in pages} == dict(pages)
        got = {int(r.id): (r.payload_bytes, r.payload_digest) for r in warc.summarise(table).collect()}
        assert got == {i: (len(t), sha(t)) for i, t in pages}


def test_archive_is_a_warc_file(spark):
    path, _ = round_trip(spark, spark.createDataFrame([(1, "hello")], "page_id long, html string"))
    text = "".join(r.value for r in spark.read.option("lineSep", "\x00").text(path).collect())
    head, _, rest = text.partition("\r\n\r\n")
    assert head.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "Content-Length: 5" in head
    assert rest == "hello\r\n\r\n"


def test_null_and_repeated_ids(spark):
    big = "z" * 2000
    df = spark.createDataFrame([(None, big), (3, big), (3, big), (None, "q"), (4, "q"), (4, "q")], "page_id long, html string")
    _, table = round_trip(spark, df)
    got = sorted((r.id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in warc.summarise(table).collect())
    assert got == [("", "response", "", 1), ("", "revisit", "3", 2000), ("3", "response", "", 2000),
                   ("3", "response", "", 2000), ("4", "response", "", 1), ("4", "response", "", 1)]


def test_copies_without_any_id_are_all_written(spark):
    df = spark.createDataFrame([(None, "z" * 2000)] * 2, "page_id long, html string")
    _, table = round_trip(spark, df)
    assert [r.record_type for r in warc.summarise(table).collect()] == ["response"] * 2


def test_odd_rows(spark, odd):
    df = odd.withColumnRenamed("doc_id", "page_id")
    _, table = round_trip(spark, df, 1000, "text")
    got = sorted((r.id or "", r.payload_bytes) for r in warc.summarise(table).collect())
    assert got == sorted((str(r.page_id or ""), len((r.text or "").encode())) for r in df.collect())


def test_empty_table(spark, none):
    _, table = round_trip(spark, none.withColumnRenamed("doc_id", "page_id"), payload="text")
    assert warc.summarise(table).collect() == []
