import base64
import hashlib
import struct

import zstandard

from docfields.llm import warc
from tests_llm_help import prose, rows_of

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    found = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        origin = first.get(html or "")
        same = origin is None or origin == page_id
        found.append((page_id, len(payload), digest, "response" if same else "revisit", None if same else origin,
                      len(payload) if same else 0, None))
    return sorted(found, key=repr)


ROWS = [
    (5, "http://a/5", "<p>é🙂</p>"), (3, "http://a/3", "<p>é🙂</p>"), (9, None, None), (8, "http://a/\r\nX: y", ""), (7, "http://a/7", "\r\n\r\nWARC/1.1\r\n"),
    (3, "http://a/3", "<p>é🙂</p>"), (None, "http://none", "<p>é🙂</p>"), (None, None, "only without id"), (11, "", "x" * 300_000),
    *[(100 + i, f"http://b/{i}", f"<html><body>{prose(i % 40, 60)}</body></html>") for i in range(120)],
]


def test_round_trip_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    assert rows_of(warc.round_trip(spark.createDataFrame(ROWS, PAGES))) == brute(ROWS)


def test_one_copy_of_many(spark):
    rows = [(i, f"http://c/{i}", "the same page") for i in range(500, 0, -1)]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(7))
    assert rows_of(found) == brute(rows)


def test_odd_tables(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    extra = "record_type string, digest string, payload string, first_id long, refers_to string, content binary"
    table = spark.createDataFrame([(*r, "t", "d", "p", 1, "r", b"c") for r in ROWS[:6]], f"{PAGES}, {extra}")
    assert rows_of(warc.round_trip(table)) == brute(ROWS[:6])


def archive(records, dictionary=b"", compressed=True):
    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(dict_data=words) if words else zstandard.ZstdCompressor()
    content = warc.dictionary_frame(dictionary)[8:] if compressed else dictionary
    leading = struct.pack("<II", warc.SKIPPABLE, len(content)) + content if dictionary else b""
    return leading + b"".join(compressor.compress(r) for r in records)


def record(block=b"hello", **headers):
    full = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Date": warc.DATE} | headers
    return warc.record_bytes({k: v for k, v in full.items() if v is not None}, block)


def test_reader_takes_either_form_of_dictionary():
    samples = [prose(i, 50).encode() for i in range(400)]
    for dictionary in (warc.make_dictionary(samples), b"raw content of a dictionary " * 9):
        for compressed in (True, False):
            found = list(warc.read_archive(archive([record(s) for s in samples[:20]], dictionary, compressed)))
            assert [r.block for r in found] == samples[:20] and not any(r.error for r in found)
    assert [r.block for r in warc.read_archive(archive([record()]))] == [b"hello"]
    assert list(warc.read_archive(b"")) == []


def errors(data):
    return [r.error for r in warc.read_archive(data)]


def test_reader_reports_what_is_wrong():
    good = record()
    assert errors(archive([good, good])) == [None, None]
    assert errors(archive([good])[:-3])[0] in ("frame is cut off",) or errors(archive([good])[:-3])[0].startswith("bad frame")
    assert errors(archive([good]) + b"junk")[1].startswith("bad frame")
    assert errors(archive([b"HTTP/1.1 200\r\n\r\n"])) == ["no version line"]
    assert errors(archive([good.replace(b"WARC-Date:", b"WARC-Date ")])) == ["malformed header"]
    assert errors(archive([record(**{"WARC-Date": None})])) == ["missing warc-date"]
    assert errors(archive([good.replace(b"Length: 5", b"Length: x")])) == ["bad length"]
    assert errors(archive([good.replace(b"Length: 5", b"Length: 6")])) == ["length differs"]
    assert errors(archive([good.replace(b"Length: 5", b"Length: 4")])) == ["length differs"]
    assert errors(archive([record(**{"WARC-Payload-Digest": "sha1:AAAA"})])) == ["digest differs"]
    assert errors(struct.pack("<II", warc.SKIPPABLE, 99) + b"short") == ["dictionary frame is cut off"]
