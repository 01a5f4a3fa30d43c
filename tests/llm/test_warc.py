import base64
import hashlib

import pytest
import zstandard

from tidepool.llm.warc import as_dictionary, dictionary_of, read_archives, write_archives

ROWS = [
    (5, "http://a/ b\r\nx", "<p>é one</p>" * 40, 1),
    (2, "http://a/2", "<p>é one</p>" * 40, 2),
    (9, None, None, 3),
    (8, "", "", 4),
    (2, "http://a/2", "<p>é one</p>" * 40, 5),
    (2, "http://a/3", "other", 6),
    (None, "http://n", "other", 7),
    (None, "http://n", "alone", 8),
    (11, "http://long", "z\r\n\r\nWARC/1.1\r\n" * 60_000, 9),
    *[(100 + i, f"http://b/{i}", f"<html><body>page number {i} " + "common words here " * (i % 7), 0) for i in range(300)],
    *[(1000 + i, f"http://c/{i}", "hot", 0) for i in range(100)],
]


def brute(rows, least=0):
    """Rows in the order of the table: of equal payloads the first row of the smallest page_id is the response."""
    first = {}
    for at, (page_id, _, html, _) in enumerate(rows):
        key = (page_id is None, page_id or 0, at)
        first[html or ""] = min(first.get(html or "", key), key)
    out = []
    for at, (page_id, _, html, _) in enumerate(rows):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        best = first[html or ""]
        again = len(raw) >= least and best[2] != at
        out.append((page_id, len(raw), digest, "revisit" if again else "response", (None if best[0] else best[1]) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "most", "hot", "few"), [(0, 1 << 20, 10**6, 10**6), (4, 4096, 10**6, 10**6), (0, 4096, 50, 0), (4, 4096, 10**6, 0)])
def test_round_trip(spark, tmp_path, least, most, hot, few):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest int")
    archives = write_archives(pages, str(tmp_path / "w"), least_bytes=least, held=2048, most=most, hot=hot, few=few)
    got = read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, least)
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h, _ in ROWS}
    assert archives.count() > (3 if most < 1 << 20 else 1)


def test_files_have_a_leading_dictionary_and_a_frame_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[9:200], "page_id long, url string, html string, digest int").coalesce(1)
    (row,) = write_archives(pages, str(tmp_path / "w")).collect()
    raw = open(row.path.removeprefix("file:"), "rb").read()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    reader = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw[8 : 8 + size]))
    one = reader.decompressobj()
    assert one.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\n") and one.unused_data[:4] == b"\x28\xb5\x2f\xfd"


def test_too_few_records_to_train_on():
    raw = dictionary_of([b"abc"], 4096)
    one = zstandard.ZstdCompressor(dict_data=as_dictionary(raw)).compress(b"abcabc")
    assert zstandard.ZstdDecompressor(dict_data=as_dictionary(raw)).decompress(one) == b"abcabc"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(pages)).collect() == []
