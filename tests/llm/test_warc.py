"""WARC round trip, framing and damage."""

import gzip
import hashlib
from pathlib import Path

import pytest

from isoweave.llm.warc import WarcError, archive_round_trip, decode_record, encode_record, members, write_archives

BIG = "x" * 150
PAGES = [(1, "http://a/1", BIG, 0), (2, "http://a/2", BIG, 0), (3, None, None, 0), (4, "http://a\r\n/4", "small", 0), (5, "u", "small", 0), (6, "u", "é" * 60, 0), (None, "u", BIG, 0), (7, "u", "y\r\n\r\n" * 40000, 0), (1, "http://a/1", BIG, 0)]


def test_round_trip(spark):
    got = archive_round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string, payload_digest int")).collect()
    assert len(got) == len(PAGES)
    out = sorted((str(r.record_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    want = []
    for page, _, html, _ in PAGES:
        raw = (html or "").encode()
        again = html == BIG and page != 1
        want.append((str(None if page is None else str(page)), "revisit" if again else "response", "1" if again else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert out == sorted(want)


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_gzip_files(spark, tmp_path):
    write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string, x int").coalesce(1), f"file://{tmp_path}/w")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("part-*"))
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES)


def record():
    return encode_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)


def test_members_in_small_steps():
    data = record() + b"\0\0" + record() + b"\0"
    got = list(members(data[i : i + 7] for i in range(0, len(data), 7)))
    assert [decode_record(x)["payload"] for x in got] == [b"payload"] * 2


@pytest.mark.parametrize("spoil", [lambda r: r.replace(b"payload", b"pay1oad"), lambda r: r[:-2], lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), lambda r: r.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x")])
def test_damage_is_found(spoil):
    with pytest.raises(WarcError):
        decode_record(spoil(gzip.decompress(record())))


def test_cut_member():
    with pytest.raises(WarcError):
        list(members([record()[:-3]]))
