import gzip
import hashlib

import pytest

from cutgraph.llm.warc import export_archives, read_records, read_warc, warc_record, warc_round_trip, write_warc

SCHEMA = "page_id long, url string, html string, record_type string"


def test_round_trip_and_revisits(spark):
    long, short = "é" * 60, "x" * 99
    rows = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (2, None, short), (4, "u", short), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n" * 40), (1, "http://c", long), (None, "u", long), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(spark, pages).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = 1 if html == long and page != 1 else None
        want.append((-1 if page is None else page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want)
    assert {(r.page_id, r.url) for r in read_warc(write_warc(pages)).collect() if r.page_id in (1, 2)} == {(1, "http://b\r\nX: y"), (1, "http://c"), (2, None)}


def test_blocks_come_back_in_order():
    blocks = [b"a" * i * 1000 for i in range(5)]
    stream = b"".join(warc_record(i, "u", b, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(blocks))
    for chunk in (1, 7, 4096, len(stream)):
        assert [b for _, b in read_records(stream[i : i + chunk] for i in range(0, len(stream), chunk))] == blocks


def test_damage_is_told():
    good = warc_record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    with pytest.raises(ValueError):
        list(read_records([good[:-9]]))
    with pytest.raises(ValueError):
        list(read_records([warc_record(1, "u", b"hello", hashlib.sha256(b"other").hexdigest(), None)]))


def test_empty(spark):
    assert warc_round_trip(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_exported_files_are_plain_gzip(spark, tmp_path):
    rows = [(i, f"http://x/{i % 4}", "page " * (i % 5 + 30) if i % 3 else None) for i in range(40)] + [(None, None, "page " * 31), (7, "u", "page " * 31)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = write_warc(pages)
    files = export_archives(archives, str(tmp_path / "out")).collect()
    assert [r.path for r in export_archives(archives, str(tmp_path / "out")).collect()] == [r.path for r in files]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted({r.path.rsplit("/", 1)[1] for r in files})
    text = b"".join(gzip.open(r.path).read() for r in files)
    assert text.count(b"WARC/1.1\r\n") == text.count(b"WARC-Date: ") == len(rows)
    back = read_warc(spark.read.format("binaryFile").load(str(tmp_path / "out")))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, read_warc(archives).collect()))


def test_wrong_lengths_and_digests():
    good = warc_record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None)
    raw = gzip.decompress(good)
    for old, new in ((b"body", b"bodx"), (b"X-Payload-Length: 4", b"X-Payload-Length: 5"), (b"Content-Length: 4", b"Content-Length: 3")):
        with pytest.raises(ValueError):
            list(read_records([gzip.compress(raw.replace(old, new))]))
