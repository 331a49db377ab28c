import base64
import hashlib

import pytest
import zstandard

from toposcan.llm import warc


@pytest.fixture
def pages(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, archive string, frame int")

    return make


def expected(rows, least=0):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        ref = first.get(b) if p is not None and first.get(b) != p else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(pages, least):
    rows = [(5, "http://a", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b", None), (8, "http://c", ""), (4, "u\r\nX: y", "é\r\n\r\nWARC/1.1 Content-Length: 3"),
            (None, "n", "<p>x</p>"), (7, "big", "é" * 400_000), (3, None, "<p>x</p>"), (11, "t", "ab"), (12, "t", "ab")] + [(100 + i, "u", f"page {i % 40}") for i in range(200)]
    out = warc.read_records(warc.write_archives(pages(*rows).repartition(3), min_bytes=least, frame_bytes=500, archive_bytes=2_000))
    got = out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, least)
    texts = {r.page_id: bytes(r.payload).decode() for r in out.filter("record_type = 'response'").collect()}
    assert texts[7] == "é" * 400_000 and texts[4] == rows[4][2] and texts[9 if least else 8] == ""


def test_archives_are_plain_zstd_and_seekable(pages):
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>" * 20) for i in range(300)]
    index = warc.write_archives(pages(*rows).repartition(2), frame_bytes=4_000)
    for path in {r.archive for r in index.select("archive").distinct().collect()}:
        system, inner = warc.file_system(path)
        with system.open_input_file(inner) as f:
            whole, table = f.read(), warc.seek_table(f)
        raw = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
        assert len(table) > 1 and len(raw) == sum(x[2] for x in table)
        assert raw.count(b"WARC-Type:") == index.filter(index.archive == path).count()
    one = warc.read_records(index.filter("record_id = 'urn:page:42'")).collect()
    assert [r.page_id for r in one] == [42] and bytes(one[0].payload).decode() == rows[42][2]
    assert warc.read_records(warc.write_archives(pages().limit(0))).count() == 0


def test_damage_is_found():
    _, raw = warc.record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paYload"))
    with pytest.raises(ValueError):
        warc.parse(raw[5:])
