"""WARC records in seekable Zstandard archives.

``write_archives`` groups records into independent frames, writes the frames one after another and ends every archive with
the seek table of the seekable Zstandard format (a skippable frame of compressed and raw sizes). Any zstd tool can unpack an
archive as a whole. The returned index maps each record id to archive, frame and offset inside the raw frame; ``read_records``
uses index and seek table to read single frames by their byte range.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest id is a response; the others are revisits that
refer to it and carry no payload. Smaller payloads are all responses. A null payload is empty. A row without id is a
response. Rows repeating the id and payload of a response are responses too. Other columns are ignored.

Archives live in a shared folder and are named by task attempt; only those of attempts that Spark committed are in the index, so a
lost executor or a repeated task leaves no trace in the result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from toposcan.llm.common import stored
from toposcan.session import scratch

# Markers of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
ARCHIVE_BYTES = 64 << 20
INDEX = "record_id string, page_id long, archive string, frame int, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(path: str):
    """(file system, path in it) of a local path or any URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit if ``refers_to`` is given."""
    name = f"urn:page:{'' if page_id is None else page_id}"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _http(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; the payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:N>
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


class _Archive:
    """Writes frames to one file and the seek table at its end."""

    def __init__(self, folder: str, name: str) -> None:
        import zstandard

        self.path = f"{folder.rstrip('/')}/{name}"
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        self.out = system.open_output_stream(f"{inner.rstrip('/')}/{name}", compression=None)
        self.pack, self.frames, self.size = zstandard.ZstdCompressor(level=3), [], 0

    def frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.size += len(packed)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, packed size, raw size) of every frame of an open archive."""
    end = source.size()
    count, descriptor, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
    width = 12 if descriptor & 0x80 else 8
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the archive")
    entries, out, start = source.read_at(count * width, end - 9 - count * width), [], 0
    for k in range(count):
        packed, raw = struct.unpack_from("<II", entries, k * width)
        out.append((start, packed, raw))
        start += packed
    return out


def _writer(folder: str, date: str, frame_bytes: int, archive_bytes: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, archive = TaskContext.get().taskAttemptId(), 0, None
        buffer, size, index = [], 0, []

        def flush():
            nonlocal archive, number, buffer, size, index
            if archive is None:
                archive = _Archive(folder, f"a{task:08d}-{number:04d}.warc.zst")
                number += 1
            rows = pd.DataFrame(index, columns=["record_id", "page_id", "offset", "length"]).assign(archive=archive.path, frame=len(archive.frames))
            archive.frame(b"".join(buffer))
            buffer, size, index = [], 0, []
            if archive.size >= archive_bytes:
                archive.close()
                archive = None
            rows["page_id"] = rows["page_id"].astype("Int64")
            return rows[["record_id", "page_id", "archive", "frame", "offset", "length"]]

        none = lambda x: None if pd.isna(x) else x
        for part in parts:
            for page_id, url, payload, refers in zip(part["page_id"], part["url"], part["payload"], part["refers_to"]):
                page_id, refers = none(page_id), none(refers)
                name, raw = record(None if page_id is None else int(page_id), none(url), (payload or "").encode("utf-8", "surrogatepass"), None if refers is None else int(refers), date)
                index.append((name, page_id, size, len(raw)))
                buffer.append(raw)
                size += len(raw)
                if size >= frame_bytes:
                    yield flush()
        if buffer:
            yield flush()
        if archive is not None:
            archive.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, payload: str = "html", date: str = "1970-01-01T00:00:00Z",
                   frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload`` rows; returns the stored index ``record_id, page_id, archive, frame, offset, length``."""
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"sha": F.sha1(F.encode("payload", "UTF-8")), "bytes": F.octet_length("payload")})
    first = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"))
    tagged = rows.join(first, ["sha", "bytes"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).cast("string").alias("refers_to"))
    return stored(tagged.mapInPandas(_writer(folder, date, frame_bytes, archive_bytes), INDEX), "warc-index")


def _reader(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    names = [x.split()[0] for x in RECORD.split(", ")]
    source, path, table, at, raw = None, None, [], None, b""
    for part in parts:
        out = []
        for archive, frame, offset, length in zip(part["archive"], part["frame"], part["offset"], part["length"]):
            if archive != path:
                if source is not None:
                    source.close()
                system, inner = file_system(archive)
                source, path, at = system.open_input_file(inner), archive, None
                table = seek_table(source)
            if frame != at:
                start, packed, size = table[frame]
                raw, at = zstandard.ZstdDecompressor().decompress(source.read_at(packed, start), max_output_size=size), frame
            out.append(parse(raw[offset : offset + length]))
            if len(out) >= 500:
                yield _frame(out, names)
                out = []
        if out:
            yield _frame(out, names)
    if source is not None:
        source.close()


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names (all or a selection), read from their frames: ``page_id, url, ..., payload``."""
    dealt = index.select("archive", "frame", "offset", "length").repartition("archive").sortWithinPartitions("archive", "frame", "offset")
    return dealt.mapInPandas(_reader, RECORD)
