"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Archives travel as rows (archive, content) so that they can be written to any store that Spark reaches; `save_archives` writes them
as files, and `read_archives` also takes rows of Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the two formats.
DICTIONARY_FRAME, FRAME, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ARCHIVE_BYTES, SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 200, 1 << 20, 16 << 10
#: Records over this many bytes are not decoded: a frame of a few bytes can claim to hold far more than a task does.
MOST_BYTES = 1 << 30
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: str | None) -> str:
    """The name of a page's record: any text can be an id, and no id is told from all of them."""
    return "<urn:none>" if page_id is None else f"<urn:page:{urllib.parse.quote(page_id, safe='')}>"


def page_of(name: str) -> str | None:
    return urllib.parse.unquote(m[1]) if (m := re.fullmatch(r"<urn:page:([^<>]*)>", name)) else None


def record(page_id: str | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, revisit: bool, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit of another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub('[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressor]:
    """The head of a new archive and the compressor for its frames; the dictionary is trained on a bounded sample of its records."""
    samples, total = [], 0
    for r in records[:SAMPLES]:
        samples.append(r[: 16 << 10])
        total += len(samples[-1])
        if total > SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few records to train on: their own beginnings serve as one
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed, zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)


def write_archives(records: DataFrame) -> DataFrame:
    """(archive, content) of records (page_id string, url, payload binary, payload_bytes, sha1 hexadecimal, revisit boolean, refers_to
    string).

    Each task fills archives of about ARCHIVE_BYTES of records, one at a time.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(waiting: list[bytes]) -> pa.RecordBatch:
            head, compressor = pack(waiting)
            content = b"".join([head, *map(compressor.compress, waiting)])
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([content], pa.binary())], ["archive", "content"])

        waiting, held = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "sha1", "revisit", "refers_to")]
            for row in zip(*columns, strict=True):
                page_id, url, payload, size, sha1, revisit, refers_to = (x.as_py() for x in row)
                waiting.append(record(page_id, url, payload, size, bytes.fromhex(sha1), revisit, refers_to))
                held += len(waiting[-1])
                if held >= ARCHIVE_BYTES:
                    yield archive(waiting)
                    waiting, held = [], 0
        if waiting:
            yield archive(waiting)

    return records.mapInArrow(fill, "archive string, content binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(file) of archives (archive, content) written as .warc.zst files to a folder that all executors see as their own. A file appears
    whole or not at all, so that a task can be done again.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            files = []
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content.as_py())
                os.replace(part, path)
                files.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    return archives.select("archive", "content").mapInArrow(save, "file string")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at a place ends, by the lengths of its blocks."""
    parameters = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a frame ends within a block's head")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * parameters.has_checksum
    if at > len(data):
        raise ValueError("a frame is longer than its archive")
    return at


def unpacked(content: bytes, most: int = MOST_BYTES) -> Iterator[bytes | ValueError]:
    """Each record's bytes, one frame at a time. A frame that cannot be decoded, or to more than most bytes only, is an error, and the
    next frame follows; where no frame can be told from the next one, the archive ends.
    """
    data, at, decompressor = memoryview(content), 0, zstandard.ZstdDecompressor()
    first = True
    while at < len(data):
        try:
            (magic,) = struct.unpack_from("<I", data, at)
            if magic in SKIPPABLE:
                (size,) = struct.unpack_from("<I", data, at + 4)
                if first and magic == DICTIONARY_FRAME:
                    trained = bytes(data[at + 8 : at + 8 + size])
                    if trained[:4] == struct.pack("<I", FRAME):
                        trained = within(zstandard.ZstdDecompressor(), trained, MOST_BYTES)
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
                at += 8 + size
            else:
                end = frame_end(data, at)
                try:
                    out = within(decompressor, data[at:end], most)
                except (zstandard.ZstdError, ValueError) as e:
                    out = ValueError(f"at byte {at}: {e}")
                yield out
                at = end
            first = False
        except (zstandard.ZstdError, struct.error, ValueError) as e:
            yield ValueError(f"at byte {at}: {e}")
            return


def within(decompressor: zstandard.ZstdDecompressor, frame: bytes | memoryview, most: int) -> bytes:
    """The content of one frame, read no further than most bytes."""
    out = decompressor.stream_reader(io.BytesIO(frame)).read(most + 1)
    if len(out) > most:
        raise ValueError(f"a frame holds more than {most} bytes")
    return out


def parsed(data: bytes) -> dict:
    """The fields of a record; problem says what is wrong with its headers, lengths or digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    problem = None
    if not re.fullmatch(r"WARC/1\.[01]", version) or len(fields) != len(lines):
        problem = "bad head"
    elif missing := [x for x in REQUIRED if x not in fields]:
        problem = f"no {missing[0]}"
    elif not fields["Content-Length"].isdigit() or int(fields["Content-Length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        problem = "bad Content-Length"
    named = lambda x: page_of(fields.get(x, ""))
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    kind, said = fields.get("WARC-Type"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    size = fields.get("X-Payload-Length", str(len(payload)))
    if not problem and kind == "response" and (size != str(len(payload)) or said != digest(payload)):
        problem = "payload differs from its length or digest"
    if not problem and kind == "revisit" and not re.fullmatch(r"<urn:(none|page:[^<>]*)>", fields.get("WARC-Refers-To", "")):
        problem = "a revisit of nothing"
    return {"page_id": named("WARC-Record-ID"), "payload_bytes": int(size) if size.isdigit() else None, "payload_digest": said, "record_type": kind, "refers_to": named("WARC-Refers-To"), "payload": payload if kind == "response" else None, "problem": problem}


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """A row per record of the archives, in the columns of RECORD. What cannot be decoded is a row with a problem only."""
    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
    broken = dict.fromkeys(schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for data in unpacked(archive.as_py() or b""):
                    rows.append(broken | {"problem": str(data)} if isinstance(data, ValueError) else parsed(data))
                    held += 0 if isinstance(data, ValueError) else len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(content).mapInArrow(read, RECORD)


def with_revisits(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records for write_archives: of pages with equal payloads of least_bytes or more, that with the smallest id keeps its payload
    and the others refer to it. Null payloads are empty. Null ids come last; rows that share the smallest id all keep theirs.

    Payloads are told apart by SHA-1 and length. The ids of first pages are written down and joined, so that Spark can split
    the rows of a payload that many pages share.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("sha1"))
    firsts = written(rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min("_id").alias("_first")), "firsts")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.col(c).cast("string")
    return rows.join(firsts, ["sha1", "payload_bytes"], "left").select(name("_id").alias("page_id"), "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "sha1", again.alias("revisit"), F.when(again, name("_first")).alias("refers_to"))
