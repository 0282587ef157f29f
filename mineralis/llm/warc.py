"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are files of a shared folder, written and read by tasks through the file system that the folder's
scheme names. A task's files carry the name of its attempt, and the table of finished files, which Spark
commits as a whole, says which of them count; what a lost attempt leaves behind is never read.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

# fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"   # pages have no date of their own
NAME = "urn:x-page:"

#: equal payloads of at least so many bytes are written once
REVISIT_BYTES = 1000
#: an archive is closed once its payloads exceed this; the dictionary is trained on its first records
ARCHIVE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES, LEVEL = 32 << 20, 128, 16 << 10, 3
CHUNK = 1 << 20
#: archives are read one to a task up to so many tasks, beyond that several
MOST_TASKS = 20_000

_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD = ("archive string, offset long, record_type string, page_id long, target_uri string, refers_to long, "
          "payload_bytes long, payload_digest string, payload binary, error string")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) for each row of (page_id, url, html).

    Payload: the html in UTF-8, a null one empty. Of the records with one payload of at least
    ``REVISIT_BYTES`` those with the largest id are responses (several if that id repeats); the others
    revisit it. Payloads of null ids only are all responses. Only payloads that occur under several ids
    take part in the join, as one row each.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    long = F.octet_length("payload") >= REVISIT_BYTES
    same = (rows.filter(long).groupBy("payload_digest").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1).select(F.col("payload_digest").alias("_digest"), "_top"))
    met = rows.join(same, (F.col("payload_digest") == F.col("_digest")) & long, "left")
    again = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return met.select("page_id", "url", "payload", "payload_digest",
                      F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.when(again, F.col("_top")).alias("refers_to"))


def _name(page_id) -> str:
    return f"<{NAME}{'none' if pd.isna(page_id) else int(page_id)}>"


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One record, headers and block, as it stands in the archive before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if isinstance(url, str) and url else f"{NAME}none"
    head = [("WARC-Type", record_type), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", CAPTURED), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if record_type == "revisit":
        head[3:3] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:   # too few or too uniform samples to train on
        return None


def _open_archive(files: fs.FileSystem, path: str, samples: list[bytes]):
    sink = files.open_output_stream(path, compression=None)
    learned = _dictionary(samples)
    if learned is not None:
        content = learned.as_bytes()
        sink.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
    return sink, zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_content_size=True)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``with_revisits`` below ``folder``; -> (path, records) of the finished archives."""
    target, where = fs.FileSystem.from_uri(folder)
    target.create_dir(where, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        attempt, made, held, sink, pack, size, count, path = uuid.uuid4().hex, 0, [], None, None, 0, 0, ""

        def begin():
            nonlocal sink, pack, path, held, made
            path = f"{base}/{attempt}-{made:05d}.warc.zst"
            sink, pack = _open_archive(files, path, held)
            made += 1
            for r in held:
                sink.write(pack.compress(r))
            held = []

        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                data = record_bytes(*row)
                size, count = size + len(data), count + 1
                if sink is not None:
                    sink.write(pack.compress(data))
                else:
                    held.append(data)
                    if len(held) == SAMPLE_RECORDS or size > ARCHIVE_BYTES:
                        begin()
                if size > ARCHIVE_BYTES:
                    sink.close()
                    yield pd.DataFrame({"path": [path], "records": [count]})
                    sink, size, count = None, 0, 0
        if held:
            begin()
        if sink is not None:
            sink.close()
            yield pd.DataFrame({"path": [path], "records": [count]})

    return cut_lineage(records.mapInPandas(write, "path string, records long"))


def frames(source) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record bytes, error) of each frame of an open archive.

    The dictionary is taken from a leading skippable frame; it may itself be compressed. Other skippable
    frames are passed over. After a torn or foreign frame nothing in the file can be placed, so its error
    is the last row.
    """
    buffer, offset, unpack = b"", 0, zstandard.ZstdDecompressor()

    def fill(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n and (more := source.read(CHUNK)):
            buffer += more
        return len(buffer) >= n

    while fill(1):
        if not fill(8):
            yield offset, None, "torn frame"
            return
        magic, size = struct.unpack("<II", buffer[:8])
        if magic >> 4 == DICTIONARY_FRAME >> 4:
            if not fill(8 + size):
                yield offset, None, "torn frame"
                return
            content = buffer[8:8 + size]
            if offset == 0 and magic == DICTIONARY_FRAME:
                try:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content) if content[:4] == ZSTD_MAGIC else content
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                except zstandard.ZstdError:
                    yield offset, None, "bad dictionary"
                    return
            buffer, offset = buffer[8 + size:], offset + 8 + size
            continue
        one, parts, used = unpack.decompressobj(), [], 0
        try:
            while not one.eof:
                if not buffer and not fill(1):
                    yield offset, None, "torn frame"
                    return
                parts.append(one.decompress(buffer))
                used += len(buffer)
                buffer = one.unused_data if one.eof else b""
        except zstandard.ZstdError:
            yield offset, None, "bad frame"
            return
        used -= len(buffer)
        yield offset, b"".join(parts), None
        offset += used


def _page(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{NAME}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """Fields of one record; ``error`` names the first check that it fails."""
    out = dict.fromkeys(("record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "error"))
    head, mark, body = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return out | {"error": "bad version line"}
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return out | {"error": "bad header line"}
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    out |= {"record_type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")),
            "target_uri": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to"))}
    if not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(fields):
        return out | {"error": "missing header"}
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit() or \
            len(body) != int(fields["content-length"]) + 4 or body[-4:] != b"\r\n\r\n":
        return out | {"error": "bad length"}
    http, mark, payload = body[:-4].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    try:
        digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    except ValueError:
        return out | {"error": "bad digest"}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": digest}
    if stated and int(stated[1]) != len(payload):
        return out | {"error": "bad length"}
    if digest and sha1(payload).hexdigest() != digest:
        return out | {"error": "bad digest"}
    return out | {"payload_bytes": len(payload), "payload_digest": digest or sha1(payload).hexdigest(), "payload": payload}


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives named in ``path``, columns ``RECORD``.

    One row per frame. A record that fails a check keeps the fields read so far and says why in
    ``error``; a file that cannot be opened is one row with an error. An empty table gives no rows.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                try:
                    with files.open_input_stream(path, compression=None) as source:
                        for offset, data, error in frames(source):
                            fields = parse_record(data) if error is None else {"error": error}
                            rows.append({"archive": path, "offset": offset, **fields})
                            size += len(data or b"")
                            if size > CHUNK:
                                yield _table(rows, names)
                                rows, size = [], 0
                except OSError as failed:
                    if not isinstance(failed, FileNotFoundError):
                        raise   # a store that is away for a moment: the task is tried again
                    rows.append({"archive": path, "offset": 0, "error": "no such file"})
                if rows:
                    yield _table(rows, names)

    tasks = max(1, min(archives.count(), MOST_TASKS))
    return archives.select("path").repartition(tasks, "path").mapInPandas(read, RECORD)


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({c: "Int64" for c in ("offset", "page_id", "refers_to", "payload_bytes")})


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in a new folder below the shared one and read the records back."""
    folder = scratch_path(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)   # a path without a scheme is in the cluster's own file system
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    folder = re.sub(r"^file:/(?!//)", "file:///", folder)
    return read_archives(write_archives(with_revisits(pages), folder), folder)
