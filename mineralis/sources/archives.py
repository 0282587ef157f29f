"""Zip archives as a splittable source and as a packed sink.

A zip file ends with a directory of its members, so one archive can be read by many tasks: the directory of a
large archive is walked once to cut it into slices of about equal size, and a task reads its slice of the directory
and then only the bytes of its own members. Nothing but the slices' places reaches the driver, however many members
there are.

The sink writes one archive per task (a few hundred for a million members, where a folder per member would be
a million) and an index of each member's place, so that one member can be read without its archive's others.
Files go through the file system that the path names: local, HDFS, S3 or GCS.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "zip_members"
MEMBER_SCHEMA = "archive string, filename string, text string, read_error string"
INDEX_SCHEMA = "filename string, archive string, place long, stored long, size long, crc long, method int"
#: bytes of members that a task reads, rows of a batch, bytes read ahead
SPLIT_BYTES, BATCH_ROWS, READ_AHEAD = 32 << 20, 1000, 1 << 20

# fixed values: records of the zip format and their layouts
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ENTRY_LAYOUT, _LOCAL_BYTES, _WIDE = struct.Struct("<4s6H3I5H2I"), 30, 0xFFFFFFFF
STORED, DEFLATED = 0, 8


@dataclass
class Member:
    filename: str
    place: int
    stored: int
    size: int
    crc: int
    method: int
    flags: int = 0


@dataclass
class Slice(InputPartition):
    """Directory entries of an archive: ``bytes`` of them from byte ``start`` on, or why there are none."""

    archive: str
    start: int = 0
    bytes: int = 0
    error: str | None = None


# ---- file systems ---------------------------------------------------------------------------------

def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that the cluster gives it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def archives_of(uri: str) -> list[tuple[float, str]]:
    """(time of change, path) of the archives that a file, folder or pattern names, by time and name."""
    from pyarrow import fs

    files, base = _file_system(uri)
    folder, pattern = (posixpath.dirname(base), posixpath.basename(base)) if any(c in posixpath.basename(base) for c in "*?[") else (base, "*.zip")
    info = files.get_file_info(folder)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = [f for f in files.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    else:
        raise FileNotFoundError(uri)
    return sorted((f.mtime_ns or 0, f.path) for f in found)


def _open(files, path: str):
    raw = files.open_input_file(path)
    return raw, raw.size()


# ---- the directory of an archive ---------------------------------------------------------------------

def directory(source, size: int) -> tuple[int, int]:
    """Where an archive's directory begins and how many bytes it has; ValueError if there is none."""
    tail_at = max(0, size - (1 << 16) - 22)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no directory")
    length, start = struct.unpack("<II", tail[at + 12:at + 20])
    if _WIDE in (length, start) and tail[at - 20:at - 16] == _LOCATOR64:
        source.seek(struct.unpack("<Q", tail[at - 12:at - 4])[0])
        wide = source.read(56)
        if wide[:4] != _END64:
            raise ValueError("no directory")
        length, start = struct.unpack("<QQ", wide[40:56])
    if start + length > size:
        raise ValueError("the directory is cut off")
    return start, length


def entries(source, start: int, length: int) -> Iterator[tuple[int, Member]]:
    """(bytes of the entry, member) of a run of directory entries, read in chunks."""
    source.seek(start)
    chunk, left = b"", length
    while left or chunk:
        if len(chunk) < (1 << 17) and left:   # an entry has less than three times 2^16 bytes of names and more
            more = source.read(min(left, 1 << 20))
            if not more:
                raise ValueError("the directory is cut off")
            chunk, left = chunk + more, left - len(more)
            if len(chunk) < (3 << 16) + 46 and left:
                continue
        kind, _, _, flags, method, _, _, crc, stored, size, n, extra, comment, _, _, _, place = _ENTRY_LAYOUT.unpack_from(chunk)
        if kind != _ENTRY:
            raise ValueError("a directory entry is damaged")
        name = chunk[46:46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        more, fields = chunk[46 + n:46 + n + extra], [size, stored, place]
        while len(more) >= 4:   # sizes beyond 32 bits stand in an extra field, in this order
            tag, size_ = struct.unpack("<HH", more[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{size_ // 8}Q", more[4:4 + size_ // 8 * 8]))
                fields = [wide.pop(0) if f == _WIDE and wide else f for f in fields]
            more = more[4 + size_:]
        used = 46 + n + extra + comment
        chunk = chunk[used:]
        yield used, Member(name, fields[2], fields[1], fields[0], crc, method, flags)


def slices(uri: str, split_bytes: int) -> list[Slice]:
    """Runs of directory entries whose members have about ``split_bytes``; a damaged archive is one slice with its error."""
    files, out = _file_system(uri)[0], []
    for _, path in archives_of(uri):
        try:
            raw, size = _open(files, path)
            with raw, io.BufferedReader(raw, READ_AHEAD) as source:
                start, length = directory(source, size)
                if size <= split_bytes:   # one slice, so its entries need no look
                    out += [Slice(path, start, length)] if length else []
                    continue
                begun = at = start
                full = 0
                for used, member in entries(source, start, length):
                    at, full = at + used, full + member.stored
                    if full >= split_bytes:
                        out.append(Slice(path, begun, at - begun))
                        begun, full = at, 0
                if at > begun:
                    out.append(Slice(path, begun, at - begun))
        except (ValueError, OSError, struct.error) as problem:
            out.append(Slice(path, error=f"read failed: {problem}"))
    return out


def read_member(source, member: Member) -> bytes:
    """The content of one member; ValueError if it is not what the directory says."""
    if member.flags & 1:
        raise ValueError("encrypted")
    if member.method not in (STORED, DEFLATED):
        raise ValueError(f"compression method {member.method}")
    source.seek(member.place)
    head = source.read(_LOCAL_BYTES)
    if head[:4] != _LOCAL:
        raise ValueError("no member at its place")
    name, extra = struct.unpack("<HH", head[26:30])
    source.seek(member.place + _LOCAL_BYTES + name + extra)
    content = source.read(member.stored)
    if member.method == DEFLATED:
        content = zlib.decompress(content, -15)
    if len(content) != member.size or zlib.crc32(content) != member.crc:
        raise ValueError("checksum differs")
    return content


# ---- source -----------------------------------------------------------------------------------------

def _texts(uri: str, part: Slice, suffix: str, batch: int):
    """Arrow batches of a slice; what cannot be read keeps a row with its error."""
    import pyarrow as pa

    schema = pa.schema([(n, pa.string()) for n in ("archive", "filename", "text", "read_error")])
    rows: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
    if part.error:
        rows.append((part.archive, None, None, part.error))
    else:
        raw, _ = _open(_file_system(uri)[0], part.archive)
        with raw, io.BufferedReader(raw, READ_AHEAD) as source:
            own = [m for _, m in entries(source, part.start, part.bytes) if m.filename.endswith(suffix) and not m.filename.endswith("/")]
            for member in sorted(own, key=lambda m: m.place):
                try:
                    rows.append((part.archive, member.filename, read_member(source, member).decode("utf-8", "replace"), None))
                except (ValueError, OSError, zlib.error, struct.error) as problem:
                    rows.append((part.archive, member.filename, None, f"read failed: {problem}"))
                if len(rows) == batch:
                    yield made()
                    rows.clear()
    if rows:
        yield made()


class _Options:
    def __init__(self, options) -> None:
        self.uri = options["path"]
        self.suffix = options.get("suffix", ".cif")
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.batch = int(options.get("batchRows", BATCH_ROWS))

    def read(self, partition: Slice):
        return _texts(self.uri, partition, self.suffix, self.batch)


class ZipReader(_Options, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return slices(self.uri, self.split_bytes) or [Slice("")]   # a folder without archives has no rows

    def read(self, partition: Slice):
        return _texts(self.uri, partition, self.suffix, self.batch) if partition.archive else iter(())


class ZipStreamReader(_Options, DataSourceStreamReader):
    """New archives in the order of their time of change and name; one that is older than what was read is not seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = archives_of(self.uri)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        files = [p for t, p in archives_of(self.uri) if (start["time"], start["path"]) < (t, p) <= (end["time"], end["path"])]
        scheme = self.uri.split("://", 1)[0] + "://" if "://" in self.uri else ""
        return [s for path in files for s in slices(scheme + path, self.split_bytes)]

    def commit(self, end: dict) -> None:
        pass


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(path)``; options suffix, splitBytes, batchRows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)

    def streamReader(self, schema) -> ZipStreamReader:
        return ZipStreamReader(self.options)


def scan_zip_archive(spark: SparkSession, path: str, batch: int = BATCH_ROWS, suffix: str = ".cif", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, filename, text, read_error) of the members of zip archives: a file, a folder or a pattern.

    Members are dealt to tasks by their sizes, so one large archive is read by many. An unreadable member, or
    an archive without a directory, keeps a row with its error.
    """
    spark.dataSource.register(ZipMembers)
    return (spark.read.format(FORMAT).option("suffix", suffix).option("splitBytes", split_bytes).option("batchRows", batch)
            .load(qualified(spark, path)))


def stream_zip_archives(spark: SparkSession, path: str, suffix: str = ".cif", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same of archives as they arrive in a folder."""
    spark.dataSource.register(ZipMembers)
    return spark.readStream.format(FORMAT).option("suffix", suffix).option("splitBytes", split_bytes).load(qualified(spark, path))


# ---- packed sink -------------------------------------------------------------------------------------

def write_zip(members: DataFrame, path: str, archive_bytes: int = 1 << 30) -> None:
    """Write (filename, text) as zip archives below ``path`` and an index of their members at ``path``/index.

    Each task writes archives of its own of about ``archive_bytes``; the index names only those of tasks that
    ended, so what a lost task leaves behind is never read. Repeated names are members of their own. A
    null text is an empty member.
    """
    uri = qualified(members.sparkSession, path)
    files, base = _file_system(uri)
    files.create_dir(base, recursive=True)

    def write(batches):
        import uuid
        import zipfile

        import pandas as pd

        files, base = _file_system(uri)
        archive = sink = None
        name, written = "", 0

        def close():
            archive.close()
            sink.close()
            return pd.DataFrame([(i.filename, name, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in archive.infolist()],
                                columns=["filename", "archive", "place", "stored", "size", "crc", "method"])

        for batch in batches:
            for filename, text in zip(batch["filename"], batch["text"]):
                if archive is None:
                    name, written = f"part-{uuid.uuid4().hex}.zip", 0
                    sink = files.open_output_stream(f"{base}/{name}", compression=None)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                content = (text or "").encode("utf-8", "surrogatepass")
                entry = zipfile.ZipInfo(filename)
                entry.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(entry, content)
                written += len(content)
                if written >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    rows = members.select("filename", "text").mapInPandas(write, INDEX_SCHEMA)
    rows.write.parquet(f"{path.rstrip('/')}/index")


def read_members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(filename, text, read_error) of the ``wanted`` names among the members that ``write_zip`` wrote. Only their
    own bytes are read; a name without a member is skipped, a repeated name gives each of its members."""
    uri = qualified(spark, path)
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path.rstrip('/')}/index")
    places = index.join(wanted.select("filename").distinct(), "filename", "left_semi")

    def read(batches):
        import pandas as pd

        files, base = _file_system(uri)
        held, name = None, None
        for batch in batches:
            rows = []
            for m in batch.sort_values(["archive", "place"]).itertuples(index=False):
                if m.archive != name:
                    if held is not None:
                        held.close()
                    held, name = _open(files, f"{base}/{m.archive}")[0], m.archive
                try:
                    rows.append((m.filename, read_member(held, Member(m.filename, m.place, m.stored, m.size, m.crc, m.method)).decode("utf-8", "replace"), None))
                except (ValueError, OSError, zlib.error) as problem:
                    rows.append((m.filename, None, f"read failed: {problem}"))
            yield pd.DataFrame(rows, columns=["filename", "text", "read_error"])

    return places.mapInPandas(read, "filename string, text string, read_error string")
