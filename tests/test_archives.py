"""Zip archives as a splittable source and a packed sink."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import functions as F

from mineralis.sources import archives as Z


def build(path, names, **options):
    with zipfile.ZipFile(path, "w", **options) as z:
        for k, name in enumerate(names):
            z.writestr(name, f"data_{name}\n" + "xyz " * (k * 50))


def test_one_archive_over_many_tasks(spark, tmp_path):
    names = [f"icsd_{k}.cif" for k in range(60)] + ["notes.txt", "é_ü.cif", "dir/inner.cif"]
    build(tmp_path / "a.zip", names, compression=zipfile.ZIP_DEFLATED)
    build(tmp_path / "b.zip", ["only.cif"])
    df = Z.scan_zip_archive(spark, str(tmp_path), split_bytes=400, batch=7)
    rows = {r.filename: r for r in df.collect()}
    assert set(rows) == {n for n in names if n.endswith(".cif")} | {"only.cif"}
    assert all(r.text == f"data_{n}\n" + "xyz " * (names.index(n) * 50 if n in names else 0) and r.read_error is None for n, r in rows.items())
    used = df.filter(F.endswith("archive", F.lit("a.zip"))).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 5
    whole = Z.scan_zip_archive(spark, str(tmp_path / "a.zip"))
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 62
    assert Z.scan_zip_archive(spark, str(tmp_path / "b*.zip"), suffix="").count() == 1


def test_slices_cover_the_directory(tmp_path):
    build(tmp_path / "a.zip", [f"{k}.cif" for k in range(500)])
    parts = Z.slices(str(tmp_path / "a.zip"), 3000)
    with open(tmp_path / "a.zip", "rb") as f:
        start, length = Z.directory(f, os.path.getsize(tmp_path / "a.zip"))
    assert parts[0].start == start and all(a.start + a.bytes == b.start for a, b in zip(parts, parts[1:]))
    assert parts[-1].start + parts[-1].bytes == start + length and len(parts) > 50


def test_members_and_archives_that_cannot_be_read(spark, tmp_path):
    path = tmp_path / "bad.zip"
    build(path, [f"m{k}.cif" for k in range(4)])
    data = bytearray(path.read_bytes())
    at = data.find(b"data_m1.cif")
    data[at] ^= 1                                   # content differs from its checksum
    at = data.find(b"PK\x03\x04", data.find(b"data_m2.cif"))
    data[at:at + 4] = b"XXXX"                       # no member at its place
    path.write_bytes(data)
    (tmp_path / "torn.zip").write_bytes(data[:300])
    (tmp_path / "empty.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    with zipfile.ZipFile(tmp_path / "lzma.zip", "w", compression=zipfile.ZIP_LZMA) as z:
        z.writestr("l.cif", "x" * 100)
    rows = {(os.path.basename(r.archive), r.filename): (r.text is not None, r.read_error) for r in Z.scan_zip_archive(spark, str(tmp_path)).collect()}
    assert rows == {("bad.zip", "m0.cif"): (True, None), ("bad.zip", "m1.cif"): (False, "read failed: checksum differs"),
                    ("bad.zip", "m2.cif"): (True, None), ("bad.zip", "m3.cif"): (False, "read failed: no member at its place"),
                    ("torn.zip", None): (False, "read failed: no directory"), ("empty.zip", None): (False, "read failed: no directory"),
                    ("lzma.zip", "l.cif"): (False, "read failed: compression method 14")}
    os.mkdir(tmp_path / "nothing")
    assert Z.scan_zip_archive(spark, str(tmp_path / "nothing")).count() == 0


def test_sizes_beyond_32_bits(spark, tmp_path):
    """The wide fields are used by a writer that does not know the size in advance."""
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        with z.open("wide.cif", "w", force_zip64=True) as f:
            f.write(b"data_wide")
    assert [(r.filename, r.text) for r in Z.scan_zip_archive(spark, str(tmp_path / "w.zip")).collect()] == [("wide.cif", "data_wide")]
    entry = (b"PK\x01\x02" + bytes(6) + bytes(10) + (b"\xff" * 4) * 2 + (1).to_bytes(2, "little") + (28).to_bytes(2, "little") + bytes(10) + b"\xff" * 4
             + b"n" + b"\x01\x00\x18\x00" + (5 << 32).to_bytes(8, "little") + (6 << 32).to_bytes(8, "little") + (7 << 32).to_bytes(8, "little"))
    import io

    (used, m), = Z.entries(io.BytesIO(entry), 0, len(entry))
    assert (used, m.size, m.stored, m.place) == (len(entry), 5 << 32, 6 << 32, 7 << 32)


def test_new_archives_stream_in(spark, tmp_path):
    source, where = tmp_path / "in", str(tmp_path / "mark")
    source.mkdir()
    build(source / "one.zip", ["a.cif", "b.cif"])

    def run():
        q = (Z.stream_zip_archives(spark, str(source)).select("filename").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", where).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(r.filename for r in spark.read.schema("filename string").parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.cif", "b.cif"]
    build(source / "two.zip", ["c.cif"])
    later = os.stat(source / "one.zip").st_mtime + 10
    os.utime(source / "two.zip", (later, later))
    assert run() == ["a.cif", "b.cif", "c.cif"] == run()


def test_packed_sink(spark, tmp_path):
    rows = [(f"m{k}.cif", f"text {k} é" * (k % 5)) for k in range(200)] + [("twice.cif", "1"), ("twice.cif", "2"), ("null.cif", None)]
    path = str(tmp_path / "packed")
    Z.write_zip(spark.createDataFrame(rows, "filename string, text string").repartition(3), path, archive_bytes=1000)
    files = [f for f in os.listdir(path) if f.endswith(".zip")]
    assert 3 <= len(files) < 30
    with zipfile.ZipFile(os.path.join(path, files[0])) as z:   # a plain zip archive to others
        assert z.testzip() is None and z.namelist()
    open(os.path.join(path, "part-lost.zip"), "wb").close()    # what a lost task leaves
    wanted = spark.createDataFrame([("m7.cif",), ("m7.cif",), ("twice.cif",), ("null.cif",), ("absent.cif",)], "filename string")
    got = sorted((r.filename, r.text, r.read_error) for r in Z.read_members(spark, path, wanted).collect())
    assert got == [("m7.cif", "text 7 é" * 2, None), ("null.cif", "", None), ("twice.cif", "1", None), ("twice.cif", "2", None)]


def test_a_small_archive_is_a_slice_without_a_look_at_its_entries(tmp_path, monkeypatch):
    build(tmp_path / "a.zip", [f"{k}.cif" for k in range(50)])
    monkeypatch.setattr(Z, "entries", lambda *a: 1 / 0)
    part, = Z.slices(str(tmp_path), 1 << 20)
    assert part.error is None and part.bytes > 0
