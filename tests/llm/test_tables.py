"""Operators on embeddings and pages, and the pipeline, against plain loops."""

from __future__ import annotations

import random
import struct
from hashlib import sha1

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from mineralis.llm import topk, warc

# --- top-k ------------------------------------------------------------------------------------------


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [60, 10**8, 2**40])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "PACK_ROWS", 4)
    monkeypatch.setattr(topk, "PAGE_BLOCKS", 3)
    rng = random.Random(scale)
    rows = [(i, [rng.randint(-scale, scale) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 240)] + [(300, [0] * 6), (301, [0] * 6), (302, rows[5][1]), (302, rows[5][1])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = [r for r in rows if r[0] % 10 == 0]
    limit = lambda s: max(-2**63, min(2**63 - 1, s))
    want = [(q, r, i, limit(s)) for q, r, i, s in brute_top(rows, queries, 5)]
    got = sorted(tuple(r) for r in topk.top_k(table, table.filter("vec_id % 10 = 0"), 5).collect())
    assert [g[3] for g in got] == [w[3] for w in want]
    if scale < 2**40:
        assert got == want


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-0.001, 0.25]), (None, [1.0, 1.0]), (50, []), (6, [2.0, 2.0, 9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    v = topk.integer_vectors(table)
    assert {r.vec_id: r.v for r in v.collect()} == {0: [256, 128], 5: [-1, 64], 50: [], 6: [512, 512, 2304]}
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect())
    assert got == [(0, 1, 6, 256 * 512 + 128 * 512), (0, 2, 5, 128 * 64 - 256), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 5, 0), (50, 3, 6, 0)]
    none = v.filter("vec_id < 0")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(v, none).count() == 0
    assert topk.top_k(v.filter("vec_id = 0"), v.filter("vec_id = 0")).count() == 0


# --- archives ---------------------------------------------------------------------------------------

def pages(spark):
    rng = random.Random(4)
    long = ["<p>" + "".join(rng.choices("abcé ", k=1200 + k)) for k in range(4)]
    rows = [(k, f"http://x/{k} \n", long[k % 4] if k % 3 else f"short {k % 5}") for k in range(60)]
    rows += [(100, None, None), (101, "u", ""), (None, "u", long[0]), (None, "u", "q" * 2000), (None, "u", "q" * 2000), (59, "u", long[59 % 4]), (102, "u", "x\r\n\r\ny")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("mine")).repartition(4)


def brute_pages(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 1000 and same and i != max(same)
        out.append((i, len(data), sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, monkeypatch):
    rows, table = pages(spark)
    back = warc.round_trip(spark, table).collect()
    assert all(r.error is None for r in back)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got, key=repr) == brute_pages(rows)
    assert warc.round_trip(spark, table.limit(0)).count() == 0


def archive(records, dictionary=None, packed=False):
    content = dictionary.as_bytes() if dictionary else b""
    if packed:
        content = zstandard.ZstdCompressor().compress(content)
    head = struct.pack("<II", warc.DICTIONARY_FRAME, len(content)) + content if dictionary else b""
    pack = zstandard.ZstdCompressor(dict_data=dictionary)
    return head + b"".join(pack.compress(r) for r in records)


def test_reading_archives_of_others(spark, tmp_path):
    payload = b"<html>x</html>" * 9
    good = [warc.record_bytes(k, "http://x", payload, sha1(payload).hexdigest(), "response", None) for k in range(9)]
    dictionary = zstandard.ZstdCompressionDict(payload * 4, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    files = {
        "plain": archive(good), "dictionary": archive(good, dictionary), "packed": archive(good, dictionary, True),
        "skippable": archive(good[:2]) + struct.pack("<II", 0x184D2A53, 3) + b"abc" + archive(good[2:3]),
        "torn": archive(good[:2])[:-5], "foreign": archive(good[:1]) + b"not a frame at all", "empty": b"",
        "length": archive([good[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), good[1]]),
        "version": archive([b"HTTP" + good[0][4:], good[1]]), "digest": archive([good[0].replace(b"<html>y", b"<html>x").replace(b"x</html>\r\n\r\n", b"z</html>\r\n\r\n")]),
        "header": archive([good[0].replace(b"WARC-Date: " + warc.CAPTURED.encode() + b"\r\n", b"")]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "missing"]], "path string")
    got = {}
    for r in warc.read_archives(paths, f"file://{tmp_path}").collect():
        got.setdefault(r.archive.rsplit("/", 1)[1], []).append((r.offset, r.error or r.page_id))
    got = {k: [x[1] for x in sorted(v, key=lambda x: x[0])] for k, v in got.items()}
    every = list(range(9))
    assert got == {"plain": every, "dictionary": every, "packed": every, "skippable": [0, 1, 2], "torn": [0, "torn frame"],
                   "foreign": [0, "bad frame"], "length": ["bad length", 1], "version": ["bad version line", 1],
                   "digest": ["bad digest"], "header": ["missing header"], "missing": ["no such file"]}


# --- pipeline ---------------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    labels = spark.createDataFrame([(k, int(k == 36)) for k in range(40)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    at = docs.withColumns({"size": F.lit("mine"), "spans": F.lit(1), "_class": F.lit(2)})
    n = at.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        at = out
        assert at.count() <= 3 * n
    assert {r.size for r in at.select("size").distinct().collect()} <= {"mine"}
    full = pipeline.run(spark, str(tmp_path)).collect()
    assert full and all(r.intact and r.n_tokens == len(r.ids) for r in full)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_pipeline_keeps_clean_rows(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == docs.count()
    redacted = stages["secret scans"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in redacted.dropna(subset=["doc_id", "text"]).collect()) == sorted(
        (r.doc_id, r.text) for r in docs.dropna(subset=["doc_id", "text"]).collect())


def test_query_names(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_topk", "op8_warc", "op10_mixing", "op12_hardneg", "op13_filter_audit"])
def test_sql_twins(spark, name):
    from mineralis import llm
    from oracle_check import compare, duck

    sf_dir = "/root/testdata/sf0.001"
    ok, message = compare(spark, duck(sf_dir), sf_dir, llm.queries()[name], llm.oracle_sql()[name])
    assert ok, message


def test_bounds_hold():
    rng = np.random.default_rng(3)
    rows, queries = rng.integers(-300, 300, (64, 8)), rng.integers(-300, 300, (16, 8))
    parts = rows.reshape(4, 16, 8)
    b = topk.bounds(queries, parts.max(1), parts.min(1))
    assert (b >= np.stack([(queries @ p.T).max(1) for p in parts], 1)).all()
