"""Versioned index, streams with bounded state, gap-free names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mineralis.operators.campaign import unique_slug
from mineralis.sources import index as I
from mineralis.streaming import ledger as S

ENTRY = "id long, filename string, n_elements int, chemsys string, elements array<string>, occ double"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_index_shows_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        I.read_index(spark, path)
    first = [(1, "a", 2, "Fe-O", ["Fe", "O"], None), (2, "b", 1, "O", ["O"], 0.5), (3, "c", None, None, None, None)]
    I.write_index(spark.createDataFrame(first, ENTRY), path, {"made": "1"})
    assert rows_of(I.read_index(spark, path), "id", "filename", "occ") == [(1, "a", None), (2, "b", 0.5), (3, "c", None)]
    assert rows_of(I.read_index(spark, path, "elements"), "id", "element") == [(1, "Fe"), (1, "O"), (2, "O")]
    assert [tuple(r) for r in I.read_index(spark, path, "meta").collect()] == [("made", "1")]
    assert rows_of(I.read_index(spark, path, n_elements=2), "id") == [(1,)] and I.read_index(spark, path, n_elements=7).count() == 0
    held = I.read_index(spark, path)   # a reader of the version before
    real = I._publish
    monkeypatch.setattr(I, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):   # everything is written, nothing is published
        I.write_index(spark.createDataFrame([(9, "z", 1, "O", ["O"], 1.0)], ENTRY), path)
    assert rows_of(I.read_index(spark, path), "id") == [(1,), (2,), (3,)]
    monkeypatch.setattr(I, "_publish", real)
    I.write_index(spark.createDataFrame([(9, "z", 1, "O", ["O"], 1.0)], ENTRY), path)
    assert rows_of(I.read_index(spark, path), "id") == [(9,)] and rows_of(held, "id") == [(1,), (2,), (3,)]
    assert I.read_index(spark, path, "meta").count() == 0
    I.write_index(spark.createDataFrame([], ENTRY), path)
    assert I.read_index(spark, path).count() == 0 and I.read_index(spark, path).columns == held.columns


def test_backfill_rewrites_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(k, f"f{k}", k % 4 or None, "x", ["O"], None) for k in range(20)]
    I.write_index(spark.createDataFrame(rows, ENTRY), path)
    folders = lambda: {r.part: r.folder for r in I._published(spark, path) if r.tbl == "entries"}
    before = folders()
    fresh = spark.createDataFrame([("f1", 0.1, "n"), ("f5", None, None), ("f4", 0.4, "m"), ("gone", 1.0, "g")], "filename string, occ double, note string")
    assert I.backfill_index(spark, path, fresh) == 2   # parts 1 and that without a number
    after = folders()
    assert {p for p in after if after[p] != before[p]} == {1, -1}
    want = [(f"f{k}", {1: 0.1, 4: 0.4}.get(k), {1: "n", 4: "m"}.get(k)) for k in range(20)]
    assert rows_of(I.read_index(spark, path), "filename", "occ", "note") == sorted(want, key=repr)
    assert I.backfill_index(spark, path, fresh) == 0 and folders() == after
    assert I.backfill_index(spark, path, spark.createDataFrame([("f1", 0.1)], "filename string, occ double")) == 0
    assert I.backfill_index(spark, path, spark.createDataFrame([("f2", 0.2)], "filename string, occ double")) == 1
    assert dict(rows_of(I.read_index(spark, path), "filename", "note"))["f1"] == "n"   # other columns stay
    with pytest.raises(ValueError):
        I.backfill_index(spark, path, spark.createDataFrame([("f2", 1)], "filename string, n_elements int"))


@pytest.fixture
def two_batches(monkeypatch):
    monkeypatch.setattr(S, "COMPACT_EVERY", 2)


def test_streams_read_few_folders(spark, tmp_path, two_batches, monkeypatch):
    """Seven batches; each reads at most the compacted table and two batches, and a replay changes nothing."""
    src, rng = str(tmp_path / "src"), random.Random(1)
    seen, rows = [], []
    read = S._changes
    monkeypatch.setattr(S, "_changes", lambda spark, out, base, batch, schema: (seen.append(batch - base), read(spark, out, base, batch, schema))[1])
    configs = lambda: spark.readStream.schema("key string, energy double, valid boolean, ord long").option("maxFilesPerTrigger", 1).parquet(src)
    for part in range(7):
        new = [(f"k{rng.randint(0, 12)}", rng.choice([1.0, 2.0, None, float("nan")]), rng.random() < 0.8, 10 * part + k) for k in range(6)]
        rows.append(new)
        spark.createDataFrame(new, "key string, energy double, valid boolean, ord long").coalesce(1).write.mode("append").parquet(src)
        S.stream_new_configs(configs(), str(tmp_path / "out"), str(tmp_path / "mark"))
    want = {}
    for new in rows:
        batch = {}
        for key, energy, valid, place in new:
            if valid and energy is not None and energy == energy:
                batch[key] = min(batch.get(key, (9e9, 0)), (energy, place))
        want = {**batch, **want}
    got = lambda: {r.key: (r.energy, r.ord) for r in S.read_new_configs(spark, str(tmp_path / "out")).collect()}
    assert got() == want and S.read_new_configs(spark, str(tmp_path / "out")).count() == len(want)
    assert seen and max(seen) <= 2
    S.stream_new_configs(configs(), str(tmp_path / "out"), str(tmp_path / "mark2"))   # all batches again
    assert set(got()) == set(want)


def test_last_status_after_compaction(spark, tmp_path, two_batches):
    path, out, last = str(tmp_path / "ledger"), str(tmp_path / "out"), {}
    for part in range(5):
        new = [("2024", f"f{(part * 3 + k) % 7}", ("ok", "error", "completed")[(part + k) % 3], part * 10 + k) for k in range(4)]
        spark.createDataFrame(new, "ts string, file string, status string, seq long").coalesce(1).write.mode("append").json(path)
        last.update({f: (s, q) for _, f, s, q in new})
        S.stream_ledger_status(S.read_ledger_stream(spark, path, 1), out, str(tmp_path / "mark"))
        assert {r.file: (r.status, r.seq) for r in S.read_ledger_status(spark, out).collect()} == last
    counts = str(tmp_path / "counts")
    S.stream_done_counts(S.read_ledger_stream(spark, path, 1), counts, str(tmp_path / "mark2"))
    progress = spark.read.parquet(f"{counts}/progress").orderBy("batch").collect()
    done = sum(s != "error" for s, _ in last.values())
    assert len(progress) == 5 and (progress[-1].n_done, progress[-1].n_open) == (done, len(last) - done)


def plain_slugs(names):
    plain, seen, out = {n for n in names}, {}, []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        seen[n] += 1
        while f"{n}-{seen[n]}" in plain:
            seen[n] += 1
        out.append(f"{n}-{seen[n]}")
    return out


@pytest.mark.parametrize("per_task", [1_000_000, 5])
def test_names_skip_what_is_taken(spark, per_task):
    rng = random.Random(per_task)
    names = [rng.choice(["a", "b", "a-1", "a-2", "a-4", "a-04", "a-0", "b-7", "a-1-1", "a-9"]) for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    assert [r.slug for r in unique_slug(table, per_task).orderBy("ord").collect()] == plain_slugs(names)


def test_a_million_taken_numbers(spark):
    n = 1_000_000
    taken = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("x-"), F.when(F.col("id") % 10 == 9, F.col("id") + 2 * n).otherwise(F.col("id") + 1).cast("string")).alias("name"))
    repeats = spark.range(n, n + 30).select(F.col("id").alias("ord"), F.lit("x").alias("name"))
    got = [r.slug for r in unique_slug(taken.unionByName(repeats), 100_000).filter("name = 'x'").orderBy("ord").collect()]
    assert got == ["x"] + [f"x-{10 * k}" for k in range(1, 30)]


def test_index_makes_its_entries_once(spark, tmp_path):
    """The bridge lists the elements of the entries that were written, not of a second reading of the input."""
    import uuid

    from pyspark.sql import functions as F

    name = F.udf(lambda: uuid.uuid4().hex, "string").asNondeterministic()
    made = spark.range(6).select("id", F.lit("x").alias("filename"), F.lit(1).alias("n_elements"), F.lit("X").alias("chemsys"), F.array(name()).alias("elements"))
    I.write_index(made, str(tmp_path / "index"))
    held = {(r.id, r.elements[0]) for r in I.read_index(spark, str(tmp_path / "index")).collect()}
    assert {(r.id, r.element) for r in I.read_index(spark, str(tmp_path / "index"), "elements").collect()} == held and len(held) == 6
