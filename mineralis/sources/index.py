"""A catalogue index in versions, published by one switch.

A rebuild or a backfill writes folders beside those in use and then publishes them with one file in
``<path>/published``: a list of the folders that make up the version. A reader takes the highest published
number once and reads only that version's folders, so it sees one version during a rebuild and the old one
after a failed one. A backfill rewrites the partitions whose rows change; the others are shared between versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "n_elements"
PUBLISHED = "number long, version string, tbl string, part int, folder string"
#: part of entries without a number of elements
NO_PART = -1


def _published(spark: SparkSession, path: str) -> list:
    """Rows of the version in force: a folder per table and partition, as many as entries have numbers of elements."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    rows = spark.read.schema(PUBLISHED).parquet(f"{path}/published")
    last = rows.agg(F.max(F.struct("number", "version")).alias("v")).first().v   # two writers at once: one of the two, whole
    return rows.filter((F.col("number") == last.number) & (F.col("version") == last.version)).collect() if last else []


def _publish(spark: SparkSession, path: str, version: str, number: int, folders: list[tuple]) -> None:
    rows = spark.createDataFrame([(number, version, *f) for f in folders], PUBLISHED)
    rows.coalesce(1).write.mode("append").parquet(f"{path}/published")   # one file: there or not


def _write_parts(entries: DataFrame, folder: str) -> list[tuple]:
    """Entries by their number of elements, sorted so that a search by system skips row groups."""
    parted = entries.withColumn("_part", F.coalesce(F.col(PART).cast("int"), F.lit(NO_PART)))
    parted.sortWithinPartitions("_part", "chemsys").write.partitionBy("_part").parquet(folder)
    spark = entries.sparkSession
    parts = [r._part for r in spark.read.schema("_part int").parquet(folder).select("_part").distinct().collect()]
    if not parts:
        entries.write.parquet(f"{folder}/none")   # keeps the schema
        return [("entries", None, f"{folder}/none")]
    return [("entries", p, f"{folder}/_part={p}") for p in sorted(parts)]


def write_index(entries: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Rebuild the whole index (entries, the element bridge and meta) as a new version and publish it."""
    spark, version = entries.sparkSession, uuid.uuid4().hex
    before, folder = _published(spark, path), f"{path}/data/{version}"
    folders = _write_parts(entries, f"{folder}/entries")
    written = spark.read.schema(entries.schema).parquet(*[f[2] for f in folders])   # entries are made once
    written.select("id", F.explode("elements").alias("element")).distinct().sortWithinPartitions("element").write.parquet(f"{folder}/elements")
    spark.createDataFrame(sorted((meta or {}).items()), "key string, value string").coalesce(1).write.parquet(f"{folder}/meta")
    folders += [("elements", None, f"{folder}/elements"), ("meta", None, f"{folder}/meta")]
    _publish(spark, path, version, before[0].number + 1 if before else 0, folders)


def read_index(spark: SparkSession, path: str, table: str = "entries", n_elements: int | None = None) -> DataFrame:
    """A table of the version in force; ``n_elements`` reads that partition's files only."""
    rows = _published(spark, path)
    if not rows:
        raise FileNotFoundError(f"no index is published at {path}")
    return _read(spark, [r for r in rows if r.tbl == table], n_elements)


def _read(spark: SparkSession, rows: list, n_elements: int | None = None) -> DataFrame:
    wanted = [r.folder for r in rows if n_elements is None or r.part == n_elements]
    df = spark.read.option("mergeSchema", True).parquet(*(wanted or [rows[0].folder]))
    return df if wanted else df.filter(F.lit(False))


def backfill_index(spark: SparkSession, path: str, recomputed: DataFrame, key: str = "filename") -> int:
    """Put the recomputed columns into the entries of their keys and publish the result; -> partitions rewritten.

    Keys without a recomputed row keep what they have, keys that the index lacks are ignored, of repeated keys one
    row counts. Only partitions in which a value changes are rewritten; if none does, nothing is published.
    The number of elements and the elements themselves cannot be backfilled: they are what the index is built by.
    """
    rows = _published(spark, path)
    fresh = [c for c in recomputed.columns if c != key]
    if {PART, "elements", "id"} & set(fresh):
        raise ValueError("rebuild the index to change ids or elements")
    held = [r for r in rows if r.tbl == "entries"]
    entries = _read(spark, held)
    new = recomputed.dropDuplicates([key]).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fresh])
    met = entries.join(new, F.col(key) == F.col("_key"))
    known = [c for c in fresh if c in entries.columns]
    differs = F.lit(len(known) < len(fresh))
    for c in known:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    touched = {r[0] for r in met.filter(differs).select(F.coalesce(F.col(PART).cast("int"), F.lit(NO_PART))).distinct().collect()}
    if not touched:
        return 0
    version = uuid.uuid4().hex
    part = F.coalesce(F.col(PART).cast("int"), F.lit(NO_PART))
    old = _read(spark, [r for r in held if r.part in touched]).filter(part.isin(*touched))
    merged = old.join(new, F.col(key) == F.col("_key"), "left")
    has = F.col("_key").isNotNull()
    merged = merged.select(*[c for c in old.columns if c not in fresh], *[
        F.when(has, F.col(f"_{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)).alias(c) for c in fresh])
    folders = _write_parts(merged, f"{path}/data/{version}/entries")
    kept = [(r.tbl, r.part, r.folder) for r in rows if r.tbl != "entries" or r.part not in touched]
    _publish(spark, path, version, rows[0].number + 1, kept + folders)
    return len(touched)
