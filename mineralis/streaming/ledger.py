"""Streaming twins of the ledger and checkpoint operators.

Each run drains what is there (``availableNow``) and resumes from its checkpoint. Batches are written
to a folder of their own, so a replayed batch replaces itself instead of adding rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FINISHED_STATUSES
from ..sources.readers import LEDGER_SCHEMA


def read_ledger_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    rows = spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def _drain(stream: DataFrame, mode: str, write, checkpoint: str) -> None:
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def _last_status(rows: DataFrame) -> DataFrame:
    """The row of highest sequence number per file; a missing file name counts as the empty one."""
    return rows.groupBy(F.coalesce("file", F.lit("")).alias("file")).agg(
        F.max(F.struct("seq", "status", "stage", "error")).alias("last")).select("file", "last.*")


STATUS = "file string, seq long, status string, stage string, error string"
#: batches after which the changes so far become one table
COMPACT_EVERY = 16


def _before(spark: SparkSession, out: str, batch_id: int, schema: str, reduce) -> DataFrame:
    """What the batches before ``batch_id`` left: the last compacted table and the changes since.

    At every ``COMPACT_EVERY``-th batch that is written as the next compacted table, so at most so many
    folders are read, however many batches there were. A replayed batch finds the same folders and
    overwrites its own.
    """
    base = batch_id // COMPACT_EVERY * COMPACT_EVERY
    if batch_id and batch_id == base:
        whole = reduce(_changes(spark, out, batch_id - COMPACT_EVERY, batch_id, schema))
        whole.write.mode("overwrite").parquet(f"{out}/whole/upto={batch_id}")
    return _changes(spark, out, base, batch_id, schema)


def _changes(spark: SparkSession, out: str, base: int, batch_id: int, schema: str) -> DataFrame:
    folders = [f"{out}/whole/upto={base}"] if base else []
    folders += [f"{out}/changes/batch={k}" for k in range(base, batch_id)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _last_batch(spark: SparkSession, out: str) -> int:
    """The highest batch whose changes are committed; -1 if there is none."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{out}/changes/batch=*/_SUCCESS")) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in done), default=-1)


def stream_ledger_status(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Keep the last status per file; every batch writes the files it changed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _before(batch.sparkSession, out, batch_id, STATUS, _last_status)   # compacts where it is due
        _last_status(batch).write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")

    _drain(rows, "append", write, checkpoint)


def read_ledger_status(spark: SparkSession, out: str) -> DataFrame:
    """Current status per file: the last compacted table and the few batches after it."""
    upto = _last_batch(spark, out) + 1
    return _last_status(_changes(spark, out, max(0, upto - 1) // COMPACT_EVERY * COMPACT_EVERY, upto, STATUS))


def stream_done_counts(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Files finished and not finished after each batch.

    A batch adds its changes to the state that the batches before it left, one row per file, so its cost
    does not grow with the number of batches; a replayed batch starts from that same state.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        before = _before(batch.sparkSession, out, batch_id, STATUS, _last_status)
        changes = _last_status(batch)
        changes.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
        done = F.col("status").isin(*FINISHED_STATUSES)
        state = _last_status(before.unionByName(batch.sparkSession.read.schema(STATUS).parquet(f"{out}/changes/batch={batch_id}")))
        state.agg(F.count_if(done).alias("n_done"), F.count_if(~done).alias("n_open")).write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")

    _drain(rows, "append", write, checkpoint)


def stream_new_configs(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append finished configurations once per content key; failures never enter.

    The stream itself keeps no state: a batch leaves out the keys that the batches before it wrote, which are
    read from the compacted keys and the few batches after them. Of one key's configurations in a batch the lowest
    energy is taken. A replayed batch writes what it wrote before, and a late duplicate nothing.
    """
    fresh = rows.filter("valid and energy is not null and not isnan(energy)")
    others = [c for c in fresh.columns if c not in ("key", "energy")]

    def write(batch: DataFrame, batch_id: int) -> None:
        known = _before(batch.sparkSession, out, batch_id, "key string", lambda keys: keys.distinct())
        best = batch.groupBy("key").agg(F.min(F.struct("energy", *others)).alias("c")).select("key", "c.*").select(*batch.columns)
        unseen = best.join(known.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left_anti")
        unseen.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")

    _drain(fresh, "append", write, checkpoint)


def read_new_configs(spark: SparkSession, out: str) -> DataFrame:
    """All configurations written so far, one per key."""
    return spark.read.parquet(f"{out}/changes").drop("batch")
