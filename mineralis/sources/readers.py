"""Sources: text archives, ledger, records, frames, checkpoints, stored answers, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RECORD_FILES, RECORD_VERSION
from ..functions.text import let
from .archives import scan_zip_archive  # noqa: F401

RECORD_SEP = "\u001e"
LEDGER_SCHEMA = ("ts string, file string, status string, stage string, rundir string, klass string, "
                 "confidence string, gates string, verdict string, round int, escalate string, "
                 "error string, seq long, _corrupt_record string")
EPISODE_SCHEMA = ("triggers map<string,array<string>>, "
                  "episodes map<string,struct<lesson:string,provenance:array<string>>>")
ANSWER_SCHEMA = ("entry string, exact map<string,string>, "
                 "tolerant struct<ground_E_per_atom:double,E_tol_meV_per_atom:double>, "
                 "reported map<string,string>, stamped_with string, stamped_sha256 string")


# ---- text archives ------------------------------------------------------------------------------

def scan_text_directory(spark: SparkSession, path: str) -> DataFrame:
    """One member per file."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def scan_packed_text(spark: SparkSession, path: str) -> DataFrame:
    """Many members per file, split by a record separator; the first line of a record names it.

    Unlike one file per member, packed files split across tasks and keep the listing short.
    """
    record = F.ltrim("value")
    return (
        spark.read.text(path, lineSep=RECORD_SEP).filter(F.trim("value") != "")
        .select(F.split_part(record, F.lit("\n"), F.lit(1)).alias("filename"),
                F.substring(record, F.instr(record, "\n") + 1, F.length(record)).alias("text"))
    )


# ---- ledger -------------------------------------------------------------------------------------

def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines; blank and torn lines drop out."""
    rows = spark.read.schema(LEDGER_SCHEMA).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


# ---- records ------------------------------------------------------------------------------------

RECORD_SCHEMA = (
    "schema_version string, status string, formula string, calculator string, escalate string, "
    "gates map<string,struct<state:string,pass:boolean,basis:string>>, "
    "review struct<final_verdict:string,unresolved_blocking:array<string>>, "
    "mechanism struct<class:string,confidence:string>, "
    "provenance struct<formula_sum:string>, "
    "distribution struct<ground_E_per_atom:double,spread_meV:double,n_relaxed:long,n_total:long>"
)


def scan_record_files(spark: SparkSession, path: str) -> DataFrame:
    """Record files of a results folder and of its direct children: (dir, file, text)."""
    parts = F.split(F.input_file_name(), "/")
    return (
        spark.read.text([path, f"{path.rstrip('/')}/*"], wholetext=True, pathGlobFilter="*.json")
        .select(F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("file"),
                F.col("value").alias("text"))
    )


def record_kind(record: Column) -> Column:
    """Which schema a parsed record follows; NULL when neither."""
    return (
        F.when((record["schema_version"] == RECORD_VERSION) | record["gates"].isNotNull(), RECORD_VERSION)
        .when(record["distribution"].isNotNull() | record["status"].isNotNull(), "deaverage")
    )


def discover_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected). One record per folder, by file preference; a file of neither schema never
    hides a usable one and is reported in ``rejected``."""
    known = files.filter(F.col("file").isin(*RECORD_FILES))
    parsed = known.withColumn("record", F.from_json("text", RECORD_SCHEMA))
    parsed = parsed.withColumn("kind", record_kind(F.col("record")))
    rank = F.array_position(F.array(*[F.lit(f) for f in RECORD_FILES]), F.col("file"))
    usable = parsed.filter(F.col("kind").isNotNull())
    best = usable.groupBy("dir").agg(
        F.min_by(F.struct("file", "kind", "record"), rank).alias("best")).select("dir", "best.*")
    return best, parsed.filter(F.col("kind").isNull()).select("dir", "file", "text")


# ---- frames -------------------------------------------------------------------------------------

def scan_frames(texts: DataFrame, key: str = "file") -> DataFrame:
    """Complete frames of multi-frame text: (key, frame_index, n_atoms, comment, atoms).

    A frame is a line with the atom count, a comment and as many atom lines of four or more fields; the
    next frame begins right after them. The scan of a file ends at the first line that is no count or the
    first torn frame, and the frames before it survive. A comment that looks like a count is a comment.
    One file is one row, so frames unfold without a shuffle.
    """
    count = r"^\s*\d{1,9}\s*$"
    atom = r"^\s*\S+\s+\S+\s+\S+\s+\S"

    def unfold(lines):
        # the walk takes a count line only where the frame before it ended
        heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(count))
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))

        def walk(acc, i):
            n = F.trim(F.element_at(lines, i)).cast("int")
            # complete: another line follows the last atom (the file ends with a newline)
            whole = (i == acc["next"]) & (i + 1 + n < F.size(lines))
            return F.when(whole & F.forall(F.slice(lines, i + 2, n), lambda x: x.rlike(atom)),
                          F.struct((i + 2 + n).alias("next"), F.concat(acc["starts"], F.array(i)).alias("starts"))).otherwise(acc)

        return F.transform(F.aggregate(heads, start, walk, lambda acc: acc["starts"]), lambda i: F.struct(
            F.trim(F.element_at(lines, i)).cast("int").alias("n_atoms"), F.element_at(lines, i + 1).alias("comment"),
            F.slice(lines, i + 2, F.trim(F.element_at(lines, i)).cast("int")).alias("atoms")))

    frames = let(F.split("text", r"\n"), unfold)
    return texts.select(key, F.posexplode(frames).alias("frame_index", "f")).select(key, "frame_index", "f.*")


def frame_property(comment: Column, name: str) -> Column:
    """``name=value`` of a frame comment."""
    return F.nullif(F.regexp_extract(comment, rf'(?:^|\s){name}="?([^"\s]+)"?', 1), F.lit(""))


def scan_checkpoint(frames: DataFrame, file: str = "file") -> DataFrame:
    """Finished configurations by content key; the last frame of a key wins."""
    keyed = frames.select(
        file, "frame_index",
        frame_property(F.col("comment"), "key").alias("key"),
        frame_property(F.col("comment"), "E").try_cast("double").alias("energy")).filter(
        "key is not null and energy is not null")
    return keyed.groupBy("key").agg(
        F.max(F.struct(file, "frame_index", "energy")).alias("last")).select("key", "last.energy")


# ---- stored answers and episodes ----------------------------------------------------------------

def scan_reference_answers(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(ANSWER_SCHEMA).json(path, multiLine=multiline)


def scan_episodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trigger, episode) pairs and (episode, lesson) rows."""
    doc = spark.read.schema(EPISODE_SCHEMA).json(path, multiLine=True)
    triggers = doc.select(F.explode("triggers").alias("trigger", "episodes")).select(
        "trigger", F.explode("episodes").alias("episode"))
    lessons = doc.select(F.explode("episodes").alias("episode", "e")).select("episode", "e.lesson")
    return triggers, lessons
