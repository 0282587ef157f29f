"""Sinks: index, ledger, ensembles, records, exported members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEDGER_FIELDS
from ..operators.ranking import ordinal_rank
from .archives import write_zip
from .index import write_index  # noqa: F401
from .readers import RECORD_SEP


def write_packed_text(archive: DataFrame, path: str) -> None:
    """(filename, text) -> packed text files."""
    archive.select(F.concat(F.col("filename"), F.lit("\n"), F.col("text")).alias("value")).write.text(
        path, lineSep=RECORD_SEP)


def log_line(row: dict[str, Column] | None = None) -> Column:
    """Human-readable log line: only the parts that are set."""
    c = row or {f: F.col(f) for f in LEDGER_FIELDS}
    mark = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(v) for kv in (("completed", "DONE "), ("ok", "OK   "), ("declined", "DECL "),
                                           ("error", "ERROR"), ("skipped", "SKIP ")) for v in kv]),
        c["status"]), F.lit("?    "))

    def part(label, value):
        return F.when(F.nullif(value, F.lit("")).isNotNull(), F.concat(F.lit(f"{label}="), value))

    round_text = F.when(F.coalesce(c["round"], F.lit(0)) != 0,
                        F.concat(F.lit("(r"), c["round"].cast("string"), F.lit(")"))).otherwise("")
    return F.concat_ws(
        "  ", c["ts"], mark, c["file"],
        part("class", c["klass"]), part("conf", c["confidence"]), part("gates", c["gates"]),
        F.concat(part("review", c["verdict"]), round_text),
        part("ESCALATE", c["escalate"]), part("stage", c["stage"]), part("error", c["error"]))


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows; the legacy spelling of the status is normalised on write, and ``seq`` keeps the
    append order that files do not have."""
    status = F.when(F.col("status") == "ok", "completed").otherwise(F.col("status"))
    rows.withColumn("status", status).select(*LEDGER_FIELDS, "seq").write.mode("append").json(
        path, ignoreNullFields=False)


def frame_text(n_atoms: Column, comment: Column, atoms: Column) -> Column:
    """One frame: atom count, comment, atom lines."""
    return F.concat_ws("\n", n_atoms.cast("string"), comment, F.array_join(atoms, "\n"))


def write_ensemble(frames: DataFrame, path: str, order: str = "energy", frames_per_record: int = 1000, rows_per_task: int = 1_000_000) -> None:
    """Frames by energy, packed: a record is named ``entry#part`` and holds up to ``frames_per_record`` frames.

    ``frames``: entry, ``order``, frame; of equal energies a hash of the text decides. The parts of an entry follow each
    other in energy, so a very large ensemble spreads over several records. ``scan_packed_text`` reads them
    back; the number of files does not grow with the number of entries. A frame must not hold the record separator.
    """
    tied = frames.select("entry", order, "frame", F.xxhash64("frame").alias("_tie"))
    ranked = ordinal_rank(tied, ["entry"], order, "_tie", out="_rank", rows_per_task=rows_per_task)
    part = F.floor((F.col("_rank") - 1) / frames_per_record)
    records = ranked.groupBy("entry", part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_rank", "frame"))).alias("_frames"))
    name = F.format_string("%s#%08d", F.col("entry").cast("string"), "_part")
    text = F.concat(F.array_join(F.transform("_frames", lambda f: f["frame"]), "\n"), F.lit("\n"))
    write_packed_text(records.select(name.alias("filename"), text.alias("text")), path)


def write_records(records: DataFrame, path: str) -> None:
    """One nested JSON document per entry; NULL fields stay visible."""
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def extract_members(archive: DataFrame, wanted: DataFrame, path: str) -> None:
    """Export the wanted members as zip archives with an index; a name without a member is skipped."""
    write_zip(archive.join(wanted.select("filename").distinct(), "filename", "left_semi"), path)
