"""Campaign operators: ledger, resume, episodes, stored answers, paths, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FINISHED_STATUSES
from ..functions.text import let
from ..session import cut_lineage
from .ranking import ordinal_rank


def ledger_last(rows: DataFrame) -> DataFrame:
    """Last row per file by append order. An aggregate, so a file with very many rows is reduced
    before the shuffle."""
    last = F.max(F.struct("seq", "status", "stage", "error", "verdict")).alias("last")
    return rows.groupBy(F.coalesce("file", F.lit("")).alias("file")).agg(last, F.count(F.lit(1)).alias("n_rows")).select(
        "file", F.col("last.seq").alias("seq"), F.col("last.status").alias("status"), F.col("last.stage").alias("stage"),
        F.col("last.error").alias("error"), F.col("last.verdict").alias("verdict"), "n_rows")


def ledger_counts(last: DataFrame) -> DataFrame:
    """Structures per status as written (an old 'ok' stays 'ok'), with the totals."""
    per = last.groupBy(F.coalesce("status", F.lit("?")).alias("status")).agg(
        F.count(F.lit(1)).alias("n_structures"), F.sum("n_rows").alias("n_rows"))
    total = per.agg(F.sum("n_structures").alias("n_structures"), F.sum("n_rows").alias("n_rows")).select(
        F.lit("total").alias("status"), "n_structures", "n_rows")
    return per.unionByName(total)


def ledger_done(last: DataFrame) -> DataFrame:
    """Finished files; an error is not finished and an empty name is ignored."""
    return last.filter(F.col("status").isin(*FINISHED_STATUSES) & (F.col("file") != "")).select("file")


def ledger_with_status(last: DataFrame, status: str) -> DataFrame:
    return last.filter(F.col("status") == status).select("file", "stage", "error")


def remaining_inputs(inputs: DataFrame, last: DataFrame) -> DataFrame:
    return inputs.join(ledger_done(last), "file", "left_anti")


def revise_rate(last: DataFrame) -> DataFrame:
    reviewed = last.filter("verdict is not null")
    return reviewed.agg(F.count(F.lit(1)).alias("n_reviewed"),
                        F.round(F.avg((F.col("verdict") == "revise").cast("double")), 6).alias("revise_rate"))


def fire_episodes(flags: DataFrame, triggers: DataFrame) -> DataFrame:
    """(entry, flag) -> episodes to apply, once each, with the flags that called them."""
    return flags.join(triggers, flags.flag == triggers.trigger).groupBy("entry", "episode").agg(
        F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"))


def compare_to_reference(reference: DataFrame, results: DataFrame) -> DataFrame:
    """One row per (entry, field): exact fields must be equal, the energy may differ within its
    tolerance and only when the weights are the same, reported fields never fail.

    Both sides: entry, exact map<string,string>, energy, energy_tol (reference), reported map, weights.
    """
    def rows(df, side):
        return df.select("entry", F.explode("exact").alias("field", side)).withColumn("kind", F.lit("exact")).unionByName(
            df.select("entry", F.explode("reported").alias("field", side)).withColumn("kind", F.lit("reported")))

    keys = ["entry", "kind", "field"]
    fields = rows(reference, "want").join(rows(results, "have"), keys, "full")
    text = fields.select(
        *keys, "want", "have",
        F.when(F.col("kind") == "reported", "not a criterion")
        .when(F.col("want").eqNullSafe(F.col("have")), "ok").otherwise("FAIL").alias("verdict"))
    r = reference.select("entry", F.col("energy").alias("e_want"), "energy_tol", F.col("weights").alias("w_want"))
    g = results.select("entry", F.col("energy").alias("e_have"), F.col("weights").alias("w_have"))
    off = F.abs(F.col("e_have") - F.col("e_want")) * 1000
    energy = r.join(g, "entry", "full").select(
        "entry", F.lit("tolerant").alias("kind"), F.lit("ground_E_per_atom").alias("field"),
        F.round("e_want", 4).cast("string").alias("want"), F.round("e_have", 4).cast("string").alias("have"),
        F.when(~F.coalesce(F.col("w_want") == F.col("w_have"), F.lit(False)), "not compared")
        .when(off.isNull(), "nothing to compare").when(off <= F.col("energy_tol"), "ok").otherwise("FAIL").alias("verdict"))
    return text.unionByName(energy)


def repair_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Stored path -> where it is now. ``paths``: entry, out_dir, path; ``files``: file (absolute).

    A path that exists is kept. Else the longest tail that exists under the entry's folder wins. Files
    inside the folder are stored relative to it, others absolute, unresolved ones unchanged.
    """
    parts = F.filter(F.split(F.regexp_replace("path", r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    tails = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(
        (F.size("parts") - k + 1).alias("length"),
        F.concat_ws("/", F.col("out_dir"), F.array_join(F.slice(F.col("parts"), k, F.size("parts")), "/")).alias("file")))
    cand = paths.withColumn("parts", parts).select("entry", "out_dir", "path", F.explode(tails).alias("t")).select(
        "entry", "out_dir", "path", "t.length", "t.file")
    whole = paths.select("entry", "out_dir", "path", F.lit(None).cast("int").alias("length"), F.col("path").alias("file"))
    found = cand.unionByName(whole).join(files.select("file"), "file", "left_semi").groupBy("entry", "path").agg(
        F.max_by("file", F.struct(F.col("length").isNull(), "length")).alias("found"))
    inside = F.startswith("found", F.concat("out_dir", F.lit("/")))
    return paths.join(found, ["entry", "path"], "left").select(
        "entry", "path", F.col("found").alias("resolved"),
        F.when(inside, F.expr("substring(found, length(out_dir) + 2)")).otherwise(F.coalesce("found", "path")).alias("stored"))


def slug(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return let(clean, lambda v: F.when(v == "", "result").otherwise(v))


def unique_slug(names: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """File-safe unique names: (ord, name, slug). Repeats get ``-1``, ``-2`` …; a number whose result
    is itself some entry's plain name is passed over.

    Before the i-th taken number t of a stem there are t - i free ones, so in one order of repeats (by how many
    repeats are before them) and taken numbers (by how many free ones are before them, the taken one first)
    the place of a repeat is its number. Ranks come from ``ordinal_rank``: no list of a stem's numbers is made.
    """
    based = names.withColumn("base", slug(F.col("name")))
    ranked = cut_lineage(ordinal_rank(based, ["base"], "ord", "ord", out="k", rows_per_task=rows_per_task).select("base", "k", "ord", "name"))
    stems = ranked.filter("k = 1").select(F.col("base").alias("whole"), F.regexp_extract("base", r"^(.*)-\d+$", 1).alias("base"),
                                          F.regexp_extract("base", r"-(\d+)$", 1).try_cast("long").alias("t"))
    # only numbers from one on are given, and they have no zeros in front
    taken = stems.filter((F.col("base") != "") & (F.col("t") >= 1) & (F.concat("base", F.lit("-"), F.col("t").cast("string")) == F.col("whole")))
    order = ordinal_rank(taken, ["base"], "t", "t", out="i", rows_per_task=rows_per_task)
    kind = ranked.schema["ord"].dataType
    marks = order.select("base", (2 * (F.col("t") - F.col("i"))).alias("place"), "t", F.lit(None).cast(kind).alias("ord"), F.lit(None).cast("string").alias("name"))
    repeats = ranked.filter("k > 1").select("base", (2 * (F.col("k") - 2) + 1).alias("place"), F.lit(0).cast("long").alias("t"), "ord", "name")
    placed = ordinal_rank(marks.unionByName(repeats), ["base"], "place", "t", out="number", rows_per_task=rows_per_task).filter("place % 2 = 1")
    given = placed.select("ord", "name", F.concat("base", F.lit("-"), F.col("number").cast("string")).alias("slug"))
    return ranked.filter("k = 1").select("ord", "name", F.col("base").alias("slug")).unionByName(given)
