"""Catalogue queries: chemistry columns, tri-state filters, relational division, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_ELEMENTS, MAX_PRESSURE_KPA, MIN_ATOMS
from ..functions.text import reduced_formula
from ..session import cut_lineage
from .ranking import null_safe_join

LIST_COLUMNS = ("id", "reduced_formula", "chemsys", "n_elements", "spacegroup_number",
                "min_occupancy", "is_disordered")


# ---- arguments ----------------------------------------------------------------------------------

def normalize_chemsys(spec: str) -> str:
    """Sort the symbols of a ``-`` separated system; empty parts drop out."""
    return "-".join(sorted(filter(None, spec.split("-"))))


def parse_elements(spec: str) -> list[str]:
    """Split a comma or blank separated element list."""
    return spec.replace(",", " ").split()


# ---- chemistry columns --------------------------------------------------------------------------

def chemistry_columns(amounts: DataFrame, elements: DataFrame) -> DataFrame:
    """(structure_id, element, n, min_occ) -> one row per structure with its chemistry.

    The array holds one item per distinct symbol, so it is bounded by the periodic table however many
    rows a structure has. A symbol that the table does not list is kept like any other; without an
    electronegativity it comes last in the reduced formula.
    """
    en = elements.select(F.col("symbol").alias("element"), "electronegativity")
    grouped = (
        amounts.join(en, "element", "left")
        .groupBy("structure_id")
        .agg(F.sort_array(F.collect_list(F.struct("element", "n", "electronegativity"))).alias("terms"),
             F.min("min_occ").alias("min_occupancy"))
    )
    return grouped.select(
        "structure_id",
        F.transform("terms", lambda t: t["element"]).alias("elements"),
        F.array_join(F.transform("terms", lambda t: t["element"]), "-").alias("chemsys"),
        F.size("terms").alias("n_elements"),
        F.array_join(F.transform("terms", lambda t: F.concat(t["element"], t["n"].cast("string"))), " ")
        .alias("formula_sum"),
        reduced_formula(F.col("terms")).alias("reduced_formula"),
        "min_occupancy",
    )


# ---- filters ------------------------------------------------------------------------------------

def tristate_filter(df: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    """True / False / None: an unknown row is in neither branch, and None does not filter."""
    return df if wanted is None else df.filter(F.col(column) == F.lit(wanted))


def limit_rows(df: DataFrame, n: int | None) -> DataFrame:
    """``n`` rows; zero and None both mean every row."""
    return df.limit(int(n)) if n else df


def sort_by_id(df: DataFrame) -> DataFrame:
    """Listing order. Ids repeat and may be NULL, so the file name completes the order."""
    tie = ["filename"] if "filename" in df.columns else []
    return df.orderBy(F.col("id").asc_nulls_first(), *tie)


def _narrow(df, sg, disordered):
    if sg is not None:
        df = df.filter(F.col("spacegroup_number") == sg)
    return tristate_filter(df, "is_disordered", disordered)


def _listing(df, limit):
    return limit_rows(sort_by_id(df), limit)


def query_chemsys(entries, chemsys, sg=None, disordered=None, limit=None) -> DataFrame:
    hit = entries.filter(F.col("chemsys") == normalize_chemsys(chemsys))
    return _listing(_narrow(hit, sg, disordered), limit)


def query_formula(entries, formula, sg=None, disordered=None, limit=None) -> DataFrame:
    """Exact reduced formula; the argument is used as it is."""
    hit = entries.filter(F.col("reduced_formula") == formula)
    return _listing(_narrow(hit, sg, disordered), limit)


def query_spacegroup(entries, number, chemsys=None, disordered=None, limit=None) -> DataFrame:
    if chemsys:
        return query_chemsys(entries, chemsys, sg=number, disordered=disordered, limit=limit)
    return _listing(_narrow(entries, number, disordered), limit)


def ids_with_all(bridge: DataFrame, elements: Iterable[str]) -> DataFrame:
    """Relational division over the element bridge: ids that hold every wanted element."""
    wanted = sorted(set(elements))
    return (
        bridge.filter(F.col("element").isin(wanted))
        .groupBy("id").agg(F.count_distinct("element").alias("found"))
        .filter(F.col("found") == len(wanted)).select("id")
    )


def has_all_elements(array: Column, elements: Iterable[str]) -> Column:
    """The same division on an element array: no join, no shuffle."""
    return F.forall(F.array(*[F.lit(e) for e in sorted(set(elements))]),
                    lambda e: F.array_contains(array, e))


def query_subsystem(entries, elements, bridge=None, exact=False, sg=None, disordered=None,
                    limit=None) -> DataFrame:
    """Entries that contain at least these elements; ``exact`` means these and no others."""
    wanted = sorted(set(elements))
    if exact:
        return query_chemsys(entries, "-".join(wanted), sg, disordered, limit)
    if bridge is None:
        hit = entries.filter(has_all_elements(F.col("elements"), wanted))
    else:
        hit = entries.join(ids_with_all(bridge, wanted), "id", "left_semi")
    return _listing(_narrow(hit, sg, disordered), limit)


def search(entries, chemsys=None, formula=None, elements=None, exact=False, sg=None,
           n_elements=None, disordered=None, limit=None) -> DataFrame:
    """Any AND-combination of the criteria."""
    df = entries
    if chemsys:
        df = df.filter(F.col("chemsys") == normalize_chemsys(chemsys))
    if formula:
        df = df.filter(F.col("reduced_formula") == formula)
    if elements:
        wanted = sorted(set(elements))
        df = (df.filter(F.col("chemsys") == "-".join(wanted)) if exact
              else df.filter(has_all_elements(F.col("elements"), wanted)))
    if n_elements is not None:
        df = df.filter(F.col("n_elements") == n_elements)
    return _listing(_narrow(df, sg, disordered), limit)


def show_entry(entries: DataFrame, entry_id: int, archive: DataFrame | None = None) -> DataFrame:
    """One full row; ``found`` tells a missing id apart from an empty one."""
    wanted = entries.sparkSession.range(1).select(F.lit(entry_id).cast("long").alias("id"))
    row = entries.filter(F.col("id") == entry_id)
    if archive is not None:
        row = row.join(archive, "filename", "left")
    return wanted.join(row, "id", "left").withColumn("found", F.col("filename").isNotNull())


def get_text(ids: DataFrame, entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Raw text per wanted id; ids without a member stay, with ``missing`` set."""
    named = ids.join(entries.select("id", "filename"), "id", "left")
    return (
        named.join(archive, "filename", "left")
        .select("id", "filename", "text", F.col("text").isNull().alias("missing"))
    )


def filenames_by_ids(entries, ids: DataFrame) -> DataFrame:
    return sort_by_id(entries.join(ids.select("id").distinct(), "id", "left_semi").select("id", "filename"))


def filenames_by_query(entries, chemsys=None, formula=None, elements=None, exact=False, sg=None,
                       disordered=None) -> DataFrame:
    """First given criterion wins. The element branch re-selects by id, so every row sharing a
    matched id is returned and rows without an id are lost."""
    if chemsys:
        return _narrow(entries.filter(F.col("chemsys") == normalize_chemsys(chemsys)), sg, disordered).select("filename")
    if formula:
        return _narrow(entries.filter(F.col("reduced_formula") == formula), sg, disordered).select("filename")
    if elements:
        ids = query_subsystem(entries, elements, exact=exact, sg=sg, disordered=disordered).select("id")
        return filenames_by_ids(entries, ids.filter("id is not null")).select("filename")
    return entries.limit(0).select("filename")


def scope_reason(n_elements: Column, pressure_kpa: Column, n_atoms: Column) -> Column:
    """First reason an entry is out of scope, else NULL."""
    return (
        F.when(n_elements > MAX_ELEMENTS, "gt6-elements")
        .when(pressure_kpa > MAX_PRESSURE_KPA, "high-pressure")
        .when(n_atoms < MIN_ATOMS, "partial-structure")
    )


# ---- statistics ---------------------------------------------------------------------------------

def catalogue_stats(entries: DataFrame, error: Column | None = None) -> DataFrame:
    error = F.lit(None).cast("string") if error is None else error
    return entries.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(error).alias("parse_errors"),
        F.count_distinct("chemsys").alias("distinct_chemsys"),
        F.count_distinct("reduced_formula").alias("distinct_formula"),
        F.count_if(F.col("is_disordered")).alias("disordered"),
        F.count_if(~F.col("is_disordered")).alias("ordered"),
        F.count_if(F.col("is_disordered").isNull()).alias("unknown"),
    )


def by_n_elements(entries: DataFrame) -> DataFrame:
    return (entries.groupBy("n_elements").agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.col("n_elements").asc_nulls_first()))


def backfill_counts(entries: DataFrame) -> DataFrame:
    """Counts a backfill reports; ordered is what remains."""
    counted = entries.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("is_disordered")).alias("disordered"),
        F.count_if(F.col("min_occupancy").isNull()).alias("unknown"))
    return counted.withColumn("ordered", F.col("n_rows") - F.col("disordered") - F.col("unknown"))


def add_columns(entries: DataFrame, recomputed: DataFrame, key: str = "filename") -> DataFrame:
    """Replace or add the recomputed columns by key; running it twice changes nothing."""
    fresh = [c for c in recomputed.columns if c != key]
    return entries.drop(*fresh).join(recomputed, key, "left")


# ---- siblings -----------------------------------------------------------------------------------

def ordered_flag(rows: DataFrame, tol: float) -> DataFrame:
    """Per structure: no position shared by two rows and every position sum within ``tol`` of one.

    Positions aggregate first, so the second grouping sees one row per position.
    """
    positions = rows.groupBy("structure_id", "x", "y", "z").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.col("occ"), F.lit(1.0))).alias("occ_sum"))
    return positions.groupBy("structure_id").agg(
        (~F.bool_or((F.col("n_rows") > 1) | (F.abs(F.col("occ_sum") - 1) > tol))).alias("is_ordered"))


def sibling_search(entries: DataFrame) -> DataFrame:
    """Best ordered sibling per entry: same key, same space group first, then lowest id.

    ``entries``: id, sibling_key, spacegroup_number, is_ordered. Listing all pairs of a key would be
    quadratic in its size. Only the two lowest ids of each (key, space group) and of each key can be
    anyone's best match, two because an entry never matches itself; the rest is counting.
    """
    key = "sibling_key"
    entries = cut_lineage(entries.select("id", key, "spacegroup_number", "is_ordered"))
    # one row per id and group: ids may repeat, and an id is never its own sibling
    good = entries.filter(F.col(key).isNotNull() & F.col("is_ordered")).groupBy(key, "spacegroup_number", "id").agg(
        F.count(F.lit(1)).alias("n"))
    first = good.groupBy(key, "spacegroup_number").agg(F.min("id").alias("same_1"), F.sum("n").alias("n_same"))
    # an aggregate with a sorted pair would hold all ids; the second lowest is the lowest of the others
    group = [key, "spacegroup_number"]
    rest = null_safe_join(good, first, group, "inner").filter(F.col("id") > F.col("same_1"))
    second = rest.groupBy(*group).agg(F.min("id").alias("same_2"))
    same = cut_lineage(null_safe_join(first, second, group, "left"))
    # best in another space group: per key, the two lowest (lowest id, space group) heads; an unknown group is one of its own
    heads = same.select(key, F.struct(F.col("same_1").alias("id"), F.col("spacegroup_number").alias("sg"), "same_2").alias("head"), "n_same")
    best = heads.groupBy(key).agg(F.min("head").alias("head_1"), F.sum("n_same").alias("n_all"))
    runner = heads.join(best, key).filter(F.col("head") > F.col("head_1")).groupBy(key).agg(F.min("head").alias("head_2"))
    groups = cut_lineage(best.join(runner, key, "left"))
    mine = good.groupBy(key, "id").agg(F.sum("n").alias("n_own")).withColumnRenamed("id", "own_id").withColumnRenamed(key, "own_key")
    joined = (null_safe_join(entries, same, group, "left")
              .join(groups, key, "left").join(mine, (F.col(key) == F.col("own_key")) & (F.col("id") == F.col("own_id")), "left"))
    same_id = F.when(~F.col("same_1").eqNullSafe(F.col("id")), F.col("same_1")).otherwise(F.col("same_2"))
    not_own = lambda h: F.when(~h["id"].eqNullSafe(F.col("id")), h["id"]).otherwise(h["same_2"])
    other_id = F.when(~F.col("head_1.sg").eqNullSafe(F.col("spacegroup_number")), not_own(F.col("head_1"))).otherwise(not_own(F.col("head_2")))
    n_match = (F.coalesce(F.col("n_all"), F.lit(0)) - F.coalesce(F.col("n_own"), F.lit(0))).cast("long")
    return joined.select(
        "id",
        F.when(F.col(key).isNull(), F.lit(None).cast("long")).otherwise(n_match).alias("n_siblings"),
        F.coalesce(same_id, other_id).alias("best_sibling"),
        F.when(F.col(key).isNull(), "not_run").otherwise("derived").alias("state"),
        F.when(F.col(key).isNull(), "not searched")
        .when(same_id.isNotNull(), "same-SG").when(other_id.isNotNull(), "other-SG")
        .otherwise("none").alias("sibling"),
    )


def sibling_state(searched: Column, lookup_error: Column, n_matches: Column) -> Column:
    """'none' has two meanings; this column keeps them apart."""
    return (
        F.when(lookup_error.isNotNull(), "not_run: lookup error")
        .when(~searched, "not_run: no catalogue")
        .when(n_matches > 0, "derived: found").otherwise("derived: searched and absent")
    )
