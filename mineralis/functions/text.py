"""Column expressions that read CIF text. Everything stays inside one row: no shuffle, no window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AMOUNT_TOL, DISORDER_TOL, ELEMENTS, GROUP_DIFFERENCE, MOLECULES

# ---- fixed values: keys and patterns of the text format -----------------------------------------
CELL_KEYS = {
    "a": "_cell_length_a",
    "b": "_cell_length_b",
    "c": "_cell_length_c",
    "alpha": "_cell_angle_alpha",
    "beta": "_cell_angle_beta",
    "gamma": "_cell_angle_gamma",
    "volume": "_cell_volume",
    "density": "_exptl_crystal_density_diffrn",
    "z_form": "_cell_formula_units_Z",
}
ID_PATTERN = r"_(\d+)\.cif"
# fixed value: the three spellings of the formula
FORMULA = r"_chemical_formula_sum\s+('[^']+'|;\s*[^;]+?\s*;|[^;'\s]\S*)"
FORMULA_TERM = r"([A-Z][a-z]?)([0-9]*\.?[0-9]*)"
SG_NUMBER = r"_space_group_IT_number\s+(\d+)"
SG_SYMBOL = r"_space_group_name_H-M_alt\s+'([^']+)'"
SG_SYMBOL_OLD = r"_symmetry_space_group_name_H-M\s+'([^']+)'"
LOOP_LINE = r"(?m)^[ \t]*loop_[ \t]*\r?\n"
TOKEN = r"""('[^']*'|"[^"]*"|\S+)"""
NUMBER = r"^([-+]?[0-9]*\.?[0-9]+)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(col: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(col, pattern, group), lambda v: F.nullif(v, F.lit("")))


def extract_id(name: Column, prefix: str = "entry") -> Column:
    return _found(name, prefix + ID_PATTERN).try_cast("long")


def extract_formula(text: Column) -> Column:
    """The first formula, quoted, in a text block or bare; inner whitespace collapses."""
    raw = let(_found(text, FORMULA), lambda f: F.when(
        F.substring(f, 1, 1).isin("'", ";"), F.substring(f, F.lit(2), F.length(f) - 2)).otherwise(f))
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def extract_cell(text: Column, key: str) -> Column:
    """A number with its uncertainty and trailing dot dropped; anything else is NULL."""
    token = _found(text, key + r"\s+(\S+)")
    return F.regexp_replace(F.split_part(token, F.lit("("), F.lit(1)), r"\.+$", "").try_cast("double")


def extract_spacegroup_number(text: Column) -> Column:
    return _found(text, SG_NUMBER).try_cast("int")


def extract_spacegroup_symbol(text: Column) -> Column:
    return F.trim(F.coalesce(_found(text, SG_SYMBOL), _found(text, SG_SYMBOL_OLD)))


def strip_isotope(symbol: Column) -> Column:
    """Leading element symbol; deuterium and tritium are hydrogen."""
    el = F.coalesce(_found(symbol, r"^([A-Z][a-z]?)"), symbol)
    return let(el, lambda e: F.when(e.isin("D", "T"), "H").otherwise(e))


def parse_composition(formula: Column, isotopes: bool = True) -> Column:
    """map<element, amount>: repeated elements add up, a blank amount counts one."""
    symbols = F.regexp_extract_all(formula, F.lit(FORMULA_TERM), F.lit(1))
    numbers = F.regexp_extract_all(formula, F.lit(FORMULA_TERM), F.lit(2))
    fix = strip_isotope if isotopes else (lambda c: c)
    terms = F.zip_with(symbols, numbers, lambda s, n: F.struct(
        fix(s).alias("el"), F.coalesce(n.try_cast("double"), F.lit(1.0)).alias("n")))

    def added(ts):
        names = F.sort_array(F.array_distinct(F.transform(ts, lambda t: t["el"])))
        return let(names, lambda ns: F.map_from_arrays(ns, F.transform(ns, lambda e: F.aggregate(
            F.filter(ts, lambda t: t["el"] == e), F.lit(0.0), lambda acc, t: acc + t["n"]))))

    return let(terms, added)   # the formula is read once, not once for each of its elements


def _gcd(values: Column) -> Column:
    """Greatest common divisor of an integer array; Euclid needs at most 1.45 log2 of the value steps."""
    def pair(a, b):
        start = F.struct(a.alias("a"), b.alias("b"))
        steps = (F.ceil(F.log2(F.greatest(a, b, F.lit(1))) * 1.45) + 2).cast("int")
        done = F.aggregate(
            F.sequence(F.lit(1), steps), start,
            lambda s, _: F.when(s["b"] == 0, s).otherwise(
                F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))))
        return done["a"]

    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: pair(v, acc))


def _amount(n: Column, ones: bool) -> Column:
    """Amount as formulas spell it: whole, or with up to eight decimals; one only where ``ones`` are written."""
    whole = F.abs(n - F.round(n)) < AMOUNT_TOL
    text = F.when(whole, F.round(n).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.8f", n), r"0+$", ""))
    return text if ones else F.when(whole & (F.round(n) == 1), "").otherwise(text)


def reduced_formula(terms: Column) -> Column:
    """Canonical formula from array<struct<element, n, electronegativity>>.

    Elements go by electronegativity, one without any last. Whole amounts are divided by their greatest
    common divisor; two last elements of three or more that differ by less than 1.65 are a group if their amounts
    have a divisor of their own, as in Ca(HO)2; gases of two atoms and peroxides keep their molecule. Amounts
    that are not all whole stay as they are, ones included.
    """
    struct = lambda t: F.struct(F.coalesce(t["electronegativity"].cast("double"), F.lit(float("inf"))).alias("en"), t["element"].alias("el"), t["n"].cast("double").alias("n"))
    ordered = F.sort_array(F.filter(F.transform(terms, struct), lambda t: F.abs(t["n"]) > AMOUNT_TOL))
    spelled = lambda ts, by, ones: F.array_join(F.transform(ts, lambda t: F.concat(t["el"], _amount(t["n"] / by, ones))), "")

    def whole(ts):
        last = F.slice(ts, -2, 2)
        # most have an element of amount one, and then nothing is left to divide by
        divisor = lambda some: F.when(F.exists(some, lambda t: F.round(t["n"]) == 1), F.lit(1).cast("long")).otherwise(
            _gcd(F.transform(some, lambda t: F.round(t["n"]).cast("long"))))
        close = (F.size(ts) >= 3) & (F.try_element_at(ts, F.lit(-1))["en"] - F.try_element_at(ts, F.lit(-2))["en"] < GROUP_DIFFERENCE)

        def written(d):
            plain = spelled(ts, d["all"], False)
            grouped = F.concat(spelled(F.slice(ts, 1, F.greatest(F.size(ts) - 2, F.lit(0))), d["all"], False), F.lit("("), spelled(last, d["last"], False), F.lit(")"), (d["last"] / d["all"]).cast("long").cast("string"))
            return let(F.when(close & (d["last"] > d["all"]), grouped).otherwise(plain), lambda f:   # only one is spelled
                        F.coalesce(F.try_element_at(molecules, f), f))

        return let(F.struct(divisor(ts).alias("all"), F.when(F.size(ts) >= 3, divisor(last)).otherwise(1).cast("long").alias("last")), written)

    molecules = F.create_map(*[F.lit(v) for pair in MOLECULES.items() for v in pair])
    return let(ordered, lambda ts: F.when(F.forall(ts, lambda t: F.abs(t["n"] - F.round(t["n"])) < AMOUNT_TOL), whole(ts)).otherwise(spelled(ts, F.lit(1.0), True)))


def composition_terms(composition: Column) -> Column:
    """map<element, amount> -> the terms of ``reduced_formula``, with the table's electronegativities."""
    known = F.create_map(*[F.lit(v) for e in ELEMENTS for v in (e[0], e[3])])   # fixed: one entry an element
    return F.transform(F.map_entries(composition), lambda t: F.struct(t["key"].alias("element"), t["value"].alias("n"), F.try_element_at(known, t["key"]).alias("electronegativity")))


def unquote(value: Column) -> Column:
    """Bare value; empty, '.' and '?' are NULL."""
    bare = F.trim(F.regexp_replace(F.trim(value), r"""^['"]+|['"]+$""", ""))
    return let(bare, lambda v: F.when(~v.isin("", ".", "?"), v))


def cif_numeric(value: Column) -> Column:
    """Leading number of a value, uncertainty dropped."""
    return _found(unquote(value), NUMBER).try_cast("double")


def cif_scalar(text: Column, key: str) -> Column:
    """Value of ``key``: on its line, on the next line, or in a ``;`` block joined by blanks."""
    pattern = (r"(?m)^[ \t]*" + key.replace("-", r"\-") +
               r"(?:[ \t]+(\S.*?)[ \t]*$"
               r"|[ \t]*\n(?:[ \t]*\n)*(?:[ \t]*;[ \t]*\n((?s:.*?))\n?[ \t]*;[ \t]*$"
               r"|[ \t]*(?!_|loop_|;)(\S.*?)[ \t]*$))")

    def value(hit):
        joined = F.trim(F.regexp_replace(F.regexp_extract(hit, pattern, 2), r"\s*\n\s*", " "))
        return F.coalesce(unquote(F.regexp_extract(hit, pattern, 1)),
                          let(joined, lambda v: F.nullif(v, F.lit(""))),
                          unquote(F.regexp_extract(hit, pattern, 3)))

    # the text is searched once, and only where it has the key; the groups are read from the short match
    found = let(F.regexp_extract(text, pattern, 0), value)
    return F.when(F.contains(text, F.lit(key)), found) if re.fullmatch(r"[\w-]+", key) else found


# ---- loops --------------------------------------------------------------------------------------

def _count_before(lines: Column, stop) -> Column:
    """How many leading lines come before the first one for which ``stop`` holds."""
    return let(F.array_position(F.transform(lines, stop), True).cast("int"),
               lambda at: F.when(at == 0, F.size(lines)).otherwise(at - 1))


def loops(text: Column, naming: str | None = None) -> Column:
    """array<struct<headers, rows>> of every ``loop_`` block; a row is still one line. With ``naming``, only of
    blocks that hold this lower-case word in any case."""
    chunks = let(F.split(text, LOOP_LINE), lambda c: F.slice(c, 2, F.size(c)))
    if naming:
        chunks = F.filter(chunks, lambda chunk: F.contains(F.lower(chunk), F.lit(naming)))
    lines = F.transform(chunks, lambda chunk: F.transform(F.split(chunk, r"\r?\n"), lambda line: F.trim(line)))
    parted = F.transform(lines, lambda block: let(
        _count_before(block, lambda line: ~F.startswith(line, F.lit("_"))),
        lambda n: F.struct(F.slice(block, 1, n).alias("headers"),
                           F.slice(block, n + 1, F.size(block)).alias("rest"))))
    return F.transform(parted, lambda part: F.struct(
        part["headers"].alias("headers"),
        let(_count_before(part["rest"], lambda line: (line == "") | line.rlike(r"^(_|#|data_|;|loop_$)")),
            lambda n: F.slice(part["rest"], 1, n)).alias("rows")))


def tokens(line: Column) -> Column:
    """Quote-aware tokens of a loop row."""
    return F.transform(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(1)),
                       lambda t: F.regexp_replace(t, r"""^(['"])(.*)\1$""", "$2"))


def cif_loops(texts: DataFrame, key: str = "filename") -> DataFrame:
    """(key, loop_no, row_no, headers, values): one row per loop row; loops without rows keep one."""
    return (
        texts.select(key, F.posexplode(loops(F.col("text"))).alias("loop_no", "block"))
        .select(key, "loop_no", F.col("block.headers").alias("headers"),
                F.posexplode_outer("block.rows").alias("row_no", "line"))
        .select(key, "loop_no", "headers", "row_no", tokens(F.col("line")).alias("values"))
    )


def loop_value(header: str) -> Column:
    """Token under ``header`` in a row of ``cif_loops``; absent or short rows give NULL."""
    at = F.array_position("headers", header).cast("int")
    return F.when(at > 0, F.get("values", at - 1))


def min_site_occupancy(text: Column) -> Column:
    """Smallest readable occupancy of the loops that also place their sites, else NULL.

    Short rows and unreadable values are ignored; a text without such a loop is unknown.
    """
    def smallest(block):
        lowered = F.transform(block["headers"], lambda h: F.lower(h))
        placed = F.exists(lowered, lambda h: F.startswith(h, F.lit("_atom_site_fract")))

        def over_rows(at):
            return F.array_min(F.transform(
                F.transform(block["rows"], lambda r: F.split(r, r"\s+")),
                lambda t: F.when(F.size(t) >= F.size(block["headers"]),
                                 F.split_part(F.get(t, at - 1), F.lit("("), F.lit(1)).try_cast("double"))))

        return F.when(placed, let(F.array_position(lowered, "_atom_site_occupancy").cast("int"),
                                  lambda at: F.when(at > 0, over_rows(at))))

    return F.array_min(F.transform(loops(text, "_atom_site_occupancy"), smallest))


def flag_disordered(min_occupancy: Column, tol: float = DISORDER_TOL) -> Column:
    """NULL stays NULL."""
    return min_occupancy < tol


def parse_entry(archive: DataFrame) -> DataFrame:
    """(filename, text) -> one catalogue row per member. A bad row is kept with its error."""
    text, formula, comp = F.col("text"), F.col("formula_sum"), F.col("composition")
    # steps of their own: what several columns read is computed once
    read = archive.select("filename", "text", extract_formula(text).alias("formula_sum"))
    read = read.withColumn("composition", parse_composition(formula, isotopes=False))
    error = (F.when(text.isNull(), "read failed")
             .when(formula.isNotNull() & (F.size(comp) == 0), "formula has no element"))
    return read.select(
        "filename",
        extract_id(F.col("filename")).alias("id"),
        formula,
        F.when(F.size(comp) > 0, F.array_join(F.map_keys(comp), "-")).alias("chemsys"),
        F.when(F.size(comp) > 0, F.size(comp)).alias("n_elements"),
        F.when(F.size(comp) > 0, F.map_keys(comp)).alias("elements"),
        F.when(F.size(comp) > 0, reduced_formula(composition_terms(comp))).alias("reduced_formula"),
        extract_spacegroup_number(text).alias("spacegroup_number"),
        extract_spacegroup_symbol(text).alias("spacegroup_symbol"),
        *[extract_cell(text, key).alias(name) for name, key in CELL_KEYS.items()],
        min_site_occupancy(text).alias("min_occupancy"),
        error.alias("parse_error"),
    ).withColumn("is_disordered", flag_disordered(F.col("min_occupancy")))


def journal_metadata(texts: DataFrame) -> DataFrame:
    """Bibliography and measurement conditions; each value has a first and a second key."""
    text = F.col("text")

    def number(first, second):
        return F.coalesce(cif_numeric(cif_scalar(text, first)), cif_numeric(cif_scalar(text, second)))

    def with_header(header):
        return F.get(F.filter("blocks", lambda b: F.array_contains(b["headers"], header)), F.lit(0))

    def at(block, header):
        return F.array_position(F.col(block)["headers"], header).cast("int")

    def cite(header):
        return F.when(at("cites", header) > 0, F.get("cite_row", at("cites", header) - 1))

    return (
        texts.withColumn("blocks", loops(text))
        .withColumn("cites", with_header("_citation_journal_full"))
        .withColumn("names", with_header("_citation_author_name"))
        .withColumn("cite_row", tokens(F.get(F.col("cites.rows"), F.lit(0))))
        .withColumn("name_at", at("names", "_citation_author_name"))
        .select(
            "filename",
            F.coalesce(cif_scalar(text, "_citation_title"), cif_scalar(text, "_publ_section_title")).alias("title"),
            unquote(cite("_citation_journal_full")).alias("journal"),
            cif_numeric(cite("_citation_year")).cast("int").alias("year"),
            F.transform("names.rows", lambda r: F.get(tokens(r), F.col("name_at") - 1)).alias("authors"),
            number("_cell_measurement_temperature", "_diffrn_ambient_temperature").alias("temperature_k"),
            number("_cell_measurement_pressure", "_diffrn_ambient_pressure").alias("pressure_kpa"),
            number("_refine_ls_R_factor_gt", "_refine_ls_R_factor_all").alias("r_factor"),
        )
    )
