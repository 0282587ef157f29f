"""Named queries over text: archives, extraction, loops, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as C
from ..session import cut_lineage, scratch_path
from ..sources import archives as Z
from ..sources import index as I
from ..sources import readers as R
from ..sources import writers as W
from . import views as V
from .registry import query


def archive(spark, sf):
    """CIF-like text per order. The site lines come from distinct (position, element, occupancy)
    rows, so even a structure with very many lines renders to a bounded text."""
    rows = V.site(spark, sf).groupBy("structure_id", "pos", "x", "y", "z", "element", "occ").count()
    line = F.format_string("%s%d %s %.4f %.4f %.4f %.2f(1) %d", "element", "pos", "element", "x", "y", "z", "occ", "count")
    sites = rows.groupBy("structure_id").agg(F.sort_array(F.collect_list(line)).alias("sites"))
    e = V.entry(spark, sf)
    formula = F.col("formula_sum")
    spelled = (F.when(formula.isNull(), F.lit(None))
               .when((F.col("id") % 3 == 0) & (F.col("n_elements") == 1), F.concat(F.lit("_chemical_formula_sum "), formula))
               .when(F.col("id") % 3 == 1, F.concat(F.lit("_chemical_formula_sum\n;\n"), F.regexp_replace(formula, " ", "\n"), F.lit("\n;")))
               .otherwise(F.concat(F.lit("_chemical_formula_sum '"), F.regexp_replace(formula, " ", "  "), F.lit("'"))))
    sg = F.col("spacegroup_number").cast("string")
    symbol = F.when(F.col("id") % 2 == 0, F.concat(F.lit("_space_group_name_H-M_alt 'P "), sg, F.lit("'"))).otherwise(
        F.concat(F.lit("_symmetry_space_group_name_H-M ' P "), sg, F.lit(" '")))
    head = F.concat_ws(
        "\n", F.concat(F.lit("data_"), F.col("id").cast("string")), spelled,
        F.when(F.col("id") % 7 == 0, "_cell_length_a ?").otherwise(
            F.concat(F.lit("_cell_length_a "), (F.col("id") % 50 + 5).cast("string"), F.lit(".25(3)"))),
        F.lit("_cell_angle_alpha 90."), F.lit("_cell_volume 125.00(3)"),
        F.concat(F.lit("_cell_formula_units_Z "), (F.col("id") % 4 + 1).cast("string")),
        F.concat(F.lit("_space_group_IT_number "), sg), symbol,
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("_citation_title\n;\nOn entry\n "), F.col("id").cast("string"), F.lit("\n;"))).otherwise(
            F.concat(F.lit("_publ_section_title 'Entry "), F.col("id").cast("string"), F.lit("'"))),
        F.when(F.col("id") % 5 == 0, "_cell_measurement_pressure .").otherwise(
            F.concat(F.lit("_cell_measurement_pressure\n"), F.col("id").cast("string"), F.lit(".5(2)"))),
        F.concat(F.lit("_diffrn_ambient_pressure "), sg),
        F.lit("_diffrn_ambient_temperature '295(2)'"),
        F.lit("loop_\n_citation_id\n_citation_journal_full\n_citation_year"),
        F.concat(F.lit("primary 'Journal of "), sg, F.lit("' "), (F.lit(1950) + F.col("id") % 70).cast("string")),
        F.lit("loop_\n_citation_author_name\n'Doe, J.'"), F.concat(F.lit("'Roe, R. "), sg, F.lit("'")))
    loop = F.concat(F.lit("\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n"
                          "_atom_site_fract_z\n_atom_site_occupancy\n_atom_site_symmetry_multiplicity\n"),
                    F.array_join("sites", "\n"), F.lit("\n#End\n"))
    return e.join(sites, e.id == sites.structure_id, "left").select(
        "filename", F.concat(head, F.coalesce(loop, F.lit("\n"))).alias("text"))


def packed(spark, sf):
    """The archive written once and read back through the packed source."""
    path = scratch_path(spark, "archive")
    W.write_packed_text(archive(spark, sf), path)
    return R.scan_packed_text(spark, path)


@query("scan_text_archive", """select filename, 'data_' || id as first_line, n_elements is not null as has_sites
       from v_entry""", ("v_entry",))
def _(spark, sf):
    return packed(spark, sf).select(
        "filename", F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"),
        F.contains("text", F.lit("_atom_site_occupancy")).alias("has_sites"))


@query("scan_zip_archive", """select filename, 'data_' || id as first_line, n_elements is not null as has_sites, null::varchar as read_error
       from v_entry""", ("v_entry",))
def _(spark, sf):
    """Zip archives written by as many tasks as there are, of at most a task's reading each."""
    path = scratch_path(spark, "zip")
    Z.write_zip(archive(spark, sf), path, Z.SPLIT_BYTES)
    return Z.scan_zip_archive(spark, path).select(
        "filename", F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"),
        F.contains("text", F.lit("_atom_site_occupancy")).alias("has_sites"), "read_error")


@query("extract_id", "select filename, id from v_entry", ("v_entry",))
def _(spark, sf):
    return archive(spark, sf).select("filename", X.extract_id(F.col("filename")).alias("id"))


@query("extract_formula", "select filename, formula_sum from v_entry", ("v_entry",))
def _(spark, sf):
    return archive(spark, sf).select("filename", X.extract_formula(F.col("text")).alias("formula_sum"))


@query("parse_composition", """select 'entry_' || structure_id || '.cif' as filename, element, n::double as amount
       from v_amount join orders on o_orderkey = structure_id""", ("v_amount",))
def _(spark, sf):
    comp = X.parse_composition(X.extract_formula(F.col("text")))
    return archive(spark, sf).select("filename", F.explode(comp).alias("element", "amount"))


@query("extract_cell", """select 'entry_' || o_orderkey || '.cif' as filename,
       case when o_orderkey % 7 <> 0 then o_orderkey % 50 + 5.25::double end as a, 90.0::double as alpha, 125.0::double as volume,
       (o_orderkey % 4 + 1)::double as z_form, null::double as density from orders""")
def _(spark, sf):
    cols = [X.extract_cell(F.col("text"), X.CELL_KEYS[n]).alias(n) for n in ("a", "alpha", "volume", "z_form", "density")]
    return archive(spark, sf).select("filename", *cols)


@query("extract_spacegroup", "select filename, spacegroup_number, 'P ' || spacegroup_number as spacegroup_symbol from v_entry", ("v_entry",))
def _(spark, sf):
    return archive(spark, sf).select(
        "filename", X.extract_spacegroup_number(F.col("text")).alias("spacegroup_number"),
        X.extract_spacegroup_symbol(F.col("text")).alias("spacegroup_symbol"))


@query("cif_scalar", """select 'entry_' || o_orderkey || '.cif' as filename,
       case when o_orderkey % 2 = 0 then 'On entry ' || o_orderkey end as title,
       case when o_orderkey % 2 = 1 then 'Entry ' || o_orderkey end as section_title,
       case when o_orderkey % 5 <> 0 then o_orderkey || '.5(2)' end as pressure, '295(2)' as temperature from orders""")
def _(spark, sf):
    t = F.col("text")
    return archive(spark, sf).select(
        "filename", X.cif_scalar(t, "_citation_title").alias("title"),
        X.cif_scalar(t, "_publ_section_title").alias("section_title"),
        X.cif_scalar(t, "_cell_measurement_pressure").alias("pressure"),
        X.cif_scalar(t, "_diffrn_ambient_temperature").alias("temperature"))


@query("cif_numeric", """select 'entry_' || o_orderkey || '.cif' as filename,
       case when o_orderkey % 5 <> 0 then o_orderkey + 0.5::double end as pressure, 295.0::double as temperature from orders""")
def _(spark, sf):
    t = F.col("text")
    return archive(spark, sf).select(
        "filename", X.cif_numeric(X.cif_scalar(t, "_cell_measurement_pressure")).alias("pressure"),
        X.cif_numeric(X.cif_scalar(t, "_diffrn_ambient_temperature")).alias("temperature"))


@query("cif_loops", """select 'entry_' || structure_id || '.cif' as filename, element || pos as label, element as symbol,
       x, y, z, occ, count(*)::int as multiplicity from v_site join orders on o_orderkey = structure_id
       group by all""", ("v_site",))
def _(spark, sf):
    rows = X.cif_loops(archive(spark, sf)).filter(F.array_contains("headers", "_atom_site_label"))
    number = lambda h: X.cif_numeric(X.loop_value(h))
    return rows.select(
        "filename", X.loop_value("_atom_site_label").alias("label"), X.loop_value("_atom_site_type_symbol").alias("symbol"),
        number("_atom_site_fract_x").alias("x"), number("_atom_site_fract_y").alias("y"), number("_atom_site_fract_z").alias("z"),
        number("_atom_site_occupancy").alias("occ"),
        number("_atom_site_symmetry_multiplicity").cast("int").alias("multiplicity"))


@query("min_site_occupancy", "select filename, min_occupancy from v_entry", ("v_entry",))
def _(spark, sf):
    return archive(spark, sf).select("filename", X.min_site_occupancy(F.col("text")).alias("min_occupancy"))


@query("flag_disordered", "select filename, is_disordered from v_entry", ("v_entry",))
def _(spark, sf):
    return archive(spark, sf).select(
        "filename", X.flag_disordered(X.min_site_occupancy(F.col("text"))).alias("is_disordered"))


@query("parse_entry", """select filename, id, formula_sum, chemsys, n_elements, array_to_string(elements, ',') as elements, reduced_formula, spacegroup_number,
       'P ' || spacegroup_number as spacegroup_symbol, case when id % 7 <> 0 then id % 50 + 5.25::double end as a,
       min_occupancy, is_disordered, null::varchar as parse_error from v_entry""", ("v_entry",))
def _(spark, sf):
    return X.parse_entry(packed(spark, sf)).select(
        "filename", "id", "formula_sum", "chemsys", "n_elements", F.array_join("elements", ",").alias("elements"), "reduced_formula",
        "spacegroup_number", "spacegroup_symbol", "a", "min_occupancy", "is_disordered", "parse_error")


@query("archive_by_formula", """select id, filename, reduced_formula, chemsys from v_entry
       where reduced_formula = (select reduced_formula from v_entry where reduced_formula is not null group by 1 order by count(*) desc, 1 limit 1)""", ("v_entry",))
def _(spark, sf):
    """The catalogue parsed from the texts answers a search by formula: all entries of the most common one."""
    parsed = cut_lineage(X.parse_entry(packed(spark, sf)).select("id", "filename", "reduced_formula", "chemsys"))   # what the search reads
    top = parsed.filter(F.col("reduced_formula").isNotNull()).groupBy("reduced_formula").count().orderBy(F.desc("count"), "reduced_formula").first()
    hits = C.query_formula(parsed, top.reduced_formula if top else "")
    return parsed.join(hits.select("id"), "id", "left_semi").select("id", "filename", "reduced_formula", "chemsys")


@query("reduced_formula_fractional", """select structure_id, case when bool_and(abs(a - round(a)) < 1e-8)
         then 'whole' else string_agg(element || case when abs(a - round(a)) < 1e-8 then round(a)::bigint::varchar else rtrim(printf('%.2f', a), '0') end, '' order by electronegativity, element) end as formula
       from (select structure_id, element, electronegativity, round(located, 2) as a from v_amount join el on symbol = element where round(located, 2) > 0) group by 1""", ("v_amount", "el"))
def _(spark, sf):
    """Formulas of the amounts that the occupancies add up to, spelled and read back."""
    located = V.site(spark, sf).groupBy("structure_id", "element").agg(F.round(F.sum("occ"), 2).alias("a"))
    text = F.array_join(F.sort_array(F.collect_list(F.format_string("%s%.2f", "element", "a"))), " ")   # one text an element
    formula = located.groupBy("structure_id").agg(text.alias("text")).withColumn("comp", X.parse_composition(F.col("text"), isotopes=False))
    whole = F.forall(F.map_values("comp"), lambda n: F.abs(n - F.round(n)) < 1e-8)
    return formula.select("structure_id", F.when(whole, "whole").otherwise(X.reduced_formula(X.composition_terms(F.col("comp")))).alias("formula"))


@query("journal_metadata", """select 'entry_' || o_orderkey || '.cif' as filename,
       case when o_orderkey % 2 = 0 then 'On entry ' || o_orderkey else 'Entry ' || o_orderkey end as title,
       'Journal of ' || (o_custkey % 230 + 1) as journal, cast(1950 + o_orderkey % 70 as integer) as year,
       'Doe, J.; Roe, R. ' || (o_custkey % 230 + 1) as authors, 295.0::double as temperature_k,
       case when o_orderkey % 5 <> 0 then o_orderkey + 0.5::double else (o_custkey % 230 + 1)::double end as pressure_kpa,
       null::double as r_factor from orders""")
def _(spark, sf):
    return X.journal_metadata(archive(spark, sf)).withColumn("authors", F.array_join("authors", "; "))


# ---- sinks --------------------------------------------------------------------------------------

@query("write_index", """select id, chemsys, n_elements, is_disordered,
       (select count(*) from v_element x where x.id = e.id)::bigint as n_bridge from v_entry e""", ("v_entry", "v_element"))
def _(spark, sf):
    path = scratch_path(spark, "index")
    W.write_index(V.entry(spark, sf), path, {"archive": sf})
    bridge = I.read_index(spark, path, "elements").groupBy("id").agg(F.count(F.lit(1)).alias("n_bridge"))
    return (I.read_index(spark, path).join(bridge, "id", "left")
            .select("id", "chemsys", F.col("n_elements").cast("int").alias("n_elements"), "is_disordered",
                    F.coalesce("n_bridge", F.lit(0)).alias("n_bridge")))


@query("backfill_index", "select filename, chemsys, case when n_elements = 2 then min_occupancy end as min_occupancy, case when n_elements = 2 then id % 9 end as mark, n_elements = 2 as rewritten from v_entry", ("v_entry",))
def _(spark, sf):
    """Occupancies put into the entries of two elements; the other partitions stay the files they were."""
    path, entries = scratch_path(spark, "index"), cut_lineage(V.entry(spark, sf))
    I.write_index(entries.withColumn("min_occupancy", F.lit(None).cast("double")), path)
    fresh = entries.filter("n_elements = 2").select("filename", "min_occupancy", (F.col("id") % 9).alias("mark"))
    I.backfill_index(spark, path, fresh)
    assert I.backfill_index(spark, path, fresh) == 0   # again: nothing changes
    first = {r.folder.split("/data/")[1].split("/")[0] for r in I._published(spark, path) if r.tbl == "meta"}
    rewritten = ~F.contains(F.input_file_name(), F.lit(first.pop()))
    return I.read_index(spark, path).select("filename", "chemsys", "min_occupancy", "mark", F.when(F.col("n_elements").isNull(), None).otherwise(rewritten).alias("rewritten"))


@query("add_columns", "select filename, spacegroup_number, min_occupancy, is_disordered from v_entry", ("v_entry",))
def _(spark, sf):
    old = V.entry(spark, sf).select("filename", "spacegroup_number", F.lit(None).cast("double").alias("min_occupancy"))
    fresh = archive(spark, sf).select("filename", X.min_site_occupancy(F.col("text")).alias("min_occupancy"))
    fresh = fresh.withColumn("is_disordered", X.flag_disordered(F.col("min_occupancy")))
    once = C.add_columns(old, fresh)
    return C.add_columns(once, fresh).select("filename", "spacegroup_number", "min_occupancy", "is_disordered")


@query("extract_members", """select filename, true as has_text from v_entry where chemsys = 'O-Si'""", ("v_entry",))
def _(spark, sf):
    path = scratch_path(spark, "members")
    wanted = C.filenames_by_query(V.entry(spark, sf), chemsys="Si-O")
    absent = spark.range(1).select(F.lit("absent.cif").alias("filename"))
    W.extract_members(archive(spark, sf), wanted.unionByName(absent), path)
    return Z.scan_zip_archive(spark, path).select("filename", F.startswith("text", F.lit("data_")).alias("has_text"))


@query("read_members", """select filename, 'data_' || id as first_line from v_entry where id % 50 = 0""", ("v_entry",))
def _(spark, sf):
    """Members read by their place in the packed archives."""
    path = scratch_path(spark, "packed")
    Z.write_zip(archive(spark, sf), path, 1 << 20)
    wanted = V.entry(spark, sf).filter("id % 50 = 0").select("filename")
    found = Z.read_members(spark, path, wanted.unionByName(spark.range(1).select(F.lit("absent.cif").alias("filename"))))
    return found.select("filename", F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"))


@query("get_text", """select w.id, filename, filename is null as missing from (
       select distinct l_partkey as id from lineitem union select 99999999) w left join v_entry e on e.id = w.id""", ("v_entry",))
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")).union(
        spark.range(1).select(F.lit(99999999).cast("long"))).distinct()
    return C.get_text(ids, V.entry(spark, sf), archive(spark, sf)).select("id", "filename", "missing")
