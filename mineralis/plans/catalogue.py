"""Named queries over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SIBLING_TOL, element_table
from ..operators import catalogue as C
from . import views as V
from .registry import query

_COLS = list(C.LIST_COLUMNS)
_SQL_COLS = ", ".join(_COLS)


def _list(df):
    return df.select(*_COLS)


@query("query_chemsys", f"select {_SQL_COLS} from v_entry where chemsys = 'Fe-O' and is_disordered order by id",
       ("v_entry",))
def _(spark, sf):
    return _list(C.query_chemsys(V.entry(spark, sf), "O-Fe", disordered=True))


@query("query_formula", f"select {_SQL_COLS} from v_entry where reduced_formula = 'FeO' order by id", ("v_entry",))
def _(spark, sf):
    return _list(C.query_formula(V.entry(spark, sf), "FeO"))


@query("query_spacegroup", f"select {_SQL_COLS} from v_entry where spacegroup_number = 62 and not is_disordered order by id",
       ("v_entry",))
def _(spark, sf):
    return _list(C.query_spacegroup(V.entry(spark, sf), 62, disordered=False))


@query("query_subsystem", f"""select {_SQL_COLS} from v_entry where id in (
           select id from v_element where element in ('Fe', 'O') group by id having count(distinct element) = 2)
           order by id""", ("v_entry", "v_element"))
def _(spark, sf):
    return _list(C.query_subsystem(V.entry(spark, sf), ["O", "Fe", "O"], bridge=V.entry_element(spark, sf)))


@query("query_subsystem_array", f"""select {_SQL_COLS} from v_entry where list_has_all(elements, ['Si', 'O', 'H'])
           and not is_disordered order by id""", ("v_entry",))
def _(spark, sf):
    return _list(C.query_subsystem(V.entry(spark, sf), C.parse_elements("Si,O H"), disordered=False))


@query("query_subsystem_exact", f"select {_SQL_COLS} from v_entry where chemsys = 'O-Si'", ("v_entry",))
def _(spark, sf):
    return _list(C.query_subsystem(V.entry(spark, sf), ["Si", "O"], exact=True))


@query("search", f"""select {_SQL_COLS} from v_entry where list_has_all(elements, ['O']) and n_elements = 4
           and is_disordered order by id""", ("v_entry",))
def _(spark, sf):
    return _list(C.search(V.entry(spark, sf), elements=["O"], n_elements=4, disordered=True))


@query("search_top", f"""select {_SQL_COLS} from v_entry where n_elements = 2 and is_disordered
           order by id limit 25""", ("v_entry",))
def _(spark, sf):
    return _list(C.search(V.entry(spark, sf), n_elements=2, disordered=True, limit=25))


@query("tristate_filter", """select 'true' as branch, count(*) as n from v_flag where is_good
           union all select 'false', count(*) from v_flag where not is_good
           union all select 'all', count(*) from v_flag""", ("v_flag",))
def _(spark, sf):
    flag = V.flag(spark, sf)

    def branch(name, wanted):
        return C.tristate_filter(flag, "is_good", wanted).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("branch"), "n")

    return branch("true", True).unionByName(branch("false", False)).unionByName(branch("all", None))


@query("scan_entries", f"select {_SQL_COLS} from v_entry", ("v_entry",))
def _(spark, sf):
    return _list(V.entry(spark, sf))


@query("sort_by_id", "select id, filename from v_entry order by id, filename", ("v_entry",))
def _(spark, sf):
    return C.sort_by_id(V.entry(spark, sf)).select("id", "filename")


@query("show_entry", """select w.id, filename, formula_sum, spacegroup_number, is_disordered,
           filename is not null as found from (select 77::bigint as id) w left join v_entry e on e.id = w.id""",
       ("v_entry",))
def _(spark, sf):
    return C.show_entry(V.entry(spark, sf), 77).select(
        "id", "filename", "formula_sum", "spacegroup_number", "is_disordered", "found")


@query("filenames_by_ids", """select id, filename from v_entry
           where id in (select o_orderkey from orders where o_totalprice > 400000) order by id""", ("v_entry",))
def _(spark, sf):
    wanted = V.table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"))
    return C.filenames_by_ids(V.entry(spark, sf), wanted)


@query("filenames_by_query", """select filename from v_entry where list_has_all(elements, ['Fe', 'O'])
           and id is not null""", ("v_entry",))
def _(spark, sf):
    return C.filenames_by_query(V.entry(spark, sf), elements=["Fe", "O"])


@query("scope_filter", """select coalesce(reason, 'in scope') as reason, count(*) as n from (
           select case when n_elements > 6 then 'gt6-elements' when pressure > 1000 then 'high-pressure'
                       when n_pos < 1.5 then 'partial-structure' end as reason
           from (select id, n_elements, o_totalprice / 400 as pressure from v_entry where n_elements is not null)
           join (select structure_id, count(distinct pos) as n_pos from v_site group by all) on structure_id = id)
           group by all""", ("v_entry", "v_site"))
def _(spark, sf):
    n_pos = V.site(spark, sf).groupBy("structure_id").agg(F.count_distinct("pos").alias("n_pos"))
    e = V.entry(spark, sf).filter("n_elements is not null")
    reason = C.scope_reason(F.col("n_elements"), F.col("o_totalprice") / 400, F.col("n_pos"))
    return (e.join(n_pos, e.id == n_pos.structure_id)
            .select(F.coalesce(reason, F.lit("in scope")).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query("catalogue_stats", """select count(*) as n_rows, count(*) filter (formula_sum is null) as parse_errors,
           count(distinct chemsys) as distinct_chemsys, count(distinct reduced_formula) as distinct_formula,
           count(*) filter (is_disordered) as disordered, count(*) filter (not is_disordered) as ordered,
           count(*) filter (is_disordered is null) as unknown from v_entry""", ("v_entry",))
def _(spark, sf):
    return C.catalogue_stats(V.entry(spark, sf), F.when(F.col("formula_sum").isNull(), "no formula"))


@query("by_n_elements", "select n_elements, count(*) as n_rows from v_entry group by 1", ("v_entry",))
def _(spark, sf):
    return C.by_n_elements(V.entry(spark, sf))


@query("backfill_counts", """select count(*) as n_rows, count(*) filter (is_disordered) as disordered,
           count(*) filter (min_occupancy is null) as unknown,
           count(*) filter (is_disordered is not null and not is_disordered) as ordered from v_entry""", ("v_entry",))
def _(spark, sf):
    return C.backfill_counts(V.entry(spark, sf))


@query("chemsys_columns", "select id, elements[1] as first_element, chemsys, n_elements from v_entry", ("v_entry",))
def _(spark, sf):
    return V.entry(spark, sf).select("id", F.try_element_at("elements", F.lit(1)).alias("first_element"), "chemsys", "n_elements")


@query("reduced_formula", """select reduced_formula, count(*) as n, min(id) as first_id from v_entry
           group by 1""", ("v_entry",))
def _(spark, sf):
    return V.entry(spark, sf).groupBy("reduced_formula").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("entry_elements_join", """select element, count(*) as n_entries, count(*) filter (is_disordered) as n_disordered
           from v_element join v_entry using (id) group by 1""", ("v_entry", "v_element"))
def _(spark, sf):
    e = V.entry(spark, sf).select("id", "is_disordered")
    return V.entry_element(spark, sf).join(e, "id").groupBy("element").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if("is_disordered").alias("n_disordered"))


_FLAG_SQL = """select structure_id, not bool_or(n_rows > 1 or abs(s - 1) > 0.02) as is_ordered
   from (select structure_id, pos, count(*) as n_rows, sum(occ) as s from v_site group by all) group by 1"""


@query("sibling_ordered_flag", _FLAG_SQL, ("v_site",))
def _(spark, sf):
    return C.ordered_flag(V.site(spark, sf), SIBLING_TOL)


def _sibling_input(spark, sf):
    """Sibling key: chemical system and nominal formula, amounts rounded half-even, zeros dropped. Some
    entries have no space group."""
    amounts = V.amount(spark, sf).withColumn("n", F.bround("located").cast("long")).filter("n > 0")
    nominal = C.chemistry_columns(amounts, element_table(spark)).select(
        F.col("structure_id").alias("id"), F.col("reduced_formula").alias("nominal"))
    flags = C.ordered_flag(V.site(spark, sf), SIBLING_TOL).withColumnRenamed("structure_id", "id")
    e = V.entry(spark, sf).select("id", "chemsys", F.when(F.col("id") % 17 != 0, F.col("spacegroup_number") % 3).alias("spacegroup_number"))
    return (
        e.join(nominal, "id", "left").join(flags, "id", "left")
        .select("id", "spacegroup_number",
                F.when(F.col("nominal").isNotNull(), F.concat_ws("|", "chemsys", "nominal")).alias("sibling_key"),
                "is_ordered")
    )


_SIBLING_SQL = f"""with nominal as (
    select structure_id, string_agg(element || case when n // g = 1 then '' else (n // g)::varchar end, ''
                                    order by electronegativity, element) as nominal
    from (select structure_id, element, n,
                 (list_reduce(list(n) over (partition by structure_id), lambda a, b: gcd(a, b))) as g
          from (select structure_id, element, round_even(located, 0)::bigint as n from v_amount) where n > 0)
         join el on symbol = element group by 1),
  flag as ({_FLAG_SQL}),
  cand as (select e.id, case when e.id % 17 <> 0 then spacegroup_number % 3 end as sg, chemsys || '|' || nominal as k, is_ordered
           from v_entry e left join nominal n on n.structure_id = e.id left join flag f on f.structure_id = e.id),
  pairs as (select a.id, b.id as other, (a.sg is distinct from b.sg) as differs,
                   row_number() over (partition by a.id order by (a.sg is distinct from b.sg), b.id) as rn,
                   count(*) over (partition by a.id) as n
            from cand a join cand b on a.k = b.k and a.id <> b.id and b.is_ordered)
  select c.id, case when k is not null then coalesce(n, 0) end as n_siblings, other as best_sibling,
         case when k is null then 'not_run' else 'derived' end as state,
         case when k is null then 'not searched' when other is null then 'none'
              when differs then 'other-SG' else 'same-SG' end as sibling
  from cand c left join pairs p on p.id = c.id and rn = 1"""


@query("sibling_search", _SIBLING_SQL, ("v_entry", "v_amount", "v_site", "el"))
def _(spark, sf):
    return C.sibling_search(_sibling_input(spark, sf))


@query("sibling_state", f"""select state, count(*) as n from (
     select case when k_missing then 'not_run: no catalogue' when n > 0 then 'derived: found'
                 else 'derived: searched and absent' end as state
     from (select (state = 'not_run') as k_missing, n_siblings as n from ({_SIBLING_SQL})))
     group by 1""", ("v_entry", "v_amount", "v_site", "el"))
def _(spark, sf):
    found = C.sibling_search(_sibling_input(spark, sf))
    state = C.sibling_state(F.col("state") != "not_run", F.lit(None), F.col("n_siblings"))
    return found.select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
