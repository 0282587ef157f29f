"""The views of ``views.py`` as SQL, for the twins of the named queries."""

from __future__ import annotations

from ..constants import ELEMENT_COLUMNS, ELEMENTS, MOLECULES
from .views import (BRAND_ELEMENTS, LABEL_ELEMENTS, POINT_CELL, POINTS_PER_CELL, SITE_CELL,
                    THIRD_ELEMENTS, TYPE_ELEMENTS)


def formula_sql(terms: str) -> str:
    """Canonical formula of a list of {x, e, n} with whole amounts without a common divisor, by electronegativity."""
    group = f"case when len({terms}) >= 3 and {terms}[-1].x - {terms}[-2].x < 1.65 then gcd({terms}[-1].n, {terms}[-2].n) else 1 end"
    amount = lambda n: f"case when {n} = 1 then '' else ({n})::bigint::varchar end"
    raw = f"""array_to_string(list_transform(case when {group} > 1 then {terms}[:-3] else {terms} end, lambda t: t.e || {amount("t.n")}), '')
        || case when {group} > 1 then '(' || {terms}[-2].e || {amount(f"({terms}[-2].n // {group})")} || {terms}[-1].e || {amount(f"({terms}[-1].n // {group})")} || ')' || ({group})::varchar else '' end"""
    return f"case {raw} " + " ".join(f"when '{k}' then '{m}'" for k, m in MOLECULES.items()) + f" else {raw} end"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_BRAND = f"{_list(BRAND_ELEMENTS)}[(cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer) - 1) % 25 + 1]"
_KIND = "case p_type " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPE_ELEMENTS.items()) + " end"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "el": ((), "select * from (values "
           + ", ".join(f"('{s}', {z}, {r}::double, {en}::double, {lo}, {hi}, {c})"
                       for s, z, r, en, lo, hi, c in ELEMENTS)
           + f") t({', '.join(ELEMENT_COLUMNS)})"),
    "v_site": ((), f"""
        select l_orderkey as structure_id, {_BRAND} as element,
               case when l_discount <= 0.07 then 1.0::double
                    else round(1 - 5 * l_discount, 2) end as occ,
               cast((l_partkey % 3) * 4 + (l_suppkey % 2) * 2 + l_quantity::bigint % 2 as integer) as pos,
               (l_partkey % 3)::double / 4 as x, (l_suppkey % 2)::double / 2 as y,
               (l_quantity::bigint % 2)::double / 4 as z,
               case when l_tax > 0.06 then 1 else 0 end as raised
        from lineitem join part on l_partkey = p_partkey"""),
    "v_species": (("v_site",), """
        select structure_id, pos, x, y, z, element, sum(occ) as occ from v_site group by all"""),
    "v_position": (("v_site",), """
        select structure_id, pos, x, y, z, count(*) as n_rows, round(sum(occ), 3) as occ_sum,
               count(distinct element) > 1 as is_mixed, round(sum(occ), 3) < 0.98 as is_partial,
               (select string_agg(t, ',' order by t) from (
                  select element || '=' || printf('%.3f', occ) || '*' || count(*) as t from v_site s
                  where s.structure_id = v.structure_id and s.pos = v.pos group by element, occ)) as signature
        from v_site v group by all"""),
    "v_psig": (("v_species",), """
        select structure_id, pos, x, y, z, sum(occ) as occ_total, count(*) as n_species,
               string_agg(element || '=' || printf('%.3f', occ), ',' order by element) as signature,
               list(element order by element) as elements,
               arg_min(element, (-round(occ, 6), element)) as major
        from v_species group by all"""),
    "v_valence": (("v_site", "el"), """
        select distinct structure_id, element, (ox_common + raised)::double as oxidation
        from v_site join el on symbol = element"""),
    "v_oxidation": (("v_valence",), """
        select structure_id, element, avg(oxidation) as oxidation, count(*) as n_states
        from v_valence group by all"""),
    "v_amount": (("v_site",), """
        select structure_id, element, count(*) as n, sum(occ) as located, min(occ) as min_occ
        from v_site group by all"""),
    "v_chem": (("v_amount", "el"), f"""
        select *, {formula_sql("terms")} as reduced_formula from (
        select structure_id, list(element order by element) as elements,
               string_agg(element, '-' order by element) as chemsys, count(*)::integer as n_elements,
               string_agg(element || n, ' ' order by element) as formula_sum,
               list({{'x': electronegativity, 'e': element, 'n': n // g}} order by electronegativity, element) as terms,
               min(min_occ) as min_occupancy
        from (select *, (list_reduce(list(n) over (partition by structure_id), lambda a, b: gcd(a, b))) as g
              from v_amount) join el on symbol = element
        group by structure_id)"""),
    "v_entry": (("v_chem",), """
        select o_orderkey as id, 'entry_' || o_orderkey || '.cif' as filename,
               cast(o_custkey % 230 + 1 as integer) as spacegroup_number, o_totalprice,
               elements, chemsys, n_elements, formula_sum, reduced_formula, min_occupancy,
               min_occupancy < 0.99 as is_disordered
        from orders left join v_chem on structure_id = o_orderkey"""),
    "v_element": (("v_site",), "select distinct structure_id as id, element from v_site"),
    "v_point": ((), f"""
        select vec_id // {POINTS_PER_CELL} as structure_id, vec_id as atom,
               {_list(LABEL_ELEMENTS)}[label + 1] as element,
               round((embedding[1]::double * 2) - floor(embedding[1]::double * 2), 4) as x,
               round((embedding[2]::double * 2) - floor(embedding[2]::double * 2), 4) as y,
               round((embedding[3]::double * 2) - floor(embedding[3]::double * 2), 4) as z,
               case vec_id % 4 when 0 then 0.5::double when 1 then 0.7::double else 1.0::double end as occ
        from embeddings"""),
    "v_pointpair": (("v_point",), f"""
        select structure_id, i, j, ei, ej, sqrt(dx * dx + dy * dy + dz * dz) as d from (
          select a.structure_id, a.atom as i, b.atom as j, a.element as ei, b.element as ej,
                 (b.x - a.x - round(b.x - a.x)) * {POINT_CELL} as dx,
                 (b.y - a.y - round(b.y - a.y)) * {POINT_CELL} as dy,
                 (b.z - a.z - round(b.z - a.z)) * {POINT_CELL} as dz
          from v_point a join v_point b on a.structure_id = b.structure_id and a.atom <> b.atom)"""),
    "v_bond": (("v_pointpair", "el"), """
        select p.*, a.radius as ri, b.radius as rj
        from v_pointpair p join el a on a.symbol = ei join el b on b.symbol = ej
        where d < 1.25 * (a.radius + b.radius)"""),
    "v_pospair": (("v_psig",), f"""
        select structure_id, i, j, si, sj, sqrt(dx * dx + dy * dy + dz * dz) as d from (
          select a.structure_id, a.pos as i, b.pos as j, a.signature as si, b.signature as sj,
                 (b.x - a.x - round(b.x - a.x)) * {SITE_CELL} as dx,
                 (b.y - a.y - round(b.y - a.y)) * {SITE_CELL} as dy,
                 (b.z - a.z - round(b.z - a.z)) * {SITE_CELL} as dz
          from v_psig a join v_psig b on a.structure_id = b.structure_id and a.pos <> b.pos)"""),
    "v_sample": ((), """
        select user_id as entry, event_id as ord, 'cfg' || event_id as label,
               case event_type when 'purchase' then 'dispersed' when 'error' then 'clustered'
                    else 'random' end as mode,
               case when value <= 1.0 then 2 else 0 end as short_fill, value > 5.0 as converged,
               value / 1000 as energy, cast(props ->> '$.k' as double) as k, event_id % 7 as m7,
               cast(case when event_id % 5 = 0 then 3 else 4 end as bigint) as n_o
        from events"""),
    "v_valid": (("v_sample",), """
        select * exclude (energy), short_fill = 0 and converged as valid,
               case when short_fill = 0 and converged then energy end as energy from v_sample"""),
    "v_ship": (("v_valid",), """
        select * from (select *, max(case when mode = 'random' then 1 else 0 end)
                                 over (partition by entry) as has_random
                       from v_valid where valid)
        where mode = 'random' or has_random = 0"""),
    "v_ledger": ((), """
        select event_id as seq, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts,
               'user_' || user_id || '.cif' as file,
               case event_type when 'view' then 'completed' when 'click' then 'ok'
                    when 'signup' then 'skipped' when 'purchase' then 'declined' else 'error' end as status,
               case event_type when 'error' then 'engine' when 'purchase' then 'review' end as stage,
               null::varchar as rundir,
               case event_id % 3 when 0 then 'B' when 1 then 'D' end as klass,
               null::varchar as confidence, null::varchar as gates,
               case when value > 200 then 'revise' when value > 20 then 'confirm' end as verdict,
               case when value > 20 then 1 end as round, null::varchar as escalate,
               case when event_type in ('error', 'purchase') then props end as error
        from events"""),
    "v_last": (("v_ledger",), "select * from v_ledger qualify row_number() over (partition by file order by seq desc) = 1"),
    "v_review": ((), """
        select conv_id as entry, turn as round,
               case when role = 'assistant' then 'confirm' else 'revise' end as verdict,
               case when length(text) % 3 = 0 then 'blocking' else 'minor' end as severity,
               'issue-' || md5(text) as issue from conversations"""),
    "v_term": ((), f"""
        select material_id, element, sum(n)::bigint as n from (
          select p_partkey as material_id, {_BRAND} as element, cast(p_size % 4 + 1 as bigint) as n from part
          union all select p_partkey, {_KIND}, cast((p_size // 4) % 4 + 1 as bigint) from part where p_partkey % 17 <> 0
          union all select p_partkey, {_list(THIRD_ELEMENTS)}[p_partkey % 5 + 1],
                           cast(p_partkey % 2 + 1 as bigint) from part where p_partkey % 3 = 0 and p_partkey % 17 <> 0)
        group by all"""),
    "v_phase": (("v_term", "el"), f"""
        select material_id, chemsys, elements, {formula_sql("terms")} as formula, energy, ehull, n_cell_atoms, fracs from (
          select material_id, string_agg(element, '-' order by element) as chemsys,
                 list(element order by element) as elements,
                 list({{'x': electronegativity, 'e': element, 'n': n // g}} order by electronegativity, element) as terms,
                 list(n / tot order by element) as fracs
          from (select *, (list_reduce(list(n) over (partition by material_id), lambda a, b: gcd(a, b))) as g,
                       sum(n) over (partition by material_id) as tot from v_term)
               join el on symbol = element
          group by material_id)
        join (select p_partkey as material_id, -((p_partkey * 7919) % 1000) / 250.0::double as energy,
                     case when p_partkey % 11 <> 0 then ((p_partkey * 31) % 50) / 100.0::double end as ehull,
                     case when p_partkey % 97 = 0 then 400 else 40 end as n_cell_atoms from part)
          using (material_id)"""),
    "v_flag": ((), """
        select d.doc_id, lang, source, n_chars, quality = 1 as is_good
        from documents d left join labels l on l.doc_id = d.doc_id"""),
}


def with_views(names: tuple[str, ...], sql: str) -> str:
    """Prefix ``sql`` with the named views and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql.strip()
    body = sql.strip()
    extra = ""
    if body.lower().startswith("with "):
        head = body[5:]
        extra = ", "
        recursive = head.lower().startswith("recursive ")
        body = head[10:] if recursive else head
    else:
        recursive = False
    ctes = ", ".join(f"{name} as materialized ({VIEWS[name][1].strip()})" for name in ordered)
    return f"with {'recursive ' if recursive else ''}{ctes}{extra or ' '}{body}"
