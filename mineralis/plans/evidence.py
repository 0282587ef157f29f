"""Named queries over evidence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..session import cut_lineage
from . import views as V
from .registry import query


def sites(spark, sf):
    """Parsed structures: one row per position, with the cell of its structure."""
    return E.site_signatures(V.species(spark, sf)).withColumn("lattice", V.site_cube())


def positions(spark, sf):
    return E.merge_positions(V.site(spark, sf))


@query("merge_positions", """select structure_id, x, y, z, n_rows, occ_sum, is_mixed, is_partial, signature
       from v_position""", ("v_position",))
def _(spark, sf):
    return positions(spark, sf)


@query("wrap_fraction", """select structure_id, round(v - floor(v), 4) as wrapped, count(*) as n
       from (select structure_id, x + occ * 3 - 1 as v from v_site) group by 1, 2""", ("v_site",))
def _(spark, sf):
    return V.site(spark, sf).select("structure_id", E.wrap_fraction(F.col("x") + F.col("occ") * 3 - 1).alias("wrapped")) \
        .groupBy("structure_id", "wrapped").agg(F.count(F.lit(1)).alias("n"))


@query("orbit_counts", """select structure_id, signature, count(*) as n_positions, bool_or(is_mixed) as mixed,
       bool_or(is_partial) as partial from v_position where is_mixed or is_partial group by 1, 2""", ("v_position",))
def _(spark, sf):
    return E.orbit_counts(positions(spark, sf))


@query("position_totals", """select structure_id, count(*) filter (is_partial) as n_partial,
       count(*) filter (is_mixed) as n_mixed from v_position group by 1""", ("v_position",))
def _(spark, sf):
    return E.position_totals(positions(spark, sf))


@query("occupancy_signature", """select structure_id, pos, signature, occ_total, n_species, major from v_psig""", ("v_psig",))
def _(spark, sf):
    return sites(spark, sf).select("structure_id", "pos", "signature", "occ_total", "n_species", "major")


@query("orbit_index", """select structure_id, signature, count(*) as n_positions, round(avg(occ_total), 3) as occ_total,
       min(pos) as first_pos from v_psig group by 1, 2""", ("v_psig",))
def _(spark, sf):
    return E.orbit_index(sites(spark, sf)).select(
        "structure_id", "signature", "n_positions", F.round("occ_total", 3).alias("occ_total"), "first_pos")


@query("oxidation_lookup", """select structure_id, element, oxidation, n_states::int as n_states from v_oxidation""", ("v_oxidation",))
def _(spark, sf):
    return E.oxidation_states(V.valence(spark, sf)).select(
        "structure_id", "element", "oxidation", F.size("states").alias("n_states"))


@query("mixed_valence", """select structure_id, element, min(oxidation) as low, max(oxidation) as high
       from v_valence group by 1, 2 having count(*) > 1""", ("v_valence",))
def _(spark, sf):
    return E.mixed_valence(E.oxidation_states(V.valence(spark, sf))).select(
        "structure_id", "element", F.array_min("states").alias("low"), F.array_max("states").alias("high"))


@query("nominal_charge", """select structure_id, case when bool_and(oxidation is not null) then round(sum(occ * oxidation), 3) end
       as nominal_charge from v_species left join (select * from v_oxidation where element <> 'Co') using (structure_id, element)
       group by 1""", ("v_species", "v_oxidation"))
def _(spark, sf):
    ox = E.oxidation_states(V.valence(spark, sf)).filter("element <> 'Co'")
    return E.nominal_charge(V.species(spark, sf), ox)


@query("located_amounts", "select structure_id, element, round(located, 4) as located from v_amount", ("v_amount",))
def _(spark, sf):
    return E.located_amounts(V.species(spark, sf)).withColumn("located", F.round("located", 4))


def _formula(spark, sf):
    """Formula amounts: each raised row counts double, every fourth position nothing."""
    return V.site_parts(spark, sf).groupBy("structure_id", "element").agg(
        F.sum(F.when(F.col("pos") % 4 != 3, 1.0 + F.col("raised")).otherwise(0.0)).alias("expected"))


def _found(spark, sf):
    return V.site_parts(spark, sf).groupBy("structure_id", "element").agg(
        F.sum(F.when(F.col("pos") != 0, F.col("occ")).otherwise(0.0)).alias("located"))


_FORMULA_SQL = """formula as (select structure_id, element, sum(case when pos % 4 <> 3 then 1.0::double + raised else 0 end) as expected
                              from v_site group by all),
                  found as (select structure_id, element, sum(case when pos <> 0 then occ else 0 end) as located from v_site group by all)"""


@query("composition_check", f"""with {_FORMULA_SQL} select * from (
       select structure_id, element, round(coalesce(expected, 0), 2) as formula_expected, round(coalesce(located, 0), 2) as located,
              round(round(coalesce(expected, 0), 2) - round(coalesce(located, 0), 2), 2) as deficit,
              round(coalesce(located, 0), 2) = 0 and round(coalesce(expected, 0), 2) > 0 as missing
       from formula full join found using (structure_id, element)) where abs(deficit) > 0.05""", ("v_site",))
def _(spark, sf):
    return E.composition_check(_formula(spark, sf), _found(spark, sf))


@query("formula_union", f"""with {_FORMULA_SQL} select structure_id, element from formula
       union select structure_id, element from found""", ("v_site",))
def _(spark, sf):
    return E.formula_union(_formula(spark, sf), _found(spark, sf))


@query("hydrogen_deficit", f"""with {_FORMULA_SQL},
       per_el as (select s.structure_id, element, count(*) as n_sites, bool_or(n_species > 1 or occ_total < 0.99) as dis
                  from v_species s join v_psig p using (structure_id, pos) group by all),
       ref as (select structure_id, max({{'n': n_sites, 'e': element, 'a': expected}}) as r
               from per_el join formula using (structure_id, element) where not dis and expected > 0 group by 1),
       h as (select structure_id, expected as fh from formula where element = 'H' and expected > 0),
       present as (select structure_id, count(*) as n from v_psig where major = 'H' group by 1)
       select structure_id, r.e as reference, round_even(fh * r.n / r.a, 0)::bigint as declared_h,
              coalesce(n, 0) as present_h, round_even(fh * r.n / r.a, 0)::bigint - coalesce(n, 0) as deficit
       from h left join ref using (structure_id) left join present using (structure_id)""", ("v_site", "v_species", "v_psig"))
def _(spark, sf):
    return E.hydrogen_deficit(_formula(spark, sf), V.species(spark, sf), sites(spark, sf))


@query("close_contacts", """select structure_id, least(si, sj) as orbit_a, greatest(si, sj) as orbit_b, round(d, 2) as d, count(*) as n
       from v_pospair p join v_psig a on a.structure_id = p.structure_id and a.pos = i
                        join v_psig b on b.structure_id = p.structure_id and b.pos = j
       where i < j and si <> sj and d < 2.6 and (a.n_species > 1 or a.occ_total < 0.99) and (b.n_species > 1 or b.occ_total < 0.99)
       group by p.structure_id, 2, 3, 4""".replace("select structure_id,", "select p.structure_id,", 1), ("v_pospair",))
def _(spark, sf):
    return E.close_contacts(sites(spark, sf), None)


_ORBIT_SQL = """orbit as (select structure_id, signature, count(*) as n, min(pos) as first_pos, any_value(elements) as els from v_psig group by 1, 2),
    osp as (select distinct p.structure_id, p.signature, s.element, round(s.occ, 3) as occ
            from v_psig p join v_species s using (structure_id, pos)),
    oinfo as (select structure_id, signature, sum(occ) as tot, max(case element when 'H' then 3 when 'O' then 2 else 0 end) as rank,
                     arg_min(element, (-occ, element)) as major from osp group by 1, 2)"""


@query("slaved_orbits", f"""with {_ORBIT_SQL},
    matched as (select structure_id, si as parent, sj as follower, count(distinct i) as n_matched from v_pospair
                where d between 0.3 and 1.9 and si <> sj group by all),
    cand as (select m.structure_id, follower, parent, po.first_pos, po.n as n_parent, fo.n as n_follower, fi.tot as f_occ, fi.major,
                    (select arg_min({{'e': element, 'o': occ}}, element) from osp t where t.structure_id = m.structure_id and t.signature = parent
                       and abs(t.occ - fi.tot) < 0.15 and t.occ < 0.99) as trig
             from matched m
             join orbit po on po.structure_id = m.structure_id and po.signature = parent
             join oinfo pi on pi.structure_id = m.structure_id and pi.signature = parent
             join orbit fo on fo.structure_id = m.structure_id and fo.signature = follower
             join oinfo fi on fi.structure_id = m.structure_id and fi.signature = follower
             where fi.tot < 0.99 and fi.rank > pi.rank and n_matched = po.n)
    select structure_id, follower, parent, trig.e as trigger, n_parent as n_parent_positions,
           greatest(1, round_even(n_follower * f_occ / (n_parent * trig.o), 0)::int) as followers_per_parent, major as follower_element
    from cand where trig is not null qualify row_number() over (partition by structure_id, follower order by first_pos) = 1""",
       ("v_pospair", "v_species"))
def _(spark, sf):
    return E.slaved_orbits(cut_lineage(sites(spark, sf)), None)


@query("rigid_shells", """with pm as (select p.*, a.major as mi, b.major as mj, b.occ_total as occ_j from v_pospair p
         join v_psig a on a.structure_id = p.structure_id and a.pos = i join v_psig b on b.structure_id = p.structure_id and b.pos = j),
    shell as (select structure_id, i as c, mi as centre, j as a, mj as ligand, occ_j as occ from pm
              where d < 2.6 and mj in ('H', 'B', 'C', 'N', 'O', 'F') and occ_j < 0.98),
    alt as (select s.structure_id, s.c, count(*) as n_alt from shell s
            join shell t on t.structure_id = s.structure_id and t.c = s.c and s.a < t.a and s.ligand = t.ligand
            join pm on pm.structure_id = s.structure_id and pm.i = s.a and pm.j = t.a and pm.d < 1.6 group by 1, 2)
    select structure_id, centre, ligand_elements, n_ligand_sites, occ_sum, n_alt as n_alt_pairs, count(*) as n_centres,
           round_even(occ_sum, 0)::int as est_coordination
    from (select structure_id, c, centre, count(*) as n_ligand_sites, round(sum(occ), 2) as occ_sum,
                 string_agg(distinct ligand, '+' order by ligand) as ligand_elements from shell group by 1, 2, 3
          having count(*) >= 2 and count(*) - sum(occ) >= 0.8 - 1e-9)
    join alt using (structure_id, c) group by all""", ("v_pospair",))
def _(spark, sf):
    return E.rigid_shells(sites(spark, sf), None)


@query("orientation_orbits")
def _(spark, sf):
    s = cut_lineage(sites(spark, sf))
    return E.orientation_orbits(s, None, E.slaved_orbits(s, None))


@query("min_image_distance", "select structure_id, i, j, round(d, 4) as d from v_pospair where i < j and d < 2.6", ("v_pospair",))
def _(spark, sf):
    return E.site_pairs(sites(spark, sf), None, 2.6, ()).withColumn("d", F.round("d", 4))


@query("provenance_rollup", """select structure_id, count(*) filter (not confident) as n_unconfident,
       coalesce(string_agg(name, ',' order by name) filter (not confident), '') as unconfident,
       string_agg(name || ':' || state, ',' order by name) as states from (
       select structure_id, 'exclusion.' || element as name,
              case when n = 1 then 'vacuous' when located = n then 'derived' when n < 3 then 'ambiguous' else 'out_of_window' end as state,
              n = 1 or located = n as confident from v_amount) group by 1""", ("v_amount",))
def _(spark, sf):
    state = (F.when(F.col("n") == 1, "vacuous").when(F.col("located") == F.col("n"), "derived")
             .when(F.col("n") < 3, "ambiguous").otherwise("out_of_window"))
    blocks = V.amount(spark, sf).select(
        "structure_id", F.concat(F.lit("exclusion."), "element").alias("name"), state.alias("state"))
    return E.provenance_rollup(blocks)
