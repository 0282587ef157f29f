"""Named queries over neighbour graphs and coordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ANIONS, BOND_TOL, ELEMENTS, FORMERS, LIGANDS, element_table
from ..operators import coordination as K
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import pairs as P
from ..operators.ensemble import minimum_contact
from ..session import cut_lineage
from . import views as V
from .evidence import sites
from .registry import query

_RADIUS = {s: r for s, _, r, *_ in ELEMENTS}
MAX_RADIUS = max(_RADIUS[s] for s in V.LABEL_ELEMENTS)


def bonds(spark, sf, tol=BOND_TOL):
    return P.bonds(V.point(spark, sf), None, element_table(spark), tol, MAX_RADIUS)


def shared_bonds(spark, sf):
    """The bond table, written once for the queries that read it several times."""
    return cut_lineage(bonds(spark, sf))


def point_pairs(spark, sf, cutoff, carry=("element",)):
    return P.nearest_image(P.half_pairs(V.point(spark, sf), None, cutoff, "atom", carry), carry)


def contact_edges(spark, sf, cutoff=1.6):
    return point_pairs(spark, sf, cutoff, ()).select("structure_id", "i", "j")


def components(spark, sf):
    return G.connected_components(V.point(spark, sf), contact_edges(spark, sf))


def _in(symbols):
    return "(" + ", ".join(f"'{s}'" for s in symbols) + ")"


_F, _A, _L = _in(FORMERS), _in(ANIONS), _in(LIGANDS)
_B = ("v_bond", "v_point", "el")

_COMPONENTS = """recursive edges as (select structure_id, i, j from v_pointpair where d < 1.6),
  reach as (select structure_id, atom as node, atom as other from v_point
            union select r.structure_id, r.node, e.j from reach r join edges e on e.structure_id = r.structure_id and e.i = r.other),
  comp as (select structure_id, node as atom, min(other) as component from reach group by 1, 2)"""
_SHAPES = _COMPONENTS + """,
  shape as (select structure_id, component, n_nodes, n_edges,
                   case when n_nodes = 1 then 'single' when n_edges = n_nodes * (n_nodes - 1) / 2 then 'clique' else 'chain' end as shape
            from (select structure_id, component, count(*) as n_nodes from comp group by 1, 2)
            left join lateral (select count(*) as n_edges from edges e join comp c on c.structure_id = e.structure_id and c.atom = e.i
                       where e.i < e.j and c.structure_id = structure_id and false) on true)"""
_SHAPES = _COMPONENTS + """,
  ecount as (select c.structure_id, component, count(*) as n_edges from edges e join comp c on c.structure_id = e.structure_id and c.atom = e.i
             where e.i < e.j group by 1, 2),
  shape as (select structure_id, component, n_nodes, coalesce(n_edges, 0) as n_edges,
                   case when n_nodes = 1 then 'single' when coalesce(n_edges, 0) = n_nodes * (n_nodes - 1) / 2 then 'clique' else 'chain' end as shape
            from (select structure_id, component, count(*) as n_nodes from comp group by 1, 2) left join ecount using (structure_id, component))"""


@query("neighbor_pairs", "select structure_id, i, j, ei as element_i, ej as element_j, round(d, 4) as d from v_bond", _B)
def _(spark, sf):
    return bonds(spark, sf).select("structure_id", "i", "j", "element_i", "element_j", F.round("d", 4).alias("d"))


@query("radius_state", """select structure_id, count(*) as n_atoms, count(*) filter (radius is null) as n_unknown,
       coalesce(string_agg(distinct case when radius is null then element end, ',' order by case when radius is null then element end), '') as unknown,
       case when count(*) filter (radius is null) > 0 then 'unknown' else 'known' end as state
       from v_point left join el on symbol = case when element in ('D', 'T') then 'H' else element end group by 1""", ("v_point", "el"))
def _(spark, sf):
    return P.radius_state(V.point(spark, sf), element_table(spark))


@query("clashes", """select structure_id, i, j, ei as element_i, ej as element_j, round(d, 2) as d from v_bond
       where i < j and d < (ri + rj) * 0.6""", _B)
def _(spark, sf):
    return K.clashes(bonds(spark, sf))


@query("minimum_contact", """select structure_id, round(min(d), 4) as min_d,
       arg_min(least(ei, ej) || '-' || greatest(ei, ej), d) as pair from v_pointpair group by 1""", ("v_pointpair",))
def _(spark, sf):
    return minimum_contact(V.point(spark, sf))


def sparse(spark, sf):
    """Two atoms to a cube of 40 angstrom, the last one alone where their number is odd."""
    edge = F.array(*[F.lit(40.0 if k % 4 == 0 else 0.0) for k in range(9)])
    return V.point(spark, sf).withColumns({"structure_id": F.floor(F.col("atom") / 2), "lattice": edge})


# the pairs of ``sparse``; a cube's nearest image is found by rounding, at any distance
_SPARSE = """sp as (select * replace (atom // 2 as structure_id) from v_point),
    spp as (select *, 40 * sqrt((bx - round(bx)) ** 2 + (b_y - round(b_y)) ** 2 + (bz - round(bz)) ** 2) as d from (
        select a.structure_id, a.atom as i, b.atom as j, a.element as ei, b.element as ej, a.occ as oi, b.occ as oj, b.x - a.x as bx, b.y - a.y as b_y, b.z - a.z as bz
        from sp a join sp b on a.structure_id = b.structure_id and a.atom < b.atom))"""


@query("minimum_contact_sparse", f"""with {_SPARSE} select structure_id, round(min(d), 4) as min_d, arg_min(least(ei, ej) || '-' || greatest(ei, ej), d) as pair
       from (select distinct structure_id from sp) left join spp using (structure_id) group by 1""", ("v_point",))
def _(spark, sf):
    return minimum_contact(sparse(spark, sf))


@query("connected_components", f"with {_COMPONENTS} select * from comp", ("v_pointpair",))
def _(spark, sf):
    return components(spark, sf)


@query("clique_or_chain", f"with {_SHAPES} select * from shape", ("v_pointpair",))
def _(spark, sf):
    return G.component_shapes(components(spark, sf), contact_edges(spark, sf))


@query("suspicious_merges", f"""with {_COMPONENTS} select structure_id, component, min(element) as element, count(*) as n_sites,
       round(sum(occ), 2) as occ_sum from comp join v_point using (structure_id, atom) group by 1, 2
       having count(*) > 1 and count(distinct element) = 1 and sum(occ) > 1.25""", ("v_pointpair",))
def _(spark, sf):
    return G.suspicious_merges(V.point(spark, sf), components(spark, sf))


@query("greedy_independent_set", """with recursive ranked as (select structure_id, atom, md5(atom::varchar) as rank,
           row_number() over (partition by structure_id order by md5(atom::varchar)) as k from v_point),
       nbr as (select structure_id, i as atom, list(j) as nb from v_pointpair where d < 1.6 group by 1, 2),
       walk as (select structure_id, 0::bigint as k, []::bigint[] as kept, null::bigint as atom, false as chosen from (select distinct structure_id from v_point)
                union all
                select w.structure_id, r.k,
                       case when len(list_intersect(w.kept, coalesce(nb, []))) = 0 then list_append(w.kept, r.atom) else w.kept end,
                       r.atom, len(list_intersect(w.kept, coalesce(nb, []))) = 0
                from walk w join ranked r on r.structure_id = w.structure_id and r.k = w.k + 1
                left join nbr n on n.structure_id = r.structure_id and n.atom = r.atom)
       select structure_id, atom, chosen from walk where atom is not null""", ("v_pointpair",))
def _(spark, sf):
    nodes = V.point(spark, sf).select("structure_id", "atom", F.md5(F.col("atom").cast("string")).alias("rank"))
    return G.greedy_independent_set(nodes, contact_edges(spark, sf)).select("structure_id", "atom", "chosen")


@query("dedup_coincident", """with recursive site as (select * from v_point where occ = 1.0),
       nbr as (select p.structure_id, i as atom, list(j) as nb from v_pointpair p join site a on a.structure_id = p.structure_id and a.atom = i
               join site b on b.structure_id = p.structure_id and b.atom = j where d < 2.5 and ei = ej group by 1, 2),
       ranked as (select structure_id, atom, row_number() over (partition by structure_id order by atom) as k from site),
       walk as (select structure_id, 0::bigint as k, []::bigint[] as kept, null::bigint as atom, false as chosen from (select distinct structure_id from site)
                union all
                select w.structure_id, r.k,
                       case when len(list_intersect(w.kept, coalesce(nb, []))) = 0 then list_append(w.kept, r.atom) else w.kept end,
                       r.atom, len(list_intersect(w.kept, coalesce(nb, []))) = 0
                from walk w join ranked r on r.structure_id = w.structure_id and r.k = w.k + 1
                left join nbr n on n.structure_id = r.structure_id and n.atom = r.atom)
       select structure_id, count(*) filter (chosen) as n_kept, count(*) filter (not chosen) as n_removed from walk where atom is not null group by 1""",
       ("v_pointpair",))
def _(spark, sf):
    full = V.point(spark, sf).filter("occ = 1.0")
    pairs = P.nearest_image(P.half_pairs(full, None, 2.5, "atom", ("element",)), ("element",))
    same = pairs.filter("element_i = element_j").select("structure_id", "i", "j")
    kept = G.greedy_independent_set(full.select("structure_id", "atom", F.col("atom").alias("rank")), same)
    return kept.groupBy("structure_id").agg(F.count_if("chosen").alias("n_kept"), F.count_if(~F.col("chosen")).alias("n_removed"))


_DIST = """pop as (select structure_id, element, count(*) as n_sites, bool_and(occ >= 0.98) as all_full from v_point group by 1, 2 having count(*) >= 2),
   dist as (select structure_id, ei as element, round(d, 4) as d, count(*) as n from v_pointpair where i < j and ei = ej group by 1, 2, 3)"""


def _populations(spark, sf):
    el = element_table(spark).select(F.col("symbol").alias("element"), "radius")
    return V.point(spark, sf).groupBy("structure_id", "element").agg(
        F.count(F.lit(1)).alias("n_sites"), F.bool_and(F.col("occ") >= 0.98).alias("all_full")).filter(
        "n_sites >= 2").join(el, "element")


@query("widest_gap_cut", f"""with {_DIST}, near as (select *, lead(d) over (partition by structure_id, element order by d) - d as gap from dist where d < 3.0),
    stat as (select structure_id, element, sum(n)::bigint as n_pairs, min(d) as closest,
                    max(coalesce(gap, 0)) filter (d <= 2.0) as g, arg_max(d, {{'g': coalesce(gap, 0), 'd': -d}}) filter (d <= 2.0) as low from near group by 1, 2),
    judged as (select *, case when closest is null then 'vacuous' when closest >= 1.3 then 'out_of_window'
                              when coalesce(g, 0) > 0.4 then 'derived' else 'ambiguous' end as state from pop left join stat using (structure_id, element))
    select structure_id, element, coalesce(n_pairs, 0) as n_pairs, round(closest, 2) as closest, state,
           case state when 'derived' then round(low + g / 2, 6) when 'ambiguous' then 1.3::double end as cut from judged""", ("v_pointpair",))
def _(spark, sf):
    return G.widest_gap_cut(_populations(spark, sf).select("structure_id", "element"), G.distance_list(point_pairs(spark, sf, 3.0)), digits=6)


@query("impossibility_split", f"""with {_DIST}, stat as (select d.structure_id, d.element, max(d) filter (d < radius * 2 * 0.9) as below,
           coalesce(min(d) filter (d >= radius * 2 * 0.9), 5.0::double) as above
           from dist d join pop using (structure_id, element) join el on symbol = element where d < 5.0 group by 1, 2)
    select structure_id, element,
           case when above - below > 0.5 and all_full then 'derived: full, no cut' when above - below > 0.5 and below < radius * 2 * 0.6 then 'derived'
                when above - below > 0.5 then 'ambiguous' else 'not applicable' end as state,
           case when above - below > 0.5 and not all_full then round((below + above) / 2, 6) end as cut
    from pop left join stat using (structure_id, element) join el on symbol = element""", ("v_pointpair", "el"))
def _(spark, sf):
    return G.impossibility_split(_populations(spark, sf).select("structure_id", "element", "radius", "all_full"),
                                 G.distance_list(point_pairs(spark, sf, 5.0)), digits=6)


_ORBITS = f"""with {_COMPONENTS},
    p as (select *, element || ':' || occ::varchar as orbit from v_point),
    comb as (select structure_id, component, sum(occ) as comb_occ, count(distinct element) as comb_n from p join comp using (structure_id, atom) group by 1, 2),
    firsts as (select structure_id, orbit, min(atom) as atom, arg_min(occ, atom) as occ from p group by 1, 2),
    touch as (select a.structure_id, a.orbit, bool_or(a.orbit = b.orbit) as internal, bool_or(a.orbit <> b.orbit) as external
              from edges e join p a on a.structure_id = e.structure_id and a.atom = e.i join p b on b.structure_id = e.structure_id and b.atom = e.j group by 1, 2),
    lab as (select f.structure_id, f.orbit,
              case when not coalesce(internal, false) and not coalesce(external, false) then case when f.occ >= 0.989 then 'O' else 'V' end
                   else (case when coalesce(external, false) and comb_n > 1 then 'S' else '' end) end as s,
              f.occ, comb_occ, comb_n, coalesce(internal, false) as internal, coalesce(external, false) as external
            from firsts f join comp using (structure_id, atom) join comb using (structure_id, component) left join touch t on t.structure_id = f.structure_id and t.orbit = f.orbit),
    labels as (select structure_id, orbit, case when not internal and not external then s
                      when external and comb_n > 1 then case when comb_occ >= 0.989 then 'SP' else 'SVP' end
                      else case when comb_occ >= 0.989 then 'P' else 'VP' end end as label from lab)"""


def _orbit_points(spark, sf):
    return V.point(spark, sf).withColumn("orbit", F.concat("element", F.lit(":"), F.col("occ").cast("string")))


def _labels(spark, sf):
    return G.disorder_labels(_orbit_points(spark, sf), contact_edges(spark, sf), components(spark, sf))


@query("orbit_label", _ORBITS + " select structure_id, orbit, label from labels", ("v_pointpair",))
def _(spark, sf):
    return _labels(spark, sf)


@query("disorder_descriptor", _ORBITS + """ select structure_id, sum(n)::bigint as n_orbits, string_agg(label || ':' || n, ',' order by label || ':' || n) as multiset,
       string_agg(label, '/' order by label) as disorder_set, bool_and(contains(label, 'V')) as no_full_backbone
       from (select structure_id, label, count(*) as n from labels group by 1, 2) group by 1""", ("v_pointpair",))
def _(spark, sf):
    return G.disorder_descriptor(_labels(spark, sf))


@query("orbit_set", _ORBITS + """ select structure_id, string_agg(distinct label, '/' order by label) as disorder_set, count(*) as n_orbits
       from labels group by 1""", ("v_pointpair",))
def _(spark, sf):
    return G.disorder_descriptor(_labels(spark, sf)).select("structure_id", "disorder_set", "n_orbits")


# ---- coordination -------------------------------------------------------------------------------

_MODAL = f"""fl as (select * from v_bond where ei in {_F} and ej in {_L}),
    cnt as (select structure_id, i, ei, count(*) as cn from fl group by all),
    modal as (select structure_id, element, modal_cn, n_centres, n_atoms from (
        select structure_id, ei as element, arg_max(cn, {{'n': n, 'f': -f}}) as modal_cn, sum(n)::bigint as n_centres
        from (select structure_id, ei, cn, count(*) as n, min(i) as f from cnt group by all) group by 1, 2)
        join (select structure_id, element, count(*) as n_atoms from v_point group by all) using (structure_id, element)
        where n_centres / n_atoms >= 0.2),
    unit as (select fl.* from fl join modal m on m.structure_id = fl.structure_id and m.element = fl.ei),
    med as (select structure_id, ei, ej, median(round(d, 4)) as median_d from unit
            where i < j or not (ej in {_F} and ei in {_L}) group by all)"""


@query("modal_coordination", f"with {_MODAL} select structure_id, element, modal_cn, n_centres, n_atoms from modal", _B)
def _(spark, sf):
    return K.modal_coordination(V.point(spark, sf), bonds(spark, sf))


@query("pair_median_length", f"with {_MODAL} select structure_id, ei as element_i, ej as element_j, median_d from med", _B)
def _(spark, sf):
    return K.pair_median_length(K.unit_table(V.point(spark, sf), shared_bonds(spark, sf)))


@query("former_coordination", f"""with {_MODAL} select structure_id, i as atom, ei as element, count(*) as cn, round(min(d), 4) as d_min
       from unit group by all""", _B)
def _(spark, sf):
    return K.unit_table(V.point(spark, sf), shared_bonds(spark, sf)).groupBy(
        "structure_id", F.col("i").alias("atom"), F.col("element_i").alias("element")).agg(
        F.count(F.lit(1)).alias("cn"), F.round(F.min("d"), 4).alias("d_min"))


@query("coordination_histogram", f"""select structure_id, element, string_agg(cn || ':' || n, ',' order by cn) as histogram, count(*) > 1 as heterogeneous
       from (select structure_id, ei as element, cn, count(*) as n from (select structure_id, i, ei, count(*) as cn from v_bond
             where ei in {_F} and ej in {_A} group by all) group by all) group by 1, 2""", _B)
def _(spark, sf):
    return K.coordination_histogram(bonds(spark, sf))


@query("bond_ranges", f"""select structure_id, ei || '-' || ej as pair, round(min(d), 2) as d_min, round(max(d), 2) as d_max, count(*) as n_bonds
       from v_bond where ei in {_F} and ej in {_A} group by 1, 2""", _B)
def _(spark, sf):
    return K.bond_ranges(bonds(spark, sf))


_POP = f"""lens as (select structure_id, ei, ej, round(d, 4) as d, count(*) as n from v_bond where ei in {_F} and ej in {_A} group by all),
    parts as (select *, sum(new) over (partition by structure_id, ei, ej order by d rows unbounded preceding) as part from (
        select *, case when d > lag(d) over (partition by structure_id, ei, ej order by d) * 1.15 then 1 else 0 end as new from lens)),
    szs as (select structure_id, ei, ej, min(pn) as least_n, sum(pn) as total from (select structure_id, ei, ej, part, sum(n) as pn from parts group by all) group by all),
    pops as (select structure_id, ei, ej, d, n, case when least_n >= greatest(3, total * 0.2) then part else 0 end as population from parts join szs using (structure_id, ei, ej)),
    pmed as (select structure_id, ei, ej, population, median(d) as median_d, count(*) as n_bonds from (select structure_id, ei, ej, d, population, unnest(range(n)) from pops) group by all),
    popstat as (select structure_id, ei, ej, population::bigint as population, n_bonds, median_d,
                       sum(case when d > median_d * 1.15 then n else 0 end)::bigint as n_stretched
                from pops join pmed using (structure_id, ei, ej, population) group by all)"""


@query("bond_populations", f"with {_POP} select structure_id, ei as element_i, ej as element_j, population, n_bonds, median_d, n_stretched from popstat", _B)
def _(spark, sf):
    return K.bond_populations(shared_bonds(spark, sf))


def _expect(spark):
    return F.broadcast(spark.createDataFrame([("Si", 4), ("P", 4)], "element string, expected int"))


@query("coordination_integrity", f"""with {_POP},
    hist as (select structure_id, ei, count(distinct cn) as k from (select structure_id, i, ei, count(*) as cn from v_bond where ei in {_F} and ej in {_A} group by all) group by all),
    acn as (select structure_id, i as atom, count(*) as cn from v_bond where ei in {_F} and ej in {_A} group by all)
    select *, n_heterogeneous + n_stretched + n_clashes > 0 as integrity_flag from (
    select s.structure_id, coalesce((select count(*) from hist h where h.structure_id = s.structure_id and k > 1), 0) as n_heterogeneous,
           coalesce((select sum(n_stretched)::bigint from popstat p where p.structure_id = s.structure_id), 0) as n_stretched,
           (select count(*) from v_bond b where b.structure_id = s.structure_id and i < j and d < (ri + rj) * 0.6) as n_clashes,
           (select count(*) from (select j from v_bond b where b.structure_id = s.structure_id and ei in {_F} and ej in {_A} group by j having count(distinct i) >= 2)) as bridging_anions,
           (select count(*) from v_point p left join acn on acn.structure_id = p.structure_id and acn.atom = p.atom
            where p.structure_id = s.structure_id and p.element in ('Si', 'P') and coalesce(cn, 0) <> 4) as n_violations
    from (select distinct structure_id from v_point) s)""", _B)
def _(spark, sf):
    return K.coordination_integrity(V.point(spark, sf), shared_bonds(spark, sf), _expect(spark))


_EXPECT = f"""{_MODAL},
    centre as (select structure_id, i as atom, ei as element, count(*) as cn, string_agg(distinct ej, '+' order by ej) as sig from unit group by all),
    lent as (select distinct structure_id, j as atom from unit),
    role as (select structure_id, element, sig, arg_max(cn, {{'n': n, 'f': -f}}) as role_cn, sum(n) as n_total from (
             select structure_id, element, sig, cn, count(*) as n, min(atom) as f from centre group by all) group by 1, 2, 3),
    role2 as (select *, case when count(*) over w = 1 then element else element || '[' || sig || ']' end as label,
                     row_number() over (partition by structure_id, element order by n_total desc, sig) as rk from role window w as (partition by structure_id, element)),
    atoms as (select p.structure_id, p.atom, p.element, case when c.atom is not null then 'centre' when l.atom is not null then 'ligand' else 'stripped' end as role
              from v_point p join modal m on m.structure_id = p.structure_id and m.element = p.element
              left join centre c on c.structure_id = p.structure_id and c.atom = p.atom left join lent l on l.structure_id = p.structure_id and l.atom = p.atom),
    expc as (select c.structure_id, c.atom, c.element, label, cn, role_cn as expected from centre c join role2 r using (structure_id, element, sig)
             union all select a.structure_id, a.atom, a.element, label, 0, role_cn from atoms a join role2 r using (structure_id, element) where role = 'stripped' and rk = 1)"""


@query("ligand_roles", f"with {_EXPECT} select structure_id, element, role, count(*) as n from atoms group by all", _B)
def _(spark, sf):
    b = shared_bonds(spark, sf)
    modal = K.modal_coordination(V.point(spark, sf), b)
    roles = K.ligand_roles(V.point(spark, sf), K.unit_table(V.point(spark, sf), b, modal), modal)
    return roles.groupBy("structure_id", "element", "role").agg(F.count(F.lit(1)).alias("n"))


@query("centre_expectations", f"with {_EXPECT} select * from expc", _B)
def _(spark, sf):
    return K.centre_expectations(V.point(spark, sf), shared_bonds(spark, sf))


@query("expect_overrides", f"""with {_EXPECT} select structure_id, atom, element, label, cn, case element when 'Si' then 4 when 'P' then 4 else expected end as expected from expc""", _B)
def _(spark, sf):
    parsed = spark.range(1).select(F.explode(F.str_to_map(F.lit("Si=4,P=4"), F.lit(","), F.lit("="))).alias("element", "expected"))
    return K.centre_expectations(V.point(spark, sf), shared_bonds(spark, sf), F.broadcast(parsed))


@query("connectivity_audit", f"""with {_EXPECT} select structure_id, label, element, expected, sum(n)::bigint as n_centres,
       coalesce(sum(n) filter (cn = expected), 0)::bigint as n_ok, coalesce(sum(n) filter (cn <> expected), 0)::bigint as n_defects,
       string_agg(cn || ':' || n, ',' order by cn) as histogram
       from (select structure_id, label, element, expected, cn, count(*) as n from expc group by all) group by 1, 2, 3, 4""", _B)
def _(spark, sf):
    return K.connectivity_audit(K.centre_expectations(V.point(spark, sf), shared_bonds(spark, sf)))


@query("first_n_defects", f"""with {_EXPECT} select structure_id, atom, label, cn, expected, n_total, rank from (
       select *, row_number() over (partition by structure_id order by atom) as rank, count(*) over (partition by structure_id) as n_total
       from expc where cn <> expected) where rank <= 5""", _B)
def _(spark, sf):
    defects = K.connectivity_defects(K.centre_expectations(V.point(spark, sf), shared_bonds(spark, sf)))
    return K.first_n(defects, "structure_id", ["atom"], 5).drop("element")


@query("element_coverage", f"""with {_EXPECT} select structure_id,
       coalesce((select string_agg(distinct element, ',' order by element) from expc e where e.structure_id = p.structure_id), '') as examined,
       coalesce(string_agg(distinct element, ',' order by element) filter (element not in {_A} and element not in (select element from expc e where e.structure_id = p.structure_id)), '') as not_examined
       from v_point p group by 1""", _B)
def _(spark, sf):
    points = V.point(spark, sf)
    return K.element_coverage(points, K.connectivity_audit(K.centre_expectations(points, shared_bonds(spark, sf))))


_ENV = f"""env as (select p.structure_id, p.atom, p.element,
      count(*) filter (ei in {_F} and ej in {_A}) as cn, count(distinct j) filter (ei in {_A} and ej in {_F}) as n_formers,
      count(*) filter (ei in {_A} and ej not in {_F} and ej not in {_A}) as n_other, coalesce(bool_or(ej = 'H'), false) as has_h
      from v_point p left join v_bond b on b.structure_id = p.structure_id and b.i = p.atom group by 1, 2, 3),
    bonding as (select distinct structure_id, element, true as bonding from env where n_formers > 0),
    full_env as (select *, coalesce(bonding, false) and n_formers = 0 and not has_h as dangling from env left join bonding using (structure_id, element))"""


@query("config_descriptors", f"""with {_ENV},
    mode as (select structure_id, element, arg_max(cn, {{'n': n, 'f': -f}}) as modal_cn from (
             select structure_id, element, cn, count(*) as n, min(atom) as f from env where cn > 0 group by all) group by 1, 2),
    lens as (select structure_id, ei, ej, round(d, 4) as d from v_bond where ei in {_F} and ej in {_A}),
    str as (select structure_id, count(*) as n from lens join (select structure_id, ei, ej, median(d) as m from lens group by all) using (structure_id, ei, ej) where d > m * 1.15 group by 1)
    select structure_id, count(*) filter (dangling) as dangling_anions, count(*) filter (cn > 0 and cn < modal_cn) as under_coord_formers,
           count(*) filter (cn > modal_cn) as over_coord_formers, count(*) filter (n_formers >= 2) as bridging_anions,
           count(*) filter (dangling and n_other = 0) as dangling_unexplained,
           coalesce((select n from str s where s.structure_id = f.structure_id), 0) as stretched_bonds,
           (select count(*) from v_bond b where b.structure_id = f.structure_id and i < j and d < (ri + rj) * 0.6) as clashes
    from full_env f left join mode using (structure_id, element) group by structure_id""", _B)
def _(spark, sf):
    return K.config_descriptors(V.point(spark, sf), shared_bonds(spark, sf))


@query("unlisted_formers", f"""with {_ENV}, cand as (select * from v_bond where ei not in {_F} and ei not in {_A} and ej in {_A}),
    close as (select c.structure_id, ei as element, j, min(d) as d from cand c join full_env f on f.structure_id = c.structure_id and f.atom = c.j where dangling group by all),
    mode as (select structure_id, element, arg_max(cn, {{'n': n, 'f': -f}}) as modal_cn, max(n) as n_mode, sum(n) as n_total from (
             select structure_id, ei as element, cn, count(*) as n, min(i) as f from (select structure_id, i, ei, count(*) as cn from cand group by all) group by all) group by 1, 2)
    select structure_id, element, count(*) as n_anions, round(median(round(d, 4)), 2) as median_d, any_value(modal_cn) as modal_cn,
           round(any_value(n_mode) / any_value(n_total), 2) as cn_uniformity from close join mode using (structure_id, element) group by 1, 2""", _B)
def _(spark, sf):
    return K.unlisted_formers(V.point(spark, sf), shared_bonds(spark, sf))


@query("unit_bonds", f"""with {_MODAL}, held as (select u.structure_id, u.i, u.j, cn between 2 and 9 as in_range,
           coalesce(round(d, 4) > median_d * 1.15 or round(d, 4) < median_d / 1.15, false) as off
           from unit u join cnt c on c.structure_id = u.structure_id and c.i = u.i left join med m on m.structure_id = u.structure_id and m.ei = u.ei and m.ej = u.ej)
    select structure_id, count(distinct i) as n_centres, count(distinct i) filter (not in_range) as skipped_cn,
           count(distinct {{'a': least(i, j), 'b': greatest(i, j)}}) filter (in_range and not off) as n_bonds,
           count(*) filter (in_range and off) as skipped_length from held group by 1""", _B)
def _(spark, sf):
    return K.unit_bond_report(K.unit_bonds(K.unit_table(V.point(spark, sf), shared_bonds(spark, sf))))


@query("bond_strength_deficit", """with near as (select * from v_pointpair where d > 0.01 and d < 2.85),
    b as (select n.structure_id, n.i, n.j, n.ei, n.d, a.ox_common as ox_i from near n join el a on a.symbol = ei join el c on c.symbol = ej
          where a.ox_common > 0.5 and c.ox_common < -0.5 and ej in ('O', 'N', 'F', 'Cl', 'S', 'Se')),
    cnx as (select structure_id, i, count(*) as cn from b group by all),
    sat as (select b.structure_id, j as atom, sum(ox_i / cn) as satisfied, count(*) filter (ei = 'H' and d < 1.3) as n_h from b join cnx using (structure_id, i) group by 1, 2)
    select structure_id, atom, element, round(deficit, 4) as deficit from (
      select p.structure_id, p.atom, element, abs(ox_common) - coalesce(satisfied, 0) - coalesce(n_h, 0) as deficit
      from v_point p join el on symbol = element left join sat using (structure_id, atom)
      where ox_common < -0.5 and element in ('O', 'N', 'F', 'Cl', 'S', 'Se')) where deficit > 0.15""", ("v_pointpair", "el"))
def _(spark, sf):
    ox = element_table(spark).select(F.col("symbol").alias("element"), F.col("ox_common").cast("double").alias("oxidation"))
    near = P.both_ways(point_pairs(spark, sf, 2.85), ("element",))
    out = K.with_deficit(V.point(spark, sf), ox, K.bond_strength_deficit(near, ox))
    return out.withColumn("deficit", F.round("deficit", 4))


@query("former_anion_cut", f"""with contact as (select p.structure_id, a.elements as ea, b.elements as eb, round(d, 2) as d
       from v_pospair p join v_psig a on a.structure_id = p.structure_id and a.pos = i join v_psig b on b.structure_id = p.structure_id and b.pos = j
       where i < j and si <> sj and d < 2.6 and (a.n_species > 1 or a.occ_total < 0.99) and (b.n_species > 1 or b.occ_total < 0.99)),
    f as (select structure_id, d, (list_has_any(ea, {list(FORMERS)}) and list_has_any(eb, {list(ANIONS)}))
              or (list_has_any(eb, {list(FORMERS)}) and list_has_any(ea, {list(ANIONS)})) as fits,  ea, eb from contact),
    g as (select structure_id, count(*) as n, count(*) filter (fits) as nf, min(d) filter (fits) as s from (select distinct structure_id, d, fits, ea, eb from f) group by 1)
    select s.structure_id, coalesce(nf, 0) > 0 as has_former_anion, coalesce(round(s * 1.15, 2), 2.0) as cut,
           case when coalesce(nf, 0) > 0 then 'derived' when coalesce(n, 0) = 0 then 'vacuous' else 'unmatched' end as state
    from (select distinct structure_id from v_site) s left join g using (structure_id)""", ("v_pospair", "v_site"))
def _(spark, sf):
    s = sites(spark, sf)
    contacts = E.close_contacts(s, None)
    return K.former_anion_cut(contacts, s.select("structure_id").distinct()).select(
        "structure_id", (F.col("n_former_anion") > 0).alias("has_former_anion"), "cut", "state")


_CLASH = """with full_site as (select * from {points} where occ >= 0.98),
    pr as (select p.structure_id, i, j, ei, ej, d, a.radius + b.radius as s, d / (a.radius + b.radius) as rho
           from {pairs} p join el a on a.symbol = ei join el b on b.symbol = ej
                join full_site x on x.structure_id = p.structure_id and x.atom = i join full_site y on y.structure_id = p.structure_id and y.atom = j where i < j),
    bad as (select structure_id, count(*) as n, list(ei || '-' || ej || printf(' d=%.3f sum=%.3f rho=%.3f', round(d, 3), round(s, 3), round(rho, 3)) order by round(rho, 3), i, j) as l
            from pr where d >= 0.2 and rho < 0.5 group by 1),
    same as (select structure_id, count(*) as n, list(ei || '-' || ej || printf(' d=%.4f', round(d, 4)) order by round(d, 4), i, j) as l from pr where d < 0.2 group by 1),
    low as (select structure_id, round(round(min(rho), 4), 3) as rho_min, arg_min(ei || '-' || ej, {{'r': round(rho, 4), 'i': i, 'j': j}}) as rho_min_pair from pr where d >= 0.2 group by 1)
    select s.structure_id, n_sites, 0::bigint as n_no_radius, rho_min, rho_min_pair, coalesce(bad.n, 0) as n_impossible, coalesce(same.n, 0) as n_coincident,
           array_to_string(coalesce(bad.l, [])[:8], ';') as impossible, array_to_string(coalesce(same.l, [])[:8], ';') as coincident,
           case when bad.n > 0 then 'superposition' end as flag, case when same.n > 0 then 'duplicate' end as dup_flag
    from (select structure_id, count(*) as n_sites from full_site group by 1) s left join low using (structure_id) left join bad using (structure_id) left join same using (structure_id)"""


def _clash(points, spark):
    found = K.full_occ_clash(points.filter("occ >= 0.98"), element_table(spark))
    return found.withColumns({c: F.array_join(c, ";") for c in ("impossible", "coincident")})


@query("full_occ_clash", _CLASH.format(points="v_point", pairs="v_pointpair"), ("v_pointpair", "el"))
def _(spark, sf):
    return _clash(V.point(spark, sf), spark)


@query("full_occ_clash_sparse", f"with {_SPARSE}, " + _CLASH.format(points="sp", pairs="spp")[5:], ("v_point", "el"))
def _(spark, sf):
    return _clash(sparse(spark, sf), spark)


@query("minority_dispersal", """with m as (select *, element as orbit, occ = 0.5 as is_minority from v_point),
    pr as (select p.structure_id, i, j, ei as orbit, d, a.is_minority and b.is_minority as both_minor from v_pointpair p
           join m a on a.structure_id = p.structure_id and a.atom = i join m b on b.structure_id = p.structure_id and b.atom = j where ei = ej),
    nn as (select structure_id, orbit, i, min(d) as d from pr where both_minor group by 1, 2, 3)
    select c.structure_id, c.orbit, n_minority, case when n_minority >= 2 then round((select avg(d) from nn where nn.structure_id = c.structure_id and nn.orbit = c.orbit)
            / (select min(d) from pr where pr.structure_id = c.structure_id and pr.orbit = c.orbit), 2) end as dispersal
    from (select structure_id, orbit, count(*) as n_minority from m where is_minority group by 1, 2) c""", ("v_pointpair",))
def _(spark, sf):
    members = V.point(spark, sf).select("structure_id", "atom", F.col("element").alias("orbit"), (F.col("occ") == 0.5).alias("is_minority"), "x", "y", "z", "lattice")
    return K.minority_dispersal(members)
