"""Named queries over allocation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SUBSTITUTION_WORDS, VACANCY_WORDS, element_table
from ..functions import text as X
from ..operators import decorate as D
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import quality as Q
from ..session import cut_lineage
from . import views as V
from .evidence import sites
from .graph import components, contact_edges
from .registry import query


def disordered(spark, sf):
    return sites(spark, sf).filter("is_disordered")


def states(spark, sf, of=None):
    """States of each disordered orbit (of the sites ``of``, if they are at hand): element, occupancy, number of positions."""
    return E.orbit_index(disordered(spark, sf) if of is None else of).select(
        "structure_id", F.col("signature").alias("orbit"), F.col("n_positions").alias("n_groups"), F.explode("species").alias("s")).select(
        "structure_id", "orbit", F.col("s.element").alias("state"), F.col("s.occ").alias("prob"), "n_groups")


_STATES = """st as (select structure_id, p.signature as orbit, s.element as state, round(any_value(s.occ), 3) as prob, count(*) as n_groups
       from v_psig p join v_species s using (structure_id, pos) where n_species > 1 or occ_total < 0.99 group by 1, 2, 3),
    lr as (select *, prob * n_groups as raw, floor(round(prob * n_groups, 9))::bigint as base from st),
    lr2 as (select *, least(n_groups, round_even(round(sum(raw) over w, 9), 0)::bigint) - sum(base) over w as spare,
                   row_number() over (partition by structure_id, orbit order by round(raw - base, 9) desc, state) as rk from lr window w as (partition by structure_id, orbit)),
    tgt as (select structure_id, orbit, state, prob, n_groups, (base + case when rk <= spare then 1 else 0 end)::bigint as target from lr2 where base + case when rk <= spare then 1 else 0 end > 0)"""
_SV = ("v_psig", "v_species")


@query("largest_remainder", f"with {_STATES} select structure_id, orbit, state, prob, n_groups, target from tgt", _SV)
def _(spark, sf):
    return D.largest_remainder(states(spark, sf))


@query("allocation_targets", f"with {_STATES} select structure_id, state, sum(target)::bigint as target, sum(n_groups)::bigint as n_groups from tgt group by 1, 2", _SV)
def _(spark, sf):
    return D.largest_remainder(states(spark, sf)).groupBy("structure_id", "state").agg(
        F.sum("target").alias("target"), F.sum("n_groups").alias("n_groups"))


# one unit a step, the steps of all structures side by side: ``n`` has the counts of a structure's (orbit, state)
_RESCUE = f"""with recursive {_STATES},
    ent as (select st.*, coalesce(target, 0)::bigint as given, row_number() over (partition by structure_id order by orbit, state) as idx
            from st left join (select structure_id, orbit, state, target from tgt) using (structure_id, orbit, state)),
    wish as (select structure_id, state, greatest(round_even(round(sum(prob * n_groups), 9), 0), case when sum(prob * n_groups) > 1e-6 then 1 else 0 end)::bigint as want,
                    list(idx) as places from ent group by 1, 2),
    pair as (select h.structure_id, h.state, h.orbit, h.idx as ih, g.idx as ig, g.state as give, h.prob * h.n_groups as ideal, h.n_groups as cap
             from ent h join ent g using (structure_id, orbit) where h.idx <> g.idx),
    walk as (
      select structure_id, 0 as k, list(given order by idx) as n, '' as turn from ent group by 1
      union all
      select structure_id, k + 1, list_transform(n, lambda x, i: case when i = m.ih then x + 1 when i = m.ig then x - 1 else x end), m.state
      from (select w.structure_id, w.k, any_value(w.n) as n, min({{'state': p.state, 'lack': -round(p.ideal - w.n[p.ih], 9), 'far': -ord.r, 'few': -w.n[p.ig], 'give': p.give, 'ih': p.ih, 'ig': p.ig}}) as m
            from walk w join pair p using (structure_id) join wish using (structure_id, state)
                 join (select structure_id, orbit, dense_rank() over (partition by structure_id order by orbit) as r from (select distinct structure_id, orbit from ent)) ord
                   on ord.structure_id = p.structure_id and ord.orbit = p.orbit
            where p.state >= w.turn and w.n[p.ih] < p.cap and w.n[p.ig] > 0 and list_sum(list_transform(places, lambda i: w.n[i])) < want group by 1, 2)),
    final as (select structure_id, arg_max(n, k) as n from walk group by 1)"""


@query("minority_rescue", _RESCUE + " select structure_id, orbit, state, n[idx]::bigint as target from ent join final using (structure_id) where n[idx] > 0", _SV)
def _(spark, sf):
    st = cut_lineage(states(spark, sf))
    return D.minority_rescue(st, D.largest_remainder(st))


class ChargeJudge:
    """Charge gate of a cell: its ordered sites plus the current targets."""

    def __init__(self, ordered, ox, elements):
        self.ordered, self.ox, self.elements = ordered, ox, elements

    def only(self, structures):
        """The gate for these structures alone, so that a round reads no others."""
        few = [cut_lineage(t.join(structures.select("structure_id"), "structure_id", "left_semi")) for t in (self.ordered, self.ox)]
        return ChargeJudge(*few, self.elements)

    def __call__(self, table):
        who = table.select("structure_id").distinct()
        placed = table.filter("target > 0").select("structure_id", F.col("state").alias("element"), F.col("target").alias("n"))
        comp = placed.unionByName(self.ordered.join(who, "structure_id", "left_semi")).groupBy("structure_id", "element").agg(F.sum("n").alias("n"))
        g = Q.charge_gate(comp, self.ox, self.elements).select("structure_id", F.col("q_per_cell").alias("q"), F.col("pass").alias("ok"))
        # an empty cell carries no charge
        return who.join(g, "structure_id", "left").select("structure_id", F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("ok", F.lit(True)).alias("ok"))


def balanced(spark, sf):
    """The sites are read once: ordered and disordered ones and the declared valences all come from them."""
    rows = cut_lineage(V.site(spark, sf).select("structure_id", "pos", "x", "y", "z", "element", "occ", "raised"))
    of = cut_lineage(E.site_signatures(V.species(spark, sf, rows)).select("structure_id", "pos", "signature", "species", "major", "is_disordered"))
    ordered = of.filter("not is_disordered").groupBy("structure_id", F.col("major").alias("element")).agg(F.count(F.lit(1)).alias("n"))
    ox = cut_lineage(E.oxidation_states(V.valence(spark, sf, rows)).select("structure_id", "element", "oxidation", F.size("states").alias("n_states")))
    charges = ox.select("structure_id", F.col("element").alias("state"), "oxidation")
    targets = D.largest_remainder(states(spark, sf, of.filter("is_disordered")))
    return D.balance_charge(targets, charges, ChargeJudge(cut_lineage(ordered), ox, element_table(spark)))


# one site a step, the steps of all structures side by side; the gate is computed anew from every cell
_BALANCE = f"""with recursive {_STATES},
    ordc as (select structure_id, s.element, count(*) as n from v_psig p join v_species s using (structure_id, pos) where n_species = 1 and occ_total >= 0.99 group by 1, 2),
    raw as (select structure_id, orbit, state, target as given, target, n_groups from tgt
            union all select structure_id, orbit, 'VAC', null, any_value(n_groups) - sum(target), any_value(n_groups) from tgt group by 1, 2),
    ent as (select r.*, case when state = 'VAC' then 0 else coalesce(oxidation, 0) end::double as ox, row_number() over (partition by r.structure_id order by orbit, state) as idx
            from raw r left join v_oxidation v on v.structure_id = r.structure_id and v.element = r.state),
    pair as (select a.structure_id, a.idx as ia, b.idx as ib, a.orbit, a.state as leave, b.state as enter, b.ox - a.ox as delta, a.given as ga, b.given as gb
             from ent a join ent b using (structure_id, orbit) where a.idx <> b.idx),
    part as (select structure_id, state as element, idx from ent where state <> 'VAC' union all select structure_id, element, null from ordc where structure_id in (select structure_id from ent)),
    els as (select structure_id, list({{'base': base, 'places': places, 'ox': ox, 'multi': multi, 'low': ox_low, 'high': ox_high}}) as els from (
              select p.structure_id, p.element, coalesce(any_value(o.n), 0) as base, coalesce(list(p.idx) filter (p.idx is not null), []) as places, coalesce(any_value(oxidation), 0.0)::double as ox,
                     coalesce(any_value(n_states) > 1 or abs(any_value(oxidation) - round_even(any_value(oxidation), 0)::double) > 1e-6, false) as multi, any_value(ox_low) as ox_low, any_value(ox_high) as ox_high
              from part p left join ordc o using (structure_id, element) left join v_oxidation using (structure_id, element) left join el on symbol = element group by 1, 2) group by 1),
    walk as (
      select structure_id, 0 as k, n, round(q, 3) as q, abs(q) < 0.3 or fits as ok, false as stuck from (
        select *, len(list_filter(cell, lambda e: e.multi and e.n > 0 and -(q - e.n * e.ox) / e.n between e.low - 1e-9 and e.high + 1e-9)) > 0 as fits from (
          select *, coalesce(list_sum(list_transform(cell, lambda e: e.n * e.ox)), 0.0) as q from (
            select structure_id, n, list_transform(els, lambda e: {{'n': e.base + coalesce(list_sum(list_transform(e.places, lambda i: n[i])), 0), 'ox': e.ox, 'multi': e.multi, 'low': e.low, 'high': e.high}}) as cell
            from (select structure_id, list(target::bigint order by idx) as n from ent group by 1) join els using (structure_id))))
      union all
      select structure_id, k + 1, n, round(q, 3), abs(q) < 0.3 or fits, not abs(round(q, 3)) < abs(was) - 1e-9 from (
        select *, len(list_filter(cell, lambda e: e.multi and e.n > 0 and -(q - e.n * e.ox) / e.n between e.low - 1e-9 and e.high + 1e-9)) > 0 as fits from (
          select *, coalesce(list_sum(list_transform(cell, lambda e: e.n * e.ox)), 0.0) as q from (
            select structure_id, k, n, was, list_transform(els, lambda e: {{'n': e.base + coalesce(list_sum(list_transform(e.places, lambda i: n[i])), 0), 'ox': e.ox, 'multi': e.multi, 'low': e.low, 'high': e.high}}) as cell
            from (select structure_id, k, was, list_transform(n, lambda x, i: case when i = m.ia then x - 1 when i = m.ib then x + 1 else x end) as n
                  from (select w.structure_id, w.k, any_value(w.n) as n, any_value(w.q) as was, min({{'size': round(abs(w.q + p.delta), 3),
                               'dev': coalesce(abs(w.n[p.ia] - 1 - p.ga) - abs(w.n[p.ia] - p.ga), 0) + coalesce(abs(w.n[p.ib] + 1 - p.gb) - abs(w.n[p.ib] - p.gb), 0),
                               'orbit': p.orbit, 'leave': p.leave, 'enter': p.enter, 'ia': p.ia, 'ib': p.ib}}) as m
                        from walk w join pair p using (structure_id)
                        where not w.ok and not w.stuck and w.n[p.ia] > 0 and abs(w.q + p.delta) < abs(w.q) - 1e-9 group by 1, 2)
                  where m.size < abs(was) - 1e-9) join els using (structure_id))))),
    final as (select structure_id, arg_max(n, k) as n, arg_max(q, k) as q, arg_max(ok, k) as ok, arg_min(q, k) as q0, arg_min(ok, k) as ok0 from walk group by 1)"""
_BV = (*_SV, "v_oxidation", "el")


@query("balance_charge", _BALANCE + " select structure_id, orbit, state, n[idx]::bigint as target, given, n_groups from ent join final using (structure_id) where state <> 'VAC'", _BV)
def _(spark, sf):
    return balanced(spark, sf)[0]


@query("charge_balance_state", _BALANCE + """, orb as (select structure_id, orbit, sum(given) as was, sum(n[idx]) as now, any_value(n_groups) as size, sum(abs(n[idx] - given)) as dev
      from ent join final using (structure_id) where state <> 'VAC' group by 1, 2),
    lost as (select structure_id, count(*) filter (was < size and now >= size) as n_filled, count(*) filter (was > 0 and now = 0) as n_emptied, sum(dev)::bigint as deviation from orb group by 1)
    select structure_id, q0 as q_initial, q as q_final, deviation, n_filled, n_emptied,
           case when ok0 then 'vacuous' when n_filled + n_emptied > 0 or not ok then 'ambiguous' else 'derived' end as state from final join lost using (structure_id)""", _BV)
def _(spark, sf):
    return D.charge_balance_state(*balanced(spark, sf))


@query("distinct_decorations", f"""with {_STATES}, o as (select structure_id, orbit, max(n_groups) as n, sum(target) as used, sum(lgamma(target + 1)) as placed from tgt group by 1, 2),
    l as (select structure_id, sum(ln_o) as ln_n, bool_or(floor(exp(ln_o) + 1e-6) = 0) as none_left from (select *, lgamma(n + 1) - placed - lgamma(greatest(n - used, 0) + 1) as ln_o from o) group by 1)
    select structure_id, case when none_left then 0 when ln_n >= ln(31) - 1e-9 then 31 else round(exp(ln_n)) end::bigint as n_distinct from l""", _SV)
def _(spark, sf):
    return D.distinct_decorations(D.largest_remainder(states(spark, sf)), 30)


@query("random_decorations", f"""with {_STATES},
    g as (select structure_id, signature as orbit, pos, c.config from v_psig cross join (select unnest(range(3)) as config) c where n_species > 1 or occ_total < 0.99),
    r as (select *, row_number() over (partition by structure_id, config, orbit order by ('0x' || substr(md5('7:' || config || ':' || structure_id || ':' || pos), 1, 13))::bigint, pos) as rank from g),
    rng as (select structure_id, orbit, state, sum(target) over w - target as low, sum(target) over w as high from tgt
            window w as (partition by structure_id, orbit order by target, state rows unbounded preceding))
    select r.structure_id, config, r.orbit, r.pos as "group", coalesce(state, 'VAC') as state from r left join rng on rng.structure_id = r.structure_id and rng.orbit = r.orbit and rank > low and rank <= high""", _SV)
def _(spark, sf):
    found = cut_lineage(disordered(spark, sf))   # read several times
    groups = found.select("structure_id", F.col("signature").alias("orbit"), F.col("pos").alias("group"))
    return D.random_decorations(groups, D.largest_remainder(states(spark, sf, found)), 3, seed=7)


@query("random_decorations_split", f"""with pts as (select structure_id // 5 as structure_id, element as orbit, atom from v_point),
    cnt as (select structure_id, orbit, count(*) as n from pts group by 1, 2),
    r as (select *, row_number() over (partition by structure_id, config, orbit order by ('0x' || substr(md5('1:' || config || ':' || structure_id || ':' || atom), 1, 13))::bigint, atom) as rank
          from pts cross join (select unnest(range(2)) as config))
    select structure_id, config, orbit, atom as "group", case when rank <= n // 2 then 'on' else 'VAC' end as state from r join cnt using (structure_id, orbit)""", ("v_point",))
def _(spark, sf):
    groups = V.point(spark, sf).select(F.floor(F.col("structure_id") / 5).alias("structure_id"), F.col("element").alias("orbit"), F.col("atom").alias("group"))
    half = groups.groupBy("structure_id", "orbit").agg(F.floor(F.count(F.lit(1)) / 2).alias("target")).withColumn("state", F.lit("on"))
    # orbits above 10 groups are ranked in slices, as a hot orbit would be
    return D.random_decorations(groups, half, 2, seed=1, rows_per_task=10)


def _fill_input(spark, sf):
    points = V.point(spark, sf)
    score = D.shuffle_score(3, F.lit(0), F.col("atom")).cast("long")
    groups = points.select("structure_id", F.when(F.col("element") == "O", 0).otherwise(1).alias("orbit_no"), F.col("atom").alias("group"), score.alias("rank"))
    targets = groups.groupBy("structure_id", "orbit_no").agg(F.ceil(F.count(F.lit(1)) * 0.6).alias("target"))
    return groups, contact_edges(spark, sf, 1.9), targets


_FILL = """with recursive g as (select structure_id, case when element = 'O' then 0 else 1 end as orbit_no, atom, ('0x' || substr(md5('3:0:' || atom), 1, 13))::bigint as rank from v_point),
    t as (select structure_id, orbit_no, ceil(count(*) * 0.6)::bigint as target from g group by 1, 2),
    o as (select g.*, target, row_number() over (partition by structure_id order by orbit_no, rank) as k from g join t using (structure_id, orbit_no)),
    nbr as (select structure_id, i as atom, list(j) as nb from v_pointpair where d < 1.9 group by 1, 2),
    walk as (select structure_id, 0::bigint as k, []::bigint[] as kept, null::bigint as atom, 0 as orbit_no, 0::bigint as placed, false as chosen from (select distinct structure_id from v_point)
             union all
             select structure_id, k, case when ok then list_append(kept, atom) else kept end, atom, orbit_no, before + case when ok then 1 else 0 end, ok from (
               select w.structure_id, o.k, w.kept, o.atom, o.orbit_no, case when o.orbit_no = w.orbit_no then w.placed else 0 end as before,
                      (case when o.orbit_no = w.orbit_no then w.placed else 0 end) < o.target and len(list_intersect(w.kept, coalesce(nb, []))) = 0 as ok
               from walk w join o on o.structure_id = w.structure_id and o.k = w.k + 1 left join nbr n on n.structure_id = o.structure_id and n.atom = o.atom))"""


@query("independent_fill", _FILL + """ select structure_id, atom as "group", orbit_no from walk where chosen""", ("v_pointpair",))
def _(spark, sf):
    return D.independent_fill(*_fill_input(spark, sf))


@query("short_fill", _FILL + """ select structure_id, sum(target - coalesce(placed, 0))::bigint as short_fill from t
       left join (select structure_id, orbit_no, count(*) as placed from walk where chosen group by 1, 2) using (structure_id, orbit_no) group by 1""", ("v_pointpair",))
def _(spark, sf):
    groups, edges, targets = _fill_input(spark, sf)
    return D.short_fill(D.independent_fill(groups, edges, targets), targets)


# ---- cells and groups ---------------------------------------------------------------------------

def _cells(spark, sf):
    k = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        k.alias("structure_id"), (F.col("o_custkey") % 9 + 3.0).alias("a"), (k % 5 + 4.5).alias("b"), F.lit(6.0).alias("c"), (k % 12 + 1).alias("n_atoms"))


_CELLS = """cell as (select o_orderkey as structure_id, o_custkey % 9 + 3.0::double as a, o_orderkey % 5 + 4.5::double as b, 6.0::double as c, o_orderkey % 12 + 1 as n_atoms from orders),
    m0 as (select *, ceil(15 / a)::int as m1, ceil(15 / b)::int as m2, ceil(15 / c)::int as m3 from cell),
    red as (select structure_id, n_atoms, a, b, c, m1, m2, m3, m1 as r1, m2 as r2, m3 as r3 from m0
            union all select structure_id, n_atoms, a, b, c, case when m1 >= m2 and m1 >= m3 then m1 - 1 else m1 end, case when m1 >= m2 and m1 >= m3 then m2 when m2 >= m3 then m2 - 1 else m2 end,
                   case when (m1 >= m2 and m1 >= m3) or m2 >= m3 then m3 else m3 - 1 end, r1, r2, r3 from red where n_atoms * m1 * m2 * m3 > 300 and greatest(m1, m2, m3) > 1),
    fin as (select * from red where n_atoms * m1 * m2 * m3 <= 300 or greatest(m1, m2, m3) = 1)"""


@query("supercell", f"""with recursive {_CELLS} select structure_id, r1 || 'x' || r2 || 'x' || r3 as requested, m1 || 'x' || m2 || 'x' || m3 as mult, n_atoms * m1 * m2 * m3 as n_sites,
       round(least(a * m1, b * m2, c * m3), 2) as edge, case when round(least(a * m1, b * m2, c * m3), 2) >= 15 then 'derived' else 'overridden' end as state from fin""")
def _(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "x")
    return D.supercell(_cells(spark, sf), 15.0, 300).withColumn("requested", text("requested")).withColumn("mult", text("mult"))


@query("supercell_sites", f"""with recursive {_CELLS} select p.structure_id, pos, count(*) as n, sum(u + 10 * v + 100 * w)::bigint as check_sum from v_psig p join fin on fin.structure_id = p.structure_id,
       unnest(range(m1)) t1(u), unnest(range(m2)) t2(v), unnest(range(m3)) t3(w) group by 1, 2""", ("v_psig",))
def _(spark, sf):
    mult = D.supercell(_cells(spark, sf), 15.0, 300)
    s = D.supercell_sites(sites(spark, sf).select("structure_id", "pos"), mult)
    return s.groupBy("structure_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("u + 10 * v + 100 * w")).cast("long").alias("check_sum"))


def _members(spark, sf):
    """Points with their exclusion group and the orbit of identical groups."""
    comp = cut_lineage(components(spark, sf))
    edges = cut_lineage(contact_edges(spark, sf))
    groups = G.exclusion_groups(comp, G.component_shapes(comp, edges))
    pts = V.point(spark, sf).select("structure_id", "atom", F.concat("element", F.lit(":"), F.col("occ").cast("string")).alias("signature"))
    return groups.join(pts, ["structure_id", "atom"]), edges


_GROUPS = """with recursive edges as (select structure_id, i, j from v_pointpair where d < 1.6),
  reach as (select structure_id, atom as node, atom as other from v_point
            union select r.structure_id, r.node, e.j from reach r join edges e on e.structure_id = r.structure_id and e.i = r.other),
  comp as (select structure_id, node as atom, min(other) as component from reach group by 1, 2),
  shp as (select c.structure_id, c.component, count(distinct c.atom) as n_nodes, count(e.i) as n_edges from comp c
          left join edges e on e.structure_id = c.structure_id and e.i = c.atom and e.i < e.j group by 1, 2),
  grp as (select structure_id, atom, case when n_nodes > 1 and n_edges <> n_nodes * (n_nodes - 1) / 2 then atom else component end as g,
                 n_nodes > 1 and n_edges <> n_nodes * (n_nodes - 1) / 2 as is_chain, element || ':' || occ::varchar as signature
          from comp join shp using (structure_id, component) join v_point using (structure_id, atom)),
  gs as (select structure_id, g, string_agg(signature, '+' order by signature) as orbit, count(*) as size from grp group by 1, 2)"""


@query("group_orbits", _GROUPS + " select structure_id, orbit, max(size) as members_per_group, count(*) as n_groups from gs group by 1, 2", ("v_pointpair",))
def _(spark, sf):
    m, _ = _members(spark, sf)
    return D.group_orbits(m.select("structure_id", "group", "signature"))


@query("orbit_exclusion_mode", _GROUPS + """, m as (select grp.structure_id, atom, orbit, size, is_chain from grp join gs on gs.structure_id = grp.structure_id and gs.g = grp.g),
   p as (select a.structure_id, a.orbit, count(*) as n_pairs from edges e join m a on a.structure_id = e.structure_id and a.atom = e.i and a.is_chain
         join m b on b.structure_id = e.structure_id and b.atom = e.j where e.i < e.j and a.orbit = b.orbit group by 1, 2)
   select structure_id, orbit, coalesce(n_pairs, 0) as n_pairs, case when k > 1 then 'clique-merged' when coalesce(n_pairs, 0) > 0 then 'pairwise' else 'none' end as mode
   from (select structure_id, orbit, max(size) as k from m group by 1, 2) left join p using (structure_id, orbit)""", ("v_pointpair",))
def _(spark, sf):
    m, edges = _members(spark, sf)
    orbit = m.groupBy("structure_id", "group").agg(F.array_join(F.sort_array(F.collect_list("signature")), "+").alias("orbit"))
    return D.orbit_exclusion_mode(m.join(orbit, ["structure_id", "group"]), edges)


# ---- labels that are no element -----------------------------------------------------------------

def _labelled(spark, sf):
    """Species in which calcium carries the truncated label L and zinc the label Q."""
    el = F.when(F.col("element") == "Ca", "L").when(F.col("element") == "Zn", "Q").otherwise(F.col("element"))
    return V.species(spark, sf).withColumn("element", el)


_LAB = """lab as (select structure_id, pos, case element when 'Ca' then 'L' when 'Zn' then 'Q' else element end as element, occ from v_species)"""


@query("element_candidates", f"""with {_LAB}, c as (select symbol, coalesce((select string_agg(e.symbol, ',' order by e.symbol) from el e where e.symbol <> x.symbol and starts_with(e.symbol, x.symbol)), '') as candidates
       from (select distinct element as symbol from lab) x) select l.element as symbol, candidates, count(*) as n_sites from lab l join c on c.symbol = l.element group by 1, 2""", ("v_species", "el"))
def _(spark, sf):
    lab = _labelled(spark, sf)
    cand = D.element_candidates(lab.select(F.col("element").alias("symbol")).distinct(), element_table(spark))
    return lab.withColumnRenamed("element", "symbol").join(cand, "symbol").groupBy("symbol", "candidates").agg(F.count(F.lit(1)).alias("n_sites"))


def _titles(spark, sf):
    k = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(k.alias("structure_id"), F.when(k % 3 == 0, "A vacancy-rich Garnet").when(k % 3 == 1, "Al-Doped oxide").otherwise("Plain oxide").alias("title"))


def _any_word(words):
    return " or ".join(f"contains(lower(text), '{w}')" for w in words)


@query("title_hint", f"select doc_id, case when {_any_word(VACANCY_WORDS)} then 'vacancy' when {_any_word(SUBSTITUTION_WORDS)} then 'element' end as leaning from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", D.title_hint(F.col("text")).alias("leaning"))


@query("dummy_species", f"""with {_LAB}, j as (select structure_id, pos, element, occ, ox_common from lab left join el on symbol = element),
    p as (select structure_id, string_agg(distinct element, ',' order by element) filter (ox_common is null) as symbols, count(*) filter (ox_common is null) as n_dummy_sites,
                 round(sum(case when ox_common is not null then occ * ox_common else 0 end), 2) as charge_vacancy, bool_or(element = 'L') as near_element from j group by 1)
    select structure_id, symbols, n_dummy_sites, charge_vacancy, near_element, case structure_id % 3 when 0 then 'vacancy' when 1 then 'element' end as leaning,
           case when structure_id % 3 = 0 or not near_element then 'vacancy' when structure_id % 3 = 1 then 'remap-to-element' else 'vacancy (ambiguous)' end as recommendation,
           not (structure_id % 3 = 0 or not near_element) as escalate from p where n_dummy_sites > 0""", ("v_species", "el"))
def _(spark, sf):
    return D.dummy_species(_labelled(spark, sf), element_table(spark), _titles(spark, sf))


@query("strip_dummies", f"""with {_LAB}, k as (select structure_id, pos, round(sum(occ) filter (element not in ('L', 'Q')), 3) as occ, count(*) filter (element not in ('L', 'Q')) as n_species, bool_or(element in ('L', 'Q')) as had
       from lab group by 1, 2) select structure_id, pos, occ, n_species, had and (n_species > 1 or occ < 0.99) as constitutional from k where n_species > 0""", ("v_species",))
def _(spark, sf):
    return D.strip_dummies(_labelled(spark, sf), element_table(spark))


@query("strip_isotope", "select element as el, count(*) as n from v_site group by 1", ("v_site",))
def _(spark, sf):
    label = F.concat(F.when((F.col("element") == "H") & (F.col("raised") == 1), "D").otherwise(F.col("element")), F.lit("2+"))
    return V.site(spark, sf).select(X.strip_isotope(label).alias("el")).groupBy("el").agg(F.count(F.lit(1)).alias("n"))
