"""Named queries over convex hulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import element_table
from ..operators import hull as H
from ..session import cut_lineage
from . import views as V
from .registry import query

_P = ("v_phase",)


def phases(spark, sf):
    return H.phase_columns(V.phase(spark, sf), element_table(spark))


_CAND = """best as (select * from v_phase qualify row_number() over (partition by formula order by coalesce(ehull, 9.0), material_id) = 1),
    tgt as (select distinct chemsys as target_chemsys, elements as tel from v_phase),
    inside as (select t.target_chemsys, b.*, coalesce(ehull, 9.0) as er from tgt t join best b on list_has_all(t.tel, b.elements)),
    cand as (select *, case when er <= 0.12 then 'near' else 'endpoint' end as role, false as skipped from (
        select *, case when len(elements) = 1 then row_number() over (partition by target_chemsys, chemsys order by er, formula, material_id) end as rk from inside)
        where er <= 0.12 or rk = 1),
    cov as (select t.target_chemsys, list_sort(list_filter(t.tel, lambda e: not list_contains(coalesce(c.covered, []), e))) as missing, coalesce(n_refs, 0) as n_refs, len(t.tel) as n_el
            from tgt t left join (select target_chemsys, list_distinct(flatten(list(elements))) as covered, count(distinct material_id) as n_refs from cand where not skipped group by 1) c using (target_chemsys)),
    st as (select target_chemsys, missing, n_refs, case when len(missing) > 0 or n_refs < n_el then 'ambiguous' else 'derived' end as state from cov)"""


@query("scan_phases", "select material_id, chemsys, formula, energy, ehull, round(fracs[1], 6) as first_fraction from v_phase", _P)
def _(spark, sf):
    return phases(spark, sf).select("material_id", "chemsys", "formula", "energy", "ehull", F.round(F.col("fractions")[0], 6).alias("first_fraction"))


@query("powerset", """select material_id, len(elements)::int as n_elements, (2 ** len(elements) - 1)::int as n_subsets, chemsys as largest from v_phase""", _P)
def _(spark, sf):
    p = phases(spark, sf).withColumn("subs", H.powerset(F.col("elements")))
    return p.select("material_id", F.size("elements").alias("n_elements"), F.size("subs").alias("n_subsets"), F.element_at("subs", -1).alias("largest"))


@query("best_per_formula", """select formula, material_id, coalesce(ehull, 9.0) as ehull_rank from v_phase
       qualify row_number() over (partition by formula order by coalesce(ehull, 9.0), material_id) = 1""", _P)
def _(spark, sf):
    return H.best_per_formula(phases(spark, sf))


def _candidates(spark, sf):
    p = cut_lineage(phases(spark, sf))
    return p, H.hull_candidates(p.select("chemsys").distinct(), p)


@query("hull_candidates", f"with {_CAND} select target_chemsys, material_id, formula, role, skipped from cand", _P)
def _(spark, sf):
    return _candidates(spark, sf)[1]


@query("hull_coverage", f"with {_CAND} select target_chemsys, array_to_string(missing, ',') as missing, n_refs, state from st", _P)
def _(spark, sf):
    p, c = _candidates(spark, sf)
    return H.hull_coverage(p.select("chemsys"), c, p)


@query("missing_elements", f"with {_CAND} select target_chemsys, array_to_string(missing, ',') as missing from st where len(missing) > 0", _P)
def _(spark, sf):
    p, c = _candidates(spark, sf)
    return H.hull_coverage(p.select("chemsys"), c, p).filter("missing <> ''").select("target_chemsys", "missing")


@query("hull_entry_scale", """select material_id, round(energy, 6) as raw, round(case when ehull is not null then energy - ehull end, 6) as corrected, ehull is not null as on_scale from v_phase""", _P)
def _(spark, sf):
    p = phases(spark, sf).withColumn("fixed", F.col("energy") - F.col("ehull"))
    raw, fixed = F.col("energy"), F.col("fixed")
    corrected = H.entry_energy("corrected", raw, fixed)
    return p.select("material_id", F.round(H.entry_energy("none", raw, fixed), 6).alias("raw"), F.round(corrected, 6).alias("corrected"),
                    corrected.isNotNull().alias("on_scale"))


@query("hull_states", f"""with {_CAND} select material_id, case when material_id % 23 = 0 then 'not_run' when material_id % 29 = 0 then 'not_run' when len(elements) > 3 then 'not_run'
       when state <> 'derived' then 'ambiguous' when material_id % 31 = 0 then 'ambiguous' else 'derived' end as state from v_phase join st on target_chemsys = chemsys""", _P)
def _(spark, sf):
    p, c = _candidates(spark, sf)
    cov = H.hull_coverage(p.select("chemsys"), c, p).select(F.col("target_chemsys").alias("chemsys"), F.col("state").alias("coverage"))
    m = F.col("material_id")
    return p.hint("merge").join(cov, "chemsys").select("material_id", H.hull_states(m % 23 == 0, m % 29 != 0, F.size("elements"), F.col("coverage"), m % 31 != 0).alias("state"))


# shares from barycentric coordinates; one- and two-component mixtures are their edges and corners
_HULL = f"""with {_CAND},
    ref as (select c.target_chemsys, formula, energy, t.tel, list_transform(t.tel, lambda e: coalesce(fracs[list_position(elements, e)], 0.0)) as f
            from cand c join tgt t using (target_chemsys) where not skipped),
    ground as (select target_chemsys, k, min(energy) as g from (select target_chemsys, energy, unnest(range(1, len(f) + 1)) as k, f from ref) where f[k] > 1 - 1e-12 group by 1, 2),
    has as (select material_id, coalesce(n_ground, 0) = len(elements) as whole, target_chemsys is not null as any_ref
            from v_phase left join (select target_chemsys, count(distinct k) filter (g is not null) as n_ground from ref left join ground using (target_chemsys) group by 1) on target_chemsys = chemsys),
    tg as (select material_id, chemsys, fracs as x, energy, len(elements) as n from v_phase join has using (material_id) where whole),
    form as (select material_id, any_value(energy) - sum(x[ground.k] * g) as formation from tg join ground on target_chemsys = chemsys group by 1),
    one as (select material_id, r.energy as e, [formula] as fs, [1.0::double] as ws from tg join ref r on target_chemsys = chemsys where n = 1),
    two as (select material_id, [a.formula, b.formula] as fs, [a.energy, b.energy] as es, (x[2] - b.f[2]) / (a.f[2] - b.f[2]) as wa
            from tg join ref a on a.target_chemsys = chemsys join ref b on b.target_chemsys = chemsys where n = 2 and a.formula < b.formula and abs(a.f[2] - b.f[2]) > 1e-12),
    tri as (select material_id, a.formula as fa, b.formula as fb, c.formula as fc, a.energy as ea, b.energy as eb, c.energy as ec,
                   (b.f[2] - c.f[2]) * (a.f[1] - c.f[1]) + (c.f[1] - b.f[1]) * (a.f[2] - c.f[2]) as det,
                   (b.f[2] - c.f[2]) * (x[1] - c.f[1]) + (c.f[1] - b.f[1]) * (x[2] - c.f[2]) as na,
                   (c.f[2] - a.f[2]) * (x[1] - c.f[1]) + (a.f[1] - c.f[1]) * (x[2] - c.f[2]) as nb
            from tg join ref a on a.target_chemsys = chemsys join ref b on b.target_chemsys = chemsys and a.formula < b.formula
                 join ref c on c.target_chemsys = chemsys and b.formula < c.formula where n = 3),
    mixed as (select material_id, e, fs, ws from one
        union all select material_id, wa * es[1] + (1 - wa) * es[2], fs, [wa, 1 - wa] from two where wa between -1e-9 and 1 + 1e-9
        union all select material_id, na / det * ea + nb / det * eb + (1 - na / det - nb / det) * ec, [fa, fb, fc], [na / det, nb / det, 1 - na / det - nb / det] from tri
              where abs(det) > 1e-12 and na / det >= -1e-9 and nb / det >= -1e-9 and na / det + nb / det <= 1 + 1e-9),
    named as (select material_id, e, list_filter(list_zip(fs, ws), lambda p: p[2] > 1e-9) as parts from mixed),
    low as (select material_id, e, array_to_string(list_transform(parts, lambda p: p[1] || '=' || printf('%.3f', floor(p[2] * 1000 + 0.5 + 1e-6) / 1000)), ',') as decomposition
            from named qualify row_number() over (partition by material_id order by round(e, 9), len(parts), list_transform(parts, lambda p: p[1])) = 1),
    result as (select material_id as target_id, chemsys, round(tg.energy - e, 6) as e_above_hull, round(formation, 6) as formation_e, abs(tg.energy - e) < 0.001 as on_hull, decomposition, null::varchar as reason
            from tg join low using (material_id) join form using (material_id)
        union all select material_id, chemsys, null, null, null, null, case when any_ref then 'no elemental endpoint' else 'no references' end from v_phase join has using (material_id) where not whole)"""


def _hull(spark, sf, target, shift=0.0):
    p, c = _candidates(spark, sf)
    targets = p.select(target.alias("target_id"), "chemsys", "fractions", "energy")
    refs = H.aligned_references(c, p).withColumn("energy", F.col("energy") + shift)
    return H.energy_above_hull(targets, refs, digits=6)


@query("energy_above_hull", _HULL + " select * exclude (chemsys) from result", _P)
def _(spark, sf):
    return _hull(spark, sf, F.col("material_id"))


@query("injected_references", _HULL + " select chemsys, count(e_above_hull) as n_targets, round(sum(e_above_hull + 0.1), 4) as above from result group by 1", _P)
def _(spark, sf):
    """Caller-supplied references in place of the selected ones: any table of the same columns."""
    solved = _hull(spark, sf, F.struct("material_id", "chemsys"), -0.1)
    return solved.groupBy(F.col("target_id.chemsys").alias("chemsys")).agg(
        F.count("e_above_hull").alias("n_targets"), F.round(F.sum("e_above_hull"), 4).alias("above"))
