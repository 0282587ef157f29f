"""Convex-hull stability for many targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HULL_REF_TOL, ON_HULL_TOL
from ..session import cut_lineage
from .catalogue import chemistry_columns

MAX_COMPONENTS = 3


def phase_columns(terms: DataFrame, elements: DataFrame) -> DataFrame:
    """(material_id, terms array) -> chemical system, reduced formula and element fractions."""
    amounts = terms.select("material_id", F.explode("terms").alias("t")).groupBy("material_id", "t.element").agg(F.sum("t.n").alias("n"))
    chem = chemistry_columns(amounts.withColumnRenamed("material_id", "structure_id").withColumn("min_occ", F.lit(1.0)), elements)
    total = F.sum("n")
    fractions = amounts.groupBy("material_id").agg(
        F.sort_array(F.collect_list(F.struct("element", "n"))).alias("a"), total.alias("total")).select(
        "material_id", F.transform("a", lambda t: t["n"] / F.col("total")).alias("fractions"))
    # one row a phase on every side: packed files of them look small enough to broadcast long before they are
    rest = terms.drop("terms").hint("merge")
    return (chem.select(F.col("structure_id").alias("material_id"), "chemsys", "elements", F.col("reduced_formula").alias("formula"))
            .join(fractions.hint("merge"), "material_id").join(rest, "material_id"))


def powerset(elements: Column) -> Column:
    """Every non-empty subset of a sorted element array, as ``-`` joined systems."""
    masks = F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2), F.size(elements)) - 1).cast("long"))
    return F.transform(masks, lambda m: F.array_join(
        F.filter(elements, lambda e, i: F.call_function("getbit", m, i.cast("int")) == 1), "-"))


def best_per_formula(phases: DataFrame) -> DataFrame:
    """Phase with the lowest energy above hull per formula; an unknown one counts as 9.0."""
    return _best(phases).select("formula", "material_id", "ehull_rank")


def _best(phases: DataFrame, *more: str) -> DataFrame:
    """The rows of ``best_per_formula`` with ``more`` of their columns."""
    rank = F.struct(F.coalesce("ehull", F.lit(9.0)).alias("ehull_rank"), "material_id", *more)
    return phases.groupBy("formula").agg(F.min(rank).alias("r")).select("formula", "r.*")


def hull_candidates(targets: DataFrame, phases: DataFrame, tol: float = HULL_REF_TOL,
                    max_atoms: int | None = None) -> DataFrame:
    """Reference phases of each target system: (target_chemsys, material_id, formula, role, skipped).

    Near-stable best phases over every sub-system, plus one elemental endpoint per element even when
    it is not near-stable. Cells above ``max_atoms``, if one is given, stay listed as skipped.
    """
    best = _best(phases, "chemsys", "n_cell_atoms", "elements")
    subs = targets.select(F.col("chemsys").alias("target_chemsys"), F.explode(powerset(F.split("chemsys", "-"))).alias("chemsys"))
    inside = subs.join(best, "chemsys")
    single = inside.filter(F.size("elements") == 1)
    endpoint = single.groupBy("target_chemsys", "chemsys").agg(F.min(F.struct("ehull_rank", "formula", "material_id")).alias("e")).select(
        "target_chemsys", F.col("e.material_id").alias("material_id"), F.lit(True).alias("is_endpoint"))
    joined = inside.join(endpoint, ["target_chemsys", "material_id"], "left")
    near = F.col("ehull_rank") <= tol
    return joined.filter(near | F.col("is_endpoint")).select(
        "target_chemsys", "material_id", "formula", F.when(near, "near").otherwise("endpoint").alias("role"),
        (F.col("n_cell_atoms") > max_atoms if max_atoms else F.lit(False)).alias("skipped"))


def hull_coverage(targets: DataFrame, candidates: DataFrame, phases: DataFrame) -> DataFrame:
    """Which elements of a target system no usable reference covers, and the state that follows."""
    used = candidates.filter("not skipped").join(phases.select("material_id", "elements").hint("merge"), "material_id")
    covered = used.select("target_chemsys", "material_id", F.explode("elements").alias("element")).groupBy("target_chemsys").agg(
        F.collect_set("element").alias("covered"), F.count_distinct("material_id").alias("n_refs"))
    t = targets.select(F.col("chemsys").alias("target_chemsys")).distinct().join(covered, "target_chemsys", "left")
    needed = F.split("target_chemsys", "-")
    missing = F.sort_array(F.array_except(needed, F.coalesce("covered", F.array().cast("array<string>"))))
    n_refs = F.coalesce("n_refs", F.lit(0))
    return t.select(
        "target_chemsys", F.array_join(missing, ",").alias("missing"), n_refs.alias("n_refs"),
        F.when((F.size(missing) > 0) | (n_refs < F.size(needed)), "ambiguous").otherwise("derived").alias("state"))


def entry_energy(scale: str, raw: Column, corrected: Column) -> Column:
    """One scale for every entry; a missing corrected energy is NULL, never silently raw."""
    return corrected if scale == "corrected" else raw


def hull_states(is_disordered: Column, converged: Column, n_components: Column, coverage: Column, on_scale: Column) -> Column:
    """State of each target before any hull is computed."""
    return (F.when(is_disordered, "not_run").when(~converged, "not_run").when(n_components > MAX_COMPONENTS, "not_run")
            .when(coverage != "derived", "ambiguous").when(~on_scale, "ambiguous").otherwise("derived"))


#: references of a system that one task turns into facets at once; larger systems are thinned first
FACET_REFERENCES = 4000
#: eV below a facet from which a reference is a vertex, and the share below which a phase is not named
DEPTH, LEAST_SHARE = 1e-10, 1e-9


def _lower_facets(fractions, energies):
    """Facets of the lower hull as rows of reference numbers, by adding one reference after the other.

    The first facet has the lowest elemental endpoint of each component and covers every composition. A
    reference below some facets replaces them: it joins the ridges that bound them. One that lies on or above
    all facets is no vertex. There is no limit of rounds: each reference is looked at once.
    """
    import numpy as np

    n = fractions.shape[1]
    pure = [np.flatnonzero(fractions[:, k] > 1 - 1e-12) for k in range(n)]
    facets = np.array([[p[np.argmin(energies[p])] for p in pure]])
    ground = energies[facets[0]]
    formation = energies - fractions @ ground
    planes = np.linalg.solve(fractions[facets], energies[facets][..., None])[..., 0]
    for ref in np.argsort(formation, kind="stable"):
        seen = planes @ fractions[ref] - energies[ref] > DEPTH
        if not seen.any():
            continue
        ridges = np.concatenate([np.delete(np.sort(facets[seen], axis=1), k, axis=1) for k in range(n)])
        once, times = np.unique(ridges, axis=0, return_counts=True)
        outer = once[times == 1]
        fresh = np.concatenate([outer, np.full((len(outer), 1), ref)], axis=1)
        fresh = fresh[np.abs(np.linalg.det(fractions[fresh])) > 1e-12]   # a ridge that the reference lies on stays an edge
        facets = np.concatenate([facets[~seen], fresh])
        planes = np.concatenate([planes[~seen], np.linalg.solve(fractions[fresh], energies[fresh][..., None])[..., 0]])
    return facets


def _complete(references: DataFrame) -> DataFrame:
    """The references of systems that have an elemental endpoint for each element, the lowest of each composition."""
    size = F.size("fractions")
    pure = F.array_position(F.transform("fractions", lambda x: x > 1 - 1e-12), True)
    has = references.groupBy("target_chemsys").agg(F.max(size).alias("n"), F.count_distinct(F.when(pure > 0, pure)).alias("ends"))
    whole = references.join(has.filter("ends = n").select("target_chemsys"), "target_chemsys", "left_semi")
    low = F.min(F.struct("energy", "formula")).alias("m")
    return whole.filter(F.col("energy").isNotNull()).groupBy("target_chemsys", "fractions").agg(low).select(
        "target_chemsys", F.col("m.formula").alias("formula"), "fractions", F.col("m.energy").alias("energy"))


def hull_facets(references: DataFrame) -> DataFrame:
    """Lower hull of each system: (target_chemsys, formulas, energies, inverse), one row per facet.

    ``references``: target_chemsys, formula, fractions (in the system's element order), energy; any number of
    components. ``inverse`` times a composition gives the shares of the facet's phases. Systems without an
    elemental endpoint for each element have no facets. A system with more references than one task should
    hold is thinned first: a vertex of the whole hull is one of any part of it that has the endpoints, so
    parts drop what is none.
    """
    refs = cut_lineage(_complete(references))
    sizes = refs.groupBy("target_chemsys").agg(F.count(F.lit(1)).alias("n_refs")).filter(F.col("n_refs") > FACET_REFERENCES)
    sizes = cut_lineage(sizes)
    columns = ["target_chemsys", "formula", "fractions", "energy"]

    def arrays(rows):
        import numpy as np

        rows = rows.sort_values("formula", kind="stable")
        return rows, np.array(rows["fractions"].tolist(), float), rows["energy"].to_numpy(float)

    def thin(rows):
        import numpy as np

        rows, fractions, energies = arrays(rows)
        return rows.iloc[np.unique(_lower_facets(fractions, energies))][columns]

    if not sizes.isEmpty():
        large = refs.join(sizes, "target_chemsys")
        parts = F.ceil(F.col("n_refs") / FACET_REFERENCES).cast("int")
        end = F.array_max("fractions") > 1 - 1e-12   # endpoints, one of each element, belong to every part
        dealt = large.withColumn("part", F.explode(F.when(end, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("formula"), parts).cast("int")))))
        thinned = dealt.groupBy("target_chemsys", "part").applyInPandas(lambda rows: thin(rows), refs.schema).distinct()
        refs = refs.join(sizes, "target_chemsys", "left_anti").unionByName(thinned)

    def facets(rows):
        import numpy as np
        import pandas as pd

        rows, fractions, energies = arrays(rows)
        names, system = rows["formula"].to_numpy(), rows["target_chemsys"].iat[0]
        found = np.sort(_lower_facets(fractions, energies), axis=1)
        inverse = np.linalg.inv(np.swapaxes(fractions[found], 1, 2))
        return pd.DataFrame({"target_chemsys": system, "formulas": [names[f].tolist() for f in found],
                             "energies": [energies[f].tolist() for f in found], "inverse": inverse.tolist()})

    schema = "target_chemsys string, formulas array<string>, energies array<double>, inverse array<array<double>>"
    return refs.groupBy("target_chemsys").applyInPandas(lambda rows: facets(rows), schema)


def energy_above_hull(targets: DataFrame, references: DataFrame, digits: int = 4) -> DataFrame:
    """Energy above the lower hull, formation energy and decomposition of each target, with the reason where
    there is none.

    ``targets``: target_id, chemsys, fractions, energy; ``references``: target_chemsys, formula,
    fractions (in the target's element order), energy. The hull of a system is computed once and meets each
    distinct composition once: the facet that holds it is the one whose shares are not negative. A target
    below the hull has a negative energy above it. ``reason`` is ``no references``, ``no elemental endpoint``
    or ``no energy`` where a target has no result, else NULL.
    """
    facets = cut_lineage(hull_facets(references)).withColumnRenamed("target_chemsys", "chemsys")
    asked = targets.select("chemsys", "fractions").distinct()
    share = F.transform("inverse", lambda line: F.aggregate(F.zip_with(line, F.col("fractions"), lambda a, x: a * x), F.lit(0.0), lambda s, v: s + v))
    met = asked.join(facets, "chemsys").withColumn("shares", share).filter(F.array_min("shares") >= -LEAST_SHARE)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    text = F.array_join(F.transform(F.filter(F.arrays_zip("formulas", "shares"), lambda p: p["shares"] > LEAST_SHARE), lambda p: F.format_string(
        "%s=%.3f", p["formulas"], F.floor(p["shares"] * 1000 + (0.5 + 1e-6)) / 1000)), ",")
    # a composition on a common ridge lies in several facets; all give the same phases
    held = met.groupBy("chemsys", "fractions").agg(F.min(F.struct(
        F.round(-F.array_min("shares"), 9).alias("outside"), "formulas", dot(F.col("shares"), F.col("energies")).alias("hull"), text.alias("decomposition"))).alias("h"))
    pure = references.select(F.col("target_chemsys").alias("chemsys"), F.posexplode("fractions").alias("k", "share"), "energy").filter(F.col("share") > 1 - 1e-12)
    ground = pure.groupBy("chemsys", "k").agg(F.min("energy").alias("energy")).groupBy("chemsys").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "energy"))).alias("ground"))
    of = F.aggregate(F.transform("fractions", lambda x, k: x * F.try_element_at("ground", k)), F.lit(0.0), lambda s, v: s + v)
    any_ = references.select(F.col("target_chemsys").alias("chemsys")).distinct().withColumn("_any", F.lit(True))
    joined = targets.join(held, ["chemsys", "fractions"], "left").join(ground, "chemsys", "left").join(any_, "chemsys", "left")
    above = F.when(F.col("h.hull").isNotNull(), F.col("energy") - F.col("h.hull"))
    return joined.select(
        "target_id", F.round(above, digits).alias("e_above_hull"), F.round(F.when(above.isNotNull(), F.col("energy") - of), digits).alias("formation_e"),
        (F.abs(above) < ON_HULL_TOL).alias("on_hull"), F.col("h.decomposition").alias("decomposition"),
        F.when(F.col("_any").isNull(), "no references").when(F.col("h").isNull(), "no elemental endpoint")
        .when(F.col("energy").isNull(), "no energy").alias("reason"))


def aligned_references(candidates: DataFrame, phases: DataFrame) -> DataFrame:
    """References with their fractions in the element order of the target system."""
    usable = candidates.filter("not skipped").join(
        phases.select("material_id", "elements", "fractions", "energy").hint("merge"), "material_id")
    aligned = F.transform(F.split("target_chemsys", "-"), lambda e: F.coalesce(
        F.try_element_at(F.map_from_arrays("elements", "fractions"), e), F.lit(0.0)))
    return usable.select("target_chemsys", "formula", aligned.alias("fractions"), "energy")
