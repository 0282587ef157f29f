"""Evidence tables of a whole corpus: positions, orbits, charge, composition, contacts, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ALTERNATE_CUT, CONFIDENT_STATES, CONTACT_CUT, FULL_SITE_OCC, LIGHT_LIGANDS,
                         ORIENT_CUT, ORIENT_OCC, PARTIAL_OCC, SLAVE_BOND, SLAVE_OCC_TOL, SLAVE_RANK)
from ..session import cut_lineage
from .pairs import both_ways, half_pairs, nearest_image


def wrap_fraction(x: Column) -> Column:
    """Fraction modulo one at four decimals; 0.99996 becomes 1.0 and stays apart from 0.0."""
    return F.bround(F.pmod(F.coalesce(x, F.lit(0.0)), F.lit(1.0)), 4)


def _term(element: Column, occ: Column) -> Column:
    return F.format_string("%s=%.3f", element, occ)


def merge_positions(rows: DataFrame) -> DataFrame:
    """Atom-site rows -> positions.

    Rows collapse to (element, occupancy) counts before they meet at a position, so the signature
    list is bounded by the distinct pairs, not by the rows.
    """
    at = [wrap_fraction(F.col(a)).alias(a) for a in "xyz"]
    terms = rows.select("structure_id", *at, "element", F.bround(F.coalesce("occ", F.lit(0.0)), 3).alias("occ3"),
                        F.coalesce("occ", F.lit(0.0)).alias("occ")).groupBy(
        "structure_id", "x", "y", "z", "element", "occ3").agg(
        F.count(F.lit(1)).alias("n"), F.sum("occ").alias("occ"))
    text = F.concat(_term(F.col("element"), F.col("occ3")), F.lit("*"), F.col("n").cast("string"))
    occ_sum = F.round(F.sum("occ"), 3)
    return terms.groupBy("structure_id", "x", "y", "z").agg(
        F.sum("n").alias("n_rows"), occ_sum.alias("occ_sum"),
        (F.size(F.collect_set("element")) > 1).alias("is_mixed"),
        (occ_sum < PARTIAL_OCC).alias("is_partial"),
        F.array_join(F.sort_array(F.collect_list(text)), ",").alias("signature"))


def orbit_counts(positions: DataFrame) -> DataFrame:
    """Disordered orbits: positions of equal signature, mixed or partial."""
    return positions.filter("is_mixed or is_partial").groupBy("structure_id", "signature").agg(
        F.count(F.lit(1)).alias("n_positions"), F.bool_or("is_mixed").alias("mixed"),
        F.bool_or("is_partial").alias("partial"))


def position_totals(positions: DataFrame) -> DataFrame:
    return positions.groupBy("structure_id").agg(
        F.count_if("is_partial").alias("n_partial"), F.count_if("is_mixed").alias("n_mixed"))


def site_signatures(species: DataFrame) -> DataFrame:
    """Occupancy per element -> one row per position with the signature of a parsed structure."""
    return species.groupBy("structure_id", "pos", "x", "y", "z").agg(
        F.sum("occ").alias("occ_total"), F.count(F.lit(1)).alias("n_species"),
        F.sort_array(F.collect_list(F.struct("element", F.bround("occ", 3).alias("occ")))).alias("species"),
        F.min(F.struct((-F.round("occ", 6)).alias("o"), "element")).getField("element").alias("major"),
    ).withColumn("signature", F.array_join(F.transform("species", lambda s: _term(s["element"], s["occ"])), ",")) \
        .withColumn("is_disordered", (F.col("n_species") > 1) | (F.col("occ_total") < FULL_SITE_OCC))


def orbit_index(sites: DataFrame) -> DataFrame:
    """All orbits of the parsed structure with their size, occupancy and species."""
    return sites.groupBy("structure_id", "signature").agg(
        F.count(F.lit(1)).alias("n_positions"), F.first("species").alias("species"),
        F.min("pos").alias("first_pos")).withColumn(
        "occ_total", F.aggregate("species", F.lit(0.0), lambda acc, s: acc + s["occ"]))


def nominal_charge(species: DataFrame, oxidation: DataFrame) -> DataFrame:
    """Sum of occupancy times mean oxidation; NULL as soon as one element is unknown."""
    joined = species.join(oxidation.select("structure_id", "element", "oxidation"), ["structure_id", "element"], "left")
    return joined.groupBy("structure_id").agg(
        F.when(F.count_if(F.col("oxidation").isNull()) == 0,
               F.round(F.sum(F.col("occ") * F.col("oxidation")), 3)).alias("nominal_charge"))


def oxidation_states(valence: DataFrame) -> DataFrame:
    """Declared oxidation numbers -> mean per element and the sorted list of distinct values."""
    return valence.groupBy("structure_id", "element").agg(
        F.sort_array(F.collect_set("oxidation")).alias("states")).select(
        "structure_id", "element", "states",
        (F.aggregate("states", F.lit(0.0), lambda a, v: a + v) / F.size("states")).alias("oxidation"))


def mixed_valence(states: DataFrame) -> DataFrame:
    return states.filter(F.size("states") > 1)


def located_amounts(species: DataFrame) -> DataFrame:
    return species.groupBy("structure_id", "element").agg(F.sum("occ").alias("located"))


def composition_check(formula: DataFrame, located: DataFrame) -> DataFrame:
    """Elements whose formula amount and located amount differ by more than 0.05."""
    both = formula.select("structure_id", "element", "expected").join(
        located.select("structure_id", "element", "located"), ["structure_id", "element"], "full")
    expected = F.round(F.coalesce("expected", F.lit(0.0)), 2)
    found = F.round(F.coalesce("located", F.lit(0.0)), 2)
    return both.select(
        "structure_id", "element", expected.alias("formula_expected"), found.alias("located"),
        F.round(expected - found, 2).alias("deficit"),
        ((found == 0) & (expected > 0)).alias("missing")).filter(F.abs(F.col("deficit")) > 0.05)


def formula_union(formula: DataFrame, located: DataFrame) -> DataFrame:
    keys = ["structure_id", "element"]
    return formula.select(*keys).union(located.select(*keys)).distinct()


def hydrogen_deficit(formula: DataFrame, species: DataFrame, sites: DataFrame) -> DataFrame:
    """Formula hydrogen scaled by an ordered reference element, minus the hydrogen present.

    The reference is the most frequent element that occurs on ordered positions only.
    """
    where = species.join(sites.select("structure_id", "pos", "is_disordered"), ["structure_id", "pos"])
    per_el = where.groupBy("structure_id", "element").agg(
        F.count(F.lit(1)).alias("n_sites"), F.bool_or("is_disordered").alias("any_disordered"))
    amounts = formula.select("structure_id", "element", F.col("expected").alias("amount"))
    ref = per_el.filter(~F.col("any_disordered")).join(amounts.filter("amount > 0"), ["structure_id", "element"])
    ref = ref.groupBy("structure_id").agg(
        F.max(F.struct("n_sites", "element", "amount")).alias("ref"))
    h = amounts.filter("element = 'H'").select("structure_id", F.col("amount").alias("formula_h"))
    present = sites.filter("major = 'H'").groupBy("structure_id").agg(F.count(F.lit(1)).alias("present_h"))
    declared = F.bround(F.col("formula_h") * F.col("ref.n_sites") / F.col("ref.amount")).cast("long")
    return (
        h.filter("formula_h > 0").join(ref, "structure_id", "left").join(present, "structure_id", "left")
        .select("structure_id", F.col("ref.element").alias("reference"), declared.alias("declared_h"),
                F.coalesce("present_h", F.lit(0)).alias("present_h"),
                (declared - F.coalesce("present_h", F.lit(0))).alias("deficit"))
    )


# ---- contacts and units -------------------------------------------------------------------------

def site_pairs(sites: DataFrame, lattice: DataFrame | None, cutoff: float, carry: tuple[str, ...]) -> DataFrame:
    return nearest_image(half_pairs(sites, lattice, cutoff, "pos", carry), carry)


def close_contacts(sites: DataFrame, lattice: DataFrame | None, cutoff: float = CONTACT_CUT) -> DataFrame:
    """Contacts between disordered positions of different orbits, counted by orbit pair and distance."""
    pairs = site_pairs(sites.filter("is_disordered"), lattice, cutoff, ("signature",))
    return (
        pairs.filter("signature_i <> signature_j")
        .groupBy("structure_id", F.least("signature_i", "signature_j").alias("orbit_a"),
                 F.greatest("signature_i", "signature_j").alias("orbit_b"), F.round("d", 2).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _rank(species: Column) -> Column:
    rank = F.lit(0)
    for element, value in SLAVE_RANK.items():
        rank = F.greatest(rank, F.when(F.exists(species, lambda s: s["element"] == element), value).otherwise(0))
    return rank


def slaved_orbits(sites: DataFrame, lattice: DataFrame | None) -> DataFrame:
    """Follower orbits whose atoms exist only where a partial parent orbit is occupied.

    Candidate orbit pairs come from the bonded positions, never from pairing orbits with orbits: a
    parent qualifies only when each of its positions has a follower in bond range. Parents have a partial
    species and followers none else, so only positions with a partial species are paired.
    """
    low, high = SLAVE_BOND
    partial = sites.filter(F.exists("species", lambda s: s["occ"] < FULL_SITE_OCC))
    # the closed upper end of the bond range needs a cutoff just above it
    pairs = both_ways(site_pairs(partial, lattice, high * 1.001, ("signature",)), ("signature",)).filter(
        F.col("d").between(low, high) & (F.col("signature_i") != F.col("signature_j")))
    matched = pairs.groupBy("structure_id", F.col("signature_i").alias("parent"),
                            F.col("signature_j").alias("follower")).agg(F.count_distinct("i").alias("n_matched"))
    orbits = orbit_index(sites)
    p = orbits.select("structure_id", F.col("signature").alias("parent"), F.col("n_positions").alias("n_parent"),
                      F.col("species").alias("p_species"), F.col("first_pos").alias("p_first"))
    f = orbits.filter(F.col("occ_total") < FULL_SITE_OCC).select(
        "structure_id", F.col("signature").alias("follower"), F.col("n_positions").alias("n_follower"),
        F.col("species").alias("f_species"), F.col("occ_total").alias("f_occ"))
    joined = matched.join(p, ["structure_id", "parent"]).join(f, ["structure_id", "follower"])
    trigger = F.get(F.filter("p_species", lambda s: (F.abs(s["occ"] - F.col("f_occ")) < SLAVE_OCC_TOL)
                             & (s["occ"] < FULL_SITE_OCC)), F.lit(0))
    hit = (
        joined.withColumn("trigger", trigger)
        .filter(F.col("trigger").isNotNull() & (F.col("n_matched") == F.col("n_parent"))
                & (_rank(F.col("f_species")) > _rank(F.col("p_species"))))
    )
    per_parent = F.greatest(F.lit(1), F.bround(
        F.col("n_follower") * F.col("f_occ") / (F.col("n_parent") * F.col("trigger.occ"))).cast("int"))
    major = F.array_min(F.transform("f_species", lambda s: F.struct((-s["occ"]).alias("o"), s["element"].alias("e"))))["e"]
    out = F.struct("p_first", "parent", F.col("trigger.element").alias("trigger"), "n_parent",
                   per_parent.alias("followers_per_parent"), major.alias("follower_element"))
    return hit.groupBy("structure_id", "follower").agg(F.min(out).alias("o")).select(
        "structure_id", "follower", "o.parent", "o.trigger", F.col("o.n_parent").alias("n_parent_positions"),
        "o.followers_per_parent", "o.follower_element")


def rigid_shells(sites: DataFrame, lattice: DataFrame | None) -> DataFrame:
    """Centres with more partial light ligand positions than atoms, some of them alternates."""
    carry = ("major", "occ_total")
    pairs = both_ways(site_pairs(sites, lattice, CONTACT_CUT, carry), carry)
    light = F.col("major_j").isin(*LIGHT_LIGANDS) & (F.col("occ_total_j") < PARTIAL_OCC)
    shell = pairs.filter(light).select(
        "structure_id", F.col("i").alias("c"), F.col("major_i").alias("centre"), F.col("j").alias("a"),
        F.col("major_j").alias("ligand"), F.col("occ_total_j").alias("occ"))
    # a shell is bounded by geometry: positions within the contact cut of one centre
    close = pairs.filter((F.col("d") < ALTERNATE_CUT) & (F.col("i") < F.col("j")) & (F.col("major_i") == F.col("major_j"))) \
        .select("structure_id", F.col("i").alias("a"), F.col("j").alias("b"))
    alt = (
        shell.select("structure_id", "c", "a").join(close, ["structure_id", "a"])
        .join(shell.select("structure_id", "c", F.col("a").alias("b")), ["structure_id", "c", "b"], "left_semi")
        .groupBy("structure_id", "c").agg(F.count(F.lit(1)).alias("n_alt_pairs"))
    )
    found = (
        shell.groupBy("structure_id", "c", "centre").agg(
            F.count(F.lit(1)).alias("n_ligand_sites"), F.sum("occ").alias("occ_sum"),
            F.array_join(F.sort_array(F.collect_set("ligand")), "+").alias("ligand_elements"))
        .filter((F.col("n_ligand_sites") >= 2) & (F.col("n_ligand_sites") - F.col("occ_sum") >= 0.8 - 1e-9))
        .join(alt, ["structure_id", "c"])
    )
    return found.withColumn("occ_sum", F.round("occ_sum", 2)).groupBy(
        "structure_id", "centre", "ligand_elements", "n_ligand_sites", "occ_sum", "n_alt_pairs").agg(
        F.count(F.lit(1)).alias("n_centres")).withColumn("est_coordination", F.bround("occ_sum").cast("int"))


def orientation_orbits(sites: DataFrame, lattice: DataFrame | None, slaved: DataFrame) -> DataFrame:
    """Partial single-element orbits that split into discrete alternatives around full anchors."""
    orbits = orbit_index(sites)
    low, high = ORIENT_OCC
    taken = slaved.select("structure_id", F.col("follower").alias("signature")).union(
        slaved.select("structure_id", "parent")).distinct()
    part = orbits.filter((F.size("species") == 1) & (F.col("occ_total") < FULL_SITE_OCC)
                         & F.col("occ_total").between(low, high)).join(
        taken, ["structure_id", "signature"], "left_anti").select(
        "structure_id", "signature", F.col("species")[0]["element"].alias("element"), "occ_total", "n_positions")
    anchors = sites.filter((F.col("n_species") == 1) & (F.col("occ_total") >= FULL_SITE_OCC)).groupBy(
        "structure_id", F.col("major").alias("element")).agg(F.count(F.lit(1)).alias("n_anchors"))
    # anchors and alternatives hold one element each, the alternatives of an anchor the same
    carry = ("signature", "major", "occ_total")
    occ = F.col("species")[0]["occ"]
    apart = sites.filter((F.col("n_species") == 1) & ((F.col("occ_total") >= FULL_SITE_OCC) | (occ < FULL_SITE_OCC) & occ.between(low, high)))
    pairs = cut_lineage(both_ways(site_pairs(apart, lattice, ORIENT_CUT, carry), carry).filter("major_i = major_j").drop("d"))
    near = pairs.filter("signature_i = signature_j").groupBy("structure_id", F.col("i").alias("pos")).agg(
        F.collect_list("j").alias("near"))
    claims = (
        pairs.filter(F.col("occ_total_i") >= FULL_SITE_OCC)
        .select("structure_id", F.col("i").alias("anchor"), F.col("j").alias("pos"), F.col("signature_j").alias("signature"))
        .join(part.select("structure_id", "signature", "occ_total"), ["structure_id", "signature"])
        .join(near, ["structure_id", "pos"], "left")
    )
    # candidates of one anchor: bounded by the positions that fit within the orientation cut
    per_anchor = claims.groupBy("structure_id", "signature", "anchor", "occ_total").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("near", F.array().cast("array<int>")).alias("near")))).alias("cand"))
    k = F.bround(F.col("occ_total") * F.size("cand")).cast("int")

    def grow(start):
        seed = F.struct(F.array(start["pos"]).alias("sub"))
        grown = F.aggregate("cand", seed, lambda s, q: F.when(
            (F.size(s["sub"]) < F.col("k")) & ~F.array_contains(s["sub"], q["pos"])
            & F.forall(s["sub"], lambda p: F.array_contains(q["near"], p)),
            F.struct(F.concat(s["sub"], F.array(q["pos"])).alias("sub"))).otherwise(s))
        return F.sort_array(grown["sub"])

    options = F.size(F.array_distinct(F.filter(F.transform("cand", grow), lambda s: F.size(s) == F.col("k"))))
    judged = per_anchor.withColumn("k", k).withColumn("n_options", options)
    ok = (F.col("k") > 0) & (F.col("k") < F.size("cand")) & (F.col("n_options") >= 2)
    rolled = judged.groupBy("structure_id", "signature").agg(
        F.count(F.lit(1)).alias("n_claiming"), F.bool_and(ok).alias("all_ok"),
        F.min(F.struct("anchor", "k")).getField("k").alias("positions_per_anchor"),
        F.min("n_options").alias("alternatives_per_anchor"))
    cover = claims.groupBy("structure_id", "signature").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct("pos").alias("n_claimed"))
    return (
        part.join(anchors, ["structure_id", "element"])
        .join(rolled, ["structure_id", "signature"]).join(cover, ["structure_id", "signature"])
        .filter(F.col("all_ok") & (F.col("n_claiming") == F.col("n_anchors"))
                & (F.col("n_claims") == F.col("n_claimed")) & (F.col("n_claimed") == F.col("n_positions")))
        .select("structure_id", "signature", "element", F.round("occ_total", 3).alias("occupancy"), "n_anchors",
                "positions_per_anchor", "alternatives_per_anchor")
    )


# ---- provenance ---------------------------------------------------------------------------------

def provenance(state: Column, detail: Column, evidence: Column | None = None,
               source: Column | None = None) -> Column:
    """State, derived confidence, detail, evidence and source of one derived value."""
    none = F.lit(None).cast("string")
    return F.struct(
        state.alias("state"), state.isin(*CONFIDENT_STATES).alias("confident"), detail.alias("detail"),
        (evidence if evidence is not None else F.create_map().cast("map<string,string>")).alias("evidence"),
        (source if source is not None else none).alias("source"))


def provenance_rollup(blocks: DataFrame) -> DataFrame:
    """(structure_id, name, state) -> how many derived values are not confident, and which.

    Names are a fixed set of parameters (one more per element), so the lists stay short.
    """
    named = blocks.withColumn("confident", F.col("state").isin(*CONFIDENT_STATES))
    return named.groupBy("structure_id").agg(
        F.count_if(~F.col("confident")).alias("n_unconfident"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("confident"), F.col("name")))), ",").alias("unconfident"),
        F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit(":"), "state"))), ",").alias("states"))
