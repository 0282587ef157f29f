"""Coordination of centres and ligands over a bond table.

``bonds`` is the directed output of ``pairs.bonds``: structure_id, i, j, element_i, element_j,
radius_i, radius_j, d. Lists collected per atom are bounded by how many bonds one atom can have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import (ANIONS, BV_MIN_DEFICIT, BV_NEIGHBOUR_CUT, CLASH_FACTOR, COUPLE_DEFAULT_CUT,
                         DUPLICATE_FLOOR, FORMERS, LIGANDS, PROTON_ACCEPTORS, STRETCH_FACTOR,
                         SUPERPOSITION_RATIO, UNIT_PREVALENCE)
from .pairs import half_pairs, nearest, nearest_image, with_radius


def _is(column: str, symbols) -> Column:
    return F.col(column).isin(*symbols)


def _mode(df: DataFrame, keys: list[str], value: str, first: str, out: str) -> DataFrame:
    """Most common value per key; ties go to the one met first."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("f"))
    return counted.groupBy(*keys).agg(
        F.max(F.struct("n", (-F.col("f")).alias("f"), value)).alias("m"), F.sum("n").alias("n_total")).select(
        *keys, F.col(f"m.{value}").alias(out), F.col("m.n").alias("n_mode"), "n_total")


def exact_median(df: DataFrame, keys: list[str], value: str = "d", out: str = "median") -> DataFrame:
    """Exact median over values rounded to four decimals: the rows collapse to value counts first."""
    counted = df.groupBy(*keys, F.round(value, 4).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias(out))


def former_bonds(bonds: DataFrame, formers=FORMERS, ligands=LIGANDS) -> DataFrame:
    return bonds.filter(_is("element_i", formers) & _is("element_j", ligands))


def modal_coordination(points: DataFrame, bonds: DataFrame, prevalence: float = UNIT_PREVALENCE,
                       formers=FORMERS, ligands=LIGANDS) -> DataFrame:
    """Most common coordination per centre element, if enough of its atoms centre a unit at all."""
    cn = former_bonds(bonds, formers, ligands).groupBy("structure_id", "i", "element_i").agg(F.count(F.lit(1)).alias("cn"))
    mode = _mode(cn, ["structure_id", "element_i"], "cn", "i", "modal_cn").withColumnRenamed("element_i", "element")
    total = points.groupBy("structure_id", "element").agg(F.count(F.lit(1)).alias("n_atoms"))
    return mode.join(total, ["structure_id", "element"]).filter(
        F.col("n_total") / F.col("n_atoms") >= prevalence).select(
        "structure_id", "element", "modal_cn", F.col("n_total").alias("n_centres"), "n_atoms")


def unit_table(points: DataFrame, bonds: DataFrame, modal: DataFrame | None = None) -> DataFrame:
    """Former-ligand bonds of the accepted centre elements."""
    modal = modal if modal is not None else modal_coordination(points, bonds)
    keep = modal.select("structure_id", F.col("element").alias("element_i"))
    return former_bonds(bonds).join(keep, ["structure_id", "element_i"], "left_semi")


def pair_median_length(units: DataFrame) -> DataFrame:
    """Median bond length per (centre, ligand) pair. A bond whose two ends both qualify as centre and
    ligand arrives twice and is counted once, from its lower index."""
    twice = _is("element_j", FORMERS) & _is("element_i", LIGANDS)
    once = units.filter((F.col("i") < F.col("j")) | ~twice)
    return exact_median(once, ["structure_id", "element_i", "element_j"], out="median_d")


def coordination_histogram(bonds: DataFrame) -> DataFrame:
    """Per centre element: CN counts as text, whether they differ."""
    cn = former_bonds(bonds, ligands=ANIONS).groupBy("structure_id", "i", "element_i").agg(F.count(F.lit(1)).alias("cn"))
    hist = cn.groupBy("structure_id", F.col("element_i").alias("element"), "cn").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("structure_id", "element").agg(
        F.sort_array(F.collect_list(F.struct("cn", "n"))).alias("h")).select(
        "structure_id", "element",
        F.array_join(F.transform("h", lambda t: F.format_string("%d:%d", t["cn"], t["n"])), ",").alias("histogram"),
        (F.size("h") > 1).alias("heterogeneous"))


def bond_ranges(bonds: DataFrame) -> DataFrame:
    return former_bonds(bonds, ligands=ANIONS).groupBy("structure_id", F.concat_ws("-", "element_i", "element_j").alias("pair")).agg(
        F.round(F.min("d"), 2).alias("d_min"), F.round(F.max("d"), 2).alias("d_max"), F.count(F.lit(1)).alias("n_bonds"))


def clashes(bonds: DataFrame, factor: float = CLASH_FACTOR) -> DataFrame:
    return bonds.filter((F.col("i") < F.col("j")) & (F.col("d") < (F.col("radius_i") + F.col("radius_j")) * factor)).select(
        "structure_id", "i", "j", "element_i", "element_j", F.round("d", 2).alias("d"))


def bond_populations(bonds: DataFrame, stretch: float = STRETCH_FACTOR, min_share: float = 0.2) -> DataFrame:
    """Bond lengths per pair, split where the next length is more than ``stretch`` times the last.

    A split counts only when every part has at least three bonds and a fifth of all. Lengths rounded
    to four decimals are counted first, so the windows see a bounded number of distinct lengths.
    """
    keys = ["structure_id", "element_i", "element_j"]
    lens = former_bonds(bonds, ligands=ANIONS).groupBy(*keys, F.round("d", 4).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys).orderBy("d")
    new = F.coalesce((F.col("d") > F.lag("d").over(w) * stretch).cast("int"), F.lit(0))
    parts = lens.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    sizes = parts.groupBy(*keys, "part").agg(F.sum("n").alias("part_n"))
    smallest = sizes.groupBy(*keys).agg(F.min("part_n").alias("least"), F.sum("part_n").alias("total"))
    split = F.col("least") >= F.greatest(F.lit(3), F.col("total") * min_share)
    final = parts.join(smallest, keys).withColumn("population", F.when(split, F.col("part")).otherwise(0))
    median = final.groupBy(*keys, "population").agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("median_d"))
    return final.join(median, keys + ["population"]).groupBy(*keys, "population").agg(
        F.sum("n").alias("n_bonds"), F.first("median_d").alias("median_d"),
        F.sum(F.when(F.col("d") > F.col("median_d") * stretch, F.col("n")).otherwise(0)).alias("n_stretched"))


def coordination_integrity(points: DataFrame, bonds: DataFrame, expect: DataFrame | None = None) -> DataFrame:
    """One row per structure: heterogeneous centres, stretched bonds, clashes, bridging anions,
    violations of an expected coordination, and the flag to investigate."""
    zero = F.lit(0)
    base = points.select("structure_id").distinct()
    hetero = coordination_histogram(bonds).groupBy("structure_id").agg(F.count_if("heterogeneous").alias("n_heterogeneous"))
    stretched = bond_populations(bonds).groupBy("structure_id").agg(F.sum("n_stretched").alias("n_stretched"))
    clash = clashes(bonds).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_clashes"))
    bridge = (former_bonds(bonds, ligands=ANIONS).groupBy("structure_id", "j").agg(F.count_distinct("i").alias("n"))
              .filter("n >= 2").groupBy("structure_id").agg(F.count(F.lit(1)).alias("bridging_anions")))
    out = base
    for part in (hetero, stretched, clash, bridge):
        out = out.join(part, "structure_id", "left")
    names = ["n_heterogeneous", "n_stretched", "n_clashes", "bridging_anions"]
    if expect is not None:
        cn = former_bonds(bonds, ligands=ANIONS).groupBy("structure_id", F.col("i").alias("atom")).agg(F.count(F.lit(1)).alias("cn"))
        viol = points.join(expect, "element").join(cn, ["structure_id", "atom"], "left").filter(
            F.coalesce("cn", zero) != F.col("expected")).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_violations"))
        out = out.join(viol, "structure_id", "left")
        names.append("n_violations")
    out = out.select("structure_id", *[F.coalesce(n, zero).alias(n) for n in names])
    return out.withColumn("integrity_flag", (F.col("n_heterogeneous") + F.col("n_stretched") + F.col("n_clashes")) > 0)


# ---- expectations and audit ---------------------------------------------------------------------

def ligand_roles(points: DataFrame, units: DataFrame, modal: DataFrame) -> DataFrame:
    """Atoms of centre elements: 'centre', 'ligand' (no ligand of its own but someone else's) or
    'stripped'."""
    own = units.select("structure_id", F.col("i").alias("atom")).distinct().withColumn("own", F.lit(True))
    lent = units.select("structure_id", F.col("j").alias("atom")).distinct().withColumn("lent", F.lit(True))
    atoms = points.join(modal.select("structure_id", "element"), ["structure_id", "element"], "left_semi")
    return atoms.join(own, ["structure_id", "atom"], "left").join(lent, ["structure_id", "atom"], "left").select(
        "structure_id", "atom", "element",
        F.when(F.col("own"), "centre").when(F.col("lent"), "ligand").otherwise("stripped").alias("role"))


def centre_expectations(points: DataFrame, bonds: DataFrame, expect: DataFrame | None = None) -> DataFrame:
    """(structure_id, atom, element, label, cn, expected) of every centre, stripped ones included.

    Centres are judged within their role, the set of their ligand elements. A centre without any
    ligand is judged by the dominant role of its element. ``expect`` (element, expected) overrides.
    """
    modal = modal_coordination(points, bonds)
    units = unit_table(points, bonds, modal)
    roles = ligand_roles(points, units, modal)
    centres = units.groupBy("structure_id", F.col("i").alias("atom"), F.col("element_i").alias("element")).agg(
        F.count(F.lit(1)).alias("cn"), F.array_join(F.sort_array(F.collect_set("element_j")), "+").alias("sig"))
    keys = ["structure_id", "element", "sig"]
    role = _mode(centres, keys, "cn", "atom", "role_cn")
    per_el = role.groupBy("structure_id", "element").agg(
        F.count(F.lit(1)).alias("n_roles"), F.max("n_total").alias("largest"))
    role = role.join(per_el, ["structure_id", "element"]).withColumn("label", F.when(
        F.col("n_roles") == 1, F.col("element")).otherwise(F.concat("element", F.lit("["), "sig", F.lit("]"))))
    dominant = role.filter("n_total = largest").groupBy("structure_id", "element").agg(
        F.min(F.struct("sig", "label", "role_cn")).alias("dom"))
    judged = centres.join(role.select(*keys, "label", "role_cn"), keys).select(
        "structure_id", "atom", "element", "label", "cn", F.col("role_cn").alias("expected"))
    stripped = roles.filter("role = 'stripped'").join(dominant, ["structure_id", "element"]).select(
        "structure_id", "atom", "element", F.col("dom.label").alias("label"), F.lit(0).cast("long").alias("cn"),
        F.col("dom.role_cn").alias("expected"))
    every = judged.unionByName(stripped)
    if expect is not None:
        every = every.join(expect.select("element", F.col("expected").cast("long").alias("target")), "element", "left") \
            .withColumn("expected", F.coalesce("target", "expected")).drop("target")
    return every


def connectivity_audit(expectations: DataFrame) -> DataFrame:
    """Per role: centres, how many are as expected, defects, histogram."""
    hist = expectations.groupBy("structure_id", "label", "element", "expected", "cn").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("structure_id", "label", "element", "expected").agg(
        F.sum("n").alias("n_centres"),
        F.sum(F.when(F.col("cn") == F.col("expected"), F.col("n")).otherwise(0)).alias("n_ok"),
        F.sum(F.when(F.col("cn") != F.col("expected"), F.col("n")).otherwise(0)).alias("n_defects"),
        F.sort_array(F.collect_list(F.struct("cn", "n"))).alias("h")).select(
        "structure_id", "label", "element", "expected", "n_centres", "n_ok", "n_defects",
        F.array_join(F.transform("h", lambda t: F.format_string("%d:%d", t["cn"], t["n"])), ",").alias("histogram"))


def connectivity_defects(expectations: DataFrame) -> DataFrame:
    return expectations.filter(F.col("cn") != F.col("expected"))


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key with the total next to them. The rank limit is applied before the
    shuffle, so a key with very many rows sends only ``n`` per task."""
    w = W.partitionBy(key).orderBy(*order)
    kept = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"))
    return kept.join(total, key)


def element_coverage(points: DataFrame, audit: DataFrame) -> DataFrame:
    """Elements examined by the audit and elements it did not look at."""
    present = points.groupBy("structure_id").agg(F.collect_set("element").alias("present"))
    seen = audit.groupBy("structure_id").agg(F.collect_set("element").alias("seen"))
    return present.join(seen, "structure_id", "left").select(
        "structure_id",
        F.array_join(F.sort_array(F.coalesce("seen", F.array().cast("array<string>"))), ",").alias("examined"),
        F.array_join(F.sort_array(F.array_except(
            F.array_except("present", F.coalesce("seen", F.array().cast("array<string>"))),
            F.array(*[F.lit(a) for a in ANIONS]))), ",").alias("not_examined"))


# ---- descriptors --------------------------------------------------------------------------------

def atom_environment(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per atom: anion neighbours of a centre, former / other neighbours of an anion, hydrogen."""
    env = bonds.groupBy("structure_id", F.col("i").alias("atom")).agg(
        F.count_if(_is("element_i", FORMERS) & _is("element_j", ANIONS)).alias("cn"),
        F.size(F.collect_set(F.when(_is("element_i", ANIONS) & _is("element_j", FORMERS), F.col("j")))).alias("n_formers"),
        F.count_if(_is("element_i", ANIONS) & ~_is("element_j", FORMERS) & ~_is("element_j", ANIONS)).alias("n_other"),
        F.bool_or(F.col("element_j") == "H").alias("has_h"))
    zero = F.lit(0)
    return points.select("structure_id", "atom", "element").join(env, ["structure_id", "atom"], "left").select(
        "structure_id", "atom", "element", F.coalesce("cn", zero).alias("cn"),
        F.coalesce("n_formers", zero).alias("n_formers"), F.coalesce("n_other", zero).alias("n_other"),
        F.coalesce("has_h", F.lit(False)).alias("has_h"))


def config_descriptors(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """Defect counts per structure; higher is more suspect."""
    env = atom_environment(points, bonds)
    modal = _mode(env.filter("cn > 0"), ["structure_id", "element"], "cn", "atom", "modal_cn").drop("n_mode", "n_total")
    bonding = env.filter("n_formers > 0").select("structure_id", "element").distinct().withColumn("bonding", F.lit(True))
    keys = ["structure_id", "element"]
    full = env.join(modal, keys, "left").join(bonding, keys, "left")
    dangling = F.coalesce("bonding", F.lit(False)) & (F.col("n_formers") == 0) & ~F.col("has_h")
    counts = full.groupBy("structure_id").agg(
        F.count_if(dangling).alias("dangling_anions"),
        F.count_if((F.col("cn") > 0) & (F.col("cn") < F.col("modal_cn"))).alias("under_coord_formers"),
        F.count_if(F.col("cn") > F.col("modal_cn")).alias("over_coord_formers"),
        F.count_if(F.col("n_formers") >= 2).alias("bridging_anions"),
        F.count_if(dangling & (F.col("n_other") == 0)).alias("dangling_unexplained"))
    lens = former_bonds(bonds, ligands=ANIONS)
    pair = ["structure_id", "element_i", "element_j"]
    stretched = lens.join(exact_median(lens, pair), pair).filter(
        F.round("d", 4) > F.col("median") * STRETCH_FACTOR).groupBy("structure_id").agg(F.count(F.lit(1)).alias("stretched_bonds"))
    clash = clashes(bonds).groupBy("structure_id").agg(F.count(F.lit(1)).alias("clashes"))
    return counts.join(stretched, "structure_id", "left").join(clash, "structure_id", "left").na.fill(
        0, ["stretched_bonds", "clashes"])


def unlisted_formers(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """Dangling anions that an element outside the role table bonds, per such element."""
    env = atom_environment(points, bonds)
    bonding = env.filter("n_formers > 0").select("structure_id", "element").distinct()
    dangling = env.filter((F.col("n_formers") == 0) & ~F.col("has_h")).join(
        bonding, ["structure_id", "element"], "left_semi").select("structure_id", F.col("atom").alias("j"))
    candidate = bonds.filter(~_is("element_i", FORMERS) & ~_is("element_i", ANIONS) & _is("element_j", ANIONS))
    closest = candidate.join(dangling, ["structure_id", "j"], "left_semi").groupBy(
        "structure_id", F.col("element_i").alias("element"), "j").agg(F.min("d").alias("d"))
    median = exact_median(closest, ["structure_id", "element"])
    anions = closest.groupBy("structure_id", "element").agg(F.count(F.lit(1)).alias("n_anions"))
    cn = candidate.groupBy("structure_id", "i", "element_i").agg(F.count(F.lit(1)).alias("cn"))
    mode = _mode(cn, ["structure_id", "element_i"], "cn", "i", "modal_cn").withColumnRenamed("element_i", "element")
    return anions.join(median, ["structure_id", "element"]).join(mode, ["structure_id", "element"]).select(
        "structure_id", "element", "n_anions", F.round("median", 2).alias("median_d"), "modal_cn",
        F.round(F.col("n_mode") / F.col("n_total"), 2).alias("cn_uniformity"))


def unit_bonds(units: DataFrame, stretch: float = STRETCH_FACTOR, min_cn: int = 2, max_cn: int = 9) -> DataFrame:
    """Bonds worth holding: plausible centre coordination, length near the pair median."""
    cn = units.groupBy("structure_id", "i").agg(F.count(F.lit(1)).alias("cn"))
    med = pair_median_length(units)
    joined = units.join(cn, ["structure_id", "i"]).join(med, ["structure_id", "element_i", "element_j"], "left")
    in_range = F.col("cn").between(min_cn, max_cn)
    d = F.round("d", 4)
    off = F.coalesce((d > F.col("median_d") * stretch) | (d < F.col("median_d") / stretch), F.lit(False))
    return joined.select("structure_id", "i", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"),
                         in_range.alias("in_range"), off.alias("off"))


def unit_bond_report(held: DataFrame) -> DataFrame:
    centres = held.groupBy("structure_id", "i").agg(F.first("in_range").alias("in_range"))
    skipped = centres.groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("n_centres"), F.count_if(~F.col("in_range")).alias("skipped_cn"))
    pairs = held.filter("in_range and not off").select("structure_id", "a", "b").distinct().groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("n_bonds"))
    long_ = held.filter("in_range and off").groupBy("structure_id").agg(F.count(F.lit(1)).alias("skipped_length"))
    return skipped.join(pairs, "structure_id", "left").join(long_, "structure_id", "left").na.fill(
        0, ["n_bonds", "skipped_length"])


def bond_strength_deficit(pairs: DataFrame, oxidation: DataFrame) -> DataFrame:
    """Anions whose charge their cation neighbours do not satisfy.

    ``pairs``: directed, within the neighbour cut; ``oxidation``: element, oxidation.
    """
    ox = oxidation.select("element", "oxidation")
    known = pairs.filter((F.col("d") > 0.01) & (F.col("d") < BV_NEIGHBOUR_CUT)).join(
        ox.select(F.col("element").alias("element_i"), F.col("oxidation").alias("ox_i")), "element_i").join(
        ox.select(F.col("element").alias("element_j"), F.col("oxidation").alias("ox_j")), "element_j")
    cation_of = (F.col("ox_i") > 0.5) & (F.col("ox_j") < -0.5) & _is("element_j", PROTON_ACCEPTORS)
    bonds = known.filter(cation_of)
    cn = bonds.groupBy("structure_id", "i").agg(F.count(F.lit(1)).alias("cn"))
    sat = bonds.join(cn, ["structure_id", "i"]).groupBy("structure_id", F.col("j").alias("atom")).agg(
        F.sum(F.col("ox_i") / F.col("cn")).alias("satisfied"),
        F.count_if((F.col("element_i") == "H") & (F.col("d") < 1.3)).alias("n_h"))
    return sat


def with_deficit(points: DataFrame, oxidation: DataFrame, satisfied: DataFrame) -> DataFrame:
    anions = points.join(oxidation, "element").filter(
        (F.col("oxidation") < -0.5) & _is("element", PROTON_ACCEPTORS)).select("structure_id", "atom", "element", "oxidation")
    deficit = F.abs("oxidation") - F.coalesce("satisfied", F.lit(0.0)) - F.coalesce("n_h", F.lit(0))
    return anions.join(satisfied, ["structure_id", "atom"], "left").select(
        "structure_id", "atom", "element", deficit.alias("deficit")).filter(F.col("deficit") > BV_MIN_DEFICIT)


def former_anion_cut(contacts: DataFrame, structures: DataFrame, override: float | None = None,
                     formers=FORMERS, anions=ANIONS) -> DataFrame:
    """Shortest former-anion contact times 1.15, or the default with the reason it was used.

    ``contacts``: structure_id, orbit_a, orbit_b, d (signature texts); ``structures``: structure_id.
    """
    def has(column, symbols):
        names = F.regexp_extract_all(F.col(column), F.lit("([A-Z][a-z]?)="), F.lit(1))
        return F.arrays_overlap(names, F.array(*[F.lit(s) for s in symbols]))

    fits = ((has("orbit_a", formers) & has("orbit_b", anions)) | (has("orbit_b", formers) & has("orbit_a", anions)))
    stat = contacts.groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("n_contacts"), F.count_if(fits).alias("n_former_anion"),
        F.min(F.when(fits, F.col("d"))).alias("shortest"))
    joined = structures.join(stat, "structure_id", "left").na.fill(0, ["n_contacts", "n_former_anion"])
    if override is not None:
        return joined.withColumn("cut", F.lit(float(override))).withColumn("state", F.lit("overridden"))
    state = (F.when(F.col("n_former_anion") > 0, "derived").when(F.col("n_contacts") == 0, "vacuous").otherwise("unmatched"))
    return joined.select("structure_id", "n_contacts", "n_former_anion",
                         F.coalesce(F.round(F.col("shortest") * 1.15, 2), F.lit(COUPLE_DEFAULT_CUT)).alias("cut"),
                         state.alias("state"))


def full_occ_clash(points: DataFrame, elements: DataFrame, ratio: float = SUPERPOSITION_RATIO,
                   floor: float = DUPLICATE_FLOOR, listed: int = 8) -> DataFrame:
    """Impossible contacts between fully occupied sites: the least ratio of distance to the sum of radii over
    all pairs of a structure, at any distance, the numbers of impossible and of coincident pairs, the
    ``listed`` worst of each, and two flags.

    ``points``: structure_id, atom, element, x, y, z, lattice of those sites only. A pair counts with its
    nearest image. Pairs below ``floor`` are coincident and have no ratio, and neither have atoms of elements
    without a radius: ``n_no_radius`` counts them. A structure without a pair has NULL ratio.
    """
    known = with_radius(points, elements)
    sized = known.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("radius").isNull()).alias("n_no_radius"),
                                              F.max("radius").alias("widest"))
    known = known.join(sized.select("structure_id", "widest"), "structure_id")
    carry = ("element", "radius", "widest")
    rho = F.col("d") / (F.col("radius_i") + F.col("radius_j"))
    # a pair out of reach has at least the ratio of two of the widest atoms just there
    lowest = nearest(known.filter(F.col("radius").isNotNull()), ["structure_id"], "group", carry=carry,
                     measure=lambda: F.when(F.col("d") >= floor, F.round(rho, 4)), least=lambda reach: F.round(reach / (2 * F.col("widest_i")), 4))
    name = F.concat_ws("-", "element_i", "element_j")   # of equal ratios the lower i comes first, so i < j
    lowest = lowest.select("structure_id", F.round("value", 3).alias("rho_min"), name.alias("rho_min_pair"))
    widest = known.agg(F.max("widest")).first()[0] or 0.0
    close = nearest_image(half_pairs(known, None, max(floor, 2 * ratio * widest) + 1e-9, "atom", carry), carry).withColumn("rho", rho)
    kind = F.when(F.col("d") < floor, "coincident").when(F.col("rho") < ratio, "impossible")
    close = close.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    worst = F.when(F.col("kind") == "coincident", F.round("d", 4)).otherwise(F.round("rho", 3))
    order = W.partitionBy("structure_id", "kind").orderBy(worst, "i", "j")
    counts = close.groupBy("structure_id").agg(F.count_if(F.col("kind") == "impossible").alias("n_impossible"), F.count_if(F.col("kind") == "coincident").alias("n_coincident"))
    top = close.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
    text = F.when(F.col("kind") == "coincident", F.format_string("%s d=%.4f", F.concat_ws("-", "element_i", "element_j"), F.round("d", 4))).otherwise(
        F.format_string("%s d=%.3f sum=%.3f rho=%.3f", F.concat_ws("-", "element_i", "element_j"), F.round("d", 3), F.round(F.col("radius_i") + F.col("radius_j"), 3), F.round("rho", 3)))
    lists = top.groupBy("structure_id").agg(*[   # at most ``listed`` of each kind
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", text.alias("text"))))), lambda r: r["text"]).alias(k) for k in ("impossible", "coincident")])
    out = sized.join(lowest, "structure_id", "left").join(counts, "structure_id", "left").join(lists, "structure_id", "left")
    none = F.array().cast("array<string>")
    n_bad, n_same = (F.coalesce(c, F.lit(0)) for c in ("n_impossible", "n_coincident"))
    return out.select(
        "structure_id", "n_sites", "n_no_radius", "rho_min", "rho_min_pair", n_bad.alias("n_impossible"), n_same.alias("n_coincident"),
        F.coalesce("impossible", none).alias("impossible"), F.coalesce("coincident", none).alias("coincident"),
        F.when(n_bad > 0, "superposition").alias("flag"), F.when(n_same > 0, "duplicate").alias("dup_flag"))


def minority_dispersal(members: DataFrame) -> DataFrame:
    """Mean nearest distance among minority sites over the orbit's nearest distance, at any distance.

    ``members``: structure_id, orbit, atom, is_minority, x, y, z, lattice.
    """
    keys = ["structure_id", "orbit"]
    orbit_nn = nearest(members, keys, "group").select(*keys, F.col("d").alias("orbit_nn"))
    among = nearest(members.filter("is_minority"), keys, "site")
    mean = among.groupBy(*keys).agg(F.avg("d").alias("mean_nn"))
    n = members.filter("is_minority").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_minority"))
    return n.join(mean, keys, "left").join(orbit_nn, keys, "left").select(
        *keys, "n_minority", F.when((F.col("n_minority") >= 2) & (F.col("orbit_nn") > 1e-6), F.round(F.col("mean_nn") / F.col("orbit_nn"), 2)).alias("dispersal"))
