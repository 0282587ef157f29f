"""Periodic neighbour pairs as a bucketed equi-join.

A distance condition alone would pair every two sites of a structure. Here the cell is divided into
buckets no thinner than the cutoff; a site is joined only with its own and the adjacent buckets, and
the bucket is part of the join key. A very large structure therefore spreads over many tasks, and a
task sees the sites of one bucket, whose number the minimum distance between sites bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_AXES = ("x", "y", "z")


def _cross(m: Column, p: int, q: int) -> list[Column]:
    a = [m[p * 3 + k] for k in range(3)]
    b = [m[q * 3 + k] for k in range(3)]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cell_heights(m: Column) -> list[Column]:
    """Perpendicular heights of the cell along its three axes."""
    faces = [_cross(m, 1, 2), _cross(m, 2, 0), _cross(m, 0, 1)]
    volume = F.abs(sum(m[k] * faces[0][k] for k in range(3)))
    return [volume / F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2]) for f in faces]


def cartesian_norm(delta: list[Column], m: Column) -> Column:
    """Length of a fractional difference vector."""
    xyz = [delta[0] * m[k] + delta[1] * m[3 + k] + delta[2] * m[6 + k] for k in range(3)]
    return F.sqrt(xyz[0] * xyz[0] + xyz[1] * xyz[1] + xyz[2] * xyz[2])


def _probes(base: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """A row per site and bucket that half of its shell reaches.

    Images whose buckets coincide, as all do in a small cell, travel as one row: the first image, how many follow
    it in steps of a cell, and the bucket that they share.
    """
    probe = base
    for a in _AXES:
        n, r = F.col(f"n{a}"), F.col(f"r{a}")
        probe = probe.withColumn(f"s{a}", F.explode(F.sequence(-r, F.least(r, n - 1 - r)))).withColumn(
            f"k{a}", F.floor((r - F.col(f"s{a}")) / n).cast("int"))
    # half of the shell: each unordered pair (with its image) is met from one side only
    last = {a: F.col(f"s{a}") + F.col(f"k{a}") * F.col(f"n{a}") for a in _AXES}
    level = {a: F.col(f"s{a}") % F.col(f"n{a}") == 0 for a in _AXES}
    probe = probe.filter((last["x"] > 0) | (level["x"] & ((last["y"] > 0) | (level["y"] & (last["z"] >= 0)))))
    return probe.select(
        "structure_id", F.col("site").alias("i"), *[F.col(a).alias(f"{a}_i") for a in _AXES],
        *[F.col(c).alias(f"{c}_i") for c in carry], *[F.col(f"{p}{a}") for p in "nsk" for a in _AXES],
        *[F.pmod(F.col(f"w{a}") + F.col(f"s{a}"), F.col(f"n{a}")).alias(f"b{a}") for a in _AXES],
        *[F.floor((F.col(f"w{a}") + F.col(f"s{a}")) / F.col(f"n{a}")).cast("int").alias(f"g{a}") for a in _AXES])


def half_pairs(points: DataFrame, lattice: DataFrame | None, cutoff: float, site: str = "atom",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """Every pair closer than ``cutoff`` once per periodic image: structure_id, i, j, d and the
    carried columns as ``<name>_i`` / ``<name>_j``.

    ``points``: structure_id, ``site``, x, y, z; ``lattice``: structure_id, array<double>(9), or None
    when the points carry the column already.
    Works for any cell and any cutoff: when the cell is thinner than the cutoff, more images are
    probed instead.
    """
    base = points.select(
        "structure_id", F.col(site).alias("site"),
        *[F.pmod(F.col(a).cast("double"), F.lit(1.0)).alias(a) for a in _AXES], *carry,
        *([] if lattice is not None else ["lattice"]))
    if lattice is not None:
        base = base.join(lattice.select("structure_id", "lattice"), "structure_id")
    heights = cell_heights(F.col("lattice"))
    for k, axis in enumerate(_AXES):
        base = base.withColumn(f"n{axis}", F.greatest(F.lit(1), F.floor(heights[k] / cutoff).cast("int")))
        base = base.withColumn(f"r{axis}", F.ceil(F.lit(cutoff) * F.col(f"n{axis}") / heights[k]).cast("int"))
        base = base.withColumn(f"w{axis}", F.least(F.floor(F.col(axis) * F.col(f"n{axis}")).cast("int"),
                                                   F.col(f"n{axis}") - 1))
    probe = _probes(base, carry)
    other = base.select(
        "structure_id", F.col("site").alias("j"), *[F.col(a).alias(f"{a}_j") for a in _AXES], "lattice",
        *[F.col(c).alias(f"{c}_j") for c in carry], *[F.col(f"w{a}").alias(f"b{a}") for a in _AXES])
    joined = probe.join(other, ["structure_id", "bx", "by", "bz"])
    for a in _AXES:
        joined = joined.withColumn("t", F.explode(F.sequence(F.lit(0), F.col(f"k{a}")))).withColumn(
            f"g{a}", F.col(f"g{a}") + F.col("t")).withColumn(f"s{a}", F.col(f"s{a}") + F.col("t") * F.col(f"n{a}"))
    sx, sy, sz = (F.col(f"s{a}") for a in _AXES)
    home = (sx == 0) & (sy == 0) & (sz == 0)
    joined = joined.filter((sx > 0) | ((sx == 0) & ((sy > 0) | ((sy == 0) & (sz >= 0)))))
    delta = [F.col(f"{a}_j") + F.col(f"g{a}") - F.col(f"{a}_i") for a in _AXES]
    return (
        joined.filter(~home | (F.col("i") < F.col("j")))
        .withColumn("d", cartesian_norm(delta, F.col("lattice")))
        .filter(F.col("d") < cutoff)
        .select("structure_id", "i", "j", "d", *[f"{c}_{s}" for c in carry for s in "ij"])
    )


def both_ways(pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Directed pairs from half pairs, without a shuffle."""
    def way(a, b):
        return F.struct(F.col(a).alias("i"), F.col(b).alias("j"),
                        *[F.col(f"{c}_{a}").alias(f"{c}_i") for c in carry],
                        *[F.col(f"{c}_{b}").alias(f"{c}_j") for c in carry])

    return pairs.select("structure_id", "d", F.explode(F.array(way("i", "j"), way("j", "i"))).alias("p")).select(
        "structure_id", "p.*", "d")


def nearest_image(pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shortest image of each unordered pair of different sites, i < j."""
    swap = F.col("i") > F.col("j")

    def end(a, b):
        return F.when(swap, F.col(b)).otherwise(F.col(a))

    oriented = pairs.filter("i <> j").select(
        "structure_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d",
        *[end(f"{c}_i", f"{c}_j").alias(f"{c}_i") for c in carry],
        *[end(f"{c}_j", f"{c}_i").alias(f"{c}_j") for c in carry])
    keys = ["structure_id", "i", "j"] + [f"{c}_{s}" for c in carry for s in "ij"]
    return oriented.groupBy(*keys).agg(F.min("d").alias("d"))


# ---- nearest without a cutoff -------------------------------------------------------------------

def _gridded(sites: DataFrame, keys: list[str], carry: tuple[str, ...]) -> DataFrame:
    """Sites with their bucket in a grid whose buckets are no thinner than the group's ``reach``."""
    heights = cell_heights(F.col("lattice"))
    out = sites.select(*keys, "site", *_AXES, *carry, "lattice", "reach")
    for k, axis in enumerate(_AXES):
        out = out.withColumn(f"n{axis}", F.greatest(F.lit(1), F.floor(heights[k] / F.col("reach")).cast("int")))
        out = out.withColumn(f"r{axis}", F.ceil(F.col("reach") * F.col(f"n{axis}") / heights[k]).cast("int"))
        out = out.withColumn(f"w{axis}", F.least(F.floor(F.col(axis) * F.col(f"n{axis}")).cast("int"), F.col(f"n{axis}") - 1))
    return out


def _around(probe: DataFrame, others: DataFrame, keys: list[str], carry: tuple[str, ...], own_images: bool) -> DataFrame:
    """Pairs of each probing site with the sites of its group nearer than the group's ``reach``."""
    near = _gridded(probe, keys, carry)
    for axis in _AXES:
        near = near.withColumn(f"s{axis}", F.explode(F.sequence(-F.col(f"r{axis}"), F.col(f"r{axis}"))))
    near = near.select(
        *keys, F.col("site").alias("i"), *[F.col(a).alias(f"{a}_i") for a in _AXES], *[F.col(c).alias(f"{c}_i") for c in carry], "lattice", "reach",
        *[F.pmod(F.col(f"w{a}") + F.col(f"s{a}"), F.col(f"n{a}")).alias(f"b{a}") for a in _AXES],
        *[F.floor((F.col(f"w{a}") + F.col(f"s{a}")) / F.col(f"n{a}")).alias(f"g{a}") for a in _AXES])
    far = _gridded(others, keys, carry).select(
        *keys, F.col("site").alias("j"), *[F.col(a).alias(f"{a}_j") for a in _AXES], *[F.col(c).alias(f"{c}_j") for c in carry],
        *[F.col(f"w{a}").alias(f"b{a}") for a in _AXES])
    delta = [F.col(f"{a}_j") + F.col(f"g{a}") - F.col(f"{a}_i") for a in _AXES]
    at_home = (F.col("gx") == 0) & (F.col("gy") == 0) & (F.col("gz") == 0)
    other = (F.col("i") != F.col("j")) | ~at_home if own_images else F.col("i") != F.col("j")
    return near.join(far, [*keys, "bx", "by", "bz"]).filter(other).withColumn("d", cartesian_norm(delta, F.col("lattice"))).filter(
        F.col("d") < F.col("reach")).select(*keys, "i", "j", "d", *[f"{c}_{s}" for c in carry for s in "ij"])


def nearest(points: DataFrame, keys: list[str], each: str, measure=None, least=None, carry: tuple[str, ...] = (),
            site: str = "atom", own_images: bool = False) -> DataFrame:
    """The nearest pair of each site, or of each group, at any distance: keys, i, j, d, value and the carried
    columns as ``<name>_i`` / ``<name>_j``.

    ``points``: ``keys`` (the structure, and what else both sites must have in common), ``site``, x, y, z and
    lattice. ``each`` is ``site`` for one row per site or ``group`` for the one lowest row of each group.
    Groups look around within a reach of their own, first about the mean spacing of their sites; who has
    found nothing that the reach proves to be the lowest looks on with twice the reach, and only those
    take part in the next round, until the reach spans the cell. ``measure`` of a pair at its nearest image (the
    distance, if not given) is what is minimised, NULL leaves the pair out; ``least`` of the reach bounds it from
    below for all pairs that the reach leaves out. Ties go to the lower (i, j). A site without any partner
    has no row; with ``own_images`` a site's own images are partners.
    """
    measure, least = measure or (lambda: F.col("d")), least or (lambda reach: reach)
    base = points.select(*keys, F.col(site).alias("site"), *[F.pmod(F.col(a).cast("double"), F.lit(1.0)).alias(a) for a in _AXES], *carry, "lattice")
    base = cut_lineage(base)
    m = F.col("lattice")
    face = _cross(m, 1, 2)
    volume = F.abs(sum(m[k] * face[k] for k in range(3)))
    # repeated rows of a site are one site: no site is its own partner
    edges = sum(F.sqrt(m[k] * m[k] + m[k + 1] * m[k + 1] + m[k + 2] * m[k + 2]) for k in (0, 3, 6))
    groups = base.groupBy(*keys).agg(F.count_distinct("site").alias("n"), F.first(F.pow(volume, 1 / 3)).alias("edge"), F.first(edges).alias("span"))
    if not own_images:
        groups = groups.filter("n > 1")
    open_ = cut_lineage(groups.select(*keys, "span", (F.col("edge") / F.pow(F.col("n").cast("double"), 1 / 3)).alias("reach")))
    waiting = base.select(*keys, "site").distinct() if each == "site" else None
    who = [*keys, "i"] if each == "site" else keys
    done = None
    while not open_.isEmpty():
        others = base.join(open_, keys)
        probe = others if waiting is None else others.join(waiting, [*keys, "site"], "left_semi")
        rest = [f"{c}_{s}" for c in carry for s in "ij"]
        found = _around(probe, others, keys, carry, own_images).groupBy(*keys, "i", "j", *rest).agg(F.min("d").alias("d"))
        found = found.join(open_, keys).withColumn("value", measure()).filter(F.col("value").isNotNull())
        first = F.struct("value", *(["i"] if each != "site" else []), "j", "d", *rest, "reach", "span")
        best = found.groupBy(*who).agg(F.min(first).alias("m")).select(*who, "m.*").select(*keys, "i", "j", "d", "value", *rest, "reach", "span")
        best = cut_lineage(best)
        sure = best.filter((F.col("value") < least(F.col("reach"))) | (F.col("reach") > F.col("span"))).drop("reach", "span")
        done = sure if done is None else done.unionByName(sure)
        wider = open_.filter(F.col("reach") <= F.col("span")).withColumn("reach", 2 * F.col("reach"))
        if waiting is None:
            open_ = cut_lineage(wider.join(sure.select(*keys), keys, "left_anti"))
        else:
            waiting = cut_lineage(waiting.join(wider.select(*keys), keys, "left_semi").join(
                sure.select(*keys, F.col("i").alias("site")), [*keys, "site"], "left_anti"))
            open_ = cut_lineage(wider.join(waiting.select(*keys).distinct(), keys, "left_semi"))
    if done is None:   # no group has a partner
        alone = base.withColumn("reach", F.lit(1.0)).filter(F.lit(False))
        done = _around(alone, alone, keys, carry, own_images).withColumn("value", measure())
    return done


def with_radius(points: DataFrame, elements: DataFrame) -> DataFrame:
    """``points`` with ``radius``; isotopes of hydrogen have its radius, an element that the table does not
    list has NULL."""
    radius = elements.select(F.col("symbol").alias("_symbol"), "radius")
    symbol = F.when(F.col("element").isin("D", "T"), F.lit("H")).otherwise(F.col("element"))
    return points.withColumn("_of", symbol).join(radius, F.col("_of") == F.col("_symbol"), "left").drop("_of", "_symbol")


def radius_state(points: DataFrame, elements: DataFrame) -> DataFrame:
    """(structure_id, n_atoms, n_unknown, unknown, state) of every structure: how many atoms have no radius,
    of which elements, and ``unknown`` if there are any, else ``known``. The bonds and clashes of such atoms
    are unknown, so a structure without any is clean only where the state is ``known``."""
    lacks = F.col("radius").isNull()
    per = with_radius(points, elements).groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.count_if(lacks).alias("n_unknown"),
        F.array_join(F.sort_array(F.collect_set(F.when(lacks, F.coalesce("element", F.lit("?"))))), ",").alias("unknown"))
    return per.withColumn("state", F.when(F.col("n_unknown") > 0, "unknown").otherwise("known"))


def bonds(points: DataFrame, lattice: DataFrame | None, elements: DataFrame, tol: float, max_radius: float,
          site: str = "atom") -> DataFrame:
    """Directed bonds d < tol * (r_i + r_j), with elements and radii of both ends.

    Atoms without a radius have no bonds here; ``radius_state`` says which structures have such atoms.
    """
    known = with_radius(points, elements).filter(F.col("radius").isNotNull())
    carry = ("element", "radius")
    half = half_pairs(known, lattice, 2 * max_radius * tol, site, carry)
    half = half.filter(F.col("d") < tol * (F.col("radius_i") + F.col("radius_j")))
    return both_ways(half, carry)
