"""Graph operators that treat every structure of the corpus at once.

Iterations carry (structure_id, node) rows, so all structures converge together; each round is cut at
a reliable checkpoint and only a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import LABEL_TOL, SAME_DEFAULT_CUT
from ..session import cut_lineage


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("structure_id", F.explode(F.array(
        F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
        F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e")).select("structure_id", "e.*").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "atom") -> DataFrame:
    """(structure_id, node, component): the smallest node of each component.

    Labels spread along edges and then jump to the label of their label, which halves long chains.
    Only nodes with an edge take part in the rounds.
    """
    links = cut_lineage(_links(edges))
    labels = links.select("structure_id", F.col("a").alias("node")).distinct().select(
        "structure_id", "node", F.col("node").alias("component"))
    while True:
        offered = labels.join(links, (labels.structure_id == links.structure_id) & (labels.node == links.a)).select(
            labels.structure_id, F.col("b").alias("node"), "component", F.lit(None).cast(labels.schema["node"].dataType).alias("old"))
        merged = labels.withColumn("old", F.col("component")).unionByName(offered).groupBy("structure_id", "node").agg(
            F.min("component").alias("near"), F.max("old").alias("old"))
        heads = merged.select("structure_id", F.col("node").alias("near"), F.col("near").alias("component"))
        step = cut_lineage(merged.join(heads, ["structure_id", "near"]).select("structure_id", "node", "component", "old"))
        labels = step.drop("old")
        if step.filter("component <> old").isEmpty():
            break
    every = nodes.select("structure_id", F.col(node).alias("node"))
    return every.join(labels, ["structure_id", "node"], "left").select(
        "structure_id", F.col("node").alias(node), F.coalesce("component", "node").alias("component"))


def component_shapes(components: DataFrame, edges: DataFrame, node: str = "atom") -> DataFrame:
    """Size and shape of each component: a clique keeps one group, a chain is split into singletons
    whose pairwise edges stay."""
    sizes = components.groupBy("structure_id", "component").agg(F.count(F.lit(1)).alias("n_nodes"))
    pairs = edges.select("structure_id", F.least("i", "j").alias(node), F.greatest("i", "j").alias("other")).distinct()
    counted = pairs.join(components, ["structure_id", node]).groupBy("structure_id", "component").agg(
        F.count(F.lit(1)).alias("n_edges"))
    joined = sizes.join(counted, ["structure_id", "component"], "left").withColumn(
        "n_edges", F.coalesce("n_edges", F.lit(0)))
    clique = F.col("n_edges") == F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return joined.withColumn("shape", F.when(F.col("n_nodes") == 1, "single").when(clique, "clique").otherwise("chain"))


def exclusion_groups(components: DataFrame, shapes: DataFrame, node: str = "atom") -> DataFrame:
    """Group of each node: its component for cliques, itself for chains."""
    return components.join(shapes.select("structure_id", "component", "shape"), ["structure_id", "component"]).select(
        "structure_id", node, F.when(F.col("shape") == "chain", F.col(node)).otherwise(F.col("component")).alias("group"),
        "shape")


def suspicious_merges(points: DataFrame, components: DataFrame, limit: float = 1.25) -> DataFrame:
    """Same-element groups whose occupancies add up well above one: perhaps a real bond."""
    return points.join(components, ["structure_id", "atom"]).groupBy("structure_id", "component").agg(
        F.min("element").alias("element"), F.max("element").alias("last"),
        F.count(F.lit(1)).alias("n_sites"), F.sum("occ").alias("occ_sum")).filter(
        (F.col("n_sites") > 1) & (F.col("element") == F.col("last")) & (F.col("occ_sum") > limit)).select(
        "structure_id", "component", "element", "n_sites", F.round("occ_sum", 2).alias("occ_sum"))


def greedy_independent_set(nodes: DataFrame, edges: DataFrame, node: str = "atom") -> DataFrame:
    """Lexicographically first independent set in rank order: (structure_id, node, chosen).

    ``nodes``: structure_id, node, rank (distinct inside a structure). A node joins once it outranks
    every undecided neighbour; its neighbours then leave. That is exactly the set one sequential pass
    over the ranks would keep, found in rounds over all structures.
    """
    links = cut_lineage(_links(edges))
    open_ = nodes.select("structure_id", F.col(node).alias("node"), "rank")
    touched = links.select("structure_id", F.col("a").alias("node")).distinct()
    free = open_.join(touched, ["structure_id", "node"], "left_anti").select("structure_id", "node")
    open_ = cut_lineage(open_.join(touched, ["structure_id", "node"], "left_semi"))
    chosen = []
    while not open_.isEmpty():
        near = open_.select("structure_id", F.col("node").alias("b"), F.col("rank").alias("near_rank"))
        best = links.join(near, ["structure_id", "b"]).groupBy("structure_id", F.col("a").alias("node")).agg(
            F.min("near_rank").alias("near_rank"))
        win = cut_lineage(open_.join(best, ["structure_id", "node"], "left").filter(
            F.col("near_rank").isNull() | (F.col("rank") < F.col("near_rank"))).select("structure_id", "node"))
        chosen.append(win)
        lost = win.join(links, (win.structure_id == links.structure_id) & (win.node == links.a)).select(
            win.structure_id, F.col("b").alias("node")).distinct()
        open_ = cut_lineage(open_.join(win, ["structure_id", "node"], "left_anti").join(
            lost, ["structure_id", "node"], "left_anti"))
    kept = free
    for part in chosen:
        kept = kept.unionByName(part)
    kept = kept.withColumn("chosen", F.lit(True))
    return nodes.select("structure_id", F.col(node).alias("node"), "rank").join(
        kept, ["structure_id", "node"], "left").select(
        "structure_id", F.col("node").alias(node), "rank", F.coalesce("chosen", F.lit(False)).alias("chosen"))


# ---- cuts from distance lists -------------------------------------------------------------------

def distance_list(pairs: DataFrame) -> DataFrame:
    """Same-element distances as (structure_id, element, d, n), d rounded to four decimals.

    Rounding bounds how many rows one (structure, element) can have, so the window below is bounded.
    """
    return pairs.filter("element_i = element_j").groupBy(
        "structure_id", F.col("element_i").alias("element"), F.round("d", 4).alias("d")).agg(F.count(F.lit(1)).alias("n"))


def widest_gap_cut(populations: DataFrame, distances: DataFrame, default: float = SAME_DEFAULT_CUT,
                   digits: int = 2) -> DataFrame:
    """Cut in the widest gap that starts at 2.0 or below, over the distances under 3.0.

    ``populations``: structure_id, element with at least two sites.
    """
    near = distances.filter("d < 3.0")
    w = W.partitionBy("structure_id", "element").orderBy("d")
    gaps = near.withColumn("gap", F.lead("d").over(w) - F.col("d"))
    # the first of equally wide gaps wins
    widest = F.max(F.when(F.col("d") <= 2.0, F.struct(F.coalesce("gap", F.lit(0.0)).alias("gap"), (-F.col("d")).alias("neg"))))
    stat = gaps.groupBy("structure_id", "element").agg(
        F.sum("n").alias("n_pairs"), F.min("d").alias("closest"), widest.alias("w"))
    joined = populations.join(stat, ["structure_id", "element"], "left")
    gap, low = F.coalesce(F.col("w.gap"), F.lit(0.0)), -F.col("w.neg")
    state = (F.when(F.col("closest").isNull(), "vacuous").when(F.col("closest") >= default, "out_of_window")
             .when(gap > 0.4, "derived").otherwise("ambiguous"))
    return joined.select(
        "structure_id", "element", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.round("closest", 2).alias("closest"),
        state.alias("state"),
        F.when(state == "derived", F.round(low + gap / 2, digits)).when(state == "ambiguous", default).alias("cut"))


def impossibility_split(populations: DataFrame, distances: DataFrame, override: float | None = None,
                        digits: int = 2) -> DataFrame:
    """Pairs below 0.9 * 2r cannot be a real bond: cut above them when a clear gap follows.

    ``populations``: structure_id, element, radius, all_full. Nothing above counts as 5.0; a fully
    occupied sublattice vetoes the cut; an override wins over everything.
    """
    reach = F.col("radius") * 2 * 0.9
    d = distances.filter("d < 5.0").join(populations, ["structure_id", "element"])
    stat = d.groupBy("structure_id", "element").agg(
        F.max(F.when(F.col("d") < reach, F.col("d"))).alias("below"),
        F.coalesce(F.min(F.when(F.col("d") >= reach, F.col("d"))), F.lit(5.0)).alias("above"))
    joined = populations.join(stat, ["structure_id", "element"], "left")
    found = F.coalesce(F.col("above") - F.col("below") > 0.5, F.lit(False))
    if override is not None:
        state, cut = F.lit("overridden"), F.lit(float(override))
    else:
        state = (F.when(found & F.col("all_full"), "derived: full, no cut")
                 .when(found & (F.col("below") < F.col("radius") * 2 * 0.6), "derived")
                 .when(found, "ambiguous").otherwise("not applicable"))
        cut = F.when(found & ~F.col("all_full"), F.round((F.col("below") + F.col("above")) / 2, digits))
    return joined.select("structure_id", "element", state.alias("state"), cut.alias("cut"))


# ---- descriptor ---------------------------------------------------------------------------------

def orbit_label(n_el, occ, internal, external, comb_occ, comb_n_el, tol: float = LABEL_TOL):
    """O / V / S / SV / P / VP / SP / SVP of one orbit."""
    full, comb_full = occ >= 1 - tol, comb_occ >= 1 - tol
    alone = F.when(n_el == 1, F.when(full, "O").otherwise("V")).otherwise(F.when(full, "S").otherwise("SV"))
    elements = F.when(external, comb_n_el).otherwise(n_el)
    joint = F.when(elements == 1, F.when(comb_full, "P").otherwise("VP")).otherwise(
        F.when(comb_full, "SP").otherwise("SVP"))
    return F.when(~internal & ~external, alone).otherwise(joint)


def disorder_labels(points: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Label per orbit. ``points``: structure_id, atom, element, occ, orbit (an input column)."""
    combined = points.join(components, ["structure_id", "atom"]).groupBy("structure_id", "component").agg(
        F.sum("occ").alias("comb_occ"), F.size(F.collect_set("element")).alias("comb_n_el"))
    first = points.groupBy("structure_id", "orbit").agg(F.min(F.struct("atom", "occ")).alias("f")).select(
        "structure_id", "orbit", "f.atom", "f.occ")
    # an orbit's first site may list several elements; a point table holds one row per element
    kinds = points.join(first.select("structure_id", "orbit", "atom"), ["structure_id", "orbit", "atom"]).groupBy(
        "structure_id", "orbit").agg(F.size(F.collect_set("element")).alias("n_el"))
    side = points.select("structure_id", "atom", "orbit").distinct()
    touch = (
        _links(edges).join(side.select("structure_id", F.col("atom").alias("a"), F.col("orbit").alias("orbit")), ["structure_id", "a"])
        .join(side.select("structure_id", F.col("atom").alias("b"), F.col("orbit").alias("orbit_b")), ["structure_id", "b"])
        .groupBy("structure_id", "orbit").agg(
            F.bool_or(F.col("orbit") == F.col("orbit_b")).alias("internal"),
            F.bool_or(F.col("orbit") != F.col("orbit_b")).alias("external"))
    )
    joined = (first.join(kinds, ["structure_id", "orbit"]).join(components, ["structure_id", "atom"])
              .join(combined, ["structure_id", "component"]).join(touch, ["structure_id", "orbit"], "left"))
    no = F.lit(False)
    return joined.select("structure_id", "orbit", orbit_label(
        F.col("n_el"), F.col("occ"), F.coalesce("internal", no), F.coalesce("external", no),
        F.col("comb_occ"), F.col("comb_n_el")).alias("label"))


def disorder_descriptor(labels: DataFrame) -> DataFrame:
    """Orbit labels -> counts per label, the distinct set, and whether no orbit is a full backbone.

    The multiset is kept as label:count, which stays short however many orbits there are.
    """
    counted = labels.groupBy("structure_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("structure_id").agg(
        F.sum("n").alias("n_orbits"),
        F.array_join(F.sort_array(F.collect_list(F.concat("label", F.lit(":"), F.col("n").cast("string")))), ",").alias("multiset"),
        F.array_join(F.sort_array(F.collect_set("label")), "/").alias("disorder_set"),
        F.bool_and(F.contains("label", F.lit("V"))).alias("no_full_backbone"))
