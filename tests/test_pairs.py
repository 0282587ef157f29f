"""The bucketed pair join against every pair of every image."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mineralis.operators import pairs as P

CELLS = {
    "cube": [8.0, 0.0, 0.0, 0.0, 8.0, 0.0, 0.0, 0.0, 8.0],
    "skewed": [7.0, 0, 0, 2.5, 6.0, 0, 1.5, -2.0, 9.0],
    "thin": [2.1, 0, 0, 0, 9.0, 0, 0.4, 0, 3.0],
}


@pytest.mark.parametrize("kind", CELLS)
@pytest.mark.parametrize("cutoff", [1.7, 3.3])
def test_all_images(spark, kind, cutoff):
    rng = np.random.default_rng(4)
    frac = rng.random((14, 3)).round(4)
    m = np.array(CELLS[kind]).reshape(3, 3)
    points = spark.createDataFrame([("s", i, *map(float, f)) for i, f in enumerate(frac)], "structure_id string, atom long, x double, y double, z double")
    lattice = spark.createDataFrame([("s", [float(v) for v in CELLS[kind]])], "structure_id string, lattice array<double>")
    got = sorted((r.i, r.j, round(r.d, 6)) for r in P.both_ways(P.half_pairs(points, lattice, cutoff)).collect())
    want = []
    for i, j in itertools.product(range(14), repeat=2):
        for image in itertools.product(range(-5, 6), repeat=3):
            if i == j and image == (0, 0, 0):
                continue
            d = float(np.linalg.norm((frac[j] + image - frac[i]) @ m))
            if d < cutoff:
                want.append((i, j, round(d, 6)))
    assert got == sorted(want)


def test_nearest_image(spark):
    points = spark.createDataFrame([("s", 0, 0.05, 0.0, 0.0), ("s", 1, 0.95, 0.0, 0.0)], "structure_id string, atom long, x double, y double, z double")
    lattice = spark.createDataFrame([("s", CELLS["cube"])], "structure_id string, lattice array<double>")
    rows = P.nearest_image(P.half_pairs(points, lattice, 9.0)).collect()
    assert [(r.i, r.j, round(r.d, 6)) for r in rows] == [(0, 1, 0.8)]


def test_atoms_without_a_radius(spark):
    from mineralis.constants import element_table

    atoms = [("d", 0, 0.0, "O"), ("d", 1, 0.12, "D"), ("ra", 0, 0.0, "Ra"), ("ra", 1, 0.1, "O"), ("ra", 2, 0.5, "Am"), ("ok", 0, 0.0, "H")]
    points = spark.createDataFrame([(s, i, x, 0.0, 0.0, e) for s, i, x, e in atoms], "structure_id string, atom long, x double, y double, z double, element string")
    lattice = spark.createDataFrame([(s, CELLS["cube"]) for s in ("d", "ra", "ok")], "structure_id string, lattice array<double>")
    rows = P.bonds(points, lattice, element_table(spark), 1.25, 0.76).collect()
    assert sorted((r.structure_id, r.element_i, r.element_j, round(r.d, 2)) for r in rows) == [("d", "D", "O", 0.96), ("d", "O", "D", 0.96)]
    states = {r.structure_id: (r.n_atoms, r.n_unknown, r.unknown, r.state) for r in P.radius_state(points, element_table(spark)).collect()}
    assert states == {"d": (2, 0, "", "known"), "ra": (3, 2, "Am,Ra", "unknown"), "ok": (1, 0, "", "known")}


# ---- nearest at any distance ---------------------------------------------------------------------

SPARSE = {**CELLS, "wide": [40.0, 0, 0, 0, 40.0, 0, 0, 0, 40.0], "flat": [60.0, 0, 0, 20.0, 3.0, 0, 1.0, 0.5, 4.0]}
SITE = "structure_id string, atom long, x double, y double, z double, element string, lattice array<double>"


def min_image(a, b, m):
    return min(float(np.linalg.norm((b - a + image) @ m)) for image in itertools.product(range(-22, 23) if abs(np.linalg.det(m)) < 800 else range(-3, 4), range(-3, 4), range(-3, 4)))


def test_nearest_at_any_distance(spark):
    from mineralis.operators.coordination import minority_dispersal
    from mineralis.operators.ensemble import minimum_contact

    rng = np.random.default_rng(6)
    rows, cells = [], {}
    for kind, cell in SPARSE.items():
        for n in (1, 2, 9):
            name = f"{kind}{n}"
            cells[name] = (np.array(cell).reshape(3, 3), rng.random((n, 3)).round(4))
            rows += [(name, k, *map(float, f), "ORa"[k % 3 == 0:][:1], [float(v) for v in cell]) for k, f in enumerate(cells[name][1])]
    cells["same3"] = (np.eye(3) * 9.0, np.array([[0.1, 0.1, 0.1], [0.1, 0.1, 0.1], [0.7, 0.1, 0.1]]))   # two atoms at one place
    rows += [("same3", k, *map(float, f), "D", [9.0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 9.0]) for k, f in enumerate(cells["same3"][1])]
    points = spark.createDataFrame(rows, SITE)
    want = {}
    for name, (m, f) in cells.items():
        for i, j in itertools.permutations(range(len(f)), 2):
            want[name, i, j] = min_image(f[i], f[j], m)
    got = {(r.structure_id, r.i): (r.j, r.d) for r in P.nearest(points, ["structure_id"], "site").collect()}
    assert set(got) == {(s, i) for s, i, _ in want}
    for (s, i), (j, d) in got.items():
        assert abs(d - min(v for (t, k, _), v in want.items() if (t, k) == (s, i))) < 1e-9 and abs(want[s, i, j] - d) < 1e-9
    least = {r.structure_id: r.min_d for r in minimum_contact(points).collect()}
    assert set(least) == set(cells)
    for s, d in least.items():
        pairs = [v for (t, _, _), v in want.items() if t == s]
        assert d is None if not pairs else abs(d - min(pairs)) < 1e-4
    images = {r.structure_id: r.d for r in P.nearest(points.filter("structure_id like '%1'"), ["structure_id"], "group", own_images=True).collect()}
    for kind, cell in SPARSE.items():   # a single atom and its own image: the shortest lattice vector
        m = np.array(cell).reshape(3, 3)
        short = min(float(np.linalg.norm(np.array(v) @ m)) for v in itertools.product(range(-20, 21), range(-3, 4), range(-3, 4)) if any(v))
        assert abs(images[f"{kind}1"] - short) < 1e-9
    from pyspark.sql import functions as F

    members = points.withColumns({"orbit": F.lit("o"), "is_minority": F.col("atom") % 2 == 0})
    for r in minority_dispersal(members).collect():
        some = range(0, len(cells[r.structure_id][1]), 2)
        if len(some) > 1:
            every = [v for (t, _, _), v in want.items() if t == r.structure_id]
            mean = np.mean([min(want[r.structure_id, i, j] for j in some if i != j) for i in some])
            assert r.dispersal is None if min(every) <= 1e-6 else abs(r.dispersal - mean / min(every)) < 0.006
        else:
            assert r.dispersal is None
    none = points.filter("false")
    assert P.nearest(none, ["structure_id"], "site").count() == 0 and minimum_contact(none).count() == 0


def test_clash_ratio_at_any_distance(spark):
    from mineralis.constants import element_table
    from mineralis.operators.coordination import full_occ_clash

    rng = np.random.default_rng(9)
    radius = {r.symbol: r.radius for r in element_table(spark).collect()}
    radius["D"] = radius["H"]
    names = ["Cs", "H", "O", "D", "Fe", "Xx"]
    rows, cells = [], {}
    for k, (edge, n) in enumerate([(40.0, 2), (25.0, 3), (6.0, 12), (5.0, 20), (30.0, 1), (9.0, 2)]):
        f = rng.random((n, 3)).round(4)
        if k == 3:
            f[1] = f[0] + [0.01, 0, 0]
        if k == 5:
            f[1] = f[0]   # nothing but a coincident pair
        kinds = [names[int(v)] for v in rng.integers(0, 6, n)] if k != 5 else ["O", "O"]
        cells[f"c{k}"] = (np.eye(3) * edge, f, kinds)
        rows += [(f"c{k}", i, *map(float, v), e, [edge, 0.0, 0.0, 0.0, edge, 0.0, 0.0, 0.0, edge]) for i, (v, e) in enumerate(zip(f, kinds))]
    for r in full_occ_clash(spark.createDataFrame(rows, SITE), element_table(spark), listed=3).collect():
        m, f, kinds = cells[r.structure_id]
        bad, same, ratios = [], [], []
        for i, j in itertools.combinations(range(len(f)), 2):
            d, pair = min_image(f[i], f[j], m), f"{kinds[i]}-{kinds[j]}"
            if d < 0.2:
                same.append((round(d, 4), i, j, pair))
            elif kinds[i] in radius and kinds[j] in radius:
                rho = d / (radius[kinds[i]] + radius[kinds[j]])
                ratios.append((rho, pair))
                if rho < 0.5:
                    bad.append((round(rho, 3), i, j, pair))
        assert (r.n_sites, r.n_no_radius) == (len(f), kinds.count("Xx"))
        assert (r.rho_min, r.rho_min_pair) == ((round(min(ratios)[0], 3), min(ratios)[1]) if ratios else (None, None))
        assert (r.n_impossible, r.n_coincident, r.flag, r.dup_flag) == (len(bad), len(same), "superposition" if bad else None, "duplicate" if same else None)
        assert [t.split(" ")[0] for t in r.impossible] == [b[3] for b in sorted(bad)[:3]]
        assert [t.split(" ")[0] for t in r.coincident] == [b[3] for b in sorted(same)[:3]]


def test_images_in_one_bucket_probe_once(spark):
    """In a cell of one bucket each site meets the join once, not once an image."""
    from mineralis.operators import pairs as P

    sites = [(1, k, k / 7, k / 5 % 1, k / 3 % 1, [5.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 5.0]) for k in range(6)]
    df = spark.createDataFrame(sites, "structure_id long, site int, x double, y double, z double, lattice array<double>")
    for a in "xyz":
        df = df.withColumn(f"n{a}", F.lit(1)).withColumn(f"r{a}", F.lit(1)).withColumn(f"w{a}", F.lit(0))
    assert P._probes(df, ()).count() == 6
