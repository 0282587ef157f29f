"""The lower hull against all mixtures of references."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from mineralis.operators import hull as H

REFERENCE = "target_chemsys string, formula string, fractions array<double>, energy double"
TARGET = "target_id long, chemsys string, fractions array<double>, energy double"


def lowest(x, refs):
    """Least energy of a mixture with composition ``x``: every set of as many references as components."""
    best, n = np.inf, len(x)
    for some in itertools.combinations(refs, n):
        m = np.array([r[2] for r in some]).T
        if abs(np.linalg.det(m)) > 1e-12 and (w := np.linalg.solve(m, x)).min() > -1e-9:
            best = min(best, float(w @ [r[3] for r in some]))
    return best


def system(rng, name, n, count):
    """Endpoints and compounds on a coarse grid, so that edges, equal compositions and flat parts occur."""
    refs = [(name, f"E{k}", [float(k == i) for i in range(n)], rng.choice([-1.0, 0.0, 0.5])) for k in range(n)]
    refs += [(name, f"E{k}b", [float(k == i) for i in range(n)], 2.0) for k in range(n)]
    for c in range(count):
        parts = [rng.randint(0, 4) for _ in range(n)]
        if sum(parts):
            refs.append((name, f"C{c}", [p / sum(parts) for p in parts], rng.choice([0.0, -1.0, -1.5, rng.uniform(-3, 1)])))
    return refs


@pytest.mark.parametrize("most", [4000, 9])
def test_hull_of_any_number_of_components(spark, monkeypatch, most):
    monkeypatch.setattr(H, "FACET_REFERENCES", most)
    rng = random.Random(most)
    refs, targets = [], []
    for s in range(12):
        n = s % 4 + 1
        own = system(rng, f"s{s}", n, 14)
        refs += own
        for t in range(6):
            parts = [rng.randint(0, 6) for _ in range(n - 1)] + [1]
            targets.append((100 * s + t, f"s{s}", [p / sum(parts) for p in parts], rng.uniform(-3, 1)))
        targets.append((100 * s + 50, f"s{s}", own[-1][2], own[-1][3]))
    got = {r.target_id: r for r in H.energy_above_hull(spark.createDataFrame(targets, TARGET), spark.createDataFrame(refs, REFERENCE), 9).collect()}
    assert len(got) == len(targets)
    for i, name, x, energy in targets:
        own = [r for r in refs if r[0] == name]
        want = energy - lowest(np.array(x), own)
        r = got[i]
        assert abs(r.e_above_hull - want) < 1e-7 and r.on_hull == (abs(want) < 1e-3) and r.reason is None
        phases = {p.split("=")[0]: float(p.split("=")[1]) for p in r.decomposition.split(",")}
        by_name = {q[1]: q for q in own}
        assert abs(sum(phases.values()) - 1) < 0.003 and abs(sum(w * by_name[p][3] for p, w in phases.items()) - (energy - want)) < 0.02
        assert np.allclose(sum(w * np.array(by_name[p][2]) for p, w in phases.items()), x, atol=0.004)
        ground = sum(xi * min(q[3] for q in own if q[2][k] == 1.0) for k, xi in enumerate(x))
        assert abs(r.formation_e - (energy - ground)) < 1e-7


def test_many_vertices_need_no_round_limit(spark):
    """A parabola: each of 900 references is a vertex, far more than any fixed number of pivots."""
    refs = [("a-b", "a", [1.0, 0.0], 0.0), ("a-b", "b", [0.0, 1.0], 0.0)]
    refs += [("a-b", f"c{k:03d}", [1 - k / 901, k / 901], -(k / 901) * (1 - k / 901)) for k in range(1, 901)]
    x = 450.5 / 901
    targets = [(1, "a-b", [1 - x, x], 0.0)]
    r, = H.energy_above_hull(spark.createDataFrame(targets, TARGET), spark.createDataFrame(refs, REFERENCE), 9).collect()
    mid = -(450 / 901 * 451 / 901 + 451 / 901 * 450 / 901) / 2
    assert abs(r.e_above_hull + mid) < 1e-8 and r.decomposition == "c450=0.500,c451=0.500"


def test_reasons(spark):
    refs = [("a-b", "a", [1.0, 0.0], 0.0), ("a-b", "ab", [0.5, 0.5], -1.0), ("c", "c", [1.0], 0.0), ("d", "d", [1.0], None)]
    targets = [(1, "a-b", [0.5, 0.5], 0.0), (2, "x-y", [0.5, 0.5], 0.0), (3, "c", [1.0], None), (4, "c", [1.0], -0.5), (4, "c", [1.0], 0.25), (5, "d", [1.0], 0.0)]
    got = sorted((r.target_id, r.e_above_hull, r.on_hull, r.reason) for r in H.energy_above_hull(
        spark.createDataFrame(targets, TARGET), spark.createDataFrame(refs, REFERENCE)).collect())
    assert got == [(1, None, None, "no elemental endpoint"), (2, None, None, "no references"), (3, None, None, "no energy"),
                   (4, -0.5, False, None), (4, 0.25, False, None), (5, None, None, "no elemental endpoint")]
    none = spark.createDataFrame([], REFERENCE)
    assert H.energy_above_hull(spark.createDataFrame([], TARGET), none).count() == 0
    assert {r.reason for r in H.energy_above_hull(spark.createDataFrame(targets, TARGET), none).collect()} == {"no references"}


def test_tables_of_phases_are_not_broadcast(spark, tmp_path):
    """Packed files of phases are far smaller than the phases, so their size alone would have them broadcast."""
    from pyspark.sql import functions as F

    ids = spark.range(20000).select(F.col("id").alias("material_id"), F.array(F.lit("Fe"), F.lit("O")).alias("elements"), F.array(F.lit(0.5), F.lit(0.5)).alias("fractions"),
                                    F.lit(-1.0).alias("energy"), F.lit(0.0).alias("ehull"), F.lit("FeO").alias("formula"), F.lit("Fe-O").alias("chemsys"), F.lit(4).alias("n_cell_atoms"))
    ids.write.parquet(str(tmp_path / "phases"))
    phases = spark.read.parquet(str(tmp_path / "phases"))
    candidates = H.hull_candidates(phases.select("chemsys").distinct(), phases)
    assert H.aligned_references(candidates, phases).collect() == [("Fe-O", "FeO", [0.5, 0.5], -1.0)]
    for df in (H.aligned_references(candidates, phases), H.hull_coverage(phases.select("chemsys"), candidates, phases)):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "material_id" in line]
        assert joins and not any("Broadcast" in line and "target_chemsys" not in line for line in joins), joins
