"""Iterative operators against plain loops on small fixtures."""

from __future__ import annotations

import random

from mineralis.operators import catalogue as C
from mineralis.operators import decorate as D
from mineralis.operators import evidence as E
from mineralis.operators import graph as G


def _edges(spark, rows):
    return spark.createDataFrame(rows, "structure_id long, i long, j long")


def test_components_of_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(s, a) for s in (1, 2) for a in range(n)], "structure_id long, atom long")
    chain = [(1, a, a + 1) for a in range(n - 1)] + [(2, a, a + 2) for a in range(n - 2)]
    got = {(r.structure_id, r.atom): r.component for r in G.connected_components(nodes, _edges(spark, chain)).collect()}
    assert got == {**{(1, a): 0 for a in range(n)}, **{(2, a): a % 2 for a in range(n)}}


def test_independent_set_is_the_sequential_one(spark):
    rng = random.Random(3)
    rows, edges = [], []
    for s in range(6):
        ranks = list(range(25))
        rng.shuffle(ranks)
        rows += [(s, a, ranks[a]) for a in range(25)]
        edges += [(s, a, b) for a in range(25) for b in range(a) if rng.random() < 0.15]
    got = {(r.structure_id, r.atom) for r in G.greedy_independent_set(
        spark.createDataFrame(rows, "structure_id long, atom long, rank long"), _edges(spark, edges)).filter("chosen").collect()}
    want = set()
    for s in range(6):
        near = {a: {b for _, x, y in (e for e in edges if e[0] == s) for b in ((y,) if x == a else (x,) if y == a else ())} for a in range(25)}
        kept = set()
        for _, a, _ in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            if not near[a] & kept:
                kept.add(a)
        want |= {(s, a) for a in kept}
    assert got == want


def test_minority_rescue(spark):
    # four one-site orbits of Si 0.7 / B 0.3: rounding alone drops boron, its global count is one
    st = [(1, f"o{k}", el, p, 1) for k in range(4) for el, p in (("Si", 0.7), ("B", 0.3))]
    st += [(2, "o", "Si", 0.6, 10), (2, "o", "B", 0.4, 10)]
    states = spark.createDataFrame(st, "structure_id long, orbit string, state string, prob double, n_groups long")
    out = {(r.structure_id, r.orbit, r.state): r.target for r in D.minority_rescue(states, D.largest_remainder(states)).collect()}
    assert out == {(1, "o0", "Si"): 1, (1, "o1", "Si"): 1, (1, "o2", "Si"): 1, (1, "o3", "B"): 1, (2, "o", "Si"): 6, (2, "o", "B"): 4}


def test_balance_charge(spark):
    ox = {"Li": 1.0, "Mg": 2.0, "Al": 3.0}
    rng = random.Random(5)
    rows, fixed_q = [], {}
    for s in range(8):
        fixed_q[s] = float(rng.randint(-12, -2))
        for o in range(2):
            n = 6
            a, b = rng.sample(sorted(ox), 2)
            rows += [(s, f"o{o}", a, 2, n), (s, f"o{o}", b, rng.randint(1, 3), n)]
    table = spark.createDataFrame(rows, "structure_id long, orbit string, state string, target long, n_groups long")
    charges = spark.createDataFrame([(s, e, q) for s in range(8) for e, q in ox.items()], "structure_id long, state string, oxidation double")
    fixed = spark.createDataFrame(list(fixed_q.items()), "structure_id long, q0 double")

    def judge(t):
        from pyspark.sql import functions as F

        q = t.join(charges, ["structure_id", "state"]).groupBy("structure_id").agg(F.sum(F.col("target") * F.col("oxidation")).alias("s"))
        return q.join(fixed, "structure_id").select("structure_id", (F.col("s") + F.col("q0")).alias("q")).withColumn("ok", F.abs("q") < 0.3)

    got_rows, status = D.balance_charge(table, charges, judge)
    got = {(r.structure_id, r.orbit, r.state): r.target for r in got_rows.collect()}
    want = {}
    for s in range(8):
        now = {(r[1], r[2]): r[3] for r in rows if r[0] == s}
        given = dict(now)
        while True:
            q = fixed_q[s] + sum(ox[e] * n for (_, e), n in now.items())
            if abs(q) < 0.3:
                break
            options = []
            for o in ("o0", "o1"):
                names = sorted(e for (x, e) in now if x == o) + [D.VACANT]
                vacant = 6 - sum(n for (x, _), n in now.items() if x == o)
                for a in names:
                    if (vacant if a == D.VACANT else now[o, a]) <= 0:
                        continue
                    for b in names:
                        if a == b:
                            continue
                        nxt = dict(now)
                        if a != D.VACANT:
                            nxt[o, a] -= 1
                        if b != D.VACANT:
                            nxt[o, b] += 1
                        size = abs(fixed_q[s] + sum(ox[e] * n for (_, e), n in nxt.items()))
                        dev = sum(abs(nxt[k] - given[k]) for k in nxt)
                        options.append((size, dev, o, a, b, nxt))
            best = min(options, key=lambda t: t[:5])
            if best[0] >= abs(q) - 1e-9:
                break
            now = best[5]
        want.update({(s, o, e): n for (o, e), n in now.items()})
    assert got == want
    assert {r.structure_id for r in status.collect()} == set(range(8))


def test_balance_charge_has_no_round_limit(spark, monkeypatch):
    """A loop counted by ``range`` would end after one move; 81 real rounds would take minutes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(D, "range", lambda n: iter((0,)), raising=False)
    table = spark.createDataFrame([(1, "o", "Li", 8, 8)], "structure_id long, orbit string, state string, target long, n_groups long")
    charges = spark.createDataFrame([(1, "Li", 1.0)], "structure_id long, state string, oxidation double")

    def judge(t):
        return t.groupBy("structure_id").agg((F.sum("target") - 6.0).alias("q")).withColumn("ok", F.abs("q") < 0.3)

    rows, _ = D.balance_charge(table, charges, judge)
    assert [(r.state, r.target) for r in rows.collect()] == [("Li", 6)]


def test_balance_charge_ends(spark):
    """Equal oxidation numbers move nothing; a gate whose charge stays ends the moves."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, "o", "Fe", 3, 6), (1, "o", "Al", 3, 6)], "structure_id long, orbit string, state string, target long, n_groups long")
    for ox in (0.0, 1.0):
        charges = spark.createDataFrame([(1, "Fe", ox), (1, "Al", ox)], "structure_id long, state string, oxidation double")
        rows, status = D.balance_charge(table, charges, lambda t: t.select("structure_id").distinct().select(
            "structure_id", F.lit(5.0004).alias("q"), F.lit(False).alias("ok")))
        assert sum(r.target for r in rows.collect()) == (6 if ox == 0 else 5)
        assert [(r.q_final, r.ok_final) for r in status.collect()] == [(5.0004, False)]


def test_sibling_search_matches_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}" if rng.random() < 0.9 else None, rng.randint(1, 4),
             rng.choice([True, False, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, sibling_key string, spacegroup_number int, is_ordered boolean").repartition(7)
    got = {r.id: (r.n_siblings, r.best_sibling, r.sibling) for r in C.sibling_search(df).collect()}
    for i, key, sg, _ in rows:
        if key is None:
            assert got[i] == (None, None, "not searched")
            continue
        match = sorted((o[2] != sg, o[0]) for o in rows if o[1] == key and o[0] != i and o[3])
        want = (0, None, "none") if not match else (len(match), match[0][1], "other-SG" if match[0][0] else "same-SG")
        assert got[i] == want


def test_orientation_orbits(spark):
    # a full oxygen anchor with three alternatives of occupancy 1/3 around it, far from its images
    sites = [(1, 0, 0.0, 0.0, 0.0, "O", 1.0)] + [(1, k, 0.1 * float(k == 1), 0.1 * float(k == 2), 0.1 * float(k == 3), "O", 0.333) for k in (1, 2, 3)]
    sites += [(2, 0, 0.0, 0.0, 0.0, "O", 1.0), (2, 1, 0.1, 0.0, 0.0, "O", 0.5), (2, 2, 0.5, 0.5, 0.5, "O", 0.5)]
    species = spark.createDataFrame(sites, "structure_id long, pos int, x double, y double, z double, element string, occ double")
    table = E.site_signatures(species)
    lattice = spark.createDataFrame([(s, [20.0, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 20.0]) for s in (1, 2)], "structure_id long, lattice array<double>")
    rows = E.orientation_orbits(table, lattice, E.slaved_orbits(table, lattice)).collect()
    assert [(r.structure_id, r.element, r.n_anchors, r.positions_per_anchor, r.alternatives_per_anchor) for r in rows] == [(1, "O", 1, 1, 3)]


# ---- many moves at once against one move at a time ------------------------------------------------

def plain_balance(cells, charges, gate, n_of):
    """One site at a time. ``cells``: {structure: {(orbit, state): target}}; ``gate``: cell -> (q, ok)."""
    out, moves = {}, {}
    for s, now in cells.items():
        given, now, ox = dict(now), dict(now), charges[s]
        moves[s] = 0
        q, ok = gate(s, now)
        while not ok:
            options = []
            for o in sorted({k[0] for k in now}):
                names = [e for x, e in now if x == o] + [D.VACANT]
                has = lambda e: n_of[s, o] - sum(v for (x, _), v in now.items() if x == o) if e == D.VACANT else now[o, e]  # noqa: B023, E731
                shift = lambda e, by: 0 if e == D.VACANT else abs(now[o, e] + by - given[o, e]) - abs(now[o, e] - given[o, e])  # noqa: B023, E731
                for a in names:
                    for b in names:
                        size = abs(q - ox.get(a, 0.0) + ox.get(b, 0.0))
                        if a != b and has(a) > 0 and size < abs(q) - 1e-9:
                            options.append((round(size, 3), shift(a, -1) + shift(b, 1), o, a, b))
            if not options or min(options)[0] >= abs(q) - 1e-9:
                break
            _, _, o, a, b = min(options)
            for e, by in ((a, -1), (b, 1)):
                if e != D.VACANT:
                    now[o, e] += by
            moves[s] += 1
            before = q
            q, ok = gate(s, now)
            if not abs(q) < abs(before) - 1e-9:
                break
        out[s] = now
    return out, moves


def run_balance(spark, cells, charges, n_of, q0, ok_sql):
    from pyspark.sql import functions as F

    rows = [(s, o, e, t, n_of[s, o]) for s, c in cells.items() for (o, e), t in c.items()]
    table = spark.createDataFrame(rows, "structure_id long, orbit string, state string, target long, n_groups long")
    ox = spark.createDataFrame([(s, e, q) for s, c in charges.items() for e, q in c.items()], "structure_id long, state string, oxidation double")
    fixed = spark.createDataFrame(list(q0.items()), "structure_id long, q0 double")
    calls = []

    def judge(t):
        calls.append(1)
        q = t.join(ox, ["structure_id", "state"]).groupBy("structure_id").agg(
            F.sum(F.col("target") * F.col("oxidation")).alias("s"), F.sum(F.when(F.col("state") == "Fe", F.col("target")).otherwise(0)).alias("fe"))
        return q.join(fixed, "structure_id").withColumn("q", F.round(F.col("s") + F.col("q0"), 3)).select("structure_id", "q", F.expr(ok_sql).alias("ok"))

    found, status = D.balance_charge(table, ox, judge)
    got = {}
    for r in found.collect():
        got.setdefault(r.structure_id, {})[r.orbit, r.state] = r.target
    return got, {r.structure_id: r for r in status.collect()}, len(calls)


def test_balance_charge_moves_many_sites_at_once(spark):
    rng = random.Random(11)
    cells, charges, n_of, q0 = {}, {}, {}, {}
    for s in range(14):
        charges[s] = {"Li": 1.0, "Mg": 2.0, "Al": 3.0, "Fe": rng.choice([2.0, 3.0, 8 / 3]), "Ti": rng.choice([4.0, 2.001]), "O": -2.0}
        q0[s], cells[s] = float(rng.randint(-60, 60)), {}
        for o in ("o0", "o1", "o2"):
            n_of[s, o] = 30
            for e in rng.sample(sorted(charges[s]), rng.randint(1, 4)):
                cells[s][o, e] = rng.randint(0, 7)

    def gate(s, now):
        q = round(q0[s] + sum(charges[s][e] * t for (_, e), t in now.items()), 3)
        fe = sum(t for (_, e), t in now.items() if e == "Fe")
        return q, abs(q) < 0.3 or (fe > 0 and abs(q) / fe <= 0.5)

    want, moves = plain_balance(cells, charges, gate, n_of)
    got, status, calls = run_balance(spark, cells, charges, n_of, q0, "abs(q) < 0.3 or (fe > 0 and abs(q) / fe <= 0.5)")
    assert got == want
    assert {s: (r.q_final, r.ok_final) for s, r in status.items()} == {s: gate(s, c) for s, c in want.items()}
    assert max(moves.values()) > 25 and sum(moves.values()) > 100


def test_ten_thousand_moves(spark):
    cells = {1: {("o", "Li"): 30_000, ("o", "Mg"): 5}, 2: {("o", "Li"): 9}}
    charges, n_of, q0 = {1: {"Li": 1.0, "Mg": 2.0}, 2: {"Li": 1.0}}, {(1, "o"): 60_000, (2, "o"): 9}, {1: -19_990.0, 2: -9.0}
    got, status, calls = run_balance(spark, cells, charges, n_of, q0, "abs(q) < 0.3")
    want, moves = plain_balance(cells, charges, lambda s, now: (q := q0[s] + sum(charges[s][e] * t for (_, e), t in now.items()), abs(q) < 0.3), n_of)
    assert got == want and moves[1] > 10_000 and status[1].ok_final and status[2].ok_initial and calls < 30


def plain_rescue(states, targets):
    table = {(o, e): [p, n, targets.get((o, e), 0)] for o, e, p, n in states}
    expected = {}
    for (_, e), (p, n, _) in table.items():
        expected[e] = expected.get(e, 0.0) + p * n
    for e in sorted(expected):
        want = max(round(round(expected[e], 9)), 1 if expected[e] > 1e-6 else 0)
        while sum(t[2] for (_, x), t in table.items() if x == e) < want:
            hosts = [(round(t[0] * t[1] - t[2], 9), o) for (o, x), t in table.items() if x == e and t[2] < t[1]
                     and any(u[2] > 0 for (q, y), u in table.items() if q == o and y != e)]
            if not hosts:
                break
            o = max(hosts)[1]
            give = min((-u[2], y) for (q, y), u in table.items() if q == o and y != e and u[2] > 0)[1]
            table[o, e][2] += 1
            table[o, give][2] -= 1
    return {k: t[2] for k, t in table.items() if t[2]}


def test_minority_rescue_moves_all_units_of_an_element(spark):
    rng = random.Random(4)
    states, targets, want = [], [], {}
    for s in range(10):
        own, chosen = [], {}
        for o in range(rng.randint(1, 5)):
            n = rng.choice([1, 3, 40, 200])
            names = rng.sample(["Al", "B", "Fe", "Si", "Ti"], rng.randint(1, 4))
            weights = [rng.random() for _ in names]
            for e, w in zip(names, weights):
                p = round(w / sum(weights) * rng.choice([1.0, 0.8]), 3)
                own.append((f"o{o}", e, p, n))
                chosen[f"o{o}", e] = 0
            for _ in range(rng.randint(0, n)):   # far from what the fractions ask for
                chosen[f"o{o}", rng.choice(names)] += 1
        states += [(s, *r) for r in own]
        targets += [(s, *k, t) for k, t in chosen.items() if t]
        want.update({(s, *k): t for k, t in plain_rescue(own, chosen).items()})
    table = spark.createDataFrame(states, "structure_id long, orbit string, state string, prob double, n_groups long")
    given = spark.createDataFrame(targets, "structure_id long, orbit string, state string, target long")
    got = {(r.structure_id, r.orbit, r.state): r.target for r in D.minority_rescue(table, given).collect()}
    assert got == want


def test_rescue_leaves_structures_at_rest(spark, monkeypatch):
    """A structure in which nothing moves is not written again in each round, and stays in the result."""
    rows = [(1, "a", "Fe", 1.0, 4, 4), (2, "a", "Fe", 0.9, 2, 2), (2, "a", "Ni", 0.1, 2, 0)]
    table = spark.createDataFrame(rows, "structure_id long, orbit string, state string, prob double, n_groups long, target long")
    written, cut = [], D.cut_lineage

    def counted(df):
        out = cut(df)
        if out.columns == table.columns:
            written.append(out.select("structure_id").distinct().count())
        return out

    monkeypatch.setattr(D, "cut_lineage", counted)
    got = {tuple(r) for r in D.minority_rescue(table.drop("target"), table.select("structure_id", "orbit", "state", "target")).collect()}
    assert got == {(1, "a", "Fe", 4), (2, "a", "Fe", 1), (2, "a", "Ni", 1)} and written == [2, 1]


def test_random_decorations_are_not_grouped_again(spark):
    groups = spark.createDataFrame([(1, "o", g) for g in range(6)], "structure_id long, orbit string, group long")
    targets = spark.createDataFrame([(1, "o", "Fe", 2), (1, "o", "Ni", 3)], "structure_id long, orbit string, state string, target long")
    found = D.random_decorations(groups, targets, 2, seed=3)
    rows = [(r.config, r.state) for r in found.collect()]
    assert sorted(rows) == sorted((c, s) for c in (0, 1) for s in ["Fe"] * 2 + ["Ni"] * 3 + [D.VACANT])
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()   # a rank meets one range at most


def test_balance_charge_reads_only_what_still_moves(spark):
    """The gate is narrowed as structures end; a structure that passes at once or cannot move is never judged again."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame(
        [(1, "o", "Li", 8, 8), (2, "o", "Li", 3, 8), (3, "o", "Li", 5, 8), (3, "p", "Mg", 4, 8), (4, "o", "Fe", 3, 6)],
        "structure_id long, orbit string, state string, target long, n_groups long")
    charges = spark.createDataFrame([(1, "Li", 1.0), (2, "Li", 1.0), (3, "Li", 1.0), (3, "Mg", 2.0), (4, "Fe", 0.0)], "structure_id long, state string, oxidation double")
    asked = []

    class Judge:
        def only(self, structures):
            asked.append(sorted(r.structure_id for r in structures.collect()))
            return self

        def __call__(self, t):
            n = F.sum(F.col("target") * F.when(F.col("state") == "Mg", 2.0).otherwise(1.0))
            return t.groupBy("structure_id").agg((n - 3.0).alias("q")).select(
                "structure_id", F.when(F.col("structure_id") == 4, 7.0).otherwise(F.col("q")).alias("q")).withColumn("ok", F.abs("q") < 0.3)

    rows, status = D.balance_charge(table, charges, Judge())
    assert asked[0] == [1, 3, 4] and all(2 not in a for a in asked) and asked[-1] == [3]
    assert sorted((r.structure_id, r.orbit, r.state, r.target) for r in rows.collect()) == [
        (1, "o", "Li", 3), (2, "o", "Li", 3), (3, "o", "Li", 3), (3, "p", "Mg", 0), (4, "o", "Fe", 3)]
    assert {r.structure_id: (r.q_initial, r.q_final, r.ok_final) for r in status.collect()} == {
        1: (5.0, 0.0, True), 2: (0.0, 0.0, True), 3: (10.0, 0.0, True), 4: (7.0, 7.0, False)}
