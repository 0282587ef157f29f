"""SimHash, hard negatives and the filter audit against plain loops."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mineralis.llm import audit, hardneg, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = "ba do ki mu ra se ti vo ne lu pa go".split()
ASCII_SPACE = " \t\n\x0b\x0c\r"


def words(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in ASCII_SPACE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out


# --- SimHash ----------------------------------------------------------------------------------------

def plain_fingerprint(text):
    ws = plain_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def check_components(rows, got):
    """``got``: (doc_id, fingerprint, component_id) in any order."""
    prints = [plain_fingerprint(r[1]) for r in rows]
    label, want = plain_components(prints), []
    for k, r in enumerate(rows):
        want.append((r[0], f"{prints[k]:016x}", min((q[0] for q, x in zip(rows, label) if x == label[k] and q[0] is not None), default=None)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_simhash_corpus(spark, docs, clashing):
    fields = "doc_id", "fingerprint", "component_id"
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_components(rows, [tuple(r) for r in simhash.near_copies(docs).select(*fields).collect()])
    check_components(rows, [tuple(r) for r in simhash.near_copies(clashing.withColumn("fp", F.lit("mine"))).select(*fields).collect()])


def test_simhash_empty(spark, empty_docs):
    assert simhash.near_copies(empty_docs).count() == 0
    nobody = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_copies(nobody).collect()} == {None}


def test_fingerprint_of_long_texts():
    rng = random.Random(1)
    text = words(rng, 70_000)   # more hashes than are counted at a time
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == plain_fingerprint(text)
    assert simhash.fingerprint(np.array([3, 5, 6, 0], np.uint64)) == 0   # no bit in over half
    odd = "a b   İ É\u0085x"   # only six characters part words, only A-Z are folded
    assert simhash.fingerprint(simhash.shingle_hashes(odd)) == plain_fingerprint(odd)


def test_tree_follows_edges_only():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    nodes, keys = simhash.build_tree(fps)
    assert sorted(nodes.tolist()) == fps.tolist() and (np.diff(keys) > 0).all()
    for k, key in enumerate(keys.tolist()):   # a child's key is its distance to the parent
        assert (int(nodes[k + 1]) ^ int(nodes[key // 65])).bit_count() == key % 65
    for radius in (0, 1, 2, 5):
        at, node = simhash.search_tree(nodes, keys, fps, radius)
        got = sorted(zip(fps[at].tolist(), nodes[node].tolist()))
        assert got == sorted((a, b) for a in fps.tolist() for b in fps.tolist() if (a ^ b).bit_count() <= radius)
    alone = simhash.build_tree(fps[:1])
    assert len(alone[0]) == 1 and len(alone[1]) == 0


@pytest.mark.parametrize("most", [8192, 16])
def test_links_of_dense_shards(spark, monkeypatch, most):
    """A chain of single bits, a dense ball and strangers; small limits deal the shards again and again."""
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    monkeypatch.setattr(simhash, "SHARD_AIM", 8)
    monkeypatch.setattr(simhash, "SEARCHERS", 7)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 3)} | {rng.getrandbits(64) for _ in range(200)}
    chain = rng.getrandbits(64)
    for b in range(0, 40):
        chain ^= 1 << b
        fps.add(chain)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    seated = simhash.seats(table, len(fps))
    assert seated.groupBy("mask", "value").count().agg(F.max("count")).first()[0] <= most
    label = plain_components(fps)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.links(table).collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
        root[find(r.a)] = find(r.b)
    groups = lambda names: sorted(sorted(f for f, g in zip(signed, names) if g == name) for name in set(names))
    assert groups([find(f) for f in signed]) == groups(label)


def test_trees_that_do_not_fit_a_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", -1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_components(rows, [tuple(r) for r in simhash.near_copies(docs).select("doc_id", "fingerprint", "component_id").collect()])


# --- hard negatives ---------------------------------------------------------------------------------

def plain_negatives(rows, anchors):
    out = []
    for a, la, va in anchors:
        score = lambda v: sum(x * y for x, y in zip(va, v))  # noqa: B023, E731
        rank = lambda part: sorted((-score(v), i) for i, _, v in part)  # noqa: B023, E731
        others = [r for r in rows if r[0] != a]
        away = [r for r in others if r[1] != la]
        for p, i in rank([r for r in others if r[1] == la])[:5]:
            hard = [(s, n) for s, n in rank(away) if 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, k + 1, n, -p, -s) for k, (s, n) in enumerate(hard[:3])]
    return sorted(out)


def negatives(rows, spark, every=7):
    table = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    anchors = [r for r in rows if r[0] % every == 0]
    return sorted(map(tuple, hardneg.mine(table, table.filter(F.col("vec_id") % every == 0)).collect())), plain_negatives(rows, anchors)


@pytest.mark.parametrize("scale, width", [(60, 6), (40_000, 20), (10**7, 3)])
def test_hard_negatives(spark, monkeypatch, scale, width):
    for name, value in {"BLOCK_ROWS": 16, "PACK_ROWS": 5, "SLOT_BLOCKS": 2, "TILE": 3, "LEADS": 2}.items():
        monkeypatch.setattr(hardneg, name, value)
    rng = random.Random(scale)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-scale, scale) for _ in range(width)]) for i in range(130)]
    rows += [(i, i % 3, rows[3][2]) for i in range(200, 220)]           # ties
    rows += [(300, 0, [0] * width), (301, 1, [0] * width), (302, 2, rows[5][2]), (303, 0, rows[6][2][:2]), (400, 9, rows[1][2])]
    got, want = negatives(rows, spark)
    assert got == want and len(want) > 50


def test_hard_negatives_repeats_and_edges(spark):
    rows = [(0, 0, [4, 0]), (1, 0, [4, 0]), (1, 0, [4, 0]), (2, 1, [2, 9]), (2, 1, [3, 0]), (3, 1, [4, 0]), (4, 1, [1, 0]), (5, 1, [-4, 0]), (6, 0, [-1, 0])]
    got, want = negatives(rows, spark)
    # 16 * 0.5 = 8 and 12 are in range, 16 is too like; id 1 counts twice; a negative positive has no range
    assert got == want == [(0, 1, 1, 2, 16, 12), (0, 1, 1, 2, 16, 12), (0, 1, 2, 2, 16, 8), (0, 1, 2, 2, 16, 8)]
    none = spark.createDataFrame([], "vec_id long, label long, v array<long>")
    some = spark.createDataFrame(rows, none.schema)
    assert hardneg.mine(none, none).count() == hardneg.mine(some, none).count() == hardneg.mine(none, some).count() == 0


def test_labelled(spark):
    rows = [(0, 1, [0.5, -0.001]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan")]), (5, 1, [float("-inf")]), (None, 1, [1.0]), (6, 2, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("V", F.lit("mine"))
    assert {(r.vec_id, r.label, tuple(r.v)) for r in hardneg.labelled(table).collect()} == {(0, 1, (128, -1)), (6, 2, ())}


@pytest.mark.parametrize("width", [1, 3, 64, 100])
def test_intervals_hold_and_are_narrow_near_the_centre(width):
    rng = np.random.default_rng(width)
    turns = hardneg.Turns(width)
    rows = rng.integers(-200, 200, (300, width))
    rows[:3] = 0
    near = rng.integers(-200, 200, width) * 50 + rows // 50
    anchors = np.concatenate([rng.integers(-200, 200, (20, width)), rows[:5], np.zeros((1, width), np.int64)])
    asked = hardneg.Asked(anchors, turns)
    for block in (rows, near, rows[:1]):
        centre, codes, about = hardneg.encode(block, turns)
        low, up = asked.intervals(slice(0, len(anchors)), centre, codes, about)
        exact = anchors @ block.T
        assert (low <= exact).all() and (exact <= up).all()
        if width == 64 and block is rows:   # one bit a coordinate and turn, and still a useful bound
            assert (up - low)[:20].mean() < 0.8 * (np.linalg.norm(anchors[:20], axis=1)[:, None] * np.linalg.norm(rows, axis=1)).mean()
    x = rng.standard_normal((4, width))
    assert np.allclose(np.linalg.norm(turns.turn(x), axis=1) ** 2, hardneg.ROTATIONS * (x ** 2).sum(axis=1))
    y = rng.standard_normal((4, turns.bits))
    assert np.allclose((turns.turn(x) * y).sum(axis=1), (turns.back(y) * x).sum(axis=1))


def test_pruning_spares_far_rows():
    """Of clustered rows most are never scored."""
    rng = np.random.default_rng(8)
    rows = np.rint(rng.choice([-90.0, 90.0], (40, 64))[rng.integers(0, 40, 2000)] + rng.normal(0, 4, (2000, 64))).astype(np.int64)
    turns, scored = hardneg.Turns(64), []
    asked = hardneg.Asked(rows[:1], turns)
    centre, codes, about = hardneg.encode(rows, turns)
    low, up = asked.intervals(slice(0, 1), centre, codes, about)

    def score(at):
        scored.append(len(at))
        return rows[at] @ rows[0]

    (ids, values), = hardneg.pick(score, low[0], up[0], np.arange(2000), np.arange(2000) > 0, [(-np.inf, np.inf)], 5)
    exact = rows[1:] @ rows[0]
    assert values.tolist() == sorted(exact.tolist(), reverse=True)[:5] and sum(scored) < 400


# --- filter audit -----------------------------------------------------------------------------------

def plain_audit(docs, labels):
    fails = []
    for r in docs:
        text, ws = r.text or "", plain_words(r.text)
        fails.append({"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                      "D": any(c in "#$%&*|" for c in text),
                      "E": r.doc_id is not None and any(q.doc_id is not None and q.doc_id < r.doc_id and (q.text or "") == text for q in docs)})
    good, bad = ({x.doc_id for x in labels if x[c] == 1 and x.doc_id is not None} for c in ("quality", "toxic"))
    out, parts = {}, {r.source or "" for r in docs}
    for part in parts:
        own = [(r.doc_id, f) for r, f in zip(docs, fails) if (r.source or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [i for i, f in left if f[k]]
                left = [x for x in left if not x[1][k]]
                share[k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[k] for _, f in own) - len(gone), sum(f[k] and sum(f.values()) == 1 for _, f in own),
                                                   sum(i in good for i in gone), sum(i in bad for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit(spark, docs, clashing):
    rng = random.Random(2)
    more = [(100 + k, words(rng, n) + tail, "en", f"s{k % 2}", 0) for k, (n, tail) in enumerate(
        [(300, ""), (300, " | x"), (250, " ABC" * 60), (199, ""), (200, "$"), (220, " #A" * 30), (30, "A" * 50), (260, "")] * 2)]
    more += [(200 + k, more[0][1], "en", "s0", 0) for k in range(40)] + [(200, more[0][1], "en", None, 0), (None, more[0][1], "en", "s0", 0), (300, ("pa do " * 300), "en", "", 0)]
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    labels = spark.createDataFrame([(i, (1, 0, None)[i % 3], i % 2) for i in range(0, 320, 2)] + [(40, 1, 1), (40, 0, 0), (101, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    want = plain_audit(every.collect(), labels.collect())
    assert sorted(map(tuple, audit.audit(every, labels).collect())) == want
    odd = every.withColumns({n: F.lit("mine") for n in ("part", "mask", "digest", "good", "removed", "first")})
    assert sorted(map(tuple, audit.audit(odd, labels).collect())) == want


def test_audit_empty(spark, empty_docs, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty_docs, none).count() == 0
    lost = audit.audit(docs, none).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(lost) == (0, 0, 600 * 6)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_shapley_of_any_game(n):
    rng = random.Random(n)
    values = [0] + [rng.randint(-50, 50) for _ in range((1 << n) - 1)]
    orders = list(permutations(range(n)))
    want = [Fraction(0)] * n
    for order in orders:
        before = 0
        for k in order:
            want[k] += Fraction(values[before | 1 << k] - values[before], len(orders))
            before |= 1 << k
    assert audit.shapley(values, n) == want
