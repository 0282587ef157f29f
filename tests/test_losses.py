"""Cases in which rows or symbols must not be lost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mineralis.constants import element_table
from mineralis.operators import catalogue, quality
from mineralis.sources import readers


def test_symbols_outside_the_table_are_kept(spark):
    rows = [(1, "Ra", 1), (1, "Cl", 2), (2, "Am", 1), (2, "O", 2), (3, "Am", 4), (4, "D", 2), (4, "O", 1), (5, "Xx", 1), (5, "Fe", 3)]
    amounts = spark.createDataFrame(rows, "structure_id long, element string, n long").withColumn("min_occ", F.lit(1.0))
    got = {r.structure_id: (r.chemsys, r.n_elements, r.reduced_formula) for r in catalogue.chemistry_columns(amounts, element_table(spark)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("Cl-Ra", 2), 2: ("Am-O", 2), 3: ("Am", 1), 4: ("D-O", 2), 5: ("Fe-Xx", 2)}
    assert got[3][2] == "Am" and got[5][2] == "Fe3Xx"   # no electronegativity: last


def brute_siblings(rows):
    out = []
    for i, key, sg, ordered in rows:
        hits = sorted((s != sg, j) for j, k, s, o in rows if key is not None and k == key and j != i and o)
        out.append((i, len(hits) if key is not None else None, hits[0][1] if hits else None,
                    "not searched" if key is None else "none" if not hits else "other-SG" if hits[0][0] else "same-SG"))
    return sorted(out, key=repr)


def test_siblings_with_unknown_space_groups_and_repeated_ids(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(60), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), rng.random() < 0.5) for _ in range(120)]
    # an id names one key and space group, whatever rows repeat it
    rows = [(i, ["a", "b", "c", None][i % 4], [None, 1, 2][i % 3], o) for i, _, _, o in rows]
    rows += [(100, "d", None, True), (101, "d", 1, False), (102, "e", None, True), (103, "e", None, True), (104, "e", 2, True)]
    table = spark.createDataFrame(rows, "id long, sibling_key string, spacegroup_number int, is_ordered boolean")
    got = sorted(((r.id, r.n_siblings, r.best_sibling, r.sibling) for r in catalogue.sibling_search(table).collect()), key=repr)
    assert got == brute_siblings(rows)


def test_all_unresolved_issues_are_listed(spark):
    rows = [(1, 1, "decline", "blocking", f"issue {k:02d}") for k in range(25)] + [(2, 1, "confirm", None, None)]
    got = {r.entry: r for r in quality.review_ledger(spark.createDataFrame(rows, "entry long, round int, verdict string, severity string, issue string")).collect()}
    assert got[1].n_unresolved == 25 and len(got[1].unresolved.split(";")) == 25
    assert got[2].n_unresolved == 0


def test_frames(spark):
    good = "2\nE=-1 key=a\nFe 0 0 0\nO 0 0 1\n"
    texts = {
        "good": good + good, "comment": "1\n7\nFe 0 0 0\n" + good, "torn": good + "3\nc\nFe 0 0 0\n" + good,
        "end": good + "2\nc\nFe 0 0 0\n", "junk": good + "junk\n" + good, "empty": "", "zero": "0\nc\n" + good,
        "open": good + "1\nc\nFe 0 0 0"}
    frames = readers.scan_frames(spark.createDataFrame(list(texts.items()), "file string, text string"))
    got = {}
    for r in frames.orderBy("file", "frame_index").collect():
        got.setdefault(r.file, []).append((r.n_atoms, r.comment, len(r.atoms)))
    two = (2, "E=-1 key=a", 2)
    assert got == {"good": [two, two], "comment": [(1, "7", 1), two], "torn": [two], "end": [two], "junk": [two], "zero": [(0, "c", 0), two], "open": [two]}
