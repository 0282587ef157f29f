"""Canonical formulas from formula texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mineralis.functions import text as X


def test_canonical_formulas(spark):
    want = {
        "O2": "O2", "O4": "O2", "O": "O2", "N3": "N2", "H1": "H2", "Cl8": "Cl2", "F": "F2", "Fe4": "Fe", "Na O": "Na2O2", "Li4 O4": "Li2O2", "H2 O2": "H2O2",
        "Ca1 O2 H2": "Ca(HO)2", "Ca6 P4 O16": "Ca3(PO4)2", "Al2 S3 O12": "Al2(SO4)3", "N2 H8 S1 O4": "H8S(NO2)2", "Fe2 O3": "Fe2O3", "H4 O2": "H2O",
        "Na1 Cl1 O4": "NaClO4", "Mg2 Cl4 O2": "MgCl2O", "La2 O2 S1": "La2SO2", "Sr1 Ti1 O3": "SrTiO3", "Ti2 Sr2 O6": "SrTiO3",
        "Li0.95 Mn2 O4": "Li0.95Mn2O4", "O1.5 Fe1": "Fe1O1.5", "Fe0.333 O1": "Fe0.333O1", "Fe2. O3.": "Fe2O3", "Xx2 O4": "O2Xx", "Fe0 O2": "O2",
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.f for r in rows.select("t", X.reduced_formula(X.composition_terms(X.parse_composition(F.col("t"), isotopes=False))).alias("f")).collect()}
    assert got == want


def test_parse_entry_gives_the_formula(spark):
    texts = [("x_1.cif", "_chemical_formula_sum 'Ca1 O2 H2'\n"), ("x_2.cif", "_chemical_formula_sum O2\n"), ("x_3.cif", "data\n"), ("x_4.cif", None)]
    rows = {int(r.filename[2]): (r.reduced_formula, r.elements, r.chemsys) for r in X.parse_entry(spark.createDataFrame(texts, "filename string, text string")).collect()}
    assert rows == {1: ("Ca(HO)2", ["Ca", "H", "O"], "Ca-H-O"), 2: ("O2", ["O"], "O"), 3: (None, None, None), 4: (None, None, None)}
