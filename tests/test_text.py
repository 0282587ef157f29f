from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from mineralis.functions import text as X
from mineralis.sources import readers as R
from mineralis.sources import writers as W

ENTRY = """data_x
_chemical_formula_sum
;
Li2 O1
H2 D1
;
_cell_length_a 5.43(2)
_cell_length_b abc
_cell_angle_alpha 90.
_citation_title
 'A title'
_empty .
_block
;
first
 second
;
_next
_other 3
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_occupancy
Li1 0.5 0.97(3)
'O 1' 0.25 1.0
short 1
Bad 0.1 x
# end
loop_
_solo
"""


def _one(spark, column):
    return spark.createDataFrame([("icsd", ENTRY)], "filename string, text string").select(column.alias("v")).first().v


def test_scalars(spark):
    t = F.col("text")
    assert _one(spark, X.extract_formula(t)) == "Li2 O1 H2 D1"
    assert _one(spark, X.extract_cell(t, "_cell_length_a")) == 5.43
    assert _one(spark, X.extract_cell(t, "_cell_length_b")) is None
    assert _one(spark, X.extract_cell(t, "_cell_angle_alpha")) == 90.0
    assert _one(spark, X.cif_scalar(t, "_citation_title")) == "A title"
    assert _one(spark, X.cif_scalar(t, "_empty")) is None
    assert _one(spark, X.cif_scalar(t, "_block")) == "first second"
    assert _one(spark, X.cif_scalar(t, "_next")) is None
    assert _one(spark, X.cif_scalar(t, "_absent")) is None
    assert _one(spark, X.cif_numeric(F.lit("'-1.5(2)'"))) == -1.5
    assert _one(spark, X.cif_numeric(F.lit("?"))) is None


def test_composition(spark):
    comp = X.parse_composition(F.lit("Li2 O1 H2 D1 Li0.5 Fe"))
    assert _one(spark, comp) == {"Fe": 1.0, "H": 3.0, "Li": 2.5, "O": 1.0}
    assert _one(spark, X.parse_composition(F.lit("H2 D1"), isotopes=False)) == {"D": 1.0, "H": 2.0}


def test_loops(spark):
    df = spark.createDataFrame([("a", ENTRY)], "filename string, text string")
    rows = X.cif_loops(df).orderBy("loop_no", "row_no").collect()
    assert [r["values"] for r in rows if r.loop_no == 0] == [["Li1", "0.5", "0.97(3)"], ["O 1", "0.25", "1.0"], ["short", "1"], ["Bad", "0.1", "x"]]
    assert [r["values"] for r in rows if r.loop_no == 1] == [None]
    # "'O 1' 0.25 1.0" splits into four blank separated tokens here, of which the third is no occupancy column
    assert _one(spark, X.min_site_occupancy(F.col("text"))) == 0.25


def test_unknown_is_not_ordered(spark):
    df = spark.createDataFrame([("a", "no loop"), ("b", None), ("c", ENTRY)], "filename string, text string")
    rows = {r.filename: r for r in X.parse_entry(df).collect()}
    assert rows["a"].is_disordered is None and rows["a"].parse_error is None
    assert rows["b"].is_disordered is None and rows["b"].parse_error == "read failed"
    assert rows["c"].is_disordered is True


def test_zip_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(5):
            z.writestr(f"icsd_{k}.cif", f"data_{k}")
        z.writestr("readme.txt", "no")
    rows = R.scan_zip_archive(spark, str(tmp_path / "a.zip"), batch=2).orderBy("filename").collect()
    assert [(r.filename, r.text) for r in rows] == [(f"icsd_{k}.cif", f"data_{k}") for k in range(5)]


def test_directory_and_packed(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.cif").write_text("data_1\nx")
    rows = R.scan_text_directory(spark, str(tmp_path / "d")).collect()
    assert [(r.filename, r.text) for r in rows] == [("one.cif", "data_1\nx")]
    W.write_packed_text(spark.createDataFrame([("a", "1\n\n2"), ("b", "3")], "filename string, text string"), str(tmp_path / "p"))
    assert sorted((r.filename, r.text) for r in R.scan_packed_text(spark, str(tmp_path / "p")).collect()) == [("a", "1\n\n2"), ("b", "3")]


def test_frames_stop_at_torn_tail(spark):
    good = '1\nlabel=a E=-1.5 key=k1\nFe 0 0 0\n1\nlabel="b" E=-2 key=k1\nO 0 0 0\n'
    df = spark.createDataFrame([("f", good + "3\nlabel=c\nFe 0 0 0\n"), ("g", good[:-1]), ("h", "")], "file string, text string")
    frames = R.scan_frames(df)
    got = sorted((r.file, R_label(r.comment)) for r in frames.collect())
    assert got == [("f", "a"), ("f", "b"), ("g", "a")]
    assert [(r.key, r.energy) for r in R.scan_checkpoint(frames.filter("file = 'f'")).collect()] == [("k1", -2.0)]


def R_label(comment):
    return comment.split("label=")[1].split()[0].strip('"')


def test_ledger_torn_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"file":"a","status":"error","seq":1}\n\n{"file":"a","status":"completed","seq":2}\n{"file":"b","sta')
    rows = R.scan_ledger(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.status) for r in rows) == [("a", "completed"), ("a", "error")]


def test_record_discovery(spark, tmp_path):
    for name, file, text in (("a", "record.json", '{"gates":{}}'), ("a", "deaverage_output.json", '{"other":1}'),
                             ("b", "record.json", '{"status":"error"}'), ("c", "record.json", "{}")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / file).write_text(text)
    (tmp_path / "record.json").write_text('{"schema_version":"mar-1.0"}')
    best, rejected = R.discover_records(R.scan_record_files(spark, str(tmp_path)))
    assert sorted((r.dir, r.file, r.kind) for r in best.collect()) == sorted([
        (tmp_path.name, "record.json", "mar-1.0"), ("a", "record.json", "mar-1.0"), ("b", "record.json", "deaverage")])
    assert sorted((r.dir, r.file) for r in rejected.collect()) == [("a", "deaverage_output.json"), ("c", "record.json")]


def test_a_formula_is_read_once(spark):
    """The terms of a formula are found by one pair of patterns, not again for each element and column."""
    df = spark.createDataFrame([("entry_1.cif", "_chemical_formula_sum 'Fe2 O3 Fe'\n")], "filename string, text string")
    plan = X.parse_entry(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2, plan
    r = X.parse_entry(df).first()
    assert (r.chemsys, r.reduced_formula, r.formula_sum, r.parse_error) == ("Fe-O", "FeO", "Fe2 O3 Fe", None)


def test_only_loops_with_an_occupancy_are_taken_apart(spark):
    text = "loop_\n_Atom_Site_Occupancy\n_atom_site_fract_x\n0.5(1) 0\n0.25 0\nloop_\n_other\n0.1\n"
    df = spark.createDataFrame([(text,), ("loop_\n_other\n0.1\n",), (None,)], "text string")
    assert [tuple(r) for r in df.select(X.min_site_occupancy(F.col("text")), F.size(X.loops(F.col("text"), "_atom_site_occupancy"))).collect()] == [
        (0.25, 1), (None, 0), (None, None)]


def test_ensembles_are_packed(spark, tmp_path):
    """Files do not grow with the entries, records are bounded, and their parts follow each other in energy."""
    frames = spark.range(600).selectExpr(
        "id % 60 as entry", "cast((id * 37) % 11 as double) as energy", "concat('1\nE=', (id * 37) % 11, ' key=k', id, '\nFe 0 0 0') as frame")
    frames = frames.unionByName(spark.range(95).selectExpr("60 as entry", "cast(id % 7 as double) as energy", "concat('1\nE=', id % 7, ' key=h', id, '\nFe 0 0 0') as frame"))
    for rows_per_task in (1_000_000, 20):   # the second cuts the large entry at quantiles
        path = tmp_path / str(rows_per_task)
        W.write_ensemble(frames.repartition(3), str(path), frames_per_record=10, rows_per_task=rows_per_task)
        assert len(list(path.rglob("part-*"))) < 60
        got = R.scan_frames(R.scan_packed_text(spark, str(path)).withColumnRenamed("filename", "file")).orderBy("file", "frame_index").collect()
        by_entry = {}
        for r in got:
            by_entry.setdefault(int(r.file.split("#")[0]), []).append((r.file, float(r.comment.split()[0][2:]), r.comment.split("key=")[1]))
        assert len(by_entry) == 61 and {len(v) for k, v in by_entry.items() if k < 60} == {10} and len(by_entry[60]) == 95
        assert len({key for v in by_entry.values() for _, _, key in v}) == 695
        assert all([e for _, e, _ in v] == sorted(e for _, e, _ in v) for v in by_entry.values())
        assert len({file for file, _, _ in by_entry[60]}) == 10
