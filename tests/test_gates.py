"""State machines, NULL inputs first."""

from __future__ import annotations

from pyspark.sql import functions as F

from mineralis.operators import campaign as P
from mineralis.operators import catalogue as C
from mineralis.operators import ensemble as N
from mineralis.operators import graph as G
from mineralis.operators import quality as Q


def _row(spark, column):
    return spark.range(1).select(column.alias("g")).first().g


def test_connectivity_gate(spark):
    def run(has, n, examined):
        ex = F.lit(None).cast("array<string>") if examined is None else F.array(*[F.lit(e) for e in examined]).cast("array<string>")
        g = _row(spark, Q.connectivity_gate(F.lit(has), F.lit(n), ex))
        return g.state, g.confident, g["pass"]

    assert run(False, 0, None) == ("not_run", False, None)
    assert run(True, 0, None) == ("ambiguous", False, None)
    assert run(True, 0, []) == ("vacuous", True, None)
    assert run(True, 0, ["Si"]) == ("derived", True, True)
    assert run(True, 2, []) == ("derived", True, False)
    assert run(True, 2, None) == ("derived", True, False)


def test_hull_gate(spark):
    def run(has, state, error, e, tol):
        text = lambda v: F.lit(v).cast("string")
        g = _row(spark, Q.hull_gate(F.lit(has), text(state), text(error), F.lit(e).cast("double"), tol))
        return g.state, g["pass"]

    assert run(False, None, None, None, 0.1) == ("not_run", None)
    assert run(True, None, "boom", None, 0.1) == ("not_run", None)
    assert run(True, "ambiguous", "gap", 0.0, 0.1) == ("ambiguous", None)
    assert run(True, "derived", None, None, 0.1) == ("not_run", None)
    assert run(True, None, None, 0.05, None) == ("derived", None)
    assert run(True, None, None, 0.05, 0.1) == ("derived", True)
    assert run(True, None, None, 0.15, 0.1) == ("derived", False)


def test_sqs_gate(spark):
    def run(has, mode, source):
        g = _row(spark, Q.sqs_gate(F.lit(has), F.lit(mode).cast("string"), F.lit(source)))
        return g.state, g["pass"]

    assert run(False, None, "engine-lowest") == ("not_run", None)
    assert run(True, None, "engine-lowest") == ("vacuous", None)
    assert run(True, "random", "engine-lowest") == ("derived", True)
    assert run(True, "clustered", "engine-lowest") == ("derived", False)
    assert run(True, "dispersed", "engine-repick") == ("derived", True)


def test_orbit_labels(spark):
    def run(*a):
        return _row(spark, G.orbit_label(*[F.lit(v) for v in a]))

    assert run(1, 1.0, False, False, 1.0, 1) == "O" and run(1, 0.5, False, False, 0.5, 1) == "V"
    assert run(2, 1.0, False, False, 1.0, 2) == "S" and run(2, 0.9, False, False, 0.9, 2) == "SV"
    assert run(1, 0.5, True, False, 1.0, 1) == "P" and run(1, 0.4, True, False, 0.8, 1) == "VP"
    assert run(2, 0.5, True, False, 1.0, 2) == "SP" and run(2, 0.4, True, False, 0.8, 2) == "SVP"
    assert run(1, 0.5, False, True, 1.0, 1) == "P" and run(1, 0.5, True, True, 0.8, 2) == "SVP"


SAMPLE = "entry long, ord long, label string, mode string, valid boolean, energy double"


def test_ship_candidates_and_shape(spark):
    rows = [(1, 1, "a", "clustered", True, -5.0), (1, 2, "b", "random", True, -4.0), (1, 3, "c", "random", False, None),
            (2, 1, "a", "clustered", True, -5.0), (2, 2, "b", "dispersed", True, -6.0), (3, 1, "a", "random", False, None)]
    s = spark.createDataFrame(rows, SAMPLE)
    assert sorted((r.entry, r.label) for r in N.ship_candidates(s).collect()) == [(1, "b"), (2, "a"), (2, "b")]
    assert {r.entry: r.label for r in N.representative(s).collect()} == {1: "b", 2: "b"}
    assert {(r.entry, r.mode): r.margin_mev for r in N.bracket_margins(s).collect()} == {
        (1, "clustered"): -1000.0, (2, "clustered"): 1000.0, (2, "dispersed"): 0.0}
    one = N.distribution_shape(spark.createDataFrame([(9, 1, "a", "random", True, -1.0)], SAMPLE)).first()
    assert one["shape"] is None and one.read_available is False
    # one unfavourable configuration in a tight pack
    pack = [(1, k, "x", "random", True, -1.0 + e) for k, e in enumerate((0.0, 0.001, 0.002, 0.05))]
    assert N.distribution_shape(spark.createDataFrame(pack, SAMPLE)).first()["shape"] == "tight+outlier"


def test_review_null_is_unreviewed(spark):
    rows = [(1, 1, "revise", "blocking", "x"), (1, 2, "confirm", None, None), (2, 1, "confirm", "blocking", "y"), (3, 1, "confirm", "minor", "z")]
    r = {x.entry: x for x in Q.review_ledger(spark.createDataFrame(rows, "entry long, round int, verdict string, severity string, issue string")).collect()}
    assert (r[1].n_rounds, r[1].final_verdict, r[1].n_unresolved, r[1].verdict_warning) == (2, "confirm", 0, False)
    assert (r[2].n_unresolved, r[2].unresolved, r[2].verdict_warning) == (1, "y", True)
    assert r[3].n_unresolved == 0 and 4 not in r


def test_ledger_rules(spark):
    rows = [(1, "a", "error"), (2, "a", "completed"), (3, "b", "completed"), (4, "b", "error"), (5, "c", "ok"), (6, "", "skipped"), (7, "d", "declined")]
    df = spark.createDataFrame(rows, "seq long, file string, status string")
    for c in ("stage", "error", "verdict"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    for shuffled in (df, df.repartition(5, "seq"), df.orderBy(F.desc("seq"))):
        last = P.ledger_last(shuffled)
        assert sorted(r.file for r in P.ledger_done(last).collect()) == ["a", "c", "d"]
        assert {r.status: r.n_structures for r in P.ledger_counts(last).collect()} == {
            "completed": 1, "error": 1, "ok": 1, "skipped": 1, "declined": 1, "total": 5}


def test_arguments(spark):
    assert C.normalize_chemsys("O-Fe--Al") == "Al-Fe-O"
    assert C.parse_elements("Li, La  Zr,O") == ["Li", "La", "Zr", "O"]
    df = spark.range(5)
    assert C.limit_rows(df, 0).count() == 5 and C.limit_rows(df, None).count() == 5 and C.limit_rows(df, 2).count() == 2


def test_charge_gate_stored(spark):
    g = _row(spark, Q.charge_gate_legacy(F.lit(None).cast("double")))
    assert g.state == "vacuous" and g["pass"] is None
    assert _row(spark, Q.charge_gate_legacy(F.lit(0.2)))["pass"] is True
    assert _row(spark, Q.charge_gate_legacy(F.lit(-0.4)))["pass"] is False


def test_content_key_ignores_the_sign_of_zero(spark):
    a = N.content_key(F.lit("t"), F.array(F.lit("Fe")), F.array(F.lit(0.0), F.lit(1.0)))
    b = N.content_key(F.lit("t"), F.array(F.lit("Fe")), F.array(F.lit(-0.0), F.lit(1.0000000001)))
    assert _row(spark, a) == _row(spark, b)
