"""Gates, review, record assembly and audit. Unknown is never a pass: ``pass`` stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CHARGE_TOL, CONFIDENT_STATES, FIDELITY_TOL, GATES, ON_HULL_TOL, PROBE_MODES,
                         RECORD_VERSION)
from ..functions.text import let


def gate(state: Column, ok: Column, basis: Column) -> Column:
    """One gate: state, confidence derived from it, three-valued verdict, basis."""
    return F.struct(state.alias("state"), state.isin(*CONFIDENT_STATES).alias("confident"),
                    ok.cast("boolean").alias("pass"), basis.alias("basis"))


# ---- charge -------------------------------------------------------------------------------------

def charge_gate(composition: DataFrame, oxidation: DataFrame, elements: DataFrame,
                override: DataFrame | None = None, tol: float = CHARGE_TOL) -> DataFrame:
    """Charge with one valence allowed to float.

    ``composition``: structure_id, element, n; ``oxidation``: structure_id, element, oxidation,
    n_states. One row per structure carries its elements, so the list is bounded by the periodic
    table. The first candidate whose implied valence is in range wins, else the first candidate.
    """
    keys = ["structure_id", "element"]
    known = composition.join(oxidation.select(*keys, "oxidation", "n_states"), keys, "left")
    if override is not None:
        known = known.join(override.select("element", F.col("state").cast("double").alias("forced")), "element", "left")
        known = known.withColumn("oxidation", F.coalesce("forced", "oxidation")).withColumn(
            "n_states", F.when(F.col("forced").isNotNull(), 1).otherwise(F.col("n_states")))
        changed = F.bool_or(F.col("forced").isNotNull())
    else:
        changed = F.bool_or(F.lit(False))
    ranged = known.join(elements.select(F.col("symbol").alias("element"), "ox_low", "ox_high"), "element", "left")
    multi = (F.col("n_states") > 1) | (F.abs(F.col("oxidation") - F.bround("oxidation")) > 1e-6)
    rows = ranged.select("structure_id", "element", "n", F.coalesce("oxidation", F.lit(0.0)).alias("ox"),
                         F.coalesce(multi & (F.col("n") > 0) & F.col("ox_low").isNotNull(), F.lit(False)).alias("multi"),
                         "ox_low", "ox_high", *(["forced"] if override is not None else []))
    packed = rows.groupBy("structure_id").agg(
        F.sort_array(F.collect_list(F.struct("element", "n", "ox", "multi", "ox_low", "ox_high"))).alias("terms"),
        changed.alias("overridden"))
    q = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["n"] * t["ox"])
    judged = packed.withColumn("q", q)
    cands = F.transform(F.filter("terms", lambda t: t["multi"]), lambda t: let(
        -(F.col("q") - t["n"] * t["ox"]) / t["n"],
        lambda v: F.struct(t["element"].alias("element"), v.alias("implied"),
                           v.between(t["ox_low"] - 1e-9, t["ox_high"] + 1e-9).alias("fits"))))
    judged = judged.withColumn("cands", cands)
    best = F.coalesce(F.get(F.filter("cands", lambda c: c["fits"]), F.lit(0)), F.get("cands", F.lit(0)))
    judged = judged.withColumn("best", best)
    neutral = F.abs(F.col("q")) < tol
    floats = F.coalesce(F.col("best.fits"), F.lit(False))
    return judged.select(
        "structure_id", F.round("q", 3).alias("q_per_cell"), (neutral | floats).alias("pass"),
        F.when(neutral, F.when(F.col("overridden"), "neutral(mean, override)").otherwise("neutral(mean)"))
        .when(floats, "neutral(valence-float)").otherwise("charge-unresolved").alias("mode"),
        F.when(~neutral, F.col("best.element")).alias("multivalent"),
        F.when(~neutral, F.round("best.implied", 3)).alias("implied_valence"))


def charge_gate_legacy(q: Column, tol: float = CHARGE_TOL) -> Column:
    """Stored charge only; a missing charge is an absence, not a failure."""
    return gate(F.when(q.isNull(), "vacuous").otherwise("derived"), F.abs(q) < tol, F.lit("stored charge"))


# ---- fidelity -----------------------------------------------------------------------------------

def fidelity_recipe(entries: DataFrame, states: DataFrame, tol: float = FIDELITY_TOL) -> DataFrame:
    """Largest difference between realised and intended fractions.

    ``states``: entry, n_groups, prob, target; an entry without a recipe is vacuous.
    """
    dev = states.groupBy("entry").agg(F.round(F.max(F.abs(
        F.coalesce("target", F.lit(0)) / F.greatest("n_groups", F.lit(1)) - F.col("prob"))), 4).alias("max_deviation"))
    return entries.select("entry").join(dev, "entry", "left").select(
        "entry", "max_deviation", F.when(F.col("max_deviation").isNull(), "vacuous").otherwise("derived").alias("state"),
        (F.col("max_deviation") <= tol).alias("pass"))


def fidelity_composition(adopted: DataFrame, nominal: DataFrame) -> DataFrame:
    """Largest element-fraction difference between two compositions: structure_id, element, n."""
    def fractions(df, name):
        total = df.groupBy("structure_id").agg(F.sum("n").alias("total"))
        return df.join(total, "structure_id").select("structure_id", "element", (F.col("n") / F.col("total")).alias(name))

    both = fractions(adopted, "a").join(fractions(nominal, "b"), ["structure_id", "element"], "full")
    return both.groupBy("structure_id").agg(
        F.round(F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), 4).alias("max_deviation"))


# ---- structural, sampling and hull gates --------------------------------------------------------

def connectivity_gate(has_audit: Column, n_defects: Column, examined: Column) -> Column:
    """``examined``: array of centres; empty means nothing was there, NULL means not reported. A
    defect fails whatever the coverage."""
    state = (F.when(~has_audit, "not_run").when(n_defects > 0, "derived").when(F.size(examined) > 0, "derived")
             .when(examined.isNotNull(), "vacuous").otherwise("ambiguous"))
    ok = (F.when(~has_audit, None).when(n_defects > 0, False).when(examined.isNotNull() & (F.size(examined) > 0), True))
    basis = (F.when(~has_audit, "no audit supplied").when((n_defects > 0) | (F.size(examined) > 0), "audit of the shipped frame")
             .when(examined.isNotNull(), "audit ran; no centre here").otherwise("coverage not reported"))
    return gate(state, ok, basis)


def sqs_gate(has_lowest: Column, mode: Column, source: Column) -> Column:
    """Fails only when the shipped engine-lowest is a bracket probe."""
    state = F.when(~has_lowest, "not_run").when(mode.isNull(), "vacuous").otherwise("derived")
    ok = (F.when(~has_lowest | mode.isNull(), None).when(source != "engine-lowest", True)
          .otherwise(~mode.isin(*PROBE_MODES)))
    basis = (F.when(~has_lowest, "no distribution").when(mode.isNull(), "no enumeration ran")
             .when(source != "engine-lowest", F.concat(F.lit("set aside; shipped "), source))
             .otherwise(F.concat(F.lit("shipped the lowest, mode "), mode)))
    return gate(state, ok, basis)


def hull_state(state: Column, error: Column) -> Column:
    """State of a hull artefact; old ones without a state are read from their error."""
    return F.coalesce(state, F.when(error.isNotNull(), "not_run").otherwise("derived"))


def hull_gate(has_hull: Column, state: Column, error: Column, e_hull: Column, tol: float | None = None) -> Column:
    """Judged only when a tolerance is set; otherwise the number is reported and ``pass`` is NULL."""
    inferred = hull_state(state, error)
    out = (F.when(~has_hull, "not_run").when(inferred == "not_run", "not_run").when(inferred != "derived", "ambiguous")
           .when(e_hull.isNull(), "not_run").otherwise("derived"))
    ok = F.lit(None).cast("boolean") if tol is None else F.when(out == "derived", e_hull <= tol)
    basis = (F.when(~has_hull, "no hull supplied").when(inferred != "derived", F.concat_ws(": ", inferred, error))
             .when(e_hull.isNull(), "no energy above hull").otherwise(F.format_string("%.3f eV/atom above hull", e_hull)))
    return gate(out, ok, basis)


def below_reference_hull(e_hull: Column) -> Column:
    return e_hull < -ON_HULL_TOL


def hull_block(has_hull: Column, state: Column, error: Column, e_hull: Column) -> Column:
    """Stored hull values: NULL only when the stage was not run; the energy only when derived."""
    inferred = hull_state(state, error)
    return F.when(has_hull, F.struct(
        inferred.alias("state"), error.alias("reason"), F.when(inferred == "derived", e_hull).alias("e_above_hull"),
        F.when(inferred == "derived", below_reference_hull(e_hull)).alias("below_hull")))


def gate_word(g: Column) -> Column:
    return (F.when(g.isNull(), "absent").when(g["pass"], "pass").when(~g["pass"], "FAIL")
            .when(g["state"] == "derived", "reported").otherwise(F.coalesce(g["state"], F.lit("not_run"))))


def gate_class(g: Column) -> Column:
    return F.when(g["pass"], "ok").when(~g["pass"], "err").otherwise("unchecked")


# ---- review -------------------------------------------------------------------------------------

def review_ledger(rounds: DataFrame) -> DataFrame:
    """Rounds and objections -> one row per reviewed entry.

    ``rounds``: entry, round, verdict, severity, issue (one row per objection, NULL severity for a
    round without any). The last round decides; its blocking issues are counted and all listed, in the
    order of their text. What one review raises fits in a row.
    """
    blocking = F.coalesce(F.col("severity") == "blocking", F.lit(False))
    per_round = rounds.groupBy("entry", "round").agg(
        F.max("verdict").alias("verdict"), F.count("severity").alias("n_objections"), F.count_if(blocking).alias("n_blocking"))
    entry = per_round.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n_rounds"), F.sum("n_objections").alias("n_objections"), F.sum("n_blocking").alias("n_blocking"),
        F.max(F.struct("round", "verdict", "n_blocking")).alias("last"))
    last_issues = rounds.filter(blocking).join(
        entry.select("entry", F.col("last.round").alias("round")), ["entry", "round"], "left_semi")
    listed = last_issues.groupBy("entry").agg(F.array_join(F.sort_array(F.collect_list("issue")), ";").alias("unresolved"))
    unresolved = F.col("last.n_blocking")
    return entry.join(listed, "entry", "left").select(
        "entry", "n_rounds", "n_objections", "n_blocking", F.col("last.verdict").alias("final_verdict"),
        unresolved.alias("n_unresolved"), "unresolved",
        ((F.col("last.verdict") == "confirm") & (unresolved > 0)).alias("verdict_warning"))


def certification(reviewed: Column, n_unresolved: Column) -> Column:
    return F.when(~reviewed, "unreviewed").when(n_unresolved > 0, "declined").otherwise("certified")


# ---- record -------------------------------------------------------------------------------------

def representative_source(override_file: Column, pick_resolved: Column) -> Column:
    """An override is a structure built by hand and wins; a resolved pick is a frame of the engine's
    own ensemble; an unresolved pick never falls back silently, its reason is kept elsewhere."""
    return (F.when(override_file.isNotNull(), "custom-build").when(F.coalesce(pick_resolved, F.lit(False)), "engine-repick")
            .otherwise("engine-lowest"))


def sampling_shortfall(n_configs: Column, n_enumerated: Column) -> Column:
    return F.when((n_enumerated > 0) & (n_configs < n_enumerated),
                  F.format_string("%d/%d enumerated configs survived", n_configs, n_enumerated))


def record_flags(gates: Column, reviewed: Column, n_unresolved: Column, verdict: Column, escalate: Column,
                 pick_unresolved: Column, missing_judgment: Column) -> Column:
    """array<struct<flag, severity>>: what an index page must show without a click."""
    def gate_flag(name):
        g = gates[name]
        return (F.when(g.isNull(), F.struct(F.lit(f"{name} absent").alias("flag"), F.lit(1).alias("severity")))
                .when(~g["pass"], F.struct(F.lit(f"{name} FAILS").alias("flag"), F.lit(2).alias("severity")))
                .when(g["pass"].isNull() & ~F.coalesce(g["state"] == "derived", F.lit(False)),
                      F.struct(F.concat(F.lit(f"{name} "), F.coalesce(g["state"], F.lit("not_run"))).alias("flag"), F.lit(1).alias("severity"))))

    def flag(when, text, severity):
        return F.when(when, F.struct(text.alias("flag"), F.lit(severity).alias("severity")))

    return F.array_compact(F.array(
        *[gate_flag(g) for g in GATES],
        flag(escalate, F.lit("ESCALATED"), 2),
        flag(~reviewed, F.lit("UNREVIEWED"), 1),
        flag(reviewed & (n_unresolved > 0), F.concat(F.lit("blocking objection ("), verdict, F.lit(")")), 2),
        flag(pick_unresolved, F.lit("pick unresolved"), 2),
        flag(missing_judgment, F.lit("judgment incomplete"), 1)))


def worst_severity(flags: Column) -> Column:
    return let(F.coalesce(F.array_max(F.transform(flags, lambda f: f["severity"])), F.lit(0)),
               lambda s: F.when(s == 2, "err").when(s == 1, "unchecked").otherwise("ok"))


def assemble_record(entries: DataFrame, **parts: DataFrame) -> DataFrame:
    """Chained left joins on ``entry``; each part becomes one struct column that is NULL when the
    stage did not run."""
    out = entries
    for name, part in parts.items():
        fields = [c for c in part.columns if c != "entry"]
        out = out.join(part.select("entry", F.struct(*fields).alias(name)), "entry", "left")
    return out


# ---- audit --------------------------------------------------------------------------------------

def record_union(judged: DataFrame, averaged: DataFrame) -> DataFrame:
    """Both record schemas in one listing."""
    return judged.withColumn("kind", F.lit(RECORD_VERSION)).unionByName(
        averaged.withColumn("kind", F.lit("deaverage")), allowMissingColumns=True)


def audit_view(records: DataFrame) -> DataFrame:
    """One row per record of either schema, with the text the search looks in."""
    title = F.coalesce("formula", "name")
    status = F.coalesce(F.when(F.col("kind") == RECORD_VERSION, F.col("certification")).otherwise(F.col("status")), F.lit("?"))
    return records.select(
        "entry", "kind", title.alias("title"), status.alias("status"), "verdict", "worst", "flags",
        F.lower(F.concat_ws(" ", title, "name", "verdict", "certification", "flags", "status")).alias("search_text"))


def audit_search(view: DataFrame, term: str = "", status: str = "all") -> DataFrame:
    """Case-insensitive substring and status filter."""
    term = (term or "").strip().lower()
    out = view.filter(F.contains("search_text", F.lit(term))) if term else view
    return out if status == "all" else out.filter(F.col("status") == status)


def campaign_tally(view: DataFrame) -> DataFrame:
    return view.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
