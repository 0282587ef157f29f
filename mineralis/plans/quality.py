"""Named queries over gates, reviews, records and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import GATES, RECORD_VERSION, element_table
from ..operators import evidence as E
from ..operators import quality as Q
from ..session import scratch_path
from ..sources import readers as R
from ..sources import writers as W
from . import views as V
from .registry import query


# ---- charge and fidelity ------------------------------------------------------------------------

def _composition(spark, sf):
    return V.amount(spark, sf).select("structure_id", "element", "n")


def _oxidation(spark, sf):
    return E.oxidation_states(V.valence(spark, sf)).withColumn("n_states", F.size("states"))


def _charge_sql(oxidation, n_states):
    return f"""with c as (select structure_id, element, n, coalesce({oxidation}, 0.0) as ox, ({n_states} > 1 or abs(({oxidation}) - round_even({oxidation}, 0)::double) > 1e-6) as multi, ox_low, ox_high
        from v_amount left join v_oxidation using (structure_id, element) left join el on symbol = element),
      s as (select structure_id, sum(n * ox) as q from c group by 1),
      k as (select structure_id, element, q, -(q - n * ox) / n as implied, -(q - n * ox) / n between ox_low - 1e-9 and ox_high + 1e-9 as fits
            from c join s using (structure_id) where multi and n > 0 and ox_low is not null),
      b as (select * from k qualify row_number() over (partition by structure_id order by (not fits), element) = 1)
      select structure_id, round(s.q, 3) as q_per_cell, abs(s.q) < 0.3 or coalesce(fits, false) as pass,"""


@query("charge_gate", _charge_sql("oxidation", "n_states") + """ case when abs(s.q) < 0.3 then 'neutral(mean)' when coalesce(fits, false) then 'neutral(valence-float)' else 'charge-unresolved' end as mode,
       case when abs(s.q) >= 0.3 then element end as multivalent, case when abs(s.q) >= 0.3 then round(implied, 3) end as implied_valence from s left join b using (structure_id)""",
       ("v_amount", "v_oxidation", "el"))
def _(spark, sf):
    return Q.charge_gate(_composition(spark, sf), _oxidation(spark, sf), element_table(spark))


@query("charge_gate_override", _charge_sql("case element when 'Fe' then 2.5 when 'Mn' then 4.0 else oxidation end", "case when element in ('Fe', 'Mn') then 1 else n_states end") + """
       case when abs(s.q) < 0.3 then case when exists (select 1 from c where c.structure_id = s.structure_id and element in ('Fe', 'Mn')) then 'neutral(mean, override)' else 'neutral(mean)' end
            when coalesce(fits, false) then 'neutral(valence-float)' else 'charge-unresolved' end as mode,
       case when abs(s.q) >= 0.3 then element end as multivalent, case when abs(s.q) >= 0.3 then round(implied, 3) end as implied_valence from s left join b using (structure_id)""",
       ("v_amount", "v_oxidation", "el"))
def _(spark, sf):
    override = F.broadcast(spark.createDataFrame([("Fe", 2.5), ("Mn", 4.0)], "element string, state double"))
    return Q.charge_gate(_composition(spark, sf), _oxidation(spark, sf), element_table(spark), override)


@query("fidelity_recipe", """with st as (select structure_id as entry, o.n as n_groups, s.occ as prob, floor(o.n * s.occ) as target from
        (select structure_id, signature, count(*) as n, min(pos) as pos from v_psig where occ_total < 0.99 or n_species > 1 group by 1, 2) o join v_species s using (structure_id, pos)),
      d as (select entry, round(max(abs(target / n_groups - prob)), 4) as max_deviation from st group by 1)
      select o_orderkey as entry, max_deviation, case when max_deviation is null then 'vacuous' else 'derived' end as state, max_deviation <= 0.08 as pass from orders left join d on entry = o_orderkey""",
       ("v_psig", "v_species"))
def _(spark, sf):
    sites = E.site_signatures(V.species(spark, sf)).filter("is_disordered")
    states = E.orbit_index(sites).select(F.col("structure_id").alias("entry"), F.col("n_positions").alias("n_groups"), F.explode("species").alias("s")).select(
        "entry", "n_groups", F.col("s.occ").alias("prob"), F.floor(F.col("n_groups") * F.col("s.occ")).alias("target"))
    return Q.fidelity_recipe(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry")), states)


@query("fidelity_composition", """with a as (select structure_id, element, n / sum(n) over (partition by structure_id) as f from v_amount),
      b as (select structure_id, element, located / sum(located) over (partition by structure_id) as f from v_amount where element <> 'H')
      select structure_id, round(max(abs(coalesce(a.f, 0) - coalesce(b.f, 0))), 4) as max_deviation from a full join b using (structure_id, element) group by 1""", ("v_amount",))
def _(spark, sf):
    amounts = V.amount(spark, sf)
    return Q.fidelity_composition(amounts.select("structure_id", "element", "n"),
                                  amounts.filter("element <> 'H'").select("structure_id", "element", F.col("located").alias("n")))


# ---- artefacts of one entry, read from its order ------------------------------------------------

def artifact(spark, sf):
    o = V.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("entry"), F.col("o_orderstatus").alias("order_status"),
        F.when(k % 7 != 0, (c % 9 - 4) / 10.0).alias("q_legacy"),
        (k % 5 != 1).alias("has_audit"), F.when(k % 9 == 0, c % 3).otherwise(0).alias("n_defects"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("P"), F.lit("Si"))).alias("examined"),
        (k % 10 != 9).alias("has_lowest"),
        F.when(k % 5 == 1, "clustered").when(k % 5 == 2, "dispersed").when(k % 5 != 3, "random").alias("lowest_mode"),
        F.when(k % 13 == 0, "custom.vasp").alias("override_file"),
        F.when(k % 11 == 0, (k % 2 == 0)).alias("pick_resolved"),
        (k % 3 != 0).alias("has_hull"),
        F.when(k % 6 == 1, "derived").when(k % 6 == 2, "ambiguous").when(k % 6 == 5, "not_run").alias("hull_state"),
        F.when(k % 12 == 4, "fetch failed").alias("hull_error"), F.when(k % 7 != 1, (c % 40 - 5) / 100.0).alias("e_hull"),
        (k % 4 != 0).alias("reviewed"), F.when(k % 8 == 1, "revise").otherwise("confirm").alias("verdict"),
        F.when(k % 16 == 2, 1).otherwise(0).alias("n_unresolved"), (k % 37 == 0).alias("escalate"), (k % 41 == 0).alias("missing_judgment"),
        F.when(k % 3 == 0, c % 30).otherwise(30).cast("long").alias("n_configs"), F.when(k % 17 != 0, 30).cast("long").alias("n_enumerated"))


def gates(spark, sf):
    a = artifact(spark, sf).withColumn("source", Q.representative_source(F.col("override_file"), F.col("pick_resolved")))
    col = F.col
    all_gates = F.struct(
        Q.charge_gate_legacy(col("q_legacy")).alias("charge"),
        F.when(col("entry") % 19 != 0, Q.gate(F.lit("derived"), col("entry") % 6 != 0, F.lit("recipe"))).alias("fidelity"),
        Q.connectivity_gate(col("has_audit"), col("n_defects"), col("examined")).alias("connectivity"),
        Q.sqs_gate(col("has_lowest"), col("lowest_mode"), col("source")).alias("sqs"),
        Q.hull_gate(col("has_hull"), col("hull_state"), col("hull_error"), col("e_hull")).alias("hull"))
    return a.withColumn("gates", all_gates)


_ART = """art as (select o_orderkey as entry, o_orderstatus as order_status, o_orderkey as k, o_custkey as c,
      case when o_orderkey % 7 <> 0 then (o_custkey % 9 - 4) / 10.0::double end as q_legacy, o_orderkey % 5 <> 1 as has_audit,
      case when o_orderkey % 9 = 0 then o_custkey % 3 else 0 end as n_defects, case o_orderkey % 4 when 0 then null when 1 then 0 else 2 end as n_examined,
      o_orderkey % 10 <> 9 as has_lowest, case o_orderkey % 5 when 1 then 'clustered' when 2 then 'dispersed' when 3 then null else 'random' end as lowest_mode,
      case when o_orderkey % 13 = 0 then 'custom-build' when o_orderkey % 11 = 0 and o_orderkey % 2 = 0 then 'engine-repick' else 'engine-lowest' end as source,
      o_orderkey % 3 <> 0 as has_hull, case o_orderkey % 6 when 1 then 'derived' when 2 then 'ambiguous' when 5 then 'not_run' end as hstate,
      case when o_orderkey % 12 = 4 then 'fetch failed' end as herr, case when o_orderkey % 7 <> 1 then (o_custkey % 40 - 5) / 100.0::double end as e_hull,
      o_orderkey % 4 <> 0 as reviewed, case when o_orderkey % 8 = 1 then 'revise' else 'confirm' end as verdict, case when o_orderkey % 16 = 2 then 1 else 0 end as n_unresolved,
      o_orderkey % 37 = 0 as escalate, o_orderkey % 41 = 0 as missing_judgment,
      case when o_orderkey % 11 = 0 and o_orderkey % 2 = 1 then true else false end as pick_unresolved from orders),
    g as (select *, case when q_legacy is null then 'vacuous' else 'derived' end as charge_state, abs(q_legacy) < 0.3 as charge_pass,
      case when k % 19 <> 0 then 'derived' end as fidelity_state, case when k % 19 <> 0 then k % 6 <> 0 end as fidelity_pass,
      case when not has_audit then 'not_run' when n_defects > 0 then 'derived' when n_examined > 0 then 'derived' when n_examined = 0 then 'vacuous' else 'ambiguous' end as connectivity_state,
      case when not has_audit then null when n_defects > 0 then false when n_examined > 0 then true end as connectivity_pass,
      case when not has_lowest then 'not_run' when lowest_mode is null then 'vacuous' else 'derived' end as sqs_state,
      case when not has_lowest or lowest_mode is null then null when source <> 'engine-lowest' then true else lowest_mode = 'random' end as sqs_pass,
      coalesce(hstate, case when herr is not null then 'not_run' else 'derived' end) as hull_inferred from art),
    gg as (select *, case when not has_hull then 'not_run' when hull_inferred = 'not_run' then 'not_run' when hull_inferred <> 'derived' then 'ambiguous'
                          when e_hull is null then 'not_run' else 'derived' end as hull_state, null::boolean as hull_pass from g)"""


def _gate_query(name):
    @query(f"{name}_gate" if name != "charge" else "charge_gate_legacy",
           f"with {_ART} select entry, {name}_state as state, {name}_state in ('derived', 'overridden', 'vacuous') as confident, {name}_pass as pass from gg")
    def _(spark, sf, name=name):
        return gates(spark, sf).select("entry", f"gates.{name}.state", f"gates.{name}.confident", f"gates.{name}.pass")


for _name in ("charge", "connectivity", "sqs", "hull"):
    _gate_query(_name)


@query("hull_gate_tolerance", f"with {_ART} select entry, hull_state as state, case when hull_state = 'derived' then e_hull <= 0.1 end as pass from gg")
def _(spark, sf):
    g = Q.hull_gate(F.col("has_hull"), F.col("hull_state"), F.col("hull_error"), F.col("e_hull"), tol=0.1)
    return artifact(spark, sf).select("entry", g.alias("g")).select("entry", "g.state", "g.pass")


@query("hull_block", f"""with {_ART} select entry, case when has_hull then hull_inferred end as state, case when has_hull then herr end as reason,
       case when has_hull and hull_inferred = 'derived' then e_hull end as e_above_hull, case when has_hull and hull_inferred = 'derived' then e_hull < -0.001 end as below_hull from g""")
def _(spark, sf):
    b = Q.hull_block(F.col("has_hull"), F.col("hull_state"), F.col("hull_error"), F.col("e_hull"))
    return artifact(spark, sf).select("entry", b.alias("b")).select("entry", "b.state", "b.reason", "b.e_above_hull", "b.below_hull")


@query("gate_word", f"""with {_ART} select word, cls, count(*) as n from (
       select case when fidelity_state is null then 'absent' when fidelity_pass then 'pass' else 'FAIL' end as word, case when fidelity_pass then 'ok' when not fidelity_pass then 'err' else 'unchecked' end as cls from gg
       union all select case when hull_state = 'derived' then 'reported' else hull_state end, 'unchecked' from gg
       union all select case when connectivity_pass then 'pass' when not connectivity_pass then 'FAIL' else connectivity_state end, case when connectivity_pass then 'ok' when not connectivity_pass then 'err' else 'unchecked' end from gg)
       group by 1, 2""")
def _(spark, sf):
    named = gates(spark, sf).select(F.explode(F.array(*[
        F.struct(Q.gate_word(F.col(f"gates.{n}")).alias("word"), Q.gate_class(F.col(f"gates.{n}")).alias("cls"))
        for n in ("fidelity", "hull", "connectivity")])).alias("w"))
    return named.groupBy("w.word", "w.cls").agg(F.count(F.lit(1)).alias("n"))


@query("gate_class", f"""with {_ART} select entry, case when connectivity_pass then 'ok' when not connectivity_pass then 'err' else 'unchecked' end as connectivity,
       case when sqs_pass then 'ok' when not sqs_pass then 'err' else 'unchecked' end as sqs from gg""")
def _(spark, sf):
    return gates(spark, sf).select("entry", *[Q.gate_class(F.col(f"gates.{n}")).alias(n) for n in ("connectivity", "sqs")])


@query("representative_source", f"with {_ART} select entry, source from art")
def _(spark, sf):
    return gates(spark, sf).select("entry", "source")


@query("sampling_shortfall", """select o_orderkey as entry, case when o_orderkey % 17 <> 0 and o_orderkey % 3 = 0 then (o_custkey % 30) || '/30 enumerated configs survived' end as shortfall from orders""")
def _(spark, sf):
    return artifact(spark, sf).select("entry", Q.sampling_shortfall(F.col("n_configs"), F.col("n_enumerated")).alias("shortfall"))


# ---- review -------------------------------------------------------------------------------------

_REVIEW = """pr as (select entry, round, max(verdict) as verdict, count(*) as n_obj, count(*) filter (severity = 'blocking') as nb from v_review group by 1, 2),
   lastr as (select * from pr qualify row_number() over (partition by entry order by round desc) = 1),
   totals as (select entry, count(*) as n_rounds, sum(n_obj)::bigint as n_objections, sum(nb)::bigint as n_blocking from pr group by 1),
   iss as (select v.entry, string_agg(issue, ';' order by issue) as unresolved from v_review v join lastr l on l.entry = v.entry and l.round = v.round where severity = 'blocking' group by 1),
   rev as (select t.entry, n_rounds, n_objections, n_blocking, verdict as final_verdict, nb as n_unresolved, unresolved, verdict = 'confirm' and nb > 0 as verdict_warning
           from totals t join lastr using (entry) left join iss using (entry))"""


@query("review_ledger", f"with {_REVIEW} select * from rev", ("v_review",))
def _(spark, sf):
    return Q.review_ledger(V.review(spark, sf))


@query("certification", f"""with {_REVIEW} select d.doc_id as entry, case when n_rounds is null then 'unreviewed' when n_unresolved > 0 then 'declined' else 'certified' end as certification
       from documents d left join rev on rev.entry = d.doc_id""", ("v_review",))
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("entry"))
    joined = docs.join(Q.review_ledger(V.review(spark, sf)), "entry", "left")
    return joined.select("entry", Q.certification(F.col("n_rounds").isNotNull(), F.col("n_unresolved")).alias("certification"))


# ---- records ------------------------------------------------------------------------------------

def _flag_column():
    c = F.col
    return Q.record_flags(c("gates"), c("reviewed"), c("n_unresolved"), c("verdict"), c("escalate"),
                          c("pick_resolved").isNotNull() & ~c("pick_resolved"), c("missing_judgment"))


def flagged(spark, sf):
    f = gates(spark, sf).withColumn("flag_list", _flag_column())
    return (f.withColumn("flags", F.array_join(F.transform("flag_list", lambda x: x["flag"]), " · "))
            .withColumn("worst", Q.worst_severity(F.col("flag_list"))))


_FLAGGED = _ART + """,
   fl as (select *, list_filter([
      case when not charge_pass then 'charge FAILS' when charge_pass is null and charge_state <> 'derived' then 'charge ' || charge_state end,
      case when fidelity_state is null then 'fidelity absent' when not fidelity_pass then 'fidelity FAILS' end,
      case when not connectivity_pass then 'connectivity FAILS' when connectivity_pass is null and connectivity_state <> 'derived' then 'connectivity ' || connectivity_state end,
      case when not sqs_pass then 'sqs FAILS' when sqs_pass is null and sqs_state <> 'derived' then 'sqs ' || sqs_state end,
      case when hull_state <> 'derived' then 'hull ' || hull_state end,
      case when escalate then 'ESCALATED' end, case when not reviewed then 'UNREVIEWED' end,
      case when reviewed and n_unresolved > 0 then 'blocking objection (' || verdict || ')' end,
      case when pick_unresolved then 'pick unresolved' end, case when missing_judgment then 'judgment incomplete' end], lambda x: x is not null) as lst from gg),
   flagged as (select *, array_to_string(lst, ' · ') as flags,
      case when len(list_filter(lst, lambda x: x like '%FAILS' or x = 'ESCALATED' or x like 'blocking%' or x = 'pick unresolved')) > 0 then 'err' when len(lst) > 0 then 'unchecked' else 'ok' end as worst,
      case when not reviewed then 'unreviewed' when n_unresolved > 0 then 'declined' else 'certified' end as certification from fl)"""


@query("record_flags", f"with {_FLAGGED} select entry, flags, worst from flagged")
def _(spark, sf):
    return flagged(spark, sf).select("entry", "flags", "worst")


def listing(spark, sf):
    """Judged records for finished orders, averaged ones for all others."""
    f = flagged(spark, sf)
    name = F.concat(F.lit("entry_"), F.col("entry").cast("string")).alias("name")
    judged = f.filter("order_status = 'F'").select(
        "entry", name, F.when(F.col("entry") % 3 != 0, F.concat(F.lit("Fe2O"), (F.col("entry") % 5).cast("string"))).alias("formula"),
        F.when(F.col("reviewed"), F.col("verdict")).otherwise("unreviewed").alias("verdict"),
        Q.certification(F.col("reviewed"), F.col("n_unresolved")).alias("certification"), "flags", "worst")
    averaged = f.filter("order_status <> 'F'").select(
        "entry", name, F.lit(None).cast("string").alias("formula"),
        F.when(F.col("entry") % 4 == 0, "no-disorder").when(F.col("entry") % 4 == 1, "error").when(F.col("entry") % 4 == 2, "de-averaged").alias("status"))
    return Q.audit_view(Q.record_union(judged, averaged))


_LISTING = _FLAGGED + f""", view as (
   select entry, '{RECORD_VERSION}' as kind, coalesce(case when k % 3 <> 0 then 'Fe2O' || (k % 5) end, 'entry_' || k) as title, certification as status,
          case when reviewed then verdict else 'unreviewed' end as verdict, worst, flags,
          lower(concat_ws(' ', coalesce(case when k % 3 <> 0 then 'Fe2O' || (k % 5) end, 'entry_' || k), 'entry_' || k, case when reviewed then verdict else 'unreviewed' end, certification, flags)) as search_text
   from flagged where order_status = 'F'
   union all select entry, 'deaverage', 'entry_' || k, case k % 4 when 0 then 'no-disorder' when 1 then 'error' when 2 then 'de-averaged' else '?' end, null, null, null,
          lower(concat_ws(' ', 'entry_' || k, 'entry_' || k, case k % 4 when 0 then 'no-disorder' when 1 then 'error' when 2 then 'de-averaged' end)) from flagged where order_status <> 'F')"""


@query("record_union", f"with {_LISTING} select kind, count(*) as n, count(verdict) as n_judged from view group by 1")
def _(spark, sf):
    return listing(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("n_judged"))


@query("audit_view", f"with {_LISTING} select entry, kind, title, status, verdict, worst, flags, search_text from view")
def _(spark, sf):
    return listing(spark, sf)


@query("audit_search", f"with {_LISTING} select entry, title from view where contains(search_text, 'sqs fails') and status = 'certified'")
def _(spark, sf):
    return Q.audit_search(listing(spark, sf), "  SQS fails ", "certified").select("entry", "title")


@query("audit_search_shown", f"with {_LISTING} select count(*) as n_shown from view where contains(search_text, 'fe2o')")
def _(spark, sf):
    return Q.audit_search(listing(spark, sf), "Fe2O").agg(F.count(F.lit(1)).alias("n_shown"))


@query("campaign_tally", f"with {_LISTING} select status, count(*) as n from view group by 1")
def _(spark, sf):
    return Q.campaign_tally(listing(spark, sf))


def _record_json(spark, sf):
    """Nested records; finished orders carry gates, open ones a status, pending ones neither."""
    f = gates(spark, sf)
    gate_map = F.create_map(*[v for n in GATES for v in (F.lit(n), F.struct(
        F.col(f"gates.{n}.state").alias("state"), F.col(f"gates.{n}.pass").alias("pass"), F.col(f"gates.{n}.basis").alias("basis")))])
    final = F.col("order_status") == "F"
    return f.select(
        "entry", "order_status", F.when(final & (F.col("entry") % 2 == 0), RECORD_VERSION).alias("schema_version"),
        F.when(F.col("order_status") == "O", "de-averaged").alias("status"), F.when(final, gate_map).alias("gates"),
        F.when(final & F.col("reviewed"), F.struct(F.col("verdict").alias("final_verdict"), F.array().cast("array<string>").alias("unresolved_blocking"))).alias("review"))


@query("write_records", f"with {_ART} select entry, order_status = 'F' as has_gates, case when order_status = 'F' then connectivity_state end as connectivity_state, case when order_status = 'F' then sqs_pass end as sqs_pass, case when order_status = 'F' and reviewed then verdict end as final_verdict from gg")
def _(spark, sf):
    path = scratch_path(spark, "records")
    W.write_records(_record_json(spark, sf), path)
    r = spark.read.schema("entry long, " + R.RECORD_SCHEMA).json(path)
    return r.select("entry", F.col("gates").isNotNull().alias("has_gates"), F.col("gates")["connectivity"]["state"].alias("connectivity_state"),
                    F.col("gates")["sqs"]["pass"].alias("sqs_pass"), F.col("review.final_verdict").alias("final_verdict"))


@query("scan_records", f"""select 'entry_' || o_orderkey as dir, case when o_orderkey % 3 = 0 then 'deaverage_output.json' else 'record.json' end as file,
       case when o_orderstatus = 'F' then '{RECORD_VERSION}' else 'deaverage' end as kind from orders where o_orderstatus in ('F', 'O')""")
def _(spark, sf):
    rec = _record_json(spark, sf)
    folder = F.concat(F.lit("entry_"), F.col("entry").cast("string"))
    text = F.to_json(F.struct("schema_version", "status", "gates", "review"))
    files = rec.select(folder.alias("dir"), F.explode(F.array_compact(F.array(
        F.struct(F.lit("record.json").alias("file"), text.alias("text")),
        F.when(F.col("entry") % 3 == 0, F.struct(F.lit("deaverage_output.json").alias("file"), text.alias("text"))),
        F.struct(F.lit("notes.json").alias("file"), F.lit("{}").alias("text"))))).alias("f")).select("dir", "f.*")
    path = scratch_path(spark, "results")
    files.write.parquet(path)
    best, _ = R.discover_records(spark.read.parquet(path))
    return best.select("dir", "file", "kind")


@query("scan_records_rejected", """select 'entry_' || o_orderkey as dir, 'record.json' as file from orders where o_orderstatus not in ('F', 'O')""")
def _(spark, sf):
    rec = _record_json(spark, sf)
    files = rec.select(F.concat(F.lit("entry_"), F.col("entry").cast("string")).alias("dir"), F.lit("record.json").alias("file"),
                       F.to_json(F.struct("schema_version", "status", "gates", "review")).alias("text"))
    return R.discover_records(files)[1].select("dir", "file")


@query("assemble_record", f"""with {_ART}, chg as (select structure_id, round(sum(occ * oxidation), 3) as q from v_species join v_oxidation using (structure_id, element) group by 1)
       select gg.entry, formula_sum, q as nominal_charge, source, case when has_hull then hull_inferred end as hull_state,
              case when reviewed then verdict end as final_verdict, connectivity_state, sqs_pass from gg left join v_entry e on e.id = gg.entry left join chg on structure_id = gg.entry""",
       ("v_entry", "v_species", "v_oxidation"))
def _(spark, sf):
    a = gates(spark, sf)
    evidence = V.entry(spark, sf).select(F.col("id").alias("entry"), "formula_sum").join(
        E.nominal_charge(V.species(spark, sf), E.oxidation_states(V.valence(spark, sf))).withColumnRenamed("structure_id", "entry"), "entry", "left")
    hull = a.filter("has_hull").select("entry", Q.hull_state(F.col("hull_state"), F.col("hull_error")).alias("state"), "e_hull")
    review = a.filter("reviewed").select("entry", F.col("verdict").alias("final_verdict"), "n_unresolved")
    rec = Q.assemble_record(a.select("entry", "source", "gates"), evidence=evidence, hull=hull, review=review)
    return rec.select("entry", "evidence.formula_sum", "evidence.nominal_charge", "source", F.col("hull.state").alias("hull_state"),
                      "review.final_verdict", F.col("gates.connectivity.state").alias("connectivity_state"), F.col("gates.sqs.pass").alias("sqs_pass"))
