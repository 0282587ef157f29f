"""Named queries over the campaign: ledger, streams, episodes, stored answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import campaign as P
from ..operators import ensemble as N
from ..session import scratch_path
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import ledger as S
from . import views as V
from .registry import query

_LAST = ("v_last",)


def last(spark, sf):
    return P.ledger_last(V.ledger(spark, sf))


@query("ledger_last_status", "select file, seq, status, stage, error from v_last", _LAST)
def _(spark, sf):
    return last(spark, sf).select("file", "seq", "status", "stage", "error")


@query("ledger_counts", """with c as (select status, count(*) as n_structures, sum(n)::bigint as n_rows from v_last join (select file, count(*) as n from v_ledger group by 1) using (file) group by 1)
       select * from c union all select 'total', sum(n_structures)::bigint, sum(n_rows)::bigint from c""", ("v_last", "v_ledger"))
def _(spark, sf):
    return P.ledger_counts(last(spark, sf))


@query("ledger_done", "select file from v_last where status in ('completed', 'ok', 'declined', 'skipped') and file <> ''", _LAST)
def _(spark, sf):
    return P.ledger_done(last(spark, sf))


@query("ledger_rerun", "select file, stage, error from v_last where status = 'error'", _LAST)
def _(spark, sf):
    return P.ledger_with_status(last(spark, sf), "error")


@query("ledger_declined", "select file, stage, error from v_last where status = 'declined'", _LAST)
def _(spark, sf):
    return P.ledger_with_status(last(spark, sf), "declined")


@query("remaining_inputs", """select 'user_' || c_custkey || '.cif' as file from customer
       where 'user_' || c_custkey || '.cif' not in (select file from v_last where status <> 'error')""", _LAST)
def _(spark, sf):
    inputs = V.table(spark, sf, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string"), F.lit(".cif")).alias("file"))
    return P.remaining_inputs(inputs, last(spark, sf))


@query("revise_rate", """select count(*) as n_reviewed, round(avg(case when verdict = 'revise' then 1.0::double else 0 end), 6) as revise_rate
       from v_last where verdict is not null""", _LAST)
def _(spark, sf):
    return P.revise_rate(last(spark, sf))


@query("scan_ledger", "select seq, ts, file, status, stage, klass, verdict, round, error from v_ledger", ("v_ledger",))
def _(spark, sf):
    # write the ledger as lines, with a torn copy of every 97th and blank lines in between
    rows = V.ledger(spark, sf)
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    torn = F.when(F.col("seq") % 97 == 0, F.concat(line, F.lit("\n"), F.expr("substring(line, 1, 40)"), F.lit("\n"))).otherwise(F.col("line"))
    path = scratch_path(spark, "ledger")
    rows.withColumn("line", line).select(torn.alias("value")).write.text(path)
    return R.scan_ledger(spark, path).select("seq", "ts", "file", "status", "stage", "klass", "verdict", "round", "error")


_LINE = """select seq, case status when 'ok' then 'completed' else status end as status,
       concat_ws('  ', ts, case status when 'completed' then 'DONE ' when 'ok' then 'OK   ' when 'declined' then 'DECL ' when 'error' then 'ERROR' else 'SKIP ' end, file,
                 'class=' || klass, 'review=' || verdict || case when round is not null then '(r' || round || ')' else '' end, 'stage=' || stage, 'error=' || error) as line from v_ledger"""


@query("append_ledger", _LINE, ("v_ledger",))
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    rows = V.ledger(spark, sf)
    W.append_ledger(rows.filter("seq % 2 = 0"), path)
    W.append_ledger(rows.filter("seq % 2 = 1"), path)
    lines = rows.select("seq", W.log_line().alias("line"))
    return R.scan_ledger(spark, path).select("seq", "status").join(lines, "seq")


# ---- streams ------------------------------------------------------------------------------------

def _ledger_folder(spark, sf):
    path = scratch_path(spark, "ledger")
    for part in range(3):
        W.append_ledger(V.ledger(spark, sf).filter(F.col("seq") % 3 == part), path)
    return path


@query("stream_ledger_status", "select file, seq, case status when 'ok' then 'completed' else status end as status from v_last", _LAST)
def _(spark, sf):
    out, cp = scratch_path(spark, "status"), scratch_path(spark, "stream")
    S.stream_ledger_status(S.read_ledger_stream(spark, _ledger_folder(spark, sf), 2), out, cp)
    return S.read_ledger_status(spark, out).select("file", "seq", "status")


@query("stream_done_counts", "select count(*) filter (status <> 'error') as n_done, count(*) filter (status = 'error') as n_open from v_last", _LAST)
def _(spark, sf):
    out, cp = scratch_path(spark, "done"), scratch_path(spark, "stream")
    S.stream_done_counts(S.read_ledger_stream(spark, _ledger_folder(spark, sf), 2), out, cp)
    progress = spark.read.parquet(f"{out}/progress")
    return progress.agg(F.max_by(F.struct("n_done", "n_open"), "batch").alias("p")).select("p.*")


@query("stream_new_configs", "select distinct 'k' || (ord % 500) as key from v_valid where valid", ("v_valid",))
def _(spark, sf):
    src, out, cp = (scratch_path(spark, n) for n in ("configs", "fresh", "stream"))
    rows = V.valid_sample(spark, sf).select(F.concat(F.lit("k"), (F.col("ord") % 500).cast("string")).alias("key"), "ord", "valid", "energy")
    for part in range(2):
        rows.filter(F.col("ord") % 2 == part).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.stream_new_configs(stream, out, cp)
    return S.read_new_configs(spark, out).select("key")


# ---- episodes and answers -----------------------------------------------------------------------

def _episodes(spark, sf):
    """A knowledge document made of given tables: an event type triggers the nations of its place in the
    alphabet, whose lesson is their region."""
    path = scratch_path(spark, "episodes")
    kinds = V.table(spark, sf, "events").select("event_type").distinct()
    kinds = kinds.withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1)   # one row per event type
    nations = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = kinds.join(nations, F.col("n_nationkey") % 5 == F.col("k"))
    triggers = pairs.groupBy("event_type").agg(F.sort_array(F.collect_list("n_name")).alias("names")).agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "names"))).alias("triggers"))
    lesson = F.struct(F.col("r_name").alias("lesson"), F.array().cast("array<string>").alias("provenance"))
    episodes = nations.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), lesson))).alias("episodes"))
    triggers.join(episodes).coalesce(1).write.json(path)   # one row each
    return R.scan_episodes(spark, path)


_FLAGS = """flags as (select user_id as entry, event_type as flag from events group by 1, 2 having max(value) > 480),
   kinds as (select event_type, row_number() over (order by event_type) - 1 as k from (select distinct event_type from events)),
   trig as (select event_type as trigger, n_name as episode, r_name as lesson from kinds join nation on n_nationkey % 5 = k join region on n_regionkey = r_regionkey)"""


def _flags(spark, sf):
    highest = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("entry"), F.col("event_type").alias("flag")).agg(F.max("value").alias("most"))
    return highest.filter("most > 480").select("entry", "flag")


@query("fire_episodes", f"with {_FLAGS} select entry, episode, string_agg(distinct flag, ',' order by flag) as flags from flags join trig on trigger = flag group by 1, 2")
def _(spark, sf):
    triggers, _ = _episodes(spark, sf)
    return P.fire_episodes(_flags(spark, sf), triggers)


@query("scan_episodes", f"with {_FLAGS} select episode, lesson, count(distinct entry) as n_entries from flags join trig on trigger = flag group by 1, 2")
def _(spark, sf):
    triggers, lessons = _episodes(spark, sf)
    fired = P.fire_episodes(_flags(spark, sf), triggers)
    return fired.join(lessons, "episode").groupBy("episode", "lesson").agg(F.count_distinct("entry").alias("n_entries"))


def _facts(spark, sf, shift):
    d = N.distribution(V.valid_sample(spark, sf))
    off = F.when(F.col("entry") % 4 == 0, shift).otherwise(0.0)
    text = lambda c: F.col(c).cast("string")
    return d.select(
        F.col("entry").cast("string").alias("entry"),
        F.create_map(F.lit("status"), F.when((F.col("entry") % 5 == 0) & (F.lit(shift) > 0), "error").otherwise("de-averaged"),
                     F.lit("n_total"), text("n_total")).alias("exact"),
        (F.col("ground") + off).alias("energy"), F.lit(20.0).alias("energy_tol"),
        F.create_map(F.lit("n_relaxed"), text("n_relaxed")).alias("reported"),
        F.when((F.col("entry") % 3 == 0) & (F.lit(shift) > 0), "w2").otherwise("w1").alias("weights"))


@query("scan_reference_answers", f"""select entry::varchar as entry, 'de-averaged' as status, count(*)::varchar as n_total, min(energy) as ground from v_valid
       group by 1 having count(*) filter (valid) > 0""", ("v_valid",))
def _(spark, sf):
    path = scratch_path(spark, "answers")
    f = _facts(spark, sf, 0.0)
    f.select("entry", "exact", F.struct(F.col("energy").alias("ground_E_per_atom"), F.col("energy_tol").alias("E_tol_meV_per_atom")).alias("tolerant"),
             "reported", F.lit("potential").alias("stamped_with"), F.col("weights").alias("stamped_sha256")).write.json(path)
    a = R.scan_reference_answers(spark, path, multiline=False)
    return a.select("entry", F.col("exact")["status"].alias("status"), F.col("exact")["n_total"].alias("n_total"),
                    F.col("tolerant.ground_E_per_atom").alias("ground"))


@query("compare_to_reference", """with d as (select entry, count(*) filter (valid) as n_relaxed, count(*) as n_total, min(energy) as ground from v_valid group by 1 having count(*) filter (valid) > 0)
    select entry::varchar as entry, 'exact' as kind, 'status' as field, case when entry % 5 = 0 then 'FAIL' else 'ok' end as verdict from d
    union all select entry::varchar, 'exact', 'n_total', 'ok' from d union all select entry::varchar, 'reported', 'n_relaxed', 'not a criterion' from d
    union all select entry::varchar, 'tolerant', 'ground_E_per_atom', case when entry % 3 = 0 then 'not compared' when entry % 4 = 0 then 'FAIL' else 'ok' end from d""", ("v_valid",))
def _(spark, sf):
    return P.compare_to_reference(_facts(spark, sf, 0.0), _facts(spark, sf, 0.05)).select("entry", "kind", "field", "verdict")


# ---- paths and names ----------------------------------------------------------------------------

@query("repair_paths", """select o_orderkey as entry, case when o_orderkey % 4 = 2 then '/shared/' || o_orderkey || '.cif' else 'old/run/entry_' || o_orderkey || '/_work/r' || (o_custkey % 3) || '/rep.cif' end as path,
       case o_orderkey % 4 when 0 then '/new/entry_' || o_orderkey || '/_work/r' || (o_custkey % 3) || '/rep.cif' when 1 then '/new/entry_' || o_orderkey || '/rep.cif'
            when 2 then '/shared/' || o_orderkey || '.cif' end as resolved,
       case o_orderkey % 4 when 0 then '_work/r' || (o_custkey % 3) || '/rep.cif' when 1 then 'rep.cif' when 2 then '/shared/' || o_orderkey || '.cif'
            else 'old/run/entry_' || o_orderkey || '/_work/r' || (o_custkey % 3) || '/rep.cif' end as stored from orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    key, run = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 3).cast("string")
    work = F.concat(F.lit("/_work/r"), run, F.lit("/rep.cif"))
    m = F.col("o_orderkey") % 4
    shared = F.concat(F.lit("/shared/"), key, F.lit(".cif"))
    paths = o.select(F.col("o_orderkey").alias("entry"), F.concat(F.lit("/new/entry_"), key).alias("out_dir"),
                     F.when(m == 2, shared).otherwise(F.concat(F.lit("old/run/entry_"), key, work)).alias("path"))
    files = o.select(F.explode(F.array_compact(F.array(
        F.when(m == 0, F.concat(F.lit("/new/entry_"), key, work)), F.when(m <= 1, F.concat(F.lit("/new/entry_"), key, F.lit("/rep.cif"))),
        F.when(m == 2, shared)))).alias("file"))
    return P.repair_paths(paths, files)


_SLUG = """with n as (select event_id as ord, '  Entry ' || (user_id % 40) || case when event_id % 50 = 0 then '-1' else '' end || '!' as name from events),
    b as (select ord, name, 'Entry-' || regexp_extract(name, 'Entry ([0-9]+(-1)?)', 1) as base from n),
    r as (select ord, name, base, row_number() over (partition by base order by ord) - 1 as m, (base || '-1') in (select base from b) as has_one from b)
    select ord, name, base || case when m = 0 then '' when has_one then '-' || (m + 1) else '-' || m end as slug from r"""


@query("unique_slug", _SLUG)
def _(spark, sf):
    names = V.table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.concat(
        F.lit("  Entry "), (F.col("user_id") % 40).cast("string"), F.when(F.col("event_id") % 50 == 0, "-1").otherwise(""), F.lit("!")).alias("name"))
    return P.unique_slug(names)
