"""Named queries over samples and their energies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as N
from ..session import scratch_path
from ..sources import readers as R
from ..sources import writers as W
from . import views as V
from .registry import query

_VALID = ("v_valid",)


@query("ship_candidates", "select entry, ord, label, mode, energy from v_ship", ("v_ship",))
def _(spark, sf):
    return N.ship_candidates(V.valid_sample(spark, sf)).select("entry", "ord", "label", "mode", "energy")


@query("representative", """select entry, label, mode, energy from v_ship
       qualify row_number() over (partition by entry order by energy, ord) = 1""", ("v_ship",))
def _(spark, sf):
    return N.representative(V.valid_sample(spark, sf))


@query("bracket_margins", """with base as (select entry, min(energy) as base from v_ship group by 1),
    p as (select * from v_valid where valid and mode <> 'random' qualify row_number() over (partition by entry, mode order by ord desc) = 1)
    select entry, mode, label, round(energy, 5) as energy, round(1000 * (energy - base), 2) as margin_mev from p join base using (entry)""",
       ("v_ship", "v_valid"))
def _(spark, sf):
    return N.bracket_margins(V.valid_sample(spark, sf))


_DIST = """select entry, count(*) filter (valid) as n_relaxed, count(*) as n_total, min(energy) as ground, max(energy) as highest,
       round(1000 * (max(energy) - min(energy)), 2) as spread_mev, round(1000 * stddev_pop(energy), 2) as std_mev,
       case when count(*) filter (valid and mode = 'random') > 0 then count(*) filter (valid and mode = 'random')
            else count(*) filter (valid) end as n_ship from v_valid group by 1 having count(*) filter (valid) > 0"""


@query("distribution", _DIST, _VALID)
def _(spark, sf):
    return N.distribution(V.valid_sample(spark, sf))


@query("distribution_shape", """select entry, n as n_configs, round(1000 * (mean - low), 2) as mean_mev, round(1000 * std, 2) as std_mev,
       round(1000 * (high - low), 2) as spread_mev,
       case when n = 1 then null when 1000 * (high - low) < 10 then 'narrow'
            when n >= 4 and 1000 * (high - es[2]) > 0.5 * 1000 * (high - low) and 1000 * (es[2] - low) < 15 then 'tight+outlier'
            when 1000 * (high - low) > 60 then 'broad' else 'moderate' end as shape, n > 1 as read_available
       from (select entry, count(*) as n, min(energy) as low, max(energy) as high, avg(energy) as mean, stddev_pop(energy) as std,
                    list(energy order by energy desc) as es from v_valid where energy is not null group by 1)""", _VALID)
def _(spark, sf):
    return N.distribution_shape(V.valid_sample(spark, sf))


@query("broad_spread_flag", f"""select entry, spread_mev, case when spread_mev > 200 then 'investigate' else 'ok' end as flag from ({_DIST})""", _VALID)
def _(spark, sf):
    return N.broad_spread_flag(N.distribution(V.valid_sample(spark, sf)))


@query("energy_histogram", """with s as (select entry, min(energy) as low, max(energy) as high, least(12, greatest(4, count(*) // 2))::int as bins
        from v_valid where energy is not null group by 1 having count(*) >= 2),
    b as (select entry, least(bins - 1, case when high > low then floor((energy - low) * 1000 / ((high - low) * 1000) * bins)::int else 0 end) as bin, count(*) as n
          from v_valid join s using (entry) where energy is not null group by 1, 2)
    select g.entry, g.bin::int as bin, coalesce(n, 0) as n_in_bin from (select entry, unnest(range(bins)) as bin from s) g left join b on b.entry = g.entry and b.bin = g.bin""", _VALID)
def _(spark, sf):
    return N.energy_histogram(V.valid_sample(spark, sf))


def cells(spark, sf):
    """Relaxed cells: lengths and angles vary with the sample."""
    s = V.valid_sample(spark, sf).filter("valid")
    return s.select("entry", (5 + F.col("energy")).alias("a"), (6 + F.col("k") / 100).alias("b"), (7 + F.col("m7") / 10).alias("c"),
                    (90 + F.col("k") / 50).alias("alpha"), F.lit(90.0).alias("beta"), (100 + F.col("m7")).cast("double").alias("gamma"),
                    (20 + F.col("k") / 10).alias("volume_per_atom"))


@query("cell_scatter", """select entry, count(*) as n_frames, round((stddev_pop(a) / avg(a) + stddev_pop(b) / avg(b) + stddev_pop(c) / avg(c)) / 3 * 100, 2) as len_cv_pct,
       round((stddev_pop(al) + 0 + stddev_pop(ga)) / 3, 2) as angle_std_deg, round(stddev_pop(v) / avg(v) * 100, 2) as vol_cv_pct
       from (select entry, 5 + energy as a, 6 + k / 100 as b, 7 + m7 / 10.0::double as c, 90 + k / 50 as al, (100 + m7)::double as ga, 20 + k / 10 as v from v_valid where valid)
       group by 1 having count(*) >= 3""", _VALID)
def _(spark, sf):
    return N.cell_scatter(cells(spark, sf))


@query("ensemble_order", """select entry, ord, label, mode, energy, row_number() over (partition by entry order by energy, ord) as rank from v_valid where valid""", _VALID)
def _(spark, sf):
    return N.ensemble_order(V.valid_sample(spark, sf))


@query("ensemble_order_split", """select entry, ord, label, mode, energy, row_number() over (partition by entry order by energy, ord) as rank from v_valid where valid""", _VALID)
def _(spark, sf):
    # the same ranks with every group above 50 rows cut at quantiles, as a hot entry would be
    return N.ensemble_order(V.valid_sample(spark, sf), rows_per_task=50)


@query("rank_correlation", """with v as (select entry, ord, energy, row_number() over (partition by entry order by energy, ord) as er, k, m7::double as m7 from v_valid where valid),
    l as (select entry, ord, er, 'k' as descriptor, k as v from v union all select entry, ord, er, 'm7', m7 from v),
    r as (select *, row_number() over (partition by entry, descriptor order by v, ord) as vr from l),
    s as (select entry, descriptor, round(corr(er, vr), 3) as rho, arg_min(v, er) as low_value, arg_max(v, er) as high_value, stddev_pop(v) as sd from r group by 1, 2)
    select entry, descriptor, rho, low_value, high_value,
           coalesce(rho = max(case when rho >= 0.5 then rho end) over (partition by entry), false) as is_top from s where sd >= 1e-9""", _VALID)
def _(spark, sf):
    return N.rank_correlation(V.valid_sample(spark, sf), ["k", "m7"])


@query("select_top_scores", """select entry, ord, score, rank from (select entry, ord, k as score, row_number() over (partition by entry order by k, ord) as rank from v_sample) where rank <= 10""", ("v_sample",))
def _(spark, sf):
    return N.select_top_scores(V.sample(spark, sf).select("entry", "ord", F.col("k").alias("score")), 10)


def _with_reason(spark, sf):
    s = V.valid_sample(spark, sf)
    comp = F.concat(F.lit("Fe2 O"), F.col("n_o").cast("string"))
    return s.select("entry", "ord", "valid", "energy", comp.alias("composition"),
                    N.invalid_reason(F.col("short_fill"), F.col("converged")).alias("reason"))


_REASON = """r as (select entry, ord, valid, energy, 'Fe2 O' || n_o as composition,
      case when short_fill > 0 then 'short-filled by ' || short_fill || ' site(s)' when not converged then 'relaxation did not converge' end as reason from v_valid),
    m as (select entry, arg_max(composition, {'n': n, 'f': -f}) as modal from (select entry, composition, count(*) as n, min(ord) as f from r where valid group by 1, 2) group by 1),
    e as (select entry, ord, composition, valid and composition = modal as valid, case when valid and composition <> modal then null else energy end as energy,
                 case when valid and composition <> modal then 'composition differs from the modal decoration' else reason end as reason from r left join m using (entry))"""


@query("evaluate_samples", f"with {_REASON} select entry, ord, valid, energy, composition, reason from r", _VALID)
def _(spark, sf):
    return _with_reason(spark, sf)


@query("modal_composition", f"with {_REASON} select entry, ord, composition, coalesce(valid, false) as valid, energy, reason from e", _VALID)
def _(spark, sf):
    return N.modal_composition(_with_reason(spark, sf)).withColumn("valid", F.coalesce("valid", F.lit(False)))


@query("invalid_reason_rollup", """with s as (select entry * 1000 + ord // 400 as entry, short_fill = 0 and converged as valid,
         case when short_fill > 0 then 'short-filled by ' || short_fill || ' site(s)' when not converged then 'relaxation did not converge' end as reason from v_sample)
    select entry, coalesce(reason, 'relaxation did not converge') as reason, count(*) as n from s
    where entry not in (select entry from s where valid) group by 1, 2""", ("v_sample",))
def _(spark, sf):
    fine = _with_reason(spark, sf).withColumn("entry", F.col("entry") * 1000 + F.floor(F.col("ord") / 400))
    return N.invalid_reason_rollup(fine)


@query("composition_counts", "select structure_id, map_from_entries(list((element, n) order by element)) as composition from (select structure_id, element, count(*) as n from v_point group by 1, 2) group by 1".replace("map_from_entries(list((element, n) order by element)) as composition", "string_agg(element || n, ' ' order by element) as composition"), ("v_point",))
def _(spark, sf):
    comp = N.composition_counts(V.point(spark, sf))
    return comp.select("structure_id", F.array_join(F.transform(F.map_entries("composition"), lambda e: F.concat(e["key"], e["value"].cast("string"))), " ").alias("composition"))


# ---- frames: written, then read back ------------------------------------------------------------

def _frames(spark, sf):
    """Valid samples as frames of two atoms; the comment carries label, mode and energy."""
    s = V.valid_sample(spark, sf).filter("valid")
    comment = F.concat_ws(" ", F.lit('Lattice="5 0 0 0 5 0 0 0 5"'), F.concat(F.lit("label="), "label"), F.concat(F.lit("mode="), "mode"),
                          F.concat(F.lit("E="), F.col("energy").cast("string")),
                          F.concat(F.lit("key=k"), (F.col("ord") % 500).cast("string")))
    atoms = F.array(F.lit("Fe 0.0 0.0 0.0"), F.concat(F.lit("O 1.0 1.0 "), F.col("m7").cast("string"), F.lit(".0")))
    return s.select("entry", "ord", "energy", W.frame_text(F.lit(2), comment, atoms).alias("frame"))


def _written_frames(spark, sf):
    path = scratch_path(spark, "ensemble")
    W.write_ensemble(_frames(spark, sf), path)
    return R.scan_packed_text(spark, path).withColumnRenamed("filename", "file")


@query("scan_frames", """select label, mode, energy, 2 as n_atoms, 'Fe 0.0 0.0 0.0' as first_atom from v_valid where valid""", _VALID)
def _(spark, sf):
    f = R.scan_frames(_written_frames(spark, sf))
    c = F.col("comment")
    return f.select(R.frame_property(c, "label").alias("label"), R.frame_property(c, "mode").alias("mode"),
                    R.frame_property(c, "E").cast("double").alias("energy"), "n_atoms", F.col("atoms")[0].alias("first_atom"))


@query("write_ensemble", """select entry::int as entry, count(*) as n_frames, true as in_energy_order from v_valid where valid group by 1""", _VALID)
def _(spark, sf):
    named = _written_frames(spark, sf)
    f = R.scan_frames(named).withColumn("e", R.frame_property(F.col("comment"), "E").cast("double"))
    per_file = f.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("frame_index", "e"))).alias("s"))
    steps = F.transform("s", lambda x: x["e"])
    return per_file.select(F.split_part("file", F.lit("#"), F.lit(1)).cast("int").alias("entry"), "n",
                           (steps == F.sort_array(steps)).alias("ok")).groupBy("entry").agg(
        F.sum("n").alias("n_frames"), F.bool_and("ok").alias("in_energy_order"))


@query("frame_count", "select entry::int as entry, count(*) as n_frames from v_valid where valid group by 1", _VALID)
def _(spark, sf):
    f = R.scan_frames(_written_frames(spark, sf)).withColumn("entry", F.split_part("file", F.lit("#"), F.lit(1)).cast("int"))
    return N.frame_count(f, "entry")


def _checkpoint(spark, sf):
    """Finished configurations: one file per thousand events, the later frame of a key wins."""
    s = _frames(spark, sf).select(F.format_string("part-%08d", F.floor(F.col("ord") / 1000)).alias("file"), "ord", "frame")
    path = scratch_path(spark, "cache")
    s.repartitionByRange("file", "ord").sortWithinPartitions("file", "ord").select("file", F.col("frame").alias("value")) \
        .write.partitionBy("file").text(path)
    files = spark.read.option("basePath", path).text(path, wholetext=True)
    return R.scan_checkpoint(R.scan_frames(files.select(
        F.concat_ws("#", "file", F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("file"), F.col("value").alias("text"))))


@query("scan_checkpoint", "select 'k' || (ord % 500) as key, arg_max(energy, ord) as energy from v_valid where valid group by 1", _VALID)
def _(spark, sf):
    return _checkpoint(spark, sf)


@query("reuse_checkpoint", """with cache as (select distinct 'k' || (ord % 500) as key from v_valid where valid and ord % 3 = 0)
       select 'k' || (ord % 700) as key, count(*) as n, ('k' || (ord % 700)) in (select key from cache) as reused from v_sample group by 1""", ("v_valid", "v_sample"))
def _(spark, sf):
    configs = V.sample(spark, sf).groupBy(F.concat(F.lit("k"), (F.col("ord") % 700).cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    cache = N.cacheable(V.valid_sample(spark, sf)).filter("ord % 3 = 0").select(
        F.concat(F.lit("k"), (F.col("ord") % 500).cast("string")).alias("key")).distinct()
    reused, todo = N.reuse_checkpoint(configs, cache)
    return reused.withColumn("reused", F.lit(True)).unionByName(todo.withColumn("reused", F.lit(False)))


@query("content_key", """select entry, count(distinct key) as n_keys from (select entry, sha1('pot|' || mode || ' x|' || printf('%.6f', round(k, 6)) || ' ' || printf('%.6f', round(m7, 6)::double)) as key
       from v_sample) group by 1""".replace("sha1(", "md5("), ("v_sample",))
def _(spark, sf):
    key = N.content_key(F.lit("pot"), F.array("mode", F.lit("x")), F.array("k", -F.col("m7").cast("double")))
    return V.sample(spark, sf).select("entry", key.alias("key")).groupBy("entry").agg(F.count_distinct("key").alias("n_keys"))


def _picks(spark, sf):
    """One pick per entry, by label, by index, unknown, empty or without an ensemble."""
    s = V.valid_sample(spark, sf).groupBy("entry").agg(F.min("label").alias("some"), F.max("ord").alias("top"))
    m = F.col("entry") % 6
    return s.select(
        "entry", F.when(m == 0, F.col("some")).when(m == 1, "nowhere").alias("config_label"),
        F.when(m == 2, 1).when(m == 3, 100000).cast("long").alias("frame_index"), (m != 5).alias("has_ensemble"))


@query("resolve_pick", """with fr as (select entry, label, mode, energy, row_number() over (partition by entry order by energy, ord) as fi from v_valid where valid),
    p as (select entry, case entry % 6 when 0 then min(label) when 1 then 'nowhere' end as cl, case entry % 6 when 2 then 1 when 3 then 100000 end as fx, entry % 6 <> 5 as he from v_valid group by entry),
    j as (select p.entry, he, cl, fx, l.fi as li, l.mode as lm, l.energy as le, x.fi as xi, x.mode as xm, x.energy as xe, (select count(*) from fr where fr.entry = p.entry) as n
          from p left join fr l on l.entry = p.entry and l.label = cl left join fr x on x.entry = p.entry and x.fi = fx),
    r as (select *, case when not he then 'the engine output names no ensemble file' when n = 0 then 'ensemble file does not resolve'
                when cl is null and fx is null then 'pick needs a label or a frame index' when cl is not null and li is null then 'no frame with that label'
                when cl is null and xi is null then 'frame index outside the ensemble' end as reason from j)
    select entry, case when reason is null then coalesce(li, xi) end as picked_index, case when reason is null then coalesce(lm, xm) end as mode,
           case when reason is null then coalesce(le, xe) end as energy, reason from r""", _VALID)
def _(spark, sf):
    frames = N.ensemble_order(V.valid_sample(spark, sf)).withColumnRenamed("rank", "frame_index")
    return N.resolve_pick(_picks(spark, sf), frames)


@query("pick_final_tier", """with runs as (select 'run_' || o_orderkey as run, case when o_orderstatus = 'F' then 'from' else 'enumerate' end as m,
         case when o_orderkey % 5 <> 0 then -o_totalprice / 100000 end as e, o_custkey % 50 as a, o_orderkey, o_custkey from orders),
    p as (select o_orderkey as entry, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 'absent' else 'run_' || o_orderkey end as f,
                 case when o_orderkey % 3 = 0 then o_custkey % 50 else 7 end as n from orders),
    j as (select entry, f, m, e, case when f is null then null when m is null then 'could not read the final run' when m <> 'from' then 'not a single-frame run'
            when e is null then 'its final tier did not run' when n > 0 and a > 0 and n <> a then 'atom counts differ' end as reason from p left join runs on run = f)
    select entry, f as final_from, case when f is not null and reason is null then round(e::decimal(28, 10), 5)::double end as e_final, reason from j""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    name = F.concat(F.lit("run_"), key.cast("string"))
    runs = o.select(name.alias("run"), F.when(F.col("o_orderstatus") == "F", "from").otherwise("enumerate").alias("run_mode"),
                    F.when(key % 5 != 0, -F.col("o_totalprice") / 100000).alias("e_final"), (F.col("o_custkey") % 50).alias("run_atoms"))
    picks = o.select(key.alias("entry"), F.when(key % 7 == 0, None).when(key % 11 == 0, "absent").otherwise(name).alias("final_from"),
                     F.when(key % 3 == 0, F.col("o_custkey") % 50).otherwise(7).alias("n_atoms"))
    return N.pick_final_tier(picks, runs)


@query("score_udf", """select entry, ord, score, rank from (select *, row_number() over (partition by entry order by score, ord) as rank
       from (select entry, ord, abs(k - 50) + m7 as score from v_sample)) where rank <= 5""", ("v_sample",))
def _(spark, sf):
    score = F.pandas_udf(lambda k, m7: (k - 50).abs() + m7, "double", F.PandasUDFType.SCALAR)
    scored = V.sample(spark, sf).select("entry", "ord", score("k", "m7").alias("score"))
    return N.select_top_scores(scored, 5)


@query("energy_provider", """select entry, ord, round(k * 0.01 - m7 * 0.1, 6) as energy, k < 95 as valid from v_sample""", ("v_sample",))
def _(spark, sf):
    def relax(batches):
        for frame in batches:
            frame["energy"] = (frame["k"] * 0.01 - frame["m7"] * 0.1).round(6)
            frame["valid"] = frame["k"] < 95
            yield frame[["entry", "ord", "energy", "valid"]]

    return V.sample(spark, sf).select("entry", "ord", "k", "m7").mapInPandas(
        relax, "entry long, ord long, energy double, valid boolean")
