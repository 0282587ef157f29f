"""Ensembles of configurations: validity, ship candidates, distributions, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import BROAD_SPREAD_MEV, PROBE_MODES
from .pairs import nearest
from .ranking import ordinal_rank


def minimum_contact(points: DataFrame) -> DataFrame:
    """Closest pair of different atoms of each structure, at any distance, with its sorted element pair.

    ``points``: structure_id, atom, element, x, y, z, lattice. A structure of one atom has no pair: its row
    has NULLs.
    """
    found = nearest(points, ["structure_id"], "group", carry=("element",))
    pair = F.concat_ws("-", F.least("element_i", "element_j"), F.greatest("element_i", "element_j"))
    return points.select("structure_id").distinct().join(
        found.select("structure_id", F.round("d", 4).alias("min_d"), pair.alias("pair")), "structure_id", "left")


def invalid_reason(short_fill: Column, converged: Column) -> Column:
    """Why a sample does not count, or NULL."""
    return (F.when(short_fill > 0, F.format_string("short-filled by %d site(s)", short_fill))
            .when(~converged, "relaxation did not converge"))


def modal_composition(samples: DataFrame) -> DataFrame:
    """Samples of another composition than the entry's most common one become invalid.

    ``samples``: entry, ord, valid, composition (canonical text), energy, reason.
    """
    counted = samples.filter("valid").groupBy("entry", "composition").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    modal = counted.groupBy("entry").agg(
        F.max(F.struct("n", (-F.col("first")).alias("first"), "composition")).getField("composition").alias("modal"))
    joined = samples.join(modal, "entry", "left")
    off = F.col("valid") & (F.col("composition") != F.col("modal"))
    return joined.select(
        "entry", "ord", "composition", (F.col("valid") & ~off).alias("valid"),
        F.when(~off, F.col("energy")).alias("energy"),
        F.when(off, "composition differs from the modal decoration").otherwise(F.col("reason")).alias("reason"))


def invalid_reason_rollup(samples: DataFrame) -> DataFrame:
    """Counts per reason for the entries without any valid sample."""
    per = samples.groupBy("entry", F.coalesce("reason", F.lit("relaxation did not converge")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))
    alive = per.groupBy("entry").agg(F.sum("n_valid").alias("alive"))
    return per.join(alive.filter("alive = 0"), "entry").select("entry", "reason", "n")


def ship_candidates(samples: DataFrame) -> DataFrame:
    """Valid samples that are no bracket probes; if an entry has none, all its valid ones.

    The per-entry fact comes from an aggregate joined back, so an entry with very many samples is
    pre-aggregated on the map side and its join can be split.
    """
    valid = samples.filter("valid")
    plain = ~F.col("mode").isin(*PROBE_MODES)
    has_plain = valid.groupBy("entry").agg(F.bool_or(plain).alias("has_plain"))
    return valid.join(has_plain, "entry").filter(plain | ~F.col("has_plain")).drop("has_plain")


def representative(samples: DataFrame) -> DataFrame:
    """Lowest-energy ship candidate, first sample on ties, in one aggregation."""
    valid = samples.filter("valid")
    plain = ~F.col("mode").isin(*PROBE_MODES)
    best = F.min(F.struct((~plain).alias("probe"), "energy", "ord", "label", "mode"))
    return valid.groupBy("entry").agg(best.alias("b")).select(
        "entry", F.col("b.label").alias("label"), F.col("b.mode").alias("mode"), F.col("b.energy").alias("energy"))


def bracket_margins(samples: DataFrame) -> DataFrame:
    """Each probe's energy against the lowest ship candidate; the last probe of a mode counts."""
    base = representative(samples).select("entry", F.col("energy").alias("base"))
    probes = samples.filter(F.col("valid") & F.col("mode").isin(*PROBE_MODES)).groupBy("entry", "mode").agg(
        F.max(F.struct("ord", "energy", "label")).alias("p"))
    return probes.join(base, "entry").select(
        "entry", "mode", F.col("p.label").alias("label"), F.round("p.energy", 5).alias("energy"),
        F.round(1000 * (F.col("p.energy") - F.col("base")), 2).alias("margin_mev"))


def distribution(samples: DataFrame) -> DataFrame:
    """Counts and energies of each entry; the sorted energies are rows of ``ensemble_order``."""
    plain = ~F.col("mode").isin(*PROBE_MODES)
    e = F.col("energy")
    n_plain = F.count_if(F.col("valid") & plain)
    return samples.groupBy("entry").agg(
        F.count_if("valid").alias("n_relaxed"), F.count(F.lit(1)).alias("n_total"),
        F.min(e).alias("ground"), F.max(e).alias("highest"),
        F.round(1000 * (F.max(e) - F.min(e)), 2).alias("spread_mev"),
        F.round(1000 * F.stddev_pop(e), 2).alias("std_mev"),
        F.when(n_plain > 0, n_plain).otherwise(F.count_if("valid")).alias("n_ship")).filter("n_relaxed > 0")


def distribution_shape(samples: DataFrame) -> DataFrame:
    """Mean, spread and a coarse shape tag. One sample has no shape: the read is unavailable.

    The second-highest energy comes from a top-two rank, which is limited before the shuffle.
    """
    valid = samples.filter("energy is not null")
    w = W.partitionBy("entry").orderBy(F.col("energy").desc(), "ord")
    second = valid.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").groupBy("entry").agg(
        F.min("energy").alias("second"))
    stat = valid.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n"), F.min("energy").alias("low"), F.max("energy").alias("high"),
        F.avg("energy").alias("mean"), F.stddev_pop("energy").alias("std"))
    s = stat.join(second, "entry")
    spread = 1000 * (F.col("high") - F.col("low"))
    gap = 1000 * (F.col("high") - F.col("second"))
    shape = (F.when(F.col("n") == 1, None).when(spread < 10, "narrow")
             .when((F.col("n") >= 4) & (gap > 0.5 * spread) & (1000 * (F.col("second") - F.col("low")) < 15), "tight+outlier")
             .when(spread > 60, "broad").otherwise("moderate"))
    return s.select("entry", F.col("n").alias("n_configs"), F.round(1000 * (F.col("mean") - F.col("low")), 2).alias("mean_mev"),
                    F.round(1000 * F.col("std"), 2).alias("std_mev"), F.round(spread, 2).alias("spread_mev"),
                    shape.alias("shape"), (F.col("n") > 1).alias("read_available"))


def broad_spread_flag(dist: DataFrame, limit: float = BROAD_SPREAD_MEV) -> DataFrame:
    return dist.select("entry", "spread_mev", F.when(F.col("spread_mev") > limit, "investigate").otherwise("ok").alias("flag"))


def energy_histogram(samples: DataFrame) -> DataFrame:
    """Counts per energy bin, empty bins included; entries with fewer than two energies have none."""
    e = samples.filter("energy is not null")
    stat = e.groupBy("entry").agg(F.min("energy").alias("low"), F.max("energy").alias("high"), F.count(F.lit(1)).alias("n"))
    stat = stat.filter("n >= 2").withColumn("bins", F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.col("n") / 2))).cast("int"))
    span = (F.col("high") - F.col("low")) * 1000
    pos = F.floor((F.col("energy") - F.col("low")) * 1000 / F.when(span > 0, span) * F.col("bins")).cast("int")
    binned = e.join(stat, "entry").withColumn("bin", F.coalesce(F.least(F.col("bins") - 1, pos), F.lit(0)))
    counts = binned.groupBy("entry", "bin").agg(F.count(F.lit(1)).alias("n_in_bin"))
    grid = stat.select("entry", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return grid.join(counts, ["entry", "bin"], "left").select("entry", "bin", F.coalesce("n_in_bin", F.lit(0)).alias("n_in_bin"))


def cell_scatter(frames: DataFrame) -> DataFrame:
    """Scatter of the cells of an ensemble; fewer than three frames say nothing."""
    def cv(c):
        return F.stddev_pop(c) / F.avg(c)

    lens, angles = ("a", "b", "c"), ("alpha", "beta", "gamma")
    return frames.groupBy("entry").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.round(sum(cv(c) for c in lens) / 3 * 100, 2).alias("len_cv_pct"),
        F.round(sum(F.stddev_pop(c) for c in angles) / 3, 2).alias("angle_std_deg"),
        F.round(cv("volume_per_atom") * 100, 2).alias("vol_cv_pct")).filter("n_frames >= 3")


def ensemble_order(samples: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """Rank of every valid sample by energy."""
    valid = samples.filter("valid").select("entry", "ord", "label", "mode", "energy")
    return ordinal_rank(valid, ["entry"], "energy", "ord", out="rank", rows_per_task=rows_per_task)


def select_top_scores(samples: DataFrame, n: int) -> DataFrame:
    """The ``n`` best scores per entry; the rank limit is applied before the shuffle."""
    w = W.partitionBy("entry").orderBy("score", "ord")
    return samples.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rank_correlation(samples: DataFrame, descriptors: list[str], min_rho: float = 0.5,
                     rows_per_task: int = 1_000_000) -> DataFrame:
    """Correlation of each descriptor's rank with the energy rank; constants are skipped.

    ``samples``: entry, ord, energy and the descriptor columns. Ranks are ordinal, ties by ``ord``.
    """
    valid = samples.filter("energy is not null")
    ranked = ordinal_rank(valid.select("entry", "ord", "energy", *descriptors), ["entry"], "energy", "ord",
                          out="e_rank", rows_per_task=rows_per_task)
    pairs = ", ".join(f"'{d}', cast({d} as double)" for d in descriptors)
    long_ = ranked.selectExpr("entry", "ord", "energy", "e_rank", f"stack({len(descriptors)}, {pairs}) as (descriptor, v)")
    long_ = long_.withColumn("v", F.coalesce("v", F.lit(0.0)))
    both = ordinal_rank(long_, ["entry", "descriptor"], "v", "ord", out="v_rank", rows_per_task=rows_per_task)
    stat = both.groupBy("entry", "descriptor").agg(
        F.round(F.corr(F.col("e_rank").cast("double"), F.col("v_rank").cast("double")), 3).alias("rho"),
        F.stddev_pop("v").alias("std"),
        F.min_by("v", "e_rank").alias("low_value"), F.max_by("v", "e_rank").alias("high_value"))
    kept = stat.filter("std >= 1e-9")
    top = kept.filter(F.col("rho") >= min_rho).groupBy("entry").agg(
        F.max(F.struct("rho", "descriptor")).getField("rho").alias("best"))
    return kept.join(top, "entry", "left").select(
        "entry", "descriptor", "rho", "low_value", "high_value",
        F.coalesce(F.col("rho") == F.col("best"), F.lit(False)).alias("is_top"))


def frame_count(frames: DataFrame, file: str = "file") -> DataFrame:
    return frames.groupBy(file).agg(F.count(F.lit(1)).alias("n_frames"))


def composition_counts(atoms: DataFrame) -> DataFrame:
    """Atoms per element of each structure; one map entry per element."""
    per = atoms.groupBy("structure_id", "element").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("structure_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("element", "n")))).alias("composition"))


def resolve_pick(picks: DataFrame, frames: DataFrame) -> DataFrame:
    """Analyst's pick -> a frame of the ensemble, or the reason why not. Never falls back to the lowest.

    ``picks``: entry, config_label, frame_index, has_ensemble; ``frames``: entry, frame_index, label,
    mode, energy.
    """
    by_label = frames.groupBy("entry", F.col("label").alias("config_label")).agg(
        F.min(F.struct("frame_index", "mode", "energy")).alias("l"))
    by_index = frames.select("entry", "frame_index", F.struct("frame_index", "mode", "energy").alias("x"))
    n = frames.groupBy("entry").agg(F.count(F.lit(1)).alias("n_frames"))
    j = (picks.join(by_label, ["entry", "config_label"], "left").join(by_index, ["entry", "frame_index"], "left")
         .join(n, "entry", "left"))
    hit = F.when(F.col("config_label").isNotNull(), F.col("l")).otherwise(F.col("x"))
    reason = (
        F.when(~F.col("has_ensemble"), "the engine output names no ensemble file")
        .when(F.col("n_frames").isNull(), "ensemble file does not resolve")
        .when(F.col("config_label").isNull() & F.col("frame_index").isNull(), "pick needs a label or a frame index")
        .when(F.col("config_label").isNotNull() & F.col("l").isNull(), "no frame with that label")
        .when(F.col("config_label").isNull() & F.col("x").isNull(), "frame index outside the ensemble"))
    ok = reason.isNull()
    return j.select("entry", F.when(ok, hit["frame_index"]).alias("picked_index"), F.when(ok, hit["mode"]).alias("mode"),
                    F.when(ok, hit["energy"]).alias("energy"), reason.alias("reason"))


def pick_final_tier(picks: DataFrame, runs: DataFrame) -> DataFrame:
    """Final energy of a picked frame from the run that finalised it, or why it was rejected.

    ``picks``: entry, final_from, n_atoms; ``runs``: run, run_mode, e_final, run_atoms.
    """
    j = picks.join(runs.withColumnRenamed("run", "final_from"), "final_from", "left")
    reason = (
        F.when(F.col("final_from").isNull(), None)   # nothing was asked for
        .when(F.col("run_mode").isNull(), "could not read the final run")
        .when(F.col("run_mode") != "from", "not a single-frame run")
        .when(F.col("e_final").isNull(), "its final tier did not run")
        .when((F.col("n_atoms") > 0) & (F.col("run_atoms") > 0) & (F.col("n_atoms") != F.col("run_atoms")), "atom counts differ"))
    return j.select("entry", "final_from", F.when(F.col("final_from").isNotNull() & reason.isNull(), F.round(F.col("e_final").cast("decimal(28,10)"), 5).cast("double")).alias("e_final"), reason.alias("reason"))


def reuse_checkpoint(configs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, to do): configurations whose content key is cached, and the rest."""
    return configs.join(cache, "key"), configs.join(cache.select("key"), "key", "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Failures never enter the cache."""
    return results.filter(F.col("valid") & F.col("energy").isNotNull() & ~F.isnan("energy"))


def content_key(tag: Column, symbols: Column, numbers: Column) -> Column:
    """Hash of what makes a configuration: potential tag, symbols, and numbers at six decimals with
    minus zero equal to zero."""
    text = F.transform(numbers, lambda v: F.format_string("%.6f", F.round(v, 6) + F.lit(0.0)))
    return F.sha1(F.concat_ws("|", tag, F.array_join(symbols, " "), F.array_join(text, " ")))
