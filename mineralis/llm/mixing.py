"""Time-varying curriculum: which words of which document a training run reads, and when.

A source's weight is a schedule over the run's time t in [0, 1], a piecewise linear curve given by
knots. Its integral is the source's demand for words; the cumulative demand, inverted, turns a place
in the source's stream of words into the time at which those words are read. Sorting all documents by
that time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, without

#: weights of the sources in the order of their names, repeating, and the curve of each: an even
#: start-to-end fall, a level line, and a rise
WEIGHTS = (5, 2, 1)
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: hexadecimal digits of the shuffled order's key that name a bucket: 4096 buckets to a source
BUCKET_DIGITS = 3
MADE = ("size", "source_size", "target", "taken", "positions", "_class", "_key", "_bucket", "_before", "_inside")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, _class (its place in ``weights``).

    The weights share the sum of all sizes; no target exceeds ``cap`` times its source's size, and what
    that leaves over goes to the others by weight. Sources are ordered by code point, null last. The
    table has one row per source, so its windows run over as many rows as there are sources. All sums
    are integers, the target is one division, so reruns agree to the bit.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("_class", (place % len(weights)).cast("int"))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("_class") + 1))
    per = per.withColumn("_cap", cap * F.col("source_size"))
    order = W.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rest = total - F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("_full", F.col("_cap") * open_weight <= rest * F.col("_w")).withColumn("_total", total)
    left = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything)
    left_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everything)
    shared = F.try_divide((F.col("_w") * left).cast("double"), left_weight.cast("double"))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(shared)
    return per.select("source", "source_size", target.alias("target"), "_class")


def read_time(part: Column, curve: tuple[tuple[float, float], ...]) -> Column:
    """The time by which ``part`` (0 to 1) of the demand under ``curve`` has been read.

    Between knots the rate is linear, the cumulative demand a parabola; its inverse is taken in the form
    that also holds for a level rate.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:])]
    out, done, whole = F.lit(curve[-1][0]), sum(areas), sum(areas)
    for (t0, m0), (t1, m1), area in reversed(list(zip(curve, curve[1:], areas))):
        done -= area
        need = part * F.lit(whole) - F.lit(done)
        slope = (m1 - m0) / (t1 - t0)
        rate = F.lit(m0) + F.sqrt(F.lit(m0 * m0) + F.lit(2 * slope) * need)
        time = F.lit(t0) + F.coalesce(F.try_divide(2 * need, rate), F.lit(0.0))   # no rate yet: nothing needed yet
        out = F.when(need >= 0, F.when(need <= area, time).otherwise(out)).otherwise(time) if done > 0 else F.when(need <= area, time).otherwise(out)
    return out


def curriculum(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, curves=CURVES, cap: int = 3) -> DataFrame:
    """``docs`` with size, source_size, target, taken and positions.

    ``taken`` counts the words read, repeats included, at most ``cap`` times ``size``; ``positions`` has
    the time of each pass over the document, in order (null for a document that is not read). A source's
    documents follow each other in the order of the MD5 of their id, then the id (rows of one id by size, so
    that reruns agree; which of two texts of one id and size comes first is open); the source's stream is
    read again from its start while its demand lasts, so the words taken sum to the whole part of the
    target. Only the last document read may be read in part.

    Prefix sums are taken in two steps, over the buckets of a source and inside a bucket, so a source
    with a third of all rows spreads over thousands of buckets.

    Null or empty text: size 0, taken 0. A null source is a source of its own, the last; a null id sorts
    by the MD5 of the empty text. Repeated rows each count. An empty table gives an empty table. Input
    columns that bear the name of a made column are replaced; others pass through.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = (without(docs, *MADE)
             .withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
             .withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)))
    targets = source_targets(sized.select("source", "size"), weights, cap)
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").cast("long").alias("_n"))
    over = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before")
    offsets = buckets.select("source", "_bucket", before)
    offsets = _null_safe(offsets, targets, ["source"])
    inside = W.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = _null_safe(placed, offsets, ["source", "_bucket"])
    start = F.col("_before") + F.col("_inside")
    whole = F.floor("target")
    takes, times = [], []
    for turn in range(cap):
        at = start + turn * F.col("source_size")
        takes.append(F.least(F.greatest(whole - at, F.lit(0)), F.col("size")))
        part = F.try_divide(at.cast("double"), F.col("target"))
        time = F.lit(None).cast("double")
        for k, curve in enumerate(curves):
            time = F.when(F.col("_class") == k, read_time(part, curve)).otherwise(time)
        times.append(F.when((at < whole) & (F.col("size") > 0), time))
    taken = sum(takes[1:], takes[0]).cast("long")
    positions = F.filter(F.array(*times), lambda t: t.isNotNull())
    out = placed.withColumn("taken", taken).withColumn("positions", F.when(F.size(positions) > 0, positions))
    return out.drop("_class", "_key", "_bucket", "_before", "_inside")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.select([F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def whole_passes(mixed: DataFrame) -> DataFrame:
    """Rows of ``curriculum`` for use as whole documents: a last pass of under half the words is left out."""
    turns = F.floor((F.col("taken") + F.col("size") / 2) / F.greatest("size", F.lit(1))).cast("int")
    kept = mixed.filter((F.col("taken") > 0) & (turns > 0))
    return kept.withColumn("positions", F.slice("positions", F.lit(1), F.least(turns, F.size("positions"))))


def training_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``curriculum`` once per pass, range-sorted by the time they are read."""
    once = mixed.withColumn("position", F.explode("positions"))
    return once.orderBy("position", "source", F.col("doc_id").asc_nulls_first(), "size", F.xxhash64("text"))
