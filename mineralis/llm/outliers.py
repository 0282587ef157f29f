"""Quality by robust multivariate outliers, in DataFrame operations throughout.

Each text becomes a vector of transformed statistics. For each language and source, the minimum covariance
determinant is approached by concentration steps from a deterministic start: keep the three quarters of
the rows that lie nearest, take their mean and covariance, measure again. Rows whose Mahalanobis distance
from the final estimate is far out in the chi-squared tail are rejected.

Statistics are whole thousandths, so sums are exact integers and reruns agree however rows are dealt. All
estimates are partial aggregates of one row per group; a group with a third of all rows is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, let, without

#: fixed values of the base rules
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

SCALE = 1000
#: statistic -> least standard deviation, in its own unit: a statistic that is constant in a group would
#: else reject every other value
STATISTICS = {"s_words": 0.25, "s_length": 0.25, "s_symbols": 0.08, "s_lines": 0.15, "s_repeats": 0.15}
#: share of rows in the concentrated subset, steps, median of chi-squared with five degrees of freedom
SHARE, STEPS, CHI2_MEDIAN = 0.75, 3, 4.35146
#: chi-squared with five degrees of freedom exceeds this in one case of ten million
CUTOFF = 42.9
#: rows a group needs for an estimate of its own
LEAST_ROWS = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MADE = (*COUNTS, "n_lines", "base_failed", *STATISTICS, "_unit", "_bin", "distance", "kept")


def _repeated_words(words: Column, n: Column) -> Column:
    """Words inside windows of eight that occur twice or more, given the word array as a lambda variable."""
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))

    def covered(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return let(ordered, lambda o: count(F.sort_array(F.transform(F.filter(
            o, lambda x, k: (F.get(o, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(o, k - 1)["h"] == x["h"]))), lambda x: x["at"]))))

    def count(places):
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")), lambda acc: acc["n"])

    zero = F.lit(0).cast("long")
    return let(windows, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), covered(h)).otherwise(zero))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and the statistics of the whole text.

    Words are runs of characters other than ASCII white space; null text has none. Counts are 64-bit.
    ``base_failed``: fewer than 20 words, or over 30 of 100 words in windows of eight words that occur
    twice or more. Columns with the names of made ones are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    both = let(words, lambda w: let(F.size(w), lambda n: F.struct(n.cast("long").alias("n"), _repeated_words(w, n).alias("r"))))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    out = (without(docs, *MADE).withColumn("_w", both).withColumn("_l", lines)
           .withColumn("n_words", F.col("_w.n")).withColumn("n_repeat_words", F.coalesce(F.col("_w.r"), F.lit(0)).cast("long"))
           .withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long"))
           .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
           .withColumn("n_lines", F.col("_l.n")).withColumn("n_dup_lines", F.col("_l.dup")).drop("_w", "_l"))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    words_, chars, lines_ = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    made = {"s_words": F.log1p("n_words"), "s_length": F.col("word_chars") / words_, "s_symbols": F.sqrt(F.col("n_symbols") / chars),
            "s_lines": F.sqrt(F.col("n_dup_lines") / lines_), "s_repeats": F.sqrt(F.col("n_repeat_words") / words_)}
    return out.withColumns({k: F.least(F.round(v * SCALE), F.lit(100 * SCALE)).cast("long") for k, v in made.items()})


def _units(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``rows`` with ``_unit``: the group a row is measured in.

    That is its own (null counts as a value) if ``LEAST_ROWS`` of its rows passed the base rules; rows of
    smaller groups are pooled over all groups but the first column, then over all; null if even that pool
    is too small.
    """
    passed = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
    sizes = rows.groupBy(*groups).agg(passed.alias("_n"))
    name = lambda level, *cols: F.concat(F.lit(level), F.to_json(F.array(*[F.col(c).cast("string") for c in cols])))
    small = sizes.filter(F.col("_n") < LEAST_ROWS)
    pools = small.groupBy(groups[0]).agg(F.sum("_n").alias("_pool"))
    last = pools.filter(F.col("_pool") < LEAST_ROWS).agg(F.sum("_pool").alias("_last"))
    pools = pools.join(F.broadcast(last))   # one row
    pools = pools.select(F.col(groups[0]).alias("_g"), F.when(F.col("_pool") >= LEAST_ROWS, name("1", groups[0]))
                         .when(F.col("_last") >= LEAST_ROWS, F.lit("2")).alias("_pooled"))
    units = sizes.join(pools, sizes[groups[0]].eqNullSafe(pools["_g"]), "left")
    units = units.select(*[F.col(g).alias(f"_u_{g}") for g in groups],
                         F.when(F.col("_n") >= LEAST_ROWS, name("0", *groups)).otherwise(F.col("_pooled")).alias("_unit"))
    units = cut_lineage(units)
    on = [rows[g].eqNullSafe(units[f"_u_{g}"]) for g in groups]
    return rows.join(units, on, "left").drop(*[f"_u_{g}" for g in groups])


def _cholesky(fit: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``m_i`` and ``l_i_j`` (lower triangle) from ``m_i`` and covariances ``c_i_j``."""
    for j in range(len(names)):
        inner = [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
        fit = fit.withColumn(f"l_{j}_{j}", F.sqrt(sum((-x for x in inner), F.col(f"c_{j}_{j}"))))
        for i in range(j + 1, len(names)):
            inner = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
            fit = fit.withColumn(f"l_{i}_{j}", sum((-x for x in inner), F.col(f"c_{i}_{j}")) / F.col(f"l_{j}_{j}"))
    return fit.drop(*[f"c_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])


def _measured(rows: DataFrame, fit: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``distance``: the squared Mahalanobis distance, null without a fit."""
    out = rows.join(fit.withColumnRenamed("_unit", "_fit"), F.col("_unit") == F.col("_fit"), "left")
    made = []
    for i, name in enumerate(names):
        value = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", value / F.col(f"l_{i}_{i}"))
        made.append(F.col(f"z_{i}") * F.col(f"z_{i}"))
    return out.withColumn("distance", sum(made[1:], made[0])).drop(
        "_fit", *[c for c in fit.columns if c != "_unit"], *[f"z_{i}" for i in range(len(names))])


def _start(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Medians and scaled median deviations, no correlation."""
    half = F.lit(0.5)
    mid = cut_lineage(rows.groupBy("_unit").agg(*[F.percentile(n, half).alias(f"m_{i}") for i, n in enumerate(names)]))
    apart = rows.join(mid, "_unit").groupBy("_unit").agg(*[
        F.percentile(F.abs(F.col(n) - F.col(f"m_{i}")).cast("long"), half).alias(f"d_{i}") for i, n in enumerate(names)])
    both = mid.join(apart, "_unit")
    zero = {f"l_{i}_{j}": F.lit(0.0) for i in range(len(names)) for j in range(i)}
    own = {f"l_{i}_{i}": F.sqrt(F.pow(1.4826 * F.col(f"d_{i}"), 2) + floors[i] ** 2) for i in range(len(names))}
    return cut_lineage(both.withColumns(own | zero).drop(*[f"d_{i}" for i in range(len(names))]))


def _bin() -> Column:
    """Squared distances in bins of a tenth of a percent: few enough for exact percentiles by counting."""
    return F.floor(F.log1p("distance") * 1000).cast("long")


def concentrate(rows: DataFrame, statistics: dict[str, float], steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """Mean and Cholesky factor of each ``_unit`` of ``rows`` after ``steps`` concentration steps."""
    names, floors = list(statistics), [f * SCALE for f in statistics.values()]
    fit = _start(rows, names, floors)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    for step in range(steps):
        near = _measured(rows, fit, names).withColumn("_bin", _bin())
        cuts = cut_lineage(near.groupBy("_unit").agg(F.percentile("_bin", F.lit(share)).alias("_cut")))
        kept = near.join(cuts, "_unit").filter(F.col("_bin") <= F.col("_cut"))
        sums = kept.groupBy("_unit").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"t_{i}") for i, n in enumerate(names)],
            *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i, j in pairs])
        fit = sums.select("_unit", *[(F.col(f"t_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(names))], *[
            (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"t_{i}") / F.col("n") * (F.col(f"t_{j}") / F.col("n"))
             + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs])
        fit = cut_lineage(_cholesky(fit, names))
    # the subset is too tight by a factor that the median of the distances shows
    middle = _measured(rows, fit, names).withColumn("_bin", _bin()).groupBy("_unit").agg(F.percentile("_bin", F.lit(0.5)).alias("_mid"))
    wide = F.sqrt(F.greatest(F.expm1((F.col("_mid") + 0.5) / 1000) / CHI2_MEDIAN, F.lit(1.0)))
    scaled = fit.join(middle, "_unit").withColumns({f"l_{i}_{j}": F.col(f"l_{i}_{j}") * wide for i, j in pairs})
    return cut_lineage(scaled.drop("_mid"))


def judge(stats: DataFrame, groups: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``text_statistics`` with ``distance`` (null without an estimate) and ``kept``.

    A row is kept if it passed the base rules and its squared distance is at most ``cutoff``, or its pool
    was too small for an estimate. Estimates rest on all rows that passed the base rules. Null groups are
    groups of their own; repeated rows each count; an empty table gives an empty table.
    """
    rows = _units(stats, list(groups))
    fit = concentrate(rows.filter(~F.col("base_failed") & F.col("_unit").isNotNull()), STATISTICS)
    out = _measured(rows, fit, list(STATISTICS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).drop("_unit")
