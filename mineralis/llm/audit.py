"""How filters interact: what each removes at each step of every order, and its Shapley value.

Everything follows from one small table. A document fails a set of filters; a coalition of filters removes
the documents that fail at least one of its members. With v(S) the number that coalition S removes, a step
that adds filter f after the filters S removes v(S + f) - v(S), whatever the order within S.

Shapley values come from constrained least squares: among all additive values phi with sum v(all), those that
minimise the sum over coalitions of w(S) * (v(S) - phi(S))^2 with the Shapley kernel
w(S) = (n - 1) / (C(n, s) * s * (n - s)). The normal equations with the multiplier of the constraint are
solved in rationals, so the values are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, let, without

FILTERS = ("A", "B", "C", "D", "E")
#: fixed values of the filters: least words, least percent of distinct words, most percent of capitals
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"


# ---- filters -------------------------------------------------------------------------------------

def text_failures(text: Column) -> Column:
    """Struct (A, B, C, D) of booleans, true where the filter rejects the text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    few = let(words, lambda w: F.struct(
        (F.size(w) < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct(w)).cast("long") < LEAST_DISTINCT * F.size(w).cast("long")).alias("B")))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return F.struct(few["A"].alias("A"), few["B"].alias("B"),
                    (100 * capitals > MOST_CAPITALS * F.length(text).cast("long")).alias("C"), text.rlike(SYMBOLS).alias("D"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): bit k of ``mask`` is set where the document fails ``FILTERS[k]``.

    E is identity with the text of any smaller id of the whole table; texts are told apart by SHA-256. Rows
    that share the smallest id of a text all pass it, and a null id is neither smaller nor larger than
    another. Only ids and digests are shuffled; a text that many rows share is one row of the table of
    smallest ids, and rows are looked up there by id, so no group of copies meets in a task.
    """
    flags = text_failures(F.col("text"))
    bits = [F.when(flags[name], 1 << k).otherwise(0) for k, name in enumerate(FILTERS[:-1])]
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), sum(bits[1:], bits[0]).cast("int").alias("own"))
    rows = cut_lineage(rows)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    named = rows.filter(F.col("doc_id").isNotNull())
    seen = named.join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    repeats = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return seen.select("doc_id", "part", (F.col("own") + repeats).cast("int").alias("mask")).unionByName(
        rows.filter(F.col("doc_id").isNull()).select("doc_id", "part", F.col("own").alias("mask")))


# ---- coalitions ----------------------------------------------------------------------------------

def coalitions(rows: DataFrame, n_filters: int, weights: dict[str, Column], part: str = "part", mask: str = "mask") -> DataFrame:
    """(part, total, for each weight an array): element S of an array is the weight that coalition S removes.

    ``rows``: one per document with the filters it fails as bits of ``mask``. Rows are counted per part and
    mask before they move, so a part of any size is at most 2^n rows.
    """
    patterns = rows.groupBy(F.col(part).alias("part"), F.col(mask).alias("mask")).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum(w.cast("long")).alias(name) for name, w in weights.items()])
    removed = lambda name: F.array(*[
        F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(name)).otherwise(F.lit(0))) for s in range(1 << n_filters)])
    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("total")).otherwise(F.lit(0))) for k in range(n_filters)])
    return patterns.groupBy("part").agg(
        F.sum("total").alias("total"), removed("total").alias("removed"), alone.alias("alone"), *[removed(name).alias(name) for name in weights])


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system by elimination in rationals."""
    rows = [[*map(Fraction, line), Fraction(b)] for line, b in zip(matrix, right)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [line[-1] for line in rows]


def shapley(values: list[int], n: int) -> list[Fraction]:
    """Shapley values of ``n`` players from the value of each of the 2^n coalitions (that of none is zero)."""
    inner = range(1, (1 << n) - 1)
    kernel = lambda s: Fraction(n - 1, comb(n, s) * s * (n - s))
    has = lambda s, k: s >> k & 1
    weight = {s: kernel(s.bit_count()) for s in inner}
    normal = [[sum((weight[s] for s in inner if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    right = [sum((weight[s] * values[s] for s in inner if has(s, i)), Fraction(0)) for i in range(n)] + [Fraction(values[-1])]
    return solve(normal, right)[:n]


def with_shapley(table: DataFrame, n_filters: int, value: str = "removed") -> DataFrame:
    """``table`` of ``coalitions`` with ``shapley``: for each filter its Shapley value times n!, an integer."""
    times = factorial(n_filters)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[int(times * x) for x in shapley([int(v) for v in values], n_filters)] for values in batch], dtype=object)

    return without(table, "shapley").withColumn("shapley", F.pandas_udf(read, "array<long>", F.PandasUDFType.SCALAR_ITER)(value))


def steps(table: DataFrame, filters: tuple[str, ...], weights: dict[str, str]) -> DataFrame:
    """One row per part, order of all filters and step, from differences of coalitions.

    ``table``: of ``coalitions`` and ``with_shapley``; ``filters``: one letter each; ``weights``: array column
    -> name of what is lost.
    """
    bit = F.create_map(*[F.lit(x) for k, name in enumerate(filters) for x in (name, 1 << k)])
    place = F.create_map(*[F.lit(x) for k, name in enumerate(filters) for x in (name, k)])
    orders = F.array(*[F.lit("".join(order)) for order in permutations(filters)])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.filter(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), lambda x: x != "")
    grid = table.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    grid = grid.withColumns({"_k": place[letter], "_own": bit[letter], "_before": F.aggregate(earlier, F.lit(0), lambda sum_, x: sum_ + bit[x])})
    at = lambda name, s: F.get(F.col(name), s)
    after = F.col("_before") + F.col("_own")
    gained = lambda name: at(name, after) - at(name, F.col("_before"))
    return grid.select(
        "part", "filter_order", "step", (F.col("total") - at("removed", after)).alias("kept"), gained("removed").alias("removed"),
        (at("removed", F.col("_own")) - gained("removed")).alias("redundant"), at("alone", F.col("_k")).alias("unique_fails"),
        *[gained(name).alias(lost) for name, lost in weights.items()], at("shapley", F.col("_k")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A part is a source, null and empty together. An empty text fails A only (and E after its first id).
    Several labels of one id count as good, or toxic, if one of them is; labels of a null id belong to
    nobody. Repeated rows each count. Columns other than doc_id, text and source are ignored, whatever their
    names. An empty table has no parts and gives no rows; without labels nothing good or toxic is lost.
    """
    failed = failures(docs.select("doc_id", "text", "source"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    nobody = F.col("doc_id").isNull()   # rows without an id look nothing up, so that they need not meet in one task
    none = F.lit(False)
    marked = failed.filter(~nobody).join(marks, "doc_id", "left").select("part", "mask", "good", "bad").unionByName(
        failed.filter(nobody).select("part", "mask", none.alias("good"), none.alias("bad")))
    weight = lambda c: F.when(F.col(c), 1).otherwise(0)
    table = cut_lineage(coalitions(marked, len(FILTERS), {"good": weight("good"), "bad": weight("bad")}))
    return steps(with_shapley(table, len(FILTERS)), FILTERS, {"good": "good_lost", "bad": "toxic_lost"})
