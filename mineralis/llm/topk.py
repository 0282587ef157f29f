"""Exact top-k search by inner product, block at a time.

Vectors are ordered by their dominant component, so that neighbours are alike, and cut into blocks: a
range of documents with its forward index (a matrix) and, for each component, the largest and the
smallest value in it. The sum of the better products of a query with these extremes bounds every score in
the block. Each query first scores the blocks with the highest bounds; the k-th score found there is a
floor, and of the other blocks only those whose bound reaches it are scored, the rest cannot hold a result.

A stated query set meets all rows in blocks: packs of queries meet pages of block summaries, and then only
pairs of pack and block that a bound left over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows of a block, queries of a pack, summaries of a page, blocks that a query scores first
BLOCK_ROWS, PACK_ROWS, PAGE_BLOCKS, LEAD = 512, 256, 512, 2
EXACT = float(1 << 53)

PACKED = "part long, ids binary, rows binary, width int, top binary, low binary"
HITS = "pack long, q int, query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(vec_id, v): each component x as floor(factor * x), for vectors without null or non-finite parts."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = table.filter(x.isNotNull() & sound & F.col("vec_id").isNotNull())
    return usable.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * factor).cast("long")).alias("v"))


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, width) if width else np.zeros((0, 0), np.int64)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors that follow each other in the order of dominant component and id.

    Range partitioning splits any run of equal components by id. Shorter vectors are filled with zeros.
    """
    size = F.transform("v", lambda c: F.abs(c))
    at = F.array_position(size, F.array_max(size))
    key = F.coalesce(at * F.when(F.try_element_at("v", at.cast("int")) < 0, -1).otherwise(1), F.lit(0)).alias("key")
    ordered = vectors.select("vec_id", "v", key)
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        count, ids, values = TaskContext.get().partitionId() << 32, [], []

        def block() -> pd.DataFrame:
            width = max(map(len, values))
            full = np.zeros((len(values), width), np.int64)
            for row, v in zip(full, values):
                row[:len(v)] = v
            top, low = (full.max(0), full.min(0)) if width else (full[0], full[0])
            return pd.DataFrame([(count, np.array(ids, np.int64).tobytes(), full.tobytes(), width, top.tobytes(), low.tobytes())],
                                columns=["part", "ids", "rows", "width", "top", "low"])

        for batch in batches:
            for vec_id, v in zip(batch["vec_id"], batch["v"]):
                ids.append(vec_id)
                values.append(v)
                if len(ids) == rows:
                    yield block()
                    count, ids, values = count + 1, [], []
        if ids:
            yield block()

    return cut_lineage(ordered.mapInPandas(cut, PACKED))


def _pages(blocks: DataFrame) -> DataFrame:
    """Summaries, ``PAGE_BLOCKS`` to a row: parts, widths, tops and lows as arrays."""
    slot = F.pmod(F.xxhash64("part"), F.lit(max(1, -(-blocks.count() // PAGE_BLOCKS)))).alias("page")
    return blocks.groupBy(slot).agg(F.collect_list(F.struct("part", "top", "low")).alias("blocks"))


def _dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T in exact integers; components past the shorter width count as zero."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(width, 1)
    if most < EXACT:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    if most < 2.0 ** 62:
        return left @ right.T
    wide = left.astype(object) @ right.T.astype(object)   # beyond 64 bits a score stands at the end of the range
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def bounds(queries: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Upper bound of each query's score in each block, as floats that are never too low."""
    width = min(queries.shape[1], tops.shape[1])
    q, t, lo = (m[:, :width].astype(float) for m in (queries, tops, lows))
    sums = np.maximum(q, 0) @ t.T + np.minimum(q, 0) @ lo.T
    return sums + 1e-9 * np.abs(sums) + 1e-12 * (np.abs(q) @ np.maximum(np.abs(t), np.abs(lo)).T)


def _summaries(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tops, lows = ([np.frombuffer(b[c], np.int64) for b in blocks] for c in ("top", "low"))
    width = max(map(len, tops), default=0)
    full = lambda rows: np.array([np.pad(r, (0, width - len(r))) for r in rows], np.int64).reshape(len(rows), width)
    return np.array([b["part"] for b in blocks], np.int64), full(tops), full(lows)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows at or above ``floor``, other than ``own``; ties to the smaller id."""
    usable = (ids != own) & (scores >= floor)
    scores, ids = scores[usable], ids[usable]
    if len(scores) > k:
        kth = np.partition(scores, -k)[-k]
        ids, scores = ids[scores >= kth], scores[scores >= kth]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _scored(pairs: DataFrame, blocks: DataFrame, packs: DataFrame, k: int) -> DataFrame:
    """Hits of pairs (pack, block, qs, floors): the queries ``qs`` of the pack in that block."""
    right = blocks.select(F.col("part").alias("block"), F.col("ids").alias("b_ids"), F.col("rows").alias("b_rows"), F.col("width").alias("b_width"))
    left = packs.select(F.col("part").alias("pack"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("width").alias("q_width"))
    met = pairs.join(left, "pack").join(right, "block")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                names, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.b_ids, np.int64)
                qs, hits = np.asarray(r.qs, int), []
                queries = _matrix(r.q_rows, r.q_width) if r.q_width else np.zeros((len(names), 0), np.int64)
                rows = _matrix(r.b_rows, r.b_width) if r.b_width else np.zeros((len(ids), 0), np.int64)
                for q, floor, line in zip(qs, r.floors, _dot(queries[qs], rows)):
                    found, values = _best(line, ids, names[q], k, floor)
                    hits.append(pd.DataFrame({"pack": r.pack, "q": q, "query_id": names[q], "vec_id": found, "score": values}))
                yield pd.concat(hits)

    columns = ["pack", "qs", "floors", "q_ids", "q_rows", "q_width", "b_ids", "b_rows", "b_width"]
    return met.select(*columns).mapInPandas(score, HITS)


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query row.

    Both inputs have (vec_id, v array<long>) as ``integer_vectors`` makes them; other columns are ignored.
    Rows that bear the query's id are not its candidates. Ties go to the smaller id; repeated rows of the
    corpus each take a rank, repeated queries each get an answer. A query with fewer than ``k`` candidates
    gets them all. Vectors of unequal length are compared as if filled with zeros. Empty inputs give no rows.
    """
    blocks, packs = packed(corpus, BLOCK_ROWS), packed(queries, PACK_ROWS)
    pages = cut_lineage(_pages(blocks))
    seen = packs.select(F.col("part").alias("pack"), "ids", "rows", "width")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                parts, tops, lows = _summaries(r.blocks)
                n = len(r.ids) // 8
                b = bounds(np.frombuffer(r.rows, np.int64).reshape(n, r.width), tops, lows)
                lead = np.argsort(-b, axis=1, kind="stable")[:, :LEAD]
                q = np.repeat(np.arange(n), lead.shape[1])
                yield pd.DataFrame({"pack": r.pack, "q": q, "block": parts[lead.ravel()], "bound": b[q, lead.ravel()]})

    ordered = seen.crossJoin(pages).select("pack", "ids", "rows", "width", "blocks").mapInPandas(order, "pack long, q int, block long, bound double")
    rank = F.row_number().over(W.partitionBy("pack", "q").orderBy(F.desc("bound"), "block"))
    leads = ordered.withColumn("rank", rank).filter(F.col("rank") <= LEAD)
    first = leads.groupBy("pack", "block").agg(F.collect_list("q").alias("qs"))
    first = first.withColumn("floors", F.transform("qs", lambda q: F.lit(float("-inf"))))
    found = _scored(first, blocks, packs, k)
    # at most LEAD * k scores to a query, PACK_ROWS queries to a pack
    floors = found.groupBy("pack", "q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    floors = floors.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("q", F.try_element_at("s", F.lit(k)).cast("double").alias("floor")))).alias("floors"))
    floors = cut_lineage(floors)
    waiting = seen.join(floors, "pack", "left")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                parts, tops, lows = _summaries(r.blocks)
                n = len(r.ids) // 8
                known = dict(r.floors) if r.floors is not None else {}
                floor = np.array([-np.inf if known.get(q) is None or np.isnan(known[q]) else known[q] for q in range(n)])
                reach = bounds(np.frombuffer(r.rows, np.int64).reshape(n, r.width), tops, lows) >= floor[:, None]
                out = [(r.pack, int(parts[j]), qs.tolist(), floor[qs].tolist()) for j in range(len(parts)) if len(qs := np.flatnonzero(reach[:, j]))]
                if out:
                    yield pd.DataFrame(out, columns=["pack", "block", "qs", "floors"])

    left = (waiting.crossJoin(pages).select("pack", "ids", "rows", "width", "blocks", "floors")
            .mapInPandas(prune, "pack long, block long, qs array<int>, floors array<double>"))
    hits = _scored(cut_lineage(left), blocks, packs, k)
    place = F.row_number().over(W.partitionBy("pack", "q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
