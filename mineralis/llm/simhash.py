"""Near-duplicate texts by SimHash fingerprints and trees of Hamming distances.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Two texts are linked if
their fingerprints differ in two bits or fewer. Distinct fingerprints are dealt to shards: the 64 bits fall
into three runs, and of two linked fingerprints at least one run is equal, so a shard holds the fingerprints
that agree in the leading bits of one run and each fingerprint stands in three shards. A shard that grows too
large is dealt again by more bits of its run, then by thirds of the bits that may still differ; after five
such steps only 2^13 fingerprints can share a shard, so every shard is bounded, whatever the data.

Each shard becomes a BK-tree: the first fingerprint is the root, the children of a node are keyed by their
Hamming distance to it, and everything below a child has that distance to the node. A search goes from
a node at distance d only along edges from d - 2 to d + 2. Trees are written as arrays; while all of them
together are small they are broadcast, beyond that they meet their shard's fingerprints in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import without
from .neardup import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: fingerprints that a shard holds on average, and at most before it is dealt again
SHARD_AIM, SHARD_MOST = 1024, 8192
#: bytes of all trees up to which they are broadcast
BROADCAST_BYTES = 32 << 20
NODE_BYTES = 13
#: fingerprints that search a tree at a time
SEARCHERS = 512
#: bits of a batch of hashes that are counted at a time
CHUNK = 255 * 256

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TREE = "mask long, value long, fps binary, keys binary, nodes int"


# ---- fingerprints --------------------------------------------------------------------------------

def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if a text has fewer words."""
    # bytes.split cuts at exactly the six ASCII white-space characters
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    shifted = [words[k:] for k in range(min(SHINGLE, len(words)))]
    joined = map(b" ".join, zip(*shifted))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(shifted[-1]))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set where over half of the hashes have it; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[start:start + CHUNK]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255   # a byte can count 255 rows
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` less its text, with ``fp`` (the 64 bits as a signed long)."""

    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(shingle_hashes(t)) if t else 0 for t in batch], dtype=np.uint64).astype(np.int64)

    bits = F.pandas_udf(read, "long", F.PandasUDFType.SCALAR_ITER)
    return without(docs, "fp").withColumn("fp", bits("text")).drop("text")


# ---- shards --------------------------------------------------------------------------------------

def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def thirds(bits: list[int]) -> list[list[int]]:
    """The bits in three runs; two numbers that differ in at most two bits agree in one run."""
    return [bits[k * len(bits) // 3:(k + 1) * len(bits) // 3] for k in range(RADIUS + 1)]


def finer(lead: int) -> dict[int, list[int]]:
    """Mask of equal bits -> masks that deal a shard again, from ``lead`` bits of each first run down to
    masks that leave so few bits open that a shard cannot be too large."""
    below: dict[int, list[int]] = {}

    def grow(fixed: list[int]) -> None:
        open_ = [b for b in range(64) if b not in set(fixed)]
        if 1 << len(open_) <= SHARD_MOST:
            return
        children = [sorted(fixed + run) for run in thirds(open_)]
        below[_mask(fixed)] = [_mask(c) for c in children]
        for child in children:
            if _mask(child) not in below:
                grow(child)

    for run in thirds(list(range(64))):
        if lead < len(run):
            below[_mask(run[:lead])] = [_mask(run)]
        grow(run)
    return below


def seats(distinct: DataFrame, n_distinct: int) -> DataFrame:
    """(mask, value, fp): the shards of each fingerprint, those with a single one left out.

    Two fingerprints within the radius share a shard. No shard has more than ``SHARD_MOST``.
    """
    spark = distinct.sparkSession
    lead = max(1, min(21, int(np.ceil(np.log2(max(n_distinct, 1) / SHARD_AIM))))) if n_distinct > SHARD_AIM else 1
    first = [_mask(run[:lead]) for run in thirds(list(range(64)))]
    table = spark.createDataFrame([(m, c) for m, below in finer(lead).items() for c in below], "mask long, child long")
    placed = lambda masks: F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    seated = distinct.select("fp", placed(first).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    settled = None
    while True:
        seated = cut_lineage(seated)
        sizes = seated.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
        fit = seated.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= SHARD_MOST)), ["mask", "value"]).select("mask", "value", "fp")
        settled = fit if settled is None else settled.unionByName(fit)
        large = cut_lineage(sizes.filter(F.col("n") > SHARD_MOST).select("mask", "value"))
        if large.isEmpty():
            return settled.distinct()
        again = seated.join(large, ["mask", "value"], "left_semi").join(F.broadcast(table), "mask")   # a fixed table of a few hundred rows
        seated = again.select("fp", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value")).distinct()


# ---- trees ---------------------------------------------------------------------------------------

def build_tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-tree of distinct fingerprints: the nodes' fingerprints and, for all but the root, the sorted keys
    65 * parent + distance. Node k + 1 has key k, so the children of a node are a run of keys.

    The tree is the one that inserting the fingerprints one by one gives, built a level at a time: all that
    fall below one edge wait together, the first of them is the child and the others go on below it.
    """
    nodes, keys = [fps[:1]], []
    waiting = fps[1:]
    parent = np.zeros(len(waiting), np.int64)
    above, made = fps[:1][parent], 1
    while len(waiting):
        key = 65 * parent + np.bitwise_count(waiting ^ above)
        edges, first, group = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edges)
        nodes.append(waiting[first])
        rest = np.ones(len(waiting), bool)
        rest[first] = False
        above = waiting[first][group[rest]]
        parent = made + group[rest]
        waiting, made = waiting[rest], made + len(first)
    return np.concatenate(nodes), np.concatenate(keys) if keys else np.empty(0, np.int64)


def search_tree(nodes: np.ndarray, keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``fps``, node) of every fingerprint of the tree within ``radius``. A level at a time, each
    searcher goes along the edges whose distance is within ``radius`` of its own."""
    at, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    found_at, found = [], []
    while len(at):
        d = np.bitwise_count(fps[at] ^ nodes[node]).astype(np.int64)
        hit = d <= radius
        found_at.append(at[hit])
        found.append(node[hit])
        low = np.searchsorted(keys, 65 * node + np.maximum(d - radius, 0))
        count = np.searchsorted(keys, 65 * node + np.minimum(d + radius, 64), side="right") - low
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, node = np.repeat(at, count), np.repeat(low, count) + step + 1
    return np.concatenate(found_at), np.concatenate(found)


def _trees(shards: DataFrame) -> DataFrame:
    """One row per shard with its tree. A partition has whole shards; one shard at a time is in memory."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def trees(rows: pd.DataFrame) -> pd.DataFrame:
            mask, value, fps = (rows[c].to_numpy() for c in ("mask", "value", "fp"))
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            out = []
            for start, end in zip(np.append(0, edge), np.append(edge, len(rows))):
                nodes, keys = build_tree(fps[start:end].view(np.uint64))
                out.append((mask[start], value[start], nodes.tobytes(), keys.astype(np.int32).tobytes(), end - start))
            return pd.DataFrame(out, columns=["mask", "value", "fps", "keys", "nodes"])

        for batch in batches:
            last = (batch["mask"].iat[-1], batch["value"].iat[-1]) if len(batch) else None
            rows = pd.concat([*held, batch]) if held else batch
            open_ = (rows["mask"] == last[0]) & (rows["value"] == last[1]) if last else np.zeros(len(rows), bool)
            held = [rows[open_]]   # the last shard may go on in the next batch
            if not open_.all():
                yield trees(rows[~open_])
        if held and len(held[0]):
            yield trees(held[0])

    sorted_ = shards.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return sorted_.mapInPandas(grow, TREE)


class _Forest:
    """Union-find over the fingerprints of one shard; a link within a set is not passed on."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _size_of_trees(trees: DataFrame) -> int:
    return NODE_BYTES * (trees.agg(F.sum("nodes").alias("n")).first().n or 0)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints; those of one shard connect what lies within the radius.

    Each shard's fingerprints search their shard's tree in packs of ``SEARCHERS``.
    """
    n = distinct.count()
    trees = cut_lineage(_trees(seats(distinct, n)))
    packs = trees.select("mask", "value", F.explode(F.sequence(F.lit(0), F.floor((F.col("nodes") - 1) / SEARCHERS).cast("int"))).alias("pack"))
    small = _size_of_trees(trees) <= BROADCAST_BYTES
    # a number, so that these small rows with long searches are not put together in one task
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = packs.repartition(parts, "mask", "value", "pack").join(F.broadcast(trees) if small else trees, ["mask", "value"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pack, fps, keys in zip(batch["pack"], batch["fps"], batch["keys"]):
                nodes, keys = np.frombuffer(fps, np.uint64), np.frombuffer(keys, np.int32).astype(np.int64)
                start = pack * SEARCHERS
                at, node = search_tree(nodes, keys, nodes[start:start + SEARCHERS])
                at = at + start
                forest, signed = _Forest(len(nodes)), nodes.view(np.int64)
                for a, b in zip(at[at < node].tolist(), node[at < node].tolist()):
                    if forest.join(a, b):
                        out.append((signed[a], signed[b]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return met.select("pack", "fps", "keys").mapInPandas(search, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of each row; ``component_id`` is the smallest id reachable.

    Null and empty texts and texts without a word have fingerprint zero and are linked like any other; a text
    of fewer than three words is one shingle; texts of any length count whole. Equal fingerprints are one entry, so copies are
    never compared. Repeated rows share a component. Null ids get a component as other rows do and are
    skipped in naming it; one of null ids only has a null ``component_id``. Columns other than doc_id and
    text are ignored, whatever their names. An empty table gives an empty table.
    """
    rows = cut_lineage(fingerprints(docs.select("doc_id", "text")))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut_lineage(links(distinct.select("fp")))
    labels = components(found).select(F.col("_cid").alias("fp"), "comp")
    placed = distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    named = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_fp = cut_lineage(placed.select("fp", "comp").join(named, "comp").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
