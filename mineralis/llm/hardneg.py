"""Hard negatives for contrastive training, found through rotated one-bit codes.

Rows lie in blocks of neighbours. A row is its block's centre plus a residual; the residual is turned by a few fixed
rotations and only the signs are kept, one bit a coordinate, with two numbers beside them: the residual's
length and its alignment, the cosine between it and the vector that the code stands for. An anchor is turned
likewise and cut into a few bit planes, so its product with a code is a sum of popcounts.

With a the alignment, g the anchor's product with the unit vector of the code and |q| the anchor's length,
the residual's share of the score is its length times a * g, up to sqrt(1 - a^2) * sqrt(|q|^2 - g^2): what
is orthogonal to the code can be no more aligned with the anchor than the anchor's own orthogonal part (the
inequality of Cauchy and Schwarz). The interval is a proof, not an estimate of the error: a row outside
the wanted range of scores is left out, all others are scored in integers.

Anchors are a stated set that meets all rows in blocks. A cell is one pack of anchors with one slot of
blocks, both filled up to a bounded number of rows; its hits are few for each anchor and are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .topk import _dot

POSITIVES, NEGATIVES = 5, 3
#: percent of the positive's score between which a negative is hard and not itself a likely positive
LEAST_SHARE, MOST_SHARE = 50, 95
#: bytes and rows of a block, blocks of a slot, anchors of a pack, anchors that meet a block at a time
BLOCK_BYTES, BLOCK_ROWS, SLOT_BLOCKS, PACK_ROWS, TILE = 4 << 20, 2048, 4, 256, 64
#: rotations of a code (bits for each coordinate), bit planes of an anchor, rows scored first for a floor
ROTATIONS, PLANES, LEADS = 4, 7, 16

BLOCK = "part int, k int, ids binary, labels binary, rows binary, kind string, width int, centre binary, codes binary, about binary, known array<long>"
PACK = "part int, k int, ids binary, labels binary, rows binary, kind string, width int, known array<long>"


def labelled(table: DataFrame, vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(vec_id, label, v): components as floor(factor * x), of rows with an id, a label and a sound vector."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = table.filter(x.isNotNull() & sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                         F.transform(x, lambda c: F.floor(c.cast("double") * factor).cast("long")).alias("v"))


# ---- rotations and codes -------------------------------------------------------------------------

def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, p = x.shape
    step = 1
    while step < p:
        pair = x.reshape(n, -1, 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, p)
        step *= 2
    return x / np.sqrt(p)


class Turns:
    """The fixed rotations for vectors of one width: random signs and a transform, twice, for each turn."""

    def __init__(self, width: int) -> None:
        self.width, self.size = width, 1 << max(0, width - 1).bit_length()
        self.signs = np.random.default_rng(11).choice([-1.0, 1.0], (ROTATIONS, 2, self.size))
        self.bits = ROTATIONS * self.size
        self.words = -(-self.bits // 64)

    def turn(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        return np.concatenate([_hadamard(_hadamard(x * one) * two) for one, two in self.signs], axis=1)

    def back(self, y: np.ndarray) -> np.ndarray:
        """The transposed map: y . turn(x) = back(y) . x."""
        parts = np.split(y, ROTATIONS, axis=1)
        return sum(one * _hadamard(two * _hadamard(part)) for part, (one, two) in zip(parts, self.signs))[:, :self.width]

    def packed(self, bits: np.ndarray) -> np.ndarray:
        full = np.zeros((len(bits), 64 * self.words), bool)
        full[:, :bits.shape[1]] = bits
        return np.packbits(full, axis=1).view(np.uint64)


def encode(rows: np.ndarray, turns: Turns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, codes and, for each row, (length of the residual, alignment, length of the code's vector, ones)."""
    rows = rows.astype(float)
    centre = np.rint(rows.mean(axis=0))
    rest = rows - centre
    bits = turns.turn(rest) > 0
    vector = turns.back(np.where(bits, 1.0, -1.0))
    length, size = np.linalg.norm(rest, axis=1), np.linalg.norm(vector, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        align = np.where((length > 0) & (size > 0), (rest * vector).sum(axis=1) / (length * size), 0.0)
    return centre, turns.packed(bits), np.stack([length, np.clip(align, -1.0, 1.0), np.where(size > 0, size, 1.0), bits.sum(axis=1)])


class Asked:
    """Anchors as bit planes of their turned vectors."""

    def __init__(self, anchors: np.ndarray, turns: Turns) -> None:
        self.rows = anchors.astype(float)
        self.length = np.linalg.norm(self.rows, axis=1)
        z = turns.turn(self.rows)
        self.low = z.min(axis=1)
        self.step = np.maximum((z.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((z - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
        self.miss = np.abs(z - self.low[:, None] - self.step[:, None] * level).sum(axis=1)
        self.planes = [turns.packed(level >> p & 1 == 1) for p in range(PLANES)]
        self.total = self.low * turns.bits + self.step * level.sum(axis=1)

    def intervals(self, some: slice, centre: np.ndarray, codes: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of the anchors ``some`` with each row of a block."""
        n, rho, (align, size, ones) = len(codes), about[0], about[1:]
        count = np.zeros((len(self.length[some]), n), np.int64)
        for p, plane in enumerate(self.planes):
            for word in range(codes.shape[1]):
                count += np.bitwise_count(plane[some, word][:, None] & codes[:, word]).astype(np.int64) << p
        low, step, q = self.low[some, None], self.step[some, None], self.length[some, None]
        g = (2 * low * ones + 2 * step * count - self.total[some, None]) / size
        miss = self.miss[some, None] / size
        base = (self.rows[some] @ centre)[:, None]
        part = np.maximum(np.abs(g) - miss, 0)
        wide = np.abs(align) * miss + np.sqrt(np.maximum(1 - align ** 2, 0)) * np.sqrt(np.maximum(q ** 2 - part ** 2, 0))
        slack = 1e-9 * q * (np.linalg.norm(centre) + rho) + 1e-9   # rounding of all the above
        middle = base + rho * align * g
        return middle - rho * wide - slack, middle + rho * wide + slack


# ---- blocks and packs ----------------------------------------------------------------------------

def _narrow(rows: np.ndarray) -> np.ndarray:
    most = int(np.abs(rows).max(initial=0)) if rows.size and rows.min() > -(1 << 62) else 1 << 62
    return rows.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _matrix(ids: bytes, rows: bytes, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(rows, kind).reshape(len(ids) // 8, width)


def _cut(table: DataFrame, width: int, most: int, coded: bool) -> DataFrame:
    """Blocks (or packs) of at most ``most`` rows that follow each other by label, dominant component and id.

    Range partitioning splits the rows of a common label by component and id. Shorter vectors are filled with zeros.
    """
    size = F.transform("v", lambda c: F.abs(c))
    at = F.array_position(size, F.array_max(size))
    side = F.when(F.try_element_at("v", at.cast("int")) < 0, -1).otherwise(1)
    order = ["label", "key", "vec_id"]
    keyed = table.select("vec_id", "label", "v", F.coalesce(at * side, F.lit(0)).alias("key"))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        turns = Turns(width) if coded else None
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            ids, labels = (np.array([r[c] for r in held], np.int64) for c in (0, 1))
            rows = np.zeros((len(held), width), np.int64)
            for line, r in zip(rows, held):
                line[:len(r[2])] = r[2]
            small, known = _narrow(rows), np.unique(labels).tolist()
            if not coded:
                return pd.DataFrame([(part, k, ids.tobytes(), labels.tobytes(), small.tobytes(), small.dtype.str, width, known)],
                                    columns=["part", "k", "ids", "labels", "rows", "kind", "width", "known"])
            centre, codes, about = encode(rows, turns)
            return pd.DataFrame([(part, k, ids.tobytes(), labels.tobytes(), small.tobytes(), small.dtype.str, width,
                                  centre.tobytes(), codes.tobytes(), about.tobytes(), known)],
                                columns=["part", "k", "ids", "labels", "rows", "kind", "width", "centre", "codes", "about", "known"])

        for batch in batches:
            for row in zip(batch["vec_id"], batch["label"], batch["v"]):
                held.append(row)
                if len(held) == most:
                    yield block()
                    k, held[:] = k + 1, []
        if held:
            yield block()

    return cut_lineage(dealt.mapInPandas(cut, BLOCK if coded else PACK))


def _filled(blocks: DataFrame, name: str, most: int, rows: int) -> tuple[DataFrame, int]:
    """``blocks`` of at most ``most`` rows with column ``name``, the number of a group of blocks that follow
    each other and begin within the same ``rows`` rows, and how many groups there are. However finely the
    table was partitioned, groups are full. The driver sees one count for each partition, whose number is a setting.
    """
    counts = {r.part: int(r.n) for r in blocks.groupBy("part").agg(F.sum(F.octet_length("ids") / 8).alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    start = F.element_at(F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(max(counts, default=0) + 1)]), F.col("part") + 1)
    return blocks.withColumn(name, F.floor((start + F.col("k") * most) / rows).cast("int")), -(-total // rows)


# ---- cells ---------------------------------------------------------------------------------------

def pick(score, low: np.ndarray, up: np.ndarray, ids: np.ndarray, usable: np.ndarray, windows: list[tuple], k: int) -> list[tuple]:
    """For each window (least, most): ids and scores of its ``k`` highest rows, ties to the smaller id.

    ``score`` gives the exact scores of chosen rows. Some rows of the highest estimates are scored first; their
    k-th score in a window is a floor, and of the others only rows whose interval meets floor to most are scored.
    """
    at = np.flatnonzero(usable & (up >= min(w[0] for w in windows)) & (low <= max(w[1] for w in windows)))
    low, up = low[at], up[at]
    middle, first = (low + up) / 2, np.zeros(len(at), bool)
    for _, most in windows:
        below = np.flatnonzero(middle <= most)
        if len(below) > LEADS:
            below = below[np.argpartition(-middle[below], LEADS)[:LEADS]]
        first[below] = True
    values = np.zeros(len(at), np.int64)
    values[first] = score(at[first])
    need = np.zeros(len(at), bool)
    for least, most in windows:
        inside = values[first & (values >= least) & (values <= most)]
        floor = np.sort(inside)[-k] if len(inside) >= k else least
        need |= (up >= floor) & (low <= most)
    more = need & ~first
    values[more] = score(at[more])
    ready, out = first | more, []
    for least, most in windows:
        inside = np.flatnonzero(ready & (values >= least) & (values <= most))
        inside = inside[np.lexsort((ids[at[inside]], -values[inside]))[:k]]
        out.append((ids[at[inside]], values[inside]))
    return out


def _cells(pairs: DataFrame, packs: DataFrame, blocks: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each (pack, slot), both of a bounded number of rows."""
    pairs = cut_lineage(pairs)
    left = pairs.join(packs, "pack").groupBy("pack", "slot")
    renamed = pairs.toDF("_pack", "slot").join(blocks.drop("known"), "slot")
    right = renamed.withColumns({"_slot": F.col("slot")}).drop("slot").groupBy("_pack", "_slot")
    return left.cogroup(right).applyInPandas(work, schema)


def _hits(pack: pd.DataFrame, blocks: pd.DataFrame, wanted, same: bool, k: int) -> Iterator[tuple]:
    """(q, anchor's id, place of the window, id, score) of one cell; ``wanted`` gives an anchor's windows."""
    joined = lambda side, c: np.concatenate([np.frombuffer(x, np.int64) for x in side[c]])
    matrix = lambda side: np.concatenate([_matrix(b.ids, b.rows, b.kind, b.width) for b in side.itertuples()])
    pack = pack.sort_values(["part", "k"])   # so that ``q`` names the same anchor in every cell
    names, labels, anchors = joined(pack, "ids"), joined(pack, "labels"), matrix(pack).astype(np.int64)
    turns = Turns(anchors.shape[1])
    asked = Asked(anchors, turns)
    ids, kinds, rows = joined(blocks, "ids"), joined(blocks, "labels"), matrix(blocks)
    parts = [(np.frombuffer(b.centre), np.frombuffer(b.codes, np.uint64).reshape(-1, turns.words), np.frombuffer(b.about).reshape(4, -1)) for b in blocks.itertuples()]
    for start in range(0, len(names), TILE):
        tile = range(start, min(start + TILE, len(names)))
        if not any(wanted(q) for q in tile):
            continue
        low, up = (np.concatenate(x, axis=1) for x in zip(*[asked.intervals(slice(start, start + TILE), *part) for part in parts]))
        for q in tile:
            windows = wanted(q)
            if not windows:
                continue
            usable = (ids != names[q]) & ((kinds == labels[q]) == same)
            score = lambda at: _dot(anchors[q:q + 1], rows[at].astype(np.int64))[0] if len(at) else np.empty(0, np.int64)  # noqa: B023, E731
            for (place, *_), (found, values) in zip(windows, pick(score, low[q - start], up[q - start], ids, usable, [w[1:] for w in windows], k)):
                for vec_id, value in zip(found.tolist(), values.tolist()):
                    yield q, int(names[q]), place, vec_id, value


HITS = ["q", "anchor_id", "place", "vec_id", "score"]


def _positives(key, pack: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    everything = [(0, -np.inf, np.inf)]
    hits = _hits(pack, blocks, lambda q: everything, True, POSITIVES) if len(blocks) and len(pack) else []
    return pd.DataFrame([(key[0], *h) for h in hits], columns=["pack", *HITS])


def _negatives(key, pack: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    if not len(pack) or not len(blocks):
        return pd.DataFrame([], columns=["pack", *HITS])
    windows: dict[int, list[tuple]] = {}
    for w in pack["windows"].iat[0]:
        least, most = -(-LEAST_SHARE * w["score"] // 100), MOST_SHARE * w["score"] // 100
        if least <= most:
            windows.setdefault(w["q"], []).append((w["place"], least, most))
    return pd.DataFrame([(key[0], *h) for h in _hits(pack, blocks, lambda q: windows.get(q), False, NEGATIVES)], columns=["pack", *HITS])


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both inputs have (vec_id, label, v) as ``labelled`` makes them; other columns are ignored. Of each anchor,
    the positives are its ``POSITIVES`` best rows of the same label; of each positive, the negatives are the ``NEGATIVES``
    best rows of another label whose score is 50 to 95 percent of the positive's. Rows that bear the
    anchor's id are not its candidates. Ties go to the smaller id; repeated rows each take a place, repeated
    anchors each get an answer. Anchors with fewer candidates get all; a positive whose score is negative has no
    range and no negatives. Vectors of unequal length are compared as if filled with zeros. Empty
    inputs give no rows.
    """
    width = rows.agg(F.max(F.size("v")).alias("w")).first().w or 0
    width = max(1, width, anchors.agg(F.max(F.size("v")).alias("w")).first().w or 0)
    fits = lambda most: max(1, min(most, BLOCK_BYTES // (8 * width)))
    blocks, n_slots = _filled(_cut(rows, width, fits(BLOCK_ROWS), True), "slot", fits(BLOCK_ROWS), SLOT_BLOCKS * fits(BLOCK_ROWS))
    packs, _ = _filled(_cut(anchors, width, fits(PACK_ROWS), False), "pack", fits(PACK_ROWS), fits(PACK_ROWS))
    known = lambda table, name: table.select(name, F.explode("known").alias("label")).distinct()
    meets = known(packs, "pack").join(known(blocks, "slot"), "label").select("pack", "slot").distinct()
    given = packs.drop("known")
    best = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    schema = "pack int, q int, anchor_id long, place int, vec_id long, score long"
    found = _cells(meets, given, blocks, _positives, schema)
    positives = cut_lineage(found.withColumn("place", best("pack", "q")).filter(F.col("place") <= POSITIVES))
    # fewer than twice PACK_ROWS anchors with POSITIVES windows each
    windows = positives.groupBy("pack").agg(F.collect_list(F.struct("q", "place", "score")).alias("windows"))
    asking = given.join(windows, "pack")
    every = packs.select("pack").distinct().select("pack", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_slots - 1)))).alias("slot"))
    hits = _cells(every, asking, blocks, _negatives, schema)
    ranked = hits.withColumn("rank", best("pack", "q", "place")).filter(F.col("rank") <= NEGATIVES)
    ranked = ranked.select("pack", "q", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("pack", "q", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["pack", "q", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
