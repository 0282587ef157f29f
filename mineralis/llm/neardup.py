"""Near-duplicate texts by ProbMinHash, banding and exact verification.

A text is a weighted set: its shingles of five words, each with the number of times it occurs. In a
signature, every shingle is a Poisson process whose rate is its weight; each arrival draws a register, and
a register keeps the shingle that reached it first. Two texts agree in a register with a probability that
is their probability Jaccard similarity. A shingle is left as soon as its next arrival comes after the
last register was taken, so most need one arrival or two.

Texts that agree in a band meet in a bucket. Buckets do not expand into pairs: a bucket compares one
centre, the member with the most company, with its other members. What is then not in one component is
compared in blocks, members of the bucket's main component against the rest and the rest among themselves,
each pair in the first bucket it shares. So most of a large group of near copies costs one comparison for
each text, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, WordHashes, grams, mix64, split_words, without

SHINGLE, SIMILAR = 5, 0.8
#: 26 bands of five registers: a pair at 0.8 shares none in 3 of 100,000 cases
BANDS, BAND_ROWS = 26, 5
REGISTERS = BANDS * BAND_ROWS
#: agreement of signatures below which a pair is not read in full: 6.5 standard deviations under 0.8
LEAST_AGREEMENT = 0.57
#: elements of a signature batch, members of a block
BATCH_ELEMENTS, BLOCK = 300_000, 128


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and their counts; a text of fewer words is one shingle."""
    words = hashes.of(split_words(text))
    places = tuple(range(min(SHINGLE, len(words))))
    if not places:
        return np.empty(0, np.uint64), np.empty(0)
    keys, counts = np.unique(grams(words, places), return_counts=True)
    return keys, counts.astype(float)


def signatures(keys: list[np.ndarray], weights: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of 32-bit registers for each weighted set; all sets are drawn side by side."""
    n = len(keys)
    owner = np.repeat(np.arange(n), [len(k) for k in keys])
    key, rate = (np.concatenate(x) if n else np.empty(0) for x in (keys, weights))
    time, first = np.zeros(len(key)), np.full(n * registers, np.inf)
    held, turn = np.zeros(n * registers, np.uint64), 0
    while len(key):
        turn += 1
        draw = mix64(key + np.uint64(turn * 0xD1342543DE82EF95 & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / rate
        cell = owner * registers + (mix64(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        held[cell[won]] = key[won]
        if turn < 8 or turn % 4 == 0:
            left = np.unique(owner)
            last = np.full(n, -np.inf)
            last[left] = first.reshape(n, registers)[left].max(axis=1)
            going = time < last[owner]
            owner, key, rate, time = owner[going], key[going], rate[going], time[going]
    return (mix64(held) >> np.uint64(32)).astype(np.uint32).reshape(n, registers)


def probability_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d), by one sort of the ratios."""
    union = np.union1d(ka, kb)
    a, b = np.zeros(len(union)), np.zeros(len(union))
    a[np.searchsorted(union, ka)], b[np.searchsorted(union, kb)] = wa, wb
    common = (a > 0) & (b > 0)
    if not common.any():
        return 0.0
    if np.array_equal(a[common], b[common]) and a.max() == 1 == b.max():
        return common.sum() / len(union)
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    ratio, a, b, common = ratio[order], a[order], b[order], common[order]
    at = np.searchsorted(ratio, ratio[common], side="left")   # from here on the first set's share is the larger
    above = np.append(np.cumsum(a[::-1])[::-1], 0.0)[at]
    below = np.append(0.0, np.cumsum(b))[at]
    return float((1.0 / (above / a[common] + below / b[common])).sum())


def _most_similar(na: float, nb: float) -> bool:
    """Sets whose numbers of shingles differ too much cannot be similar, if no shingle repeats."""
    return min(na, nb) >= SIMILAR * max(na, nb)


def _similar(ka, wa, kb, wb) -> bool:
    plain = wa.max() == 1 == wb.max()
    if plain and not _most_similar(len(ka), len(kb)):
        return False
    return probability_jaccard(ka, wa, kb, wb) >= SIMILAR - 1e-12


def _unpack(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Weights are empty where all are one."""
    keys = np.frombuffer(keys, np.uint64)
    return keys, np.frombuffer(weights, np.float32).astype(float) if weights else np.ones(len(keys))


def _with_content(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_cid``, the 64-bit hash of a text that has a word, else null."""
    return without(docs, "_cid").withColumn("_cid", F.when(F.col("text").rlike(WORD), F.xxhash64("text")))


def _signed(texts: DataFrame) -> DataFrame:
    """(_cid, bands, sig) of each distinct text: a hash per band, and a byte per register to estimate by."""
    places = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, ids, keys, weights, size = WordHashes(), [], [], [], 0
            for k, (cid, text) in enumerate(zip(batch["_cid"], batch["text"])):
                one, counts = shingles(text, hashes)
                ids.append(cid), keys.append(one), weights.append(counts)
                size += len(one)
                if size > BATCH_ELEMENTS or k == len(batch) - 1:
                    drawn = signatures(keys, weights)
                    band = np.broadcast_to(places, (len(ids), BANDS)).copy()
                    for row in range(BAND_ROWS):
                        band = mix64(band + drawn[:, row::BAND_ROWS].astype(np.uint64) + np.uint64(1))
                    yield pd.DataFrame({"_cid": ids, "bands": list(band.view(np.int64)), "sig": [r.tobytes() for r in drawn.astype(np.uint8)]})
                    ids, keys, weights, size = [], [], [], 0

    return texts.mapInPandas(sign, "_cid long, bands array<long>, sig binary").dropDuplicates(["_cid"])


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_cid, keys, weights) of the wanted texts; copies of a text fall together before they move."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, out = WordHashes(), []
            for cid, text in zip(batch["_cid"], batch["text"]):
                keys, counts = shingles(text, hashes)
                out.append((cid, keys.tobytes(), counts.astype(np.float32).tobytes() if counts.max() > 1 else b""))
            yield pd.DataFrame(out, columns=["_cid", "keys", "weights"])

    one = texts.join(wanted, "_cid", "left_semi").groupBy("_cid").agg(F.any_value("text").alias("text"))
    return one.select("_cid", "text").mapInPandas(pack, "_cid long, keys binary, weights binary")


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave similarity possible."""
    side = lambda x: signed.select(F.col("_cid").alias(x), F.col("sig").alias(f"s{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), REGISTERS) for c in ("sa", "sb"))
            yield batch.loc[(sa == sb).mean(axis=1) >= LEAST_AGREEMENT, ["a", "b"]]

    return met.mapInPandas(estimate, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    side = lambda x: sets.select(F.col("_cid").alias(x), F.col("keys").alias(f"k{x}"), F.col("weights").alias(f"w{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "wa", "kb", "wb")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            holds = [_similar(*_unpack(ka, wa), *_unpack(kb, wb)) for ka, wa, kb, wb in zip(*(batch[c] for c in ("ka", "wa", "kb", "wb")))]
            yield batch.loc[np.array(holds, bool), ["a", "b"]]

    return met.mapInPandas(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(_cid, comp) for the ends of ``links``: the smallest id reachable. Each round takes the least label
    among the neighbours, then the label of that label, so long chains halve; rounds end when none changes."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("_cid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("_cid", "b"), "b").groupBy(F.col("a").alias("_cid")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "_cid").select("_cid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("_cid").alias("comp"), F.col("comp").alias("far"))
        after = cut_lineage(lower.join(jump, "comp", "left").select("_cid", "old", F.least("comp", "far").alias("comp")))
        labels = after.select("_cid", "comp")
        if after.filter(F.col("old") != F.col("comp")).isEmpty():
            return labels


def _rest(members: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of a bucket, found block against block.

    ``members`` has (bucket, _cid, comp). The largest component of a bucket is its main one; blocks of
    other members meet blocks of the main component and each other.
    """
    parts = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"))
    main = main.select("bucket", F.col("top.comp").alias("main"), F.col("top.size").alias("n_main"), (F.col("all") - F.col("top.size")).alias("n_other"))
    sided = members.join(main, "bucket").withColumn("other", F.col("comp") != F.col("main"))
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("_cid"), F.when(F.col("other"), blocks_of("n_other")).otherwise(blocks_of("n_main"))).cast("int")
    sided = sided.withColumn("block", block)
    full = sided.join(signed, "_cid").join(sets, "_cid")
    packed = full.groupBy("bucket", "other", "block").agg(
        F.first("n_main").alias("n_main"), F.first("n_other").alias("n_other"),
        F.collect_list(F.struct("_cid", "comp", "bands", "sig", "keys", "weights")).alias("rows"))
    packed = cut_lineage(packed)
    left = packed.filter("other")
    seats = F.concat(
        F.transform(F.sequence(F.lit(0), blocks_of("n_main") - 1), lambda j: F.struct(F.lit(False).alias("other"), j.alias("block"))),
        F.transform(F.sequence(F.col("block"), blocks_of("n_other") - 1), lambda j: F.struct(F.lit(True).alias("other"), j.alias("block"))))
    met = (left.select("bucket", F.col("rows").alias("mine"), F.explode(seats).alias("seat"))
           .select("bucket", "mine", F.col("seat.other").alias("other"), F.col("seat.block").alias("block"))
           .join(packed.select("bucket", "other", "block", "rows"), ["bucket", "other", "block"]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, mine, rows in zip(batch["bucket"], batch["mine"], batch["rows"]):
                yield pd.DataFrame(_block_links(bucket, mine, rows), columns=["a", "b"], dtype=np.int64)

    return met.select("bucket", "mine", "rows").mapInPandas(compare, "a long, b long")


def _block_links(bucket: int, mine, rows) -> list[tuple[int, int]]:
    """Similar pairs of two blocks, one for each pair of components that they join.

    A pair that shares several buckets is compared in the one of its first common band.
    """
    stack = lambda side, name, kind: np.array([np.frombuffer(r[name], kind) if kind == np.uint8 else r[name] for r in side])
    root = {int(r["comp"]): int(r["comp"]) for side in (mine, rows) for r in side}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    unpacked = [_unpack(r["keys"], r["weights"]) for r in rows]
    plain = np.array([w.max() == 1 for _, w in unpacked])
    sizes = np.array([len(k) for k, _ in unpacked])
    every, starts = np.concatenate([k for k, _ in unpacked]), np.append(0, np.cumsum(sizes))[:-1]
    comps, out = [int(r["comp"]) for r in rows], []
    bands, sigs = stack(rows, "bands", np.int64), stack(rows, "sig", np.uint8)
    for r in mine:
        same = bands == np.asarray(r["bands"])
        here = np.asarray(r["bands"])[same.argmax(axis=1)] == bucket
        agree = (sigs == np.frombuffer(r["sig"], np.uint8)).mean(axis=1)
        possible = np.flatnonzero(here & (agree >= LEAST_AGREEMENT))
        possible = [j for j in possible[np.argsort(-agree[possible], kind="stable")] if find(comps[j]) != find(int(r["comp"]))]
        if not possible:
            continue
        keys, weights = _unpack(r["keys"], r["weights"])
        shared = None
        for j in possible:
            if find(comps[j]) == find(int(r["comp"])):
                continue
            if plain[j] and weights.max() == 1:
                if shared is None:   # sizes of the common part with every row, in one pass
                    at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
                    shared = np.add.reduceat(keys[at] == every, starts, dtype=np.int64)
                holds = shared[j] >= (SIMILAR - 1e-12) * (len(keys) + sizes[j] - shared[j])
            else:
                holds = _similar(keys, weights, *unpacked[j])
            if holds:
                a, b = find(int(r["comp"])), find(comps[j])
                root[max(a, b)] = min(a, b)
                out.append((int(r["_cid"]), int(rows[j]["_cid"])))
    return out


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, _cid, _class, class_id) for each row: ``class_id`` is the smallest id of its class.

    Two texts are linked if their probability Jaccard similarity is 0.8 or more; classes are the
    components of the links. Equal texts are one content, so copies are never compared. A text of fewer
    than five words is one shingle and equals only texts of the same words. Null texts and texts without
    a word are alone: no class, ``class_id`` is their own id. Null ids: the smallest id of a class skips
    them. Repeated rows share a class. An empty table gives an empty table.
    """
    rows = _with_content(docs.select("doc_id", "text"))
    texts = rows.filter(F.col("_cid").isNotNull()).select("_cid", "text")
    signed = cut_lineage(_signed(texts))
    seats = signed.select("_cid", F.explode("bands").alias("bucket"))
    full = seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = cut_lineage(seats.join(full, "bucket"))
    company = members.groupBy("_cid").agg(F.sum("n").alias("company"))
    members = cut_lineage(members.join(company, "_cid"))
    centre = members.groupBy("bucket").agg(F.max(F.struct("company", "_cid")).alias("c")).select("bucket", F.col("c._cid").alias("centre"))
    around = cut_lineage(members.join(centre, "bucket").filter(F.col("_cid") != F.col("centre")).select("bucket", "_cid", "centre", "n"))
    pairs = around.select(F.least("_cid", "centre").alias("a"), F.greatest("_cid", "centre").alias("b")).distinct()
    pairs = cut_lineage(_agreeing(pairs, signed))
    wanted = pairs.select(F.col("a").alias("_cid")).union(pairs.select("b")).union(around.filter(F.col("n") > 2).select("_cid")).distinct()
    sets = cut_lineage(_sets(texts, cut_lineage(wanted)))
    links = cut_lineage(_verified(pairs, sets))
    labels = components(links)
    # a centre has met all others of its bucket; a bucket whose others are in one component is settled
    others = around.filter(F.col("n") > 2).select("bucket", "_cid").join(labels, "_cid", "left").withColumn("comp", F.coalesce("comp", "_cid"))
    mixed = others.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(F.col("lo") != F.col("hi"))
    unsettled = cut_lineage(others.join(mixed, "bucket", "left_semi").select("bucket", "_cid", "comp"))
    rest = cut_lineage(_rest(unsettled, signed, sets))
    labels = labels if rest.isEmpty() else components(links.union(rest))
    placed = rows.select("doc_id", "_cid").join(labels, "_cid", "left").withColumn("_class", F.coalesce("comp", "_cid")).drop("comp")
    placed = cut_lineage(placed)
    least = placed.filter(F.col("_class").isNotNull()).groupBy("_class").agg(F.min("doc_id").alias("class_id"))
    named = placed.join(least, "_class", "left")
    return named.select("doc_id", "_cid", "_class", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id, and all rows without a class."""
    placed = classes(docs)
    best = placed.filter(F.col("_class").isNotNull()).groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_cid")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("_best"), F.col("b._cid").alias("_content"))
    rows = _with_content(docs)
    on = rows["doc_id"].eqNullSafe(best["_best"]) & (rows["_cid"] == best["_content"])
    kept = rows.join(best, on, "left_semi").dropDuplicates(["doc_id", "_cid"])
    return kept.unionByName(rows.filter(F.col("_cid").isNull())).drop("_cid")
