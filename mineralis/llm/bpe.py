"""Byte-level BPE, encoded and decoded by higher-order functions over distinct words.

A word (a match of the split pattern) is an array of its bytes, each byte a character of ISO 8859-1. A
fold merges, again and again, the leftmost neighbours of lowest rank. Ranks are one value: an array of
small maps, found by the CRC-32 of a piece, because looking a key up in one large map would walk it.

Words repeat, so frequent distinct words are folded once and sent to the tasks as Arrow arrays of bounded
size. The distinct words of a text that are not among them are folded there, once a text, and their ids
spliced in. A word of thousands of characters takes a heap instead of the fold, whose steps each walk the
word. Any text gives the same ids either way.
"""

from __future__ import annotations

import base64
import json
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import let, without

#: bound of the ready-made words and of the bytes of each; with ids of four bytes all of them have at most 88 MB
READY_WORDS, READY_BYTES = 524_288, 32
#: lists to that value, a power of two: a list holds a few keys
RANK_LISTS = 65_536
#: bytes up to which a word takes the fold that keeps places and ranks in one number
SHORT = 64
#: characters beyond which a word takes the heap
LONG = 512
#: words that a task looks up at once, and bins to a doubling of counts
BLOCK, BINS = 1_000_000, 16
ABSENT = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base 64 of the piece, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _held(spark: SparkSession, value: object, kind: str) -> Column:
    """``value`` as a scalar subquery over one written row. A lambda takes it by the name of a column, into which the
    optimizer puts it.

    A literal would be printed into every description of a plan, some megabytes each, and the driver keeps those.
    """
    row = spark.createDataFrame([(json.dumps(value),)], "text string")
    return cut_lineage(row.select(F.from_json("text", kind).alias("value"))).scalar()


def _lists(spark: SparkSession, items: dict[str, object], n: int, kind: str) -> Column:
    """Array of ``n`` maps; a key is in the one of its CRC-32, modulo ``n``."""
    out: list[dict] = [{} for _ in range(n)]
    for key, value in items.items():
        out[zlib.crc32(key.encode()) % n][key] = value
    return _held(spark, out, f"array<map<string,{kind}>>")


def _look(lists: Column, n: int, key: Column) -> Column:
    return F.try_element_at(F.get(lists, F.crc32(key.cast("binary")).bitwiseAND(F.lit(n - 1).cast("long")).cast("int")), key)


def _bytes_of(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _short_fold(rank, w: Column, n: Column) -> Column:
    """Ids of a word of at most ``SHORT`` bytes; its pieces are kept as the places where they begin.

    A place carries in one number, above itself, the rank of its piece with the next one. Each step takes
    away the second place of the lowest pair and looks up again the two pairs that this changes. A step
    without a pair changes nothing. Names are bound by folds over one element: taking an element out of a
    transformed array, Spark works out its type, and so walks the lambda, at every call.
    """
    width = 2 * SHORT   # a place is below it
    place = lambda x: x.bitwiseAND(F.lit(width - 1).cast("long")).cast("int")
    piece = lambda x, end: F.substring(w, place(x), place(end) - place(x))
    ranked = lambda s, piece: s.cast("long") + F.coalesce(rank(piece).cast("long") * width, F.lit(ABSENT * width))

    def merged(places, first):   # the pairs at ``first`` and after it change; where they end is two further on than before
        return F.transform(F.array_remove(places, F.get(places, first + 2)), lambda x, i: F.when(
            (i >= first) & (i <= first + 1), ranked(place(x), piece(x, F.get(places, i + 3)))).otherwise(x))

    def step(places, _):
        return F.aggregate(F.array(F.array_min(places)), places, lambda now, low: F.when(low >= F.lit(ABSENT * width), now).otherwise(
            F.aggregate(F.array(F.array_position(now, low).cast("int") - 2), now, merged)))

    def ids(places):
        return F.transform(F.slice(places, 1, F.size(places) - 1), lambda x, i: rank(piece(x, F.get(places, i + 1))))

    start = F.transform(F.sequence(F.lit(1), n + 1), lambda s: ranked(s, F.when(s < n, F.substring(w, s, F.lit(2)))))
    return F.aggregate(F.sequence(F.lit(2), n), start, step, ids)


def _long_fold(rank, w: Column, n: Column) -> Column:
    """Pieces of a longer word: ranks are kept, and only the two beside a merge are looked up again."""
    merge_rank = lambda piece: F.coalesce(rank(piece), F.lit(ABSENT))

    def step(acc, _):
        low = F.array_min(acc["ranks"])
        return F.when(F.coalesce(low, F.lit(ABSENT)) == ABSENT, acc).otherwise(let(
            F.array_position(acc["ranks"], low).cast("int"), lambda p: let(
                F.concat(F.get(acc["parts"], p - 1), F.get(acc["parts"], p)), lambda merged: merged_at(acc, p, merged))))

    def merged_at(acc, p, merged):
        near = F.array(F.when(p > 1, F.concat(F.get(acc["parts"], p - 2), merged)), F.concat(merged, F.get(acc["parts"], p + 1)))
        fresh = F.transform(F.filter(near, lambda s: s.isNotNull()), merge_rank)
        return F.struct(
            F.concat(F.slice(acc["parts"], 1, p - 1), F.array(merged), F.slice(acc["parts"], p + 2, F.size(acc["parts"]))).alias("parts"),
            F.concat(F.slice(acc["ranks"], 1, F.greatest(p - 2, F.lit(0))), fresh, F.slice(acc["ranks"], p + 2, F.size(acc["parts"]))).alias("ranks"))

    def folded(chars):
        pairs = F.transform(F.slice(chars, 1, n - 1), lambda c, i: merge_rank(F.concat(c, F.get(chars, i + 1))))
        start = F.struct(chars.alias("parts"), pairs.alias("ranks"))
        return F.aggregate(F.sequence(F.lit(2), n), start, step, lambda acc: acc["parts"])

    return let(F.split(w, ""), folded)


def _fold(ranks: Column, w: Column) -> Column:
    """Ids of one word, given as a lambda's name for the ISO 8859-1 reading of its bytes."""
    rank = lambda piece: _look(ranks, RANK_LISTS, piece)
    n = F.length(w)
    return F.when(rank(w).isNotNull(), F.array(rank(w))).when(n <= SHORT, _short_fold(rank, w, n)).otherwise(
        F.transform(_long_fold(rank, w, n), rank))


def _rank_lists(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    return _lists(spark, {piece.decode("latin-1"): r for piece, r in ranks.items()}, RANK_LISTS, "int")


def words_of(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` (null text: none); ``\\s`` and ``\\S`` take all of Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def frequent_words(docs: DataFrame, pattern: str, limit: int = READY_WORDS) -> DataFrame:
    """At most ``limit`` words of at most ``READY_BYTES`` bytes: all that are as frequent as a threshold or more.

    The threshold comes from a histogram of counts, so no task sorts all words. Words that occur once are
    left out. Which words these are changes no ids.
    """
    words = docs.select(F.explode(words_of(F.col("text"), pattern)).alias("word")).filter(F.octet_length("word") <= READY_BYTES)
    counts = cut_lineage(words.groupBy("word").count().filter("count > 1"))
    bins = counts.groupBy(F.floor(F.log2("count") * BINS).alias("bin")).count()   # at most 64 * BINS rows
    least, taken = 64 * BINS, 0
    for row in sorted(bins.collect(), reverse=True):
        taken += row["count"]
        if taken > limit:
            break
        least = row["bin"]
    return counts.filter(F.floor(F.log2("count") * BINS) >= least).select("word")


def heap_ids(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Ids of one word by a heap of neighbours: n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))   # part i ends at after[i]; 0: merged away
    pair = lambda i, end: (ranks.get(word[i:end], ABSENT), i, end)
    heap = [pair(i, i + 2) for i in range(n - 1)]
    heapify(heap)
    while heap and heap[0][0] != ABSENT:
        _, i, end = heappop(heap)
        mid = after[i]
        if not 0 < mid < n or after[mid] != end:
            continue
        after[i], after[mid] = end, 0
        if end < n:
            before[end] = i
            heappush(heap, pair(i, after[end]))
        if before[i] >= 0:
            heappush(heap, pair(before[i], end))
    return [ranks[word[i:after[i]]] for i in range(n) if after[i]]


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` at ``starts`` one after the other, and where each begins (with the end)."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


def _in_blocks(work, column: pa.ListArray) -> pa.Array:
    """``work`` over parts of the rows that have at most ``BLOCK`` elements, or one row."""
    n = len(column)
    if n < 2 or len(column.flatten()) <= BLOCK:
        return work(column)
    return pa.concat_arrays([_in_blocks(work, column.slice(0, n // 2)), _in_blocks(work, column.slice(n // 2))])


def _lists_of(values, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def code_words(words: pa.ListArray, ready: pa.Array, ids: pa.ListArray, ranks: dict[bytes, int]) -> pa.StructArray:
    """Per row ``runs`` of the ids of its words, cut where a word has none here; ``rest``, the distinct words that
    have none; ``at``, which of those stands after each run but the last."""
    flat, n = words.flatten(), len(words)
    rows = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    entry = pc.index_in(flat, value_set=ready).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    other = np.flatnonzero(entry < 0)
    coded = flat.take(pa.array(other)).dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    # long words become entries behind the ready ones, the last entry is empty and stands for all that is left
    is_long = pc.greater(pc.utf8_length(names), LONG).to_numpy(zero_copy_only=False).astype(bool)
    heaps = [heap_ids(ranks, names[int(k)].as_py().encode()) for k in np.flatnonzero(is_long)]
    entry[other] = np.where(is_long, len(ready) + np.cumsum(is_long) - 1, len(ready) + len(heaps))[code]
    values = np.concatenate([ids.flatten().to_numpy(zero_copy_only=False), *[np.array(h, np.int32) for h in heaps]])
    sizes = np.concatenate([ids.value_lengths().to_numpy(zero_copy_only=False), [len(h) for h in heaps], [0]]).astype(np.int64)
    out, ends = _gather(values, (np.cumsum(sizes) - sizes)[entry], sizes[entry])
    # distinct words left over, by row
    rest, code = other[~is_long[code]], code[~is_long[code]]
    row = np.searchsorted(rows, rest, "right") - 1
    width = max(len(names), 1)
    distinct, which = np.unique(row * width + code, return_inverse=True)
    of_row = np.searchsorted(distinct, np.arange(n + 1) * width)
    # a run ends before a word left over (odd) and at the end of a row (even, so before the next row's first word)
    run_ends = np.concatenate([[0], ends[np.sort(np.concatenate([2 * rest + 1, 2 * rows[1:]])) // 2]])
    rest_ends = np.searchsorted(rest, rows)
    runs = _lists_of(_lists_of(pa.array(out, pa.int32()), run_ends), rest_ends + np.arange(n + 1))
    at = _lists_of(pa.array(which - of_row[row], pa.int32()), rest_ends)
    return pa.StructArray.from_arrays([runs, _lists_of(names.take(pa.array(distinct % width)), of_row), at], ["runs", "rest", "at"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ready_words: int = READY_WORDS) -> DataFrame:
    """``docs`` with ``ids``: array<int>, the tokens of the whole text.

    Null or empty text: an empty array. Strings that look like special tokens are ordinary text. Every
    single byte must have a rank. Rows are taken one by one; a column named ``ids`` is replaced, those
    named ``_coded`` or ``_held`` go. A word of any length costs n log n at most.
    """
    lists = _rank_lists(docs.sparkSession, ranks)
    frequent = frequent_words(docs, pattern, ready_words).repartition(32, "word")
    folded = frequent.withColumn("_held", lists).select("word", let(F.col("_held"), lambda r: let(_bytes_of(F.col("word")), lambda w: _fold(r, w))).alias("ids")).toArrow().combine_chunks()
    ready = [pa.concat_arrays(folded[c].chunks) if folded[c].num_chunks else pa.array([], t)
             for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32())))]
    shared = docs.sparkSession.sparkContext.broadcast((*ready, ranks))

    @F.arrow_udf("struct<runs: array<array<int>>, rest: array<string>, at: array<int>>")
    def code(words: pa.Array) -> pa.Array:
        return _in_blocks(lambda w: code_words(w, *shared.value), words)

    # called nondeterministic, it stays a step of its own; else the optimizer would move it into the lambdas
    coded = without(docs, "ids", "_coded", "_held").withColumn("_coded", code.asNondeterministic()(words_of(F.col("text"), pattern)))
    folded = let(F.col("_held"), lambda r: F.transform(F.transform(F.col("_coded.rest"), _bytes_of), lambda w: _fold(r, w)))
    ids = let(folded, lambda f: F.flatten(F.transform(F.col("_coded.runs"), lambda run, k: F.concat(
        run, F.coalesce(F.get(f, F.get(F.col("_coded.at"), k)), F.array().cast("array<int>"))))))
    return coded.withColumn("_held", lists).withColumn("ids", ids).drop("_coded", "_held")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids' pieces, one after the other.

    Pieces are joined in hexadecimal and turned to bytes at the end, so a long text costs linear time. An
    id without a piece puts in what is not hexadecimal, which makes the result null.
    """
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    listed = _held(encoded.sparkSession, pieces, "array<string>")
    parts = let(F.col("_held"), lambda p: F.transform("ids", lambda i: F.get(p, i)))
    return without(encoded, "decoded", "_held").withColumn("_held", listed).withColumn("decoded", F.unhex(F.array_join(parts, "", "x"))).drop("_held")
