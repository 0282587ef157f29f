"""Repeated byte passages by the collection's Burrows-Wheeler transform, built column by column.

Remove every byte covered by a 50-byte string that also starts in a document with a smaller id. In three
steps:

* Anchors. Among the 31 places at which a 20-byte piece can lie in a 50-byte string, the one with the
  least hash is the string's anchor. It depends on the string only, so equal strings have equal anchors.
  Neighbouring strings mostly share their anchor; what they cover together is a segment of 50 to 80
  bytes. Segments whose anchor occurs in one text only hold no repeat and are left.
* Suffix order. The segments of a part of the anchors are a collection of short documents over bytes and
  one symbol for the anchor. Round by round one symbol per document is put before its suffix: the order
  after a round is the terminators followed by the old order, dealt to one sequence per symbol and read
  back one sequence after the other, and the common prefix of two neighbours is one more than the least
  one between them before. Both are rewritten front to back, as the external files of the method are.
  Equal strings have their anchor at the same place, so documents are taken in by their distance from it
  and a round holds the suffixes of one place only.
* Groups. Neighbours with 31 symbols in common (50 bytes) are equal strings; all but those of the smallest
  id are repeats.

Texts move once for each of two jobs, in packs of a few MB. A pack sends the fingerprints of its anchors
and learns which of them others have too; it sends the segments of those and learns what goes. Equal
segments of a pack are one entry and of equal texts one takes part, so large groups of copies and passages
that very many texts share cost one entry a pack, not one per occurrence.

The segments of an anchor are ordered by one task. Those of an anchor with too many different ones are dealt
by the 15 bytes beside it, and those that have too many even so as whole 50-byte strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix64

#: length of a repeat and of an anchor, places of an anchor in a repeat, bytes of a segment at most
LENGTH, ANCHOR = 50, 20
PLACES = LENGTH - ANCHOR + 1
WIDEST = LENGTH + PLACES - 1
#: bytes of the texts of a pack, about; bytes of text whose anchors one task counts, about
PACK_BYTES, COUNT_BYTES = 1 << 22, 1 << 24
#: segments that one task orders, about; anchors with more different ones than a quarter are dealt more finely
PART_SEGMENTS = 60_000
#: bits of an anchor's fingerprint, by which anchors are dealt; strings are told apart by their bytes, so two
#: anchors that share one only cost work
FINGERPRINT_BITS = 40
#: a pack learns its common fingerprints modulo this many; those let through by chance are left out by the suffix order
MAP_BITS = 1 << 32
#: 50-byte strings whose anchors are found at a time, and the bits of a place among them
BLOCK, PLACE_BITS = 1 << 17, 18
END = 255 + 1
NO_ID = (1 << 63) - 1

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x9E6C63D0876A9A35
_ODD = mix64(np.arange(1, WIDEST // 8 + 1, dtype=np.uint64)) | np.uint64(1)
#: (part, pack) with arrays of the distinct segments of a pack, of the places where they lie, and spans found already
_DEALT = "part int, pack int, routes binary, lefts binary, sizes binary, orders binary, bodies binary, owners binary, places binary, found binary"
#: what a pack is told, by kind: the ids of its copies ("copy"), common and hot fingerprints ("map", "hot"), "spans"
_TOLD = "pack int, kind string, data binary"


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, bytes before the anchor at the first start, fingerprint) of the anchors
    of all 50-byte strings of some texts, by text and start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.ones(len(data) + 1, bool)   # of a string that lies in one text
    for end in (begins + sizes).tolist():
        starts[max(0, end - LENGTH + 1):end] = False
    heads = np.zeros(len(data) + 1, bool)
    heads[begins] = True
    power = lambda k: np.uint64(pow(_STEP, k, 1 << 64))
    some_at, some_least = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        one = _TABLE[data[at:at + BLOCK + LENGTH - 1]]
        with np.errstate(over="ignore"):
            two = one[:-1] * power(1) + one[1:]
            four = two[:-2] * power(2) + two[2:]
            eight = four[:-4] * power(4) + four[4:]
            piece = (eight[:-12] * power(8) + eight[8:-4]) * power(4) + four[16:]
        least = mix64(piece) >> np.uint64(64 - FINGERPRINT_BITS) << np.uint64(PLACE_BITS)
        least |= np.arange(len(least), 0, -1, dtype=np.uint64)   # of equal ones the rightmost; a block has fewer places than wrap
        width = 1
        while width < PLACES:   # the least value of a growing window
            step = min(width, PLACES - width)
            least = np.minimum(least[step:], least[:-step])
            width += step
        new = np.append(True, least[1:] != least[:-1]) | heads[at:at + len(least)]
        new = np.flatnonzero(new & starts[at:at + len(least)])
        some_at.append(new + at)
        places = np.uint64(at + len(one) - ANCHOR + 1) - (least[new] & np.uint64((1 << PLACE_BITS) - 1))
        some_least.append(np.stack([places, least[new] >> np.uint64(PLACE_BITS)], axis=1).ravel())
    at = np.concatenate(some_at)
    place, value = np.concatenate(some_least).reshape(-1, 2).astype(np.int64).T
    new = np.append(True, place[1:] != place[:-1])[:len(at)]   # one anchor may go on in the next block
    at, place, value = at[new], place[new], value[new]
    text = np.searchsorted(begins, at, side="right") - 1
    last = np.append(at[1:] - 1, 0)[:len(at)]
    ends = np.append(text[1:] != text[:-1], True)[:len(at)]
    last[ends] = (begins + sizes)[text[ends]] - LENGTH
    return text, at - begins[text], last - begins[text], place - at, value


def _dealt_out(transform: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: where each suffix of the new order stood in the old one, and its common prefix with the one before it.

    ``transform`` has the symbol before each suffix of the old order, negative where its document begins.
    """
    going = np.flatnonzero(transform >= 0)
    dealt = going[np.argsort(transform[going], kind="stable")]
    same = transform[dealt][1:] == transform[dealt][:-1]
    grown = np.zeros(len(dealt), np.uint8)
    at = np.flatnonzero(same)
    grown[at + 1] = _least_between(common, dealt[at] + 1, dealt[at + 1] + 1) + np.uint8(1)
    return dealt, grown


def suffix_order(lengths: np.ndarray, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a collection in order, and the common prefix of each with the one before it.

    Document i has ``lengths[i]`` symbols from ``offsets[i]`` on in ``symbols``, followed by a place of its
    own for the terminator; a suffix is named by the place where it begins.
    """
    ends = offsets + lengths
    before = np.full(len(symbols), -1, np.int64)   # the transform: what stands before each suffix
    inner = np.ones(len(symbols), bool)
    inner[offsets] = False
    before[1:][inner[1:]] = symbols[:-1][inner[1:]]
    order, common = ends, np.zeros(len(ends), np.uint8)
    for _ in range(int(lengths.max(initial=0))):
        dealt, grown = _dealt_out(before[order], common)
        order = np.concatenate([ends, order[dealt] - 1])
        common = np.concatenate([np.zeros(len(ends), np.uint8), grown])
    return order, common


def place_orders(columns: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, documents in the order of their suffixes from there, common prefixes) for each column from the back.

    The rounds of ``suffix_order`` for documents that are laid below one another, one symbol a column, negative
    where a document has none: the terminators of those that end at a column (``last``, not a symbol's) come in
    there, and a round has the suffixes of one column.
    """
    order, common = np.empty(0, np.int64), np.empty(0, np.uint8)
    for column in range(columns.shape[1] - 1, -1, -1):
        ends = np.flatnonzero(last == column)
        order, common = np.concatenate([ends, order]), np.concatenate([np.zeros(len(ends), np.uint8), common])
        if len(ends) and len(order) > len(ends):
            common[len(ends)] = 0
        dealt, common = _dealt_out(columns[order, column], common)
        order = order[dealt]
        yield column, order, common


def _least_between(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:stop]`` for many ranges, from the minima of runs of powers of two."""
    level = np.frexp((stop - start).astype(float))[1] - 1
    out, run = np.empty(len(start), values.dtype), values
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(int(level.max(initial=0)) + 2))
    for k in range(len(cuts) - 1):
        chosen = by_level[cuts[k]:cuts[k + 1]]
        if len(chosen):
            out[chosen] = np.minimum(run[start[chosen]], run[stop[chosen] - (1 << k)])
        if len(run) > 1 << k:
            run = np.minimum(run[:len(run) - (1 << k)], run[1 << k:])
    return out


def _laid(flat: np.ndarray, sizes: np.ndarray, shift: np.ndarray | int = 0) -> np.ndarray:
    """Segments that follow each other in ``flat``, one a row of ``WIDEST`` bytes, each from column ``shift`` on; zero elsewhere."""
    rows = np.zeros((len(sizes), WIDEST), np.uint8)
    rows.ravel()[np.repeat(np.arange(len(sizes)) * WIDEST + shift - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return rows


def _hashes(rows: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes (a multiple of eight) and the numbers beside it; it groups, bytes are compared after it."""
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k, word in enumerate(np.ascontiguousarray(rows).view(np.uint64).T):
            out = (out ^ mix64(word ^ _ODD[k])) * _ODD[0]
        for x in others:
            out = (out ^ mix64(x.astype(np.uint64))) * _ODD[1]
    return mix64(out)


def _equal_ones(routes: np.ndarray, lefts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): an order by route in which equal segments are neighbours, those before it first, and where new ones begin.

    Different segments are never taken for equal ones; equal ones may come apart where two hashes are equal.
    """
    hashes = _hashes(rows, lefts, sizes)
    by = np.lexsort((hashes, routes))
    head = np.ones(len(by), bool)
    head[1:] = (routes[by][1:] != routes[by][:-1]) | (hashes[by][1:] != hashes[by][:-1])
    near = np.flatnonzero(~head)
    a, b = by[near], by[near - 1]
    head[near] = (lefts[a] != lefts[b]) | (sizes[a] != sizes[b]) | (rows[a] != rows[b]).any(axis=1)
    return by, head


def _sides(fingerprints: np.ndarray, lefts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether on the left, segments that have 15 bytes on that side of the anchor, hash of these and the fingerprint).

    Of the 30 bytes around the anchor of a 50-byte string, 15 or more lie on one side of it, so two segments
    that share the string have the same 15 bytes there.
    """
    half = (PLACES - 1) // 2
    for on_left, has, at in ((True, lefts >= half, lefts - half), (False, sizes >= lefts + ANCHOR + half, lefts + ANCHOR)):
        has = np.flatnonzero(has)
        beside = np.full((len(has), half + 1), on_left, np.uint8)
        beside[:, :half] = rows[has[:, None], at[has, None] + np.arange(half)]
        yield on_left, has, (_hashes(beside, fingerprints[has]) >> np.uint64(1)).astype(np.int64)


def _routed(fingerprints: np.ndarray, lefts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, hot: np.ndarray, common_sides: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, shift, size, bytes, route): the entries by which segments are dealt.

    A segment is one entry, by its fingerprint; if that is ``hot``, one for each side; where the side is in
    ``common_sides``, one for each 50-byte string whose larger part is on it, ``shift`` bytes from the segment's start.
    """
    half = (PLACES - 1) // 2
    cold = np.flatnonzero(~hot)
    made = [(cold, np.zeros(len(cold), np.int64), sizes[cold], rows[cold], fingerprints[cold])]
    hot = np.flatnonzero(hot)
    for on_left, has, route in _sides(fingerprints[hot], lefts[hot], sizes[hot], rows[hot]) if len(hot) else ():
        has, cut = hot[has], _among(route, common_sides)
        one = has[~cut]
        made.append((one, np.zeros(len(one), np.int64), sizes[one], rows[one], route[~cut]))
        has = has[cut]
        last = np.minimum(sizes[has] - LENGTH, lefts[has])
        low = np.zeros(len(has), np.int64) if on_left else np.maximum(lefts[has] - half + 1, 0)
        n = np.maximum((np.minimum(lefts[has] - half, last) if on_left else last) - low + 1, 0)
        shift = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        each = np.repeat(has, n)
        strings = np.zeros((len(each), WIDEST), np.uint8)
        strings[:, :LENGTH] = rows[each[:, None], shift[:, None] + np.arange(LENGTH)]
        made.append((each, shift, np.full(len(each), LENGTH), strings, (_hashes(strings) >> np.uint64(1)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*made))


def _likely(fingerprints: np.ndarray, lefts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Segments that may share a 50-byte string with another one of the same anchor: those with 15 equal bytes beside it."""
    keep = np.zeros(len(rows), bool)
    for _, has, beside in _sides(fingerprints, lefts, sizes, rows):
        _, back, count = np.unique(beside, return_inverse=True, return_counts=True)
        keep[has[count[back] > 1]] = True
    return np.flatnonzero(keep)


def repeated_starts(fingerprints: np.ndarray, segments: list[bytes], lefts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of every 50-byte string that is also in a segment with a smaller id."""
    sizes = np.array([len(s) for s in segments], np.int64)
    lefts = np.asarray(lefts, np.int64)
    rows = _laid(np.frombuffer(b"".join(segments), np.uint8), sizes)
    kept = _likely(fingerprints, lefts, sizes, rows)
    found = [(np.empty(0, np.int64),) * 2]
    if len(kept):
        lefts, sizes, ids = lefts[kept], sizes[kept], np.asarray(ids)[kept]
        rows = _laid(rows[kept][np.arange(WIDEST) < sizes[:, None]], sizes, PLACES - 1 - lefts)   # anchors below one another
        # an anchor's symbol stands for its bytes
        pieces = np.zeros((len(kept), ANCHOR + 4), np.uint8)
        pieces[:, :ANCHOR] = rows[:, PLACES - 1:PLACES - 1 + ANCHOR]
        names = np.unique(pieces.view(np.uint64), axis=0, return_inverse=True)[1].ravel() + END + 1
        columns = np.concatenate([rows[:, :PLACES - 1], np.zeros((len(kept), 1), np.uint8), rows[:, PLACES - 1 + ANCHOR:]], axis=1).astype(np.int32)
        columns[:, PLACES - 1] = names
        at = np.arange(columns.shape[1])
        rights = sizes - lefts - ANCHOR
        columns[(at < (PLACES - 1 - lefts)[:, None]) | (at > (PLACES - 1 + rights)[:, None])] = -1
        for column, order, common in place_orders(columns, PLACES - 1 + rights):
            if column >= PLACES:   # beyond the anchor
                continue
            head = common < PLACES
            lone = head & np.append(head[1:], True)
            order, head = order[~lone], head[~lone]
            if len(order):
                runs = np.flatnonzero(head)
                least = np.minimum.reduceat(ids[order], runs)
                again = order[ids[order] > np.repeat(least, np.diff(np.append(runs, len(order))))]
                found.append((kept[again], column - (PLACES - 1 - lefts[again])))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _as_runs(segment: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, a, b): the bytes that the 50-byte strings at ``start`` cover, by segment; unmerged where no string starts in between."""
    by = np.lexsort((start, segment))
    segment, start = segment[by], start[by]
    new = np.append(True, (segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1))[:len(segment)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(segment))[:len(first)] - 1
    return segment[first], start[first], start[last] + LENGTH


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (text, a, b) in order, those that meet or overlap as one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    low, high = (spans[:, 0] << 32) + spans[:, 1], np.maximum.accumulate((spans[:, 0] << 32) + spans[:, 2])
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1])[:len(spans)])
    last = np.append(first[1:], len(spans))[:len(first)] - 1
    return np.stack([spans[first, 0], spans[first, 1], high[last] - (spans[first, 0] << 32)], axis=1)


def _spans_out(spans: np.ndarray) -> bytes:
    return spans.astype(np.uint32).tobytes()


def _spans_in(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).reshape(-1, 3).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 64 bits, their lowest bytes first; the high ones of sorted numbers compress well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _told(beside: pd.DataFrame, kind: str) -> list[bytes]:
    return beside["data"][beside["kind"] == kind].tolist()


def _members(rows: pd.DataFrame, beside: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """(ids, order, text as bytes) of the texts of a pack that take part, by order: equal rows once, copies not."""
    gone = set(_told(beside, "copy"))
    own = {i: k for k, i in enumerate(rows["_id"]) if i not in gone}
    order = rows["_order"].to_numpy()
    chosen = sorted(own.values(), key=lambda k: (order[k], rows["_id"].iat[k]))
    return [rows["_id"].iat[k] for k in chosen], order[chosen].astype(np.int64), [rows["text"].iat[k].encode("utf-8", "surrogatepass") for k in chosen]


def _cut(data: list[bytes], text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, rows of bytes) of segments."""
    bodies = [data[t][a:b] for t, a, b in zip(text.tolist(), first.tolist(), (last + LENGTH).tolist())]
    sizes = last + LENGTH - first
    return sizes, _laid(np.frombuffer(b"".join(bodies), np.uint8), sizes)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, _order, _id, pack) and the bytes of all texts: null text empty, a null id last. ``_id`` tells texts
    apart by 128 bits and by order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_order"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = rows.withColumn("_id", F.concat(_digest(F.col("text")), F.col("_order").cast("string").cast("binary")))
    return made.withColumn("pack", F.pmod(F.xxhash64("_id"), F.lit(size // PACK_BYTES + 1)).cast("int")), size


def _digest(*parts: Column) -> Column:
    """128 bits by which texts and segments are told apart."""
    return F.unhex(F.md5(F.concat(*[p.cast("binary") for p in parts])))


def _copies(texts: DataFrame) -> DataFrame:
    """The ids of the texts that equal one of a smaller order, for their packs."""
    ids = cut_lineage(texts.select("pack", "_order", "_id", F.substring("_id", 1, 16).alias("_cid")))
    lowest = ids.groupBy("_cid").agg(F.min("_order").alias("lowest"), F.max("_order").alias("most")).filter("lowest < most")
    again = ids.join(lowest, "_cid").filter("_order > lowest").select("pack", F.lit("copy").alias("kind"), F.col("_id").alias("data")).distinct()
    return cut_lineage(again)


def _common(texts: DataFrame, copies: DataFrame, slots: int) -> DataFrame:
    """(pack, kind, data, n): the fingerprints of each pack that are in more than one text, as "map", and those with too
    many different segments for one task, as "hot"; under no pack, the sides with too many, as "side". n is how many
    segments they have in the pack."""
    bits, hot = MAP_BITS, max(2, PART_SEGMENTS // 4)

    def find(key, rows: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        _, _, data = _members(rows, beside)
        text, first, last, left, fp = anchors(data)
        by = np.argsort(fp, kind="stable")
        head = np.flatnonzero(np.append(True, fp[by][1:] != fp[by][:-1])[:len(by)])
        tail = np.append(head[1:], len(by))[:len(head)] - 1
        n = tail - head + 1
        texts = 1 + (text[by][head] != text[by][tail])
        sent = []
        several = by[np.repeat(n > 1, n)]
        if len(several):   # only different segments count
            sizes, bodies = _cut(data, text[several], first[several], last[several])
            order, new = _equal_ones(fp[several], left[several], sizes, bodies)
            n[n > 1] = np.add.reduceat(new.astype(np.int64), np.flatnonzero(np.append(True, np.diff(fp[several][order]) != 0)))
            own = order[new]
            sides = np.concatenate([x for _, _, x in _sides(fp[several][own], left[several][own], sizes[own], bodies[own])])
            sides, often = np.unique(sides, return_counts=True)   # a pack leaves out those that it has once
            sent.append(("side", sides[often > 1], np.zeros(int((often > 1).sum())), often[often > 1]))
        sent.append(("fp", fp[by][head], texts, n))
        made = []
        for kind, value, texts, n in sent:
            slot = value % slots
            for s in np.unique(slot).tolist():
                at = np.flatnonzero(slot == s)
                made.append((s, kind, key[0], _packed(value[at]), texts[at].astype(np.uint8).tobytes(), n[at].astype(np.uint32).tobytes()))
        return pd.DataFrame(made, columns=["slot", "kind", "pack", "value", "texts", "n"])

    def count(key, rows: pd.DataFrame) -> pd.DataFrame:
        lists = [_unpacked(x) for x in rows["value"]]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        value = np.concatenate(lists)
        texts = np.frombuffer(b"".join(rows["texts"]), np.uint8)
        n = np.frombuffer(b"".join(rows["n"]), np.uint32).astype(np.int64)
        by = np.argsort(value, kind="stable")
        head = np.flatnonzero(np.append(True, value[by][1:] != value[by][:-1]))
        runs = np.diff(np.append(head, len(by)))
        many = np.add.reduceat(n[by], head) >= hot
        made = []
        if key[1] == "side":
            if many.any():
                made.append((-1, "side", value[by][head][many].tobytes(), int(n[by][np.repeat(many, runs)].sum())))
            return pd.DataFrame(made, columns=["pack", "kind", "data", "n"])
        for kind, chosen in (("map", np.add.reduceat(texts[by], head, dtype=np.int64) > 1), ("hot", many)):
            some = np.sort(by[np.repeat(chosen, runs)])   # by row, then by value
            cuts = np.flatnonzero(np.append(True, np.diff(owner[some]) != 0)[:len(some)])
            for at in np.split(some, cuts[1:]) if len(some) else []:
                known = np.unique(value[at] % bits).astype("<u4").tobytes() if kind == "map" else value[at].tobytes()
                made.append((int(rows["pack"].iat[owner[at[0]]]), kind, known, int(n[at].sum())))
        return pd.DataFrame(made, columns=["pack", "kind", "data", "n"])

    sent = texts.groupBy("pack").cogroup(copies.groupBy("pack")).applyInPandas(find, "slot int, kind string, pack int, value binary, texts binary, n binary")
    return cut_lineage(sent.groupBy("slot", "kind").applyInPandas(count, _TOLD + ", n long"))


def _lookup(fp: np.ndarray, beside: pd.DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each fingerprint is common, and whether it is hot."""
    known = [np.frombuffer(x, "<u4") for x in _told(beside, "map")]
    hot = [np.frombuffer(x, np.int64) for x in _told(beside, "hot")]
    none = [np.empty(0, np.int64)]
    return _among((fp % bits).astype(np.int64), np.unique(np.concatenate(known or none)).astype(np.int64)), _among(fp, np.unique(np.concatenate(hot or none)))


def _spans(texts: DataFrame, told: DataFrame, common_sides: np.ndarray, parts: int) -> DataFrame:
    """(pack, kind, data): the spans that go from the texts of each pack."""
    bits = MAP_BITS

    def deal(key, rows: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _DEALT.split(", ")]
        _, orders, data = _members(rows, beside)
        text, first, last, left, fp = anchors(data)
        common, hot = _lookup(fp, beside, bits)
        some = np.flatnonzero(common)
        if not len(some):
            return pd.DataFrame(columns=names)
        text, first, last, left, fp, hot = (x[some] for x in (text, first, last, left, fp, hot))
        sizes, bodies = _cut(data, text, first, last)
        some, shift, sizes, bodies, route = _routed(fp, left, sizes, bodies, hot, common_sides)
        text, first, left = text[some], first[some] + shift, left[some] - shift
        by, head = _equal_ones(route, left, sizes, bodies)
        owner, order = np.cumsum(head) - 1, orders[text[by]]
        own = by[head]   # the smallest order of equal ones; those of a larger one go whole
        later = order > order[head][owner]
        spans = _merged(np.stack([text, first, first + sizes], axis=1)[by[later]])
        at, owner = by[~later], owner[~later]
        part = route[own] % parts
        slots = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(part[slots]) != 0))
        rank = np.empty(len(own), np.int64)   # of a segment within its part
        rank[slots] = np.arange(len(own)) - np.repeat(cuts, np.diff(np.append(cuts, len(own))))
        placed = np.argsort(part[owner], kind="stable")
        where = np.searchsorted(part[owner][placed], np.append(part[slots[cuts]], parts))
        made = []
        for k, chosen in enumerate(np.split(slots, cuts[1:])):
            x, y = own[chosen], placed[where[k]:where[k + 1]]
            flat = bodies[x][np.arange(WIDEST) < sizes[x][:, None]]
            made.append((int(part[chosen[0]]), key[0], _packed(route[x]), left[x].astype(np.uint8).tobytes(), sizes[x].astype(np.uint8).tobytes(),
                         orders[text[x]].tobytes(), flat.tobytes(), rank[owner[y]].astype(np.uint32).tobytes(),
                         np.stack([text[at[y]], first[at[y]]]).astype(np.uint32).tobytes(),
                         _spans_out(spans) if k == key[0] % len(cuts) else b""))
        return pd.DataFrame(made, columns=names)

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        together = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind).astype(np.int64)
        routes, lefts, sizes, orders = np.concatenate([_unpacked(x) for x in rows["routes"]]), together("lefts", np.uint8), together("sizes", np.uint8), together("orders", np.int64)
        bodies = _laid(np.frombuffer(b"".join(rows["bodies"]), np.uint8), sizes)
        by, head = _equal_ones(routes, lefts, sizes, bodies)
        name = np.empty(len(by), np.int64)
        name[by] = np.cumsum(head) - 1
        lowest = np.minimum.reduceat(orders[by], np.flatnonzero(head))
        own = by[head]
        several = np.flatnonzero(np.repeat(*(lambda n: (n > 1, n))(np.diff(np.append(np.flatnonzero(np.append(True, np.diff(routes[own]) != 0)), len(own))))))
        chosen = own[several]
        segments = [b[:n] for b, n in zip(map(bytes, bodies[chosen]), sizes[chosen].tolist())]
        segment, a, b = _as_runs(*repeated_starts(routes[chosen], segments, lefts[chosen], lowest[several]))
        count = np.zeros(len(own), np.int64)
        np.add.at(count, several[segment], 1)
        begin = np.cumsum(count) - count
        made, below = [], 0
        for pack, mine, owners, places, found in zip(rows["pack"], rows["lefts"], rows["owners"], rows["places"], rows["found"]):
            x = np.frombuffer(owners, np.uint32).astype(np.int64) + below
            below += len(mine)
            text, start = np.frombuffer(places, np.uint32).reshape(2, -1).astype(np.int64)
            whole = orders[x] > lowest[name[x]]
            n = np.where(whole, 0, count[name[x]])
            each = np.repeat(np.arange(len(x)), n)
            run = np.repeat(begin[name[x]] - (np.cumsum(n) - n), n) + np.arange(len(each))
            spans = np.concatenate([np.stack([text, start, start + sizes[x]], axis=1)[whole],
                                    np.stack([text[each], start[each] + a[run], start[each] + b[run]], axis=1), _spans_in(found)])
            if len(spans):
                made.append((pack, "spans", _spans_out(_merged(spans))))
        return pd.DataFrame(made, columns=["pack", "kind", "data"])

    dealt = texts.groupBy("pack").cogroup(told.groupBy("pack")).applyInPandas(deal, _DEALT)
    return dealt.groupBy("part").applyInPandas(order, _TOLD)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of ``docs``.

    ``spans``: maximal removed runs (start, stop) in bytes of the UTF-8 text; ``kept``: the remaining
    bytes. Null or empty text, or one of under 50 bytes: nothing is removed. Rows with one id do not remove
    each other's bytes, so repeated rows have the same result; a null id counts as the largest. A text
    that equals one of a smaller id goes whole if it has 50 bytes. Other columns are ignored; an empty
    table gives an empty table.
    """
    texts, size = _texts(docs)
    copies = _copies(texts)
    common = _common(texts, copies, size // COUNT_BYTES + 1)
    counts = {r.kind: r.n for r in common.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    entries = counts.get("map", 0) + counts.get("hot", 0) + counts.get("side", 0) * PLACES // 2
    # a common side stands for thousands of segments; for every one of them a list of a few bytes
    sides = [np.frombuffer(r.data, np.int64) for r in common.filter("kind = 'side'").select("data").toLocalIterator()]
    told = copies.unionByName(common.filter("kind != 'side'").drop("n"))
    results = copies.unionByName(_spans(texts, told, np.unique(np.concatenate([np.empty(0, np.int64), *sides])), entries // PART_SEGMENTS + 1))

    def remove(rows: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        number = {i: k for k, i in enumerate(_members(rows, beside)[0])}
        spans = _merged(np.concatenate([np.empty((0, 3), np.int64), *map(_spans_in, _told(beside, "spans"))]))
        cuts = np.searchsorted(spans[:, 0], np.arange(len(number) + 1))
        out = []
        for i, text in zip(rows["_id"], rows["text"]):
            data = text.encode("utf-8", "surrogatepass")
            if i in number:
                merged = spans[cuts[number[i]]:cuts[number[i] + 1], 1:].tolist()
            else:   # a copy
                merged = [[0, len(data)]] if len(data) >= LENGTH else []
            edges = [0, *[x for s in merged for x in s], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), [{"start": a, "stop": b} for a, b in merged], kept))
        made = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
        made.insert(0, "doc_id", pd.array([None if none else x for x, none in zip(rows["_order"].tolist(), rows["doc_id"].isna())], "Int64"))
        return made

    return texts.groupBy("pack").cogroup(results.groupBy("pack")).applyInPandas(
        remove, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
