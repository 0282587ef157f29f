"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed value: a word is a run of characters other than the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_SPLIT = re.compile(r"[ \t-\r]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that bear a name the operator is about to write (in any case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a column named inside a lambda is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def split_words(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split(text) if w] if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, kept for one batch of documents."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One hash per place for the words at ``offsets`` from it; places that reach past the end are left out."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(len(offsets) * 131 + offsets[-1]), np.uint64)
        for k in offsets:
            out = (out + hashes[k:k + n]) * _ODD
            out ^= out >> np.uint64(29)
    return mix64(out)
