"""Secrets in whole texts: keyword automaton first, anchored patterns near its hits, checksums last.

One pass of an Aho-Corasick automaton finds every place where a keyword kind could begin; a pattern is
then tried at that place only. Runs of hexadecimal digits have no keyword, so they get a sieve of their
own: a run of 24 or more covers a multiple of 24, and only the neighbourhood of such a place is read.
Kinds whose format embeds a checksum are accepted only if the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

# fixed values: the base patterns and least lengths
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# fixed values: prefixes and shapes of tokens with an embedded checksum
CRC_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEY_WORDS = ("xprv", "tprv")
KEY_TOKEN = re.compile(r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107,108}(?![0-9A-Za-z])")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "crc_token", "extended_key")
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_HEX_DIGITS = frozenset("0123456789abcdef")


def _automaton() -> ahocorasick.Automaton:
    """All keywords in lower case; a kind's own pattern settles the case."""
    out = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("crc_token", CRC_WORDS), ("extended_key", KEY_WORDS)):
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _folded(text: str) -> str:
    """Lower case with the same length; other letters than the 26 may stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def crc_token_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    number = 0
    for c in token[-6:]:
        number = number * 62 + BASE62.index(c)
    return number == zlib.crc32(token[4:-6].encode())


def extended_key_holds(token: str) -> bool:
    """Base 58 of 82 bytes, of which the last four begin the double SHA-256 of the others."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    try:
        raw = number.to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least 24 digits, found from the places that are multiples of 24."""
    done = 0
    for at, c in enumerate(text[LEAST_HEX - 1::LEAST_HEX]):
        place = (at + 1) * LEAST_HEX - 1
        if c in _HEX_DIGITS and place >= done:
            start = place
            while start > 0 and text[start - 1] in _HEX_DIGITS:
                start -= 1
            end = HEX.match(text, place).end()
            done = end
            if end - start >= LEAST_HEX:
                yield start, end


def scan(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Every span of one text as (kind, start, end) by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(_folded(text)))
    out, free = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            found = ASSIGN.match(text, at)
            holds = found and len(found[2]) >= LEAST_ASSIGN
        elif kind == "access":
            found = ACCESS.match(text, at)
            holds = found and len(found[0]) >= LEAST_ACCESS
        elif kind == "crc_token":
            found = CRC_TOKEN.match(text, at)
            holds = found and crc_token_holds(found[0])
        else:
            found = KEY_TOKEN.match(text, at)
            holds = found and extended_key_holds(found[0])
        if found:
            free[kind] = found.end()
        if holds:
            out.append((kind, at, found.end()))
    out += [("hex", *run) for run in _hex_runs(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end), in code points, end exclusive.

    Kinds: ``assign`` (a named value of six or more characters), ``access`` (AKIA and sixteen or more),
    ``hex`` (24 or more digits), ``crc_token`` and ``extended_key`` (checksum holds). Within a kind,
    matches are leftmost and do not overlap; a match that fails its test still uses its characters up.
    Spans of different kinds may overlap. Null or empty text: an empty array. Rows are taken one by
    one, so repeated rows and ties need no rule; other columns pass through, a column named ``spans``
    is replaced.
    """

    @F.pandas_udf(SPANS)
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for texts in batches:
            yield pd.Series([scan(t, automaton) for t in texts], dtype=object)

    return without(docs, "spans").withColumn("spans", spans_of("text"))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the given kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds != KINDS else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """Texts with each maximal run of spans replaced by ``[secret]``; the column ``spans`` goes.

    Overlapping and touching spans form one run. ``n_chars``, if there, becomes the new length.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        apart = s["start"] > acc["at"]
        piece = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(apart | (F.size(acc["parts"]) == 0), F.concat(acc["parts"], F.array(piece, F.lit("[secret]")))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    folded = F.aggregate("spans", start, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, folded).otherwise(F.col("text"))
    out = found.withColumn("text", text).drop("spans")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in found.columns else out
