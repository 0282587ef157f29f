"""Language by compression: the text belongs to the language whose dictionary makes it smallest.

Each language has a raw-content dictionary, pieces of labelled texts joined to one block. A whole text is
compressed block by block with every dictionary, and the sums of the sizes are compared. Dictionary and
text are read the same way: lower case, with everything but letters made one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import without

#: bound of the fit: so many different texts of a language give a piece of so many characters each
PIECES, PIECE_CHARS = 512, 256
LEVEL, BLOCK_BYTES = 3, 2048
#: least relative distance to the second-smallest size for a prediction to count as sure
MARGIN = 0.01
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
PREDICTION = "lang_pred string, score double, accepted boolean"


class Dictionary(NamedTuple):
    lang: str
    texts: int
    content: bytes


def _plain(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> list[Dictionary]:
    """Dictionaries from rows of (text, lang), the language with most texts first.

    Different texts are ranked by a hash, so a text with many copies counts once; the ``pieces`` lowest
    of each language give ``piece_chars`` characters from a place that the hash names, so that headers which many
    texts begin with are not all that is learned. The result has at most
    ``pieces * piece_chars`` characters for each language. Rows without text or language teach nothing.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    usable = usable.select("lang", "text", F.xxhash64("text").alias("order"))
    sizes = usable.groupBy("lang", "order").agg(F.count(F.lit(1)).alias("n"))
    chosen = (sizes.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order")))
              .filter(F.col("rank") <= pieces).select("lang", "order"))
    place = F.pmod("order", F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1).cast("int") + 1
    parts = (usable.join(cut_lineage(chosen), ["lang", "order"]).groupBy("lang", "order")
             .agg(F.min(F.substring(F.col("text"), place, F.lit(piece_chars))).alias("piece")))
    content = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("order", "piece"))).alias("parts"))
    counts = sizes.groupBy("lang").agg(F.sum("n").alias("texts"))
    rows = cut_lineage(content.join(counts, "lang")).collect()
    made = [Dictionary(r["lang"], r["texts"], b" ".join(_plain(p["piece"]) for p in r["parts"])) for r in rows]
    return sorted((d for d in made if len(d.content) >= 8), key=lambda d: (-d.texts, d.lang))


def _compressors(dictionaries: list[Dictionary]) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        content = zstandard.ZstdCompressionDict(d.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False,
                                            write_checksum=False, write_dict_id=False))
    return out


def sizes_of(data: bytes, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors], dtype=float)


def predict(docs: DataFrame, dictionaries: list[Dictionary], margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and accepted.

    ``lang_pred`` is the language of the smallest size; equal sizes go to the language with more learned
    texts. ``score`` is m / (m + 2 * margin) for the relative distance m to the second size, so it is 0 at
    a tie and 1/3 at the margin; with one language learned it is 1. ``accepted`` is false where m is below
    ``margin``: such a prediction is rejected by callers that need a sure one. Null text, a text without
    a letter, or nothing learned: ``und``, 0, false. Rows are taken one by one; columns with the names of
    the made ones are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(PREDICTION)
    def predict_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        learned = shared.value
        compressors = _compressors(learned)
        for texts in batches:
            rows = []
            for text in texts:
                data = _plain(text) if text and learned else b""
                if not data:
                    rows.append((UNKNOWN, 0.0, False))
                    continue
                sizes = sizes_of(data, compressors)
                best = int(np.argmin(sizes))
                second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
                m = (second - sizes[best]) / sizes[best]
                rows.append((learned[best].lang, 1.0 if np.isinf(m) else m / (m + 2 * margin), bool(m >= margin)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])

    made = without(docs, "lang_pred", "score", "accepted", "_made").withColumn("_made", predict_of("text"))
    return made.select("*", "_made.*").drop("_made")


def teaching_rows(docs: DataFrame, teaches: Column) -> DataFrame:
    return docs.filter(teaches).select("text", "lang")
