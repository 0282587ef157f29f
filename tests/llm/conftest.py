from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba do ki mu ra se ti vo ne lu pa go".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, short and long texts, repeated rows, ties."""
    rng, rows = random.Random(7), []
    base = [words(rng, 60 + 5 * k) for k in range(12)]
    for k, text in enumerate(base):
        rows.append((k, text, ("en", "de", None)[k % 3], f"s{k % 4}", len(text)))
    edit = lambda text, at, new: " ".join(new if i in at else w for i, w in enumerate(text.split(" ")))
    rows += [(20, base[0], "en", "s0", 0), (21, base[0], "en", None, 0), (22, edit(base[0], {5}, "xx"), "en", "s1", 0),
             (23, edit(base[1], {3, 40}, "yy"), "de", "s1", 0), (24, edit(base[1], {3, 20, 33, 50}, "zz"), "de", "s1", 0),
             (25, base[2] + "\n" + base[3][:120] + " tail", "en", "s2", 0), (26, base[3][10:100] + "é" + base[4][5:90], "en", "s2", 0),
             (30, None, "en", "s0", None), (31, "", "en", "s0", 0), (32, " \n\t ", None, None, 4), (33, "one", "en", "s3", 3),
             (34, "one", "en", "s3", 3), (35, "a b c", "en", "s3", 5), (36, (base[5] + "\n") * 9, "fr", "s3", 0),
             (37, words(rng, 4000), "fr", "s0", 0), (38, "日本語 テスト 😀 " * 12, "ja", "s9", 0), (None, base[6], "en", "s0", 0),
             (None, None, None, None, None), (40, base[7], "en", "s0", 1), (40, base[7], "en", "s0", 1), (40, base[8], "en", "s0", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns that bear the names operators use."""
    from pyspark.sql import functions as F

    names = ("size", "score", "Spans", "_cid", "ids", "kept", "target", "taken", "positions", "decoded", "predicted", "_made", "distance", "lang_pred")
    return docs.withColumns({n: F.lit("mine") for n in names})
