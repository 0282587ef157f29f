"""A training corpus from raw documents: each stage writes its result, the next one reads it.

Stages take the columns of documents and, but for the last, return them. Null texts pass every stage with
a defined result: they score as the model's intercept, are nobody's duplicate, hold no secret, weigh
nothing in the mix (so the mix leaves them out). Empty tables give empty tables; other columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mineralis.llm import bpe, mixing, neardup, secrets, toxicity
from mineralis.session import cut_lineage


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: rows of an Arrow batch at most. Rows are whole texts: with Spark's 10,000 each Python worker and the executor beside it
#: hold tens of MB a copy, and workers keep what they have taken for the stages that follow
BATCH_ROWS = 1_000


def _apart(stage):
    """``stage`` over the columns of documents, others carried in one struct so that no name can clash."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH_ROWS:   # stays set, because the stage's result is lazy; changes no result
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        extra = [c for c in docs.columns if c not in DOCUMENT]
        if not extra:
            return stage(spark, docs, sf_dir)
        own = [c for c in docs.columns if c in DOCUMENT]
        out = stage(spark, docs.select(*own, F.struct(*extra).alias("_carried")), sf_dir)
        new = [c for c in out.columns if c not in own and c != "_carried"]
        return out.select(*[c if c in own else F.col("_carried")[c].alias(c) for c in docs.columns],
                          *[c for c in new if c.lower() not in {x.lower() for x in docs.columns}])

    run_stage.__doc__, run_stage.__name__ = stage.__doc__, stage.__name__
    return run_stage


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from all labelled ones, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    return toxicity.score(docs, model).filter(F.col("predicted") == 0).select(*docs.columns)


@_apart
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return neardup.keep_one(docs).select(*docs.columns)


@_apart
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[secret]`` in the place of what the scan finds; ``n_chars`` follows the text."""
    return secrets.redact(secrets.find_secrets(docs)).select(*docs.columns)


@_apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once for each pass that the mix makes over them.

    A document that the last pass of its source reads only in part is kept whole when at least half of
    its words are due; one that the mix does not read goes.
    """
    mixed = mixing.curriculum(docs)
    return mixing.training_order(mixing.whole_passes(mixed)).select(*docs.columns)


@_apart
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens; ``intact`` says that decoding the tokens gives the text again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    same = F.col("decoded").eqNullSafe(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return both.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("intact", same).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL has no toxicity model and no ProbMinHash; the stages are tested against plain loops instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
