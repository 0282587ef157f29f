"""Named queries of this folder; each binds an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, hardneg, langid, mixing, neardup, outliers, repeats, secrets, simhash, topk, toxicity, twins, warc
from ..session import cut_lineage
from .common import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from those whose id leaves another remainder than 1."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector with all others."""
    vectors = topk.integer_vectors(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return neardup.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the verdict of the robust distance for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = cut_lineage(outliers.text_statistics(docs).drop("text"))
    return outliers.judge(stats).select("doc_id", *outliers.COUNTS, "base_failed", "kept", "distance")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of the bytes they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that a document of a smaller id has too."""
    left = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    found = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.joined(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS], base, secrets.joined(F.col("spans")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(spark, pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id leaves another remainder than 2."""
    docs = _read(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    dictionaries = langid.fit(langid.teaching_rows(docs, ~held_out))
    predicted = langid.predict(docs.select("doc_id", "text"), dictionaries)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order they are first read, with the words the mix takes of each."""
    mixed = mixing.curriculum(_read(spark, sf_dir, "documents"))
    first = F.element_at("positions", 1).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of near copies that it belongs to."""
    return simhash.near_copies(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector first takes the next label."""
    table = _read(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hardneg.labelled(table.withColumn("label", moved))
    return hardneg.mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each source at each step of all 120 orders."""
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (op1_toxicity, op2_topk, op3_neardup, op4_outliers, op5_bpe, op6_repeats, op7_secrets, op8_warc, op9_langid, op10_mixing,
    op11_simhash, op12_hardneg, op13_filter_audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(twins.SQL)
