"""A training corpus from raw documents, in five stages; each calls one operator of knotwork.llm.

Every stage works on all that its predecessor kept and takes effect: rejected, duplicate and
leaked documents are gone afterwards, secrets are masked in the text, and the last stage returns
token ids.

A document with null text counts as empty; it stays unless its empty text is rejected. Rows with
a null id are never duplicates of anything. Rows that repeat an id are judged each by its text;
where an id goes as a duplicate, all its rows go. Ties: a score at LEAST_QUALITY stays, and of
documents that are linked the one with the least id. Texts of any length are taken whole. An
empty table gives an empty one. Columns beyond documents' own are carried to the last stage but
one, whatever their names; n_chars, lang and source may be missing, and are then not made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import bpe, decontam, near_dups, quality, secrets
from knotwork.llm.common import remainder, stored, table

#: Least quality score of a document that stays.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rule-ensemble score is LEAST_QUALITY or more; the model is learnt from
    the labelled ones whose crc32(doc_id) mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs.select("doc_id", "text"), labels, "quality")
    return _unpacked(quality.score(_packed(docs), model, name="score").filter(F.col("score") >= LEAST_QUALITY), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return near_dups.keep_one(docs).select(*[f"`{c}`" for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.find_leaks(_packed(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return _unpacked(found.filter(~F.col("leaked")), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets; n_chars follows."""
    clean = secrets.redact(_packed(docs).withColumn("before", F.xxhash64("text")))
    if "n_chars" not in docs.columns:
        return _unpacked(clean, docs)
    size = F.when(F.xxhash64("text") != F.col("before"), F.length("text")).otherwise(F.col("row")["n_chars"])
    return _unpacked(clean, docs, n_chars=size.cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers."""
    import public_tokenizers as P

    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    found = bpe.encode(docs.select(*kept, "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return found.select(*kept, "n_tokens", "ids")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the other columns in one, so no name of an operator's own can clash."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(True).alias("none")]).alias("row"))


def _unpacked(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """docs' columns of packed rows; new: in place of a column."""
    value = lambda c: new[c] if c in new else F.col(c) if c in ("doc_id", "text") else F.col("row")[c]
    return found.select(*[value(c).alias(c) for c in docs.columns])


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: Neither the quality model nor the encoding can be expressed in SQL; tests/llm checks the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
