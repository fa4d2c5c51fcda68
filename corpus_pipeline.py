"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) over all that the one before it
kept. It is written as Parquet to the session's checkpoint folder and read again as
the next one's docs, so a lost executor costs a stage's reading and not the run.
All but the last return the columns of documents, extra ones too, whatever their
names.

In every stage rows with null ids, sources or texts take part: a null text counts as
an empty one and stays null. Rows with one id have one fate, and repeated rows
stay repeated (mixing takes each as often as its id). Texts are read whole. An empty
table gives an empty table in each stage, and a run over one gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.llm.common import fresh, saved, table
from hireloom.llm.line_dedup import dedup_lines
from hireloom.llm.minhash import near_duplicates
from hireloom.llm.mixing import mix
from hireloom.llm.packing import cut, pack, tokenize
from hireloom.llm.quality import score_quality

#: A document stays if its probability of being good is at least this.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows with one id have one fate, their best
    score's; empty and null texts are scored like others, by what they lack."""
    (key,) = fresh(docs, "_hl_id")
    scores = score_quality(docs, table(spark, sf_dir, "labels")).groupBy("doc_id").agg(F.max("score").alias("best"))
    kept = scores.where(F.col("best") >= LEAST_QUALITY).select(F.col("doc_id").alias(key))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that consist of them alone; empty and null texts,
    which have no line to lose, stay. n_chars follows the text, null for a null one."""
    counts = fresh(docs, "_hl_lines", "_hl_dropped")
    out = dedup_lines(docs, counts=tuple(counts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    emptied = (F.col(counts[1]) > 0) & (F.length(F.btrim("text")) == 0)
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8. Texts
    without words are near nothing and stay."""
    (key,) = fresh(docs, "_hl_id")
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; a null source is one of its own."""
    key, copies, copy = fresh(docs, "_hl_id", "_hl_copies", "_hl_copy")
    mixed = mix(docs).groupBy("doc_id").agg(F.max("copies").alias(copies)).withColumnRenamed("doc_id", key)
    taken = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed[key])).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens; an empty or null
    text is its end alone."""
    pieces = cut(tokenize(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return pack(saved(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixing", mixing), ("packing", packing)]

#: The quality classifier's and the tokenizer's work cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs, name)
    return docs
