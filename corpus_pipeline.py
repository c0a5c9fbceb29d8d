"""From raw documents to packed sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm.common import give_back, written
from sequora.llm.decontaminate import few, leaks
from sequora.llm.jaccard import near_components
from sequora.llm.language import identify
from sequora.llm.packing import pack_documents
from sequora.llm.templates import drop_templates

#: Least share of the best language; below it a text is in no known language or in several alike.
LEAST_SCORE = 0.4

#: Arrow batches of the stages: at most so many rows and bytes, so that what a task holds beside the heap doesn't grow with the length of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def _begin(spark: SparkSession) -> None:
    """Sets BATCH in the session, which the plans of the stages read when they run; gives back what the stage before took in the driver."""
    give_back()
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def _whole(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (and null ones) and those whose best language is unsure. Rows are judged one by one: repeated rows and equal texts fare alike, a tie of languages has the first name."""
    _begin(spark)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", _whole(docs.select(*[F.col(f"`{c}`") for c in rest])))
    found = identify(rows, docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*["text" if c == "text" else F.col(f"_whole.`{c}`").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of every text; no document goes, null texts stay null, equal texts (repeated rows) lose equal lines."""
    _begin(spark)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    out = drop_templates(docs.select("text", _whole(docs.select(*rest))))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_whole.`{c}`").alias(c) for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each near-duplicate group, and one of its repeated rows. Rows of a null id stay; of two texts of the least id both do."""
    _begin(spark)
    keep = near_components(docs).where("id = component_id").select(F.col("id").alias("kept")).distinct()
    rows = docs.select(_whole(docs), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    one = rows.join(keep, F.col("_id") == F.col("kept"), "left_semi").dropDuplicates(["_id", "_key"])
    return one.unionByName(rows.where("_id is null")).select("_whole.*")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item. Equal texts (repeated rows) fare alike; null and empty texts stay."""
    key = F.concat(F.xxhash64("text").cast("string"), F.lit("/"), F.xxhash64(F.lit(1), F.col("text")).cast("string"))
    hit = leaks(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").select(F.col("id").alias("_key")).distinct()
    rows = docs.select(_whole(docs), key.alias("_key"))
    return few(rows, written(hit, "hits"), "_key", "left_anti").select("_whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens; null texts are empty ones, repeated rows are documents of their own. No document, no row."""
    _begin(spark)
    return pack_documents(docs, keep=200_000)  # workers still hold memory of earlier stages


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("jaccard", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again.

    Columns of any further names stay until packing. An empty table runs through all stages and gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
