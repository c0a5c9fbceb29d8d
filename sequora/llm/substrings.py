"""Substring deduplication by hashed lines and the sentences in them.

Units are a text's lines, cut further after sentence ends, so that a passage inside a line is
found too. Units are normalised (lower case, single spaces), their digests are grouped over
all documents, and the occurrence of the least document id is kept. Runs of repeated units of
enough words in all are spans to remove, with offsets into the original text.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import written

UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*[.!?]*\s*")


def units(text: str):
    """(start, end, words, digest) of the units that hold a word; together they cover the text's words."""
    for m in UNIT.finditer(text):
        toks = m.group().lower().split()
        if toks:
            yield m.start(), m.end(), len(toks), xxhash.xxh3_64_intdigest(" ".join(toks)) - 2**63


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 25) -> DataFrame:
    """Spans to remove: id, text_key (hash of the whole text), start, end (characters, end exclusive), n_words, kept_id.

    A unit is repeated if it stands earlier in its text or in a document of a lesser id; a run
    of adjoining repeated units of at least least_words words is a span; kept_id is the least
    document that keeps the run's first unit (the same document for repetitions inside it).
    Null and empty texts have no spans. Rows of one id are alike in rank, so repeated rows
    don't remove each other; rows of a null id rank last and don't remove each other. Texts of one id that
    differ are told apart by text_key. Other columns are ignored. An empty table has no spans.
    """
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("k", LongType()), *(StructField(n, IntegerType()) for n in ("unit", "start", "end", "words")), StructField("digest", LongType()), StructField("again", BooleanType())])

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, k, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                seen, key, k = set(), key.as_py(), k.as_py()
                for i, (start, end, words, digest) in enumerate(units(text.as_py() or "")):
                    for col, x in zip(out, (key, k, i, start, end, words, digest, digest in seen), strict=True):
                        col.append(x)
                    seen.add(digest)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema.names)
                    out = [[] for _ in range(8)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    all_units = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    first = all_units.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = written(first, "digests")  # so that both sides of the join are dealt anew and hot digests can be split
    found = all_units.join(first.select("digest", "first"), "digest", "left").where("again or (first is not null and (id is null or id > first))")
    doc = found.groupBy("id", "k").agg(F.collect_list(F.struct("unit", "start", "end", "words", "first")).alias("u"))

    def runs(batches):
        for b in batches:
            out = []
            for key, k, us in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                us = sorted({u["unit"]: u for u in us}.values(), key=lambda u: u["unit"])
                at = 0
                for i in range(1, len(us) + 1):
                    if i == len(us) or us[i]["unit"] != us[i - 1]["unit"] + 1:
                        words = sum(u["words"] for u in us[at:i])
                        if words >= least_words:
                            out.append((key, k, us[at]["start"], us[i - 1]["end"], words, us[at]["first"]))
                        at = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((types[0], pa.int64(), pa.int32(), pa.int32(), pa.int32(), types[0]))], span.names)

    span = StructType([StructField("id", kind), StructField("text_key", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("n_words", IntegerType()), StructField("kept_id", kind)])
    return doc.select("id", "k", "u").mapInArrow(runs, span)


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of repeated_spans() cut out of text_col; rows without spans stay as they are.

    Spans belong to a row's id and text, so other texts of the same id stay whole; null ids are an id like others.
    Repeated rows lose the same spans; overlapping spans are cut once. Columns of any names stay. Either table may be empty.
    """
    cut = spans.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_own"), F.col(text_col).cast("string").alias("_text"))
    joined = rows.join(cut, F.col("_own").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_key")), "left")
    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(a, s):
        return F.struct(F.concat(a["text"], F.substring("_text", a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("text"), F.greatest(a["at"], s["end"]).alias("at"))

    kept = F.aggregate("_spans", begin, step, lambda a: F.concat(a["text"], F.substr("_text", a["at"] + 1)))
    text = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op2_lines(spark, sf_dir: str) -> DataFrame:
    """Spans of at least 25 words, of all documents, that repeat an earlier document or place."""
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.withColumnRenamed("id", "doc_id").withColumnRenamed("kept_id", "kept_doc_id")
