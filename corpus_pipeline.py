"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes the documents that its predecessor kept and returns documents (the last
one pieces of packed sequences).  Stages are written as Parquet in between.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.linededup import dedup_lines
from casegraph.llm.memory import trim
from casegraph.llm.mixing import mix_documents
from casegraph.llm.neardup import near_duplicates, row_marks
from casegraph.llm.packing import pack_documents, tokenizer_path
from casegraph.llm.quality import apply_quality_rules
from casegraph.llm.scratch import materialize, release
from casegraph.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MAX_SHARED_IDS = 2_000_000
#: Words whose ids a worker keeps: fewer than by itself, since workers outlive the stage.
CACHED_WORDS = 150_000


def _begin(spark: SparkSession) -> None:
    """Send the package out, and drop what the stage before has left: its rows are written."""
    ship_package(spark)
    release(spark, "pipeline")
    gc.collect()
    trim()


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with a new text and its length."""
    return df.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the boilerplate lines of their host."""
    _begin(spark)
    return _with_text(apply_quality_rules(docs.select(*COLUMNS), owner="pipeline").filter("kept"), "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks and passages of lines that an earlier document holds.

    Documents that have no words left are copies in whole and go.
    """
    _begin(spark)
    deduped = dedup_lines(docs.select(*COLUMNS), owner="pipeline")
    emptied = (F.size("removed") > 0) & ~F.coalesce(F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _with_text(deduped.filter(~emptied), "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8.

    Rows are told apart by doc_id and text, a null id being one like others; of rows alike
    in both one stays.
    """
    _begin(spark)
    docs = docs.select(*COLUMNS)
    marks = ["row", "other"]
    judged = near_duplicates(docs, with_marks=True, owner="pipeline")
    held = materialize(judged.groupBy(*marks).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "judged", "pipeline")
    single = held.filter("not kept or n > 1").select(*marks)
    shared = F.broadcast(single) if single.count() <= MAX_SHARED_IDS else single
    marked = docs.select(*COLUMNS, *row_marks("doc_id", "text"))
    out = marked.join(shared, marks, "left_anti").select(*COLUMNS)
    repeated = held.filter("kept and n > 1").select(*marks)
    again = repeated.count()
    if again:
        found = marked.join(F.broadcast(repeated) if again <= MAX_SHARED_IDS else repeated, marks, "left_semi")
        least = found.groupBy(*marks).agg(F.min(F.struct(*COLUMNS)).alias("_row"))
        out = out.union(least.select("_row.*"))
    return out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each copy of a document that the mix takes."""
    _begin(spark)
    mixed = mix_documents(docs.select(*COLUMNS), owner="pipeline").filter("mix_copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 4096 tokens."""
    _begin(spark)
    return pack_documents(docs, tokenizer_path(), cached_words=CACHED_WORDS, owner="pipeline")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("sequence packing", sequence_packing),
]

#: Signatures, chunk bounds and token ids are not for SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), "pipeline-stages")
    return STAGES[-1][1](spark, docs, sf_dir)
