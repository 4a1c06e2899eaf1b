"""From raw documents to packed windows: five stages over the columns of ``documents``.

Every stage reads what the one before it wrote, whole, and its decisions take effect:
language identification drops documents without a recognised language, near-duplicate
groups keep the document of least id, repeated passages are cut out of the texts,
documents with benchmark items go, and what is left is packed into windows.

The language filter of the first stage learns from all its labelled rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.llm import decontamination, jaccard, language, packing, substrings
from archlens.llm.common import owned, saved, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of the predicted language for a document to stay; clean prose scores above 0.5.
LEAST_SCORE = 0.2
WINDOW = 4096

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The work tables of the stage that ran last; its result is written when the next one begins.
_last: list[owned] = []


def stage(function: Stage) -> Stage:
    """A stage that owns its work tables: they go when the next stage begins, and no other query's do."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            _last.pop().drop(spark)
        with owned() as tables:
            _last.append(tables)
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is ``und`` or scores below LEAST_SCORE (null and letterless texts too)."""
    judged = language.predict(docs, language.learn(docs), keep=COLUMNS)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: its least doc_id, and one row of that id.

    Rows without a doc_id are known by their text: a group that has no id at all keeps its least text hash.
    """
    kept = jaccard.grouped(docs).where("n_shingles = 0 OR doc_id = component_id OR (doc_id IS NULL AND component_id IS NULL)")
    kept = saved(kept.select("doc_id", "text_hash", "n_shingles", "label"), "kept", narrow=True)
    group = F.when(F.col("n_shingles") == 0, F.col("text_hash")).otherwise(F.lit(0))
    named = kept.where("doc_id IS NOT NULL").select(F.lit(False).alias("_nameless"), F.col("doc_id").alias("_key"))
    nameless = kept.where("doc_id IS NULL").groupBy("label", group.alias("group")).agg(F.min("text_hash").alias("_key")).select(F.lit(True).alias("_nameless"), "_key")
    # the join and the window deal rows by the same columns, none of them null, so texts are sent once
    keyed = docs.select(*COLUMNS, F.isnull("doc_id").alias("_nameless"), F.coalesce("doc_id", jaccard.text_hash()).alias("_key"))
    rows = keyed.join(named.unionByName(nameless).distinct(), ["_nameless", "_key"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_nameless", "_key").orderBy("text", "source", "lang", "n_chars"))
    return rows.withColumn("_first", first).where("_first = 1").select(COLUMNS)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; n_chars is that of the new text."""
    cut = substrings.remove_repeats(docs, keep=["lang", "source"])
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its error budget."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))  # rows without a doc_id too
    found = decontamination.leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark)
    leaked = saved(found.select(F.col("doc_id").alias("_key")).distinct(), "leaked", narrow=True)
    return keyed.join(leaked, "_key", "left_anti").select(COLUMNS)


@stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in windows of WINDOW tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), WINDOW)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("packing", pack_windows),
]

#: Stages 1 to 5 need models, automata and tokenizers, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = f"{work_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        out = function(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    while _last:
        _last.pop().drop(spark)
    return docs
