"""A corpus pipeline of five stages over the table of documents.

Quality rules drop lines and documents, line dedup drops lines that many documents share,
near-dedup keeps one document of each group, mixing takes whole documents as often as the
target weights ask, and packing places their tokens in sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs; all but the last return the columns of
documents.  A stage deletes the working tables of the stage before it, whose result has
been written by then; tables that other operators made stay.

Edge cases: null, empty and blank texts fail the quality rules; a text that loses all its
lines stays as an empty text and is no near copy of anything; repeated rows are near
copies of each other; of rows with one id and different texts each counts on its own; an
empty table gives empty tables; further columns of docs are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import if_small, materialise, named, new_path, read_table, release, set_aside, text_or_empty, working_tables
from folio.llm.linededup import line_dedup
from folio.llm.minhash import near_duplicates
from folio.llm.mixing import mixed_documents
from folio.llm.packing import pack_documents
from folio.llm.quality import quality

CAPACITY = 1024

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application: the working tables of the stage that ran last.
_LEFT: dict[str, list[str]] = {}


def staged(stage: Stage) -> Stage:
    """A stage that deletes what the one before it left, and has what it makes itself deleted by the next."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, docs, _LEFT.pop(app, []))
        before = set(working_tables(spark))
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _LEFT[app] = [p for p in working_tables(spark) if p not in before]

    return run


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with n_chars, where there is one, counted again after a change of text."""
    if "n_chars" not in columns:
        return docs.select(*map(named, columns))
    return docs.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else named(c) for c in columns])


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    # set aside, so that no column of docs has the name of one that the rules add
    rows, names = set_aside(docs)
    judged = quality(rows, names["text"]).where("kept")
    back = [F.col("clean_text" if c == "text" else names[c]).alias(c) for c in docs.columns]
    return recounted(judged.select(*back), docs.columns)


@staged
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that five or more documents share (save in one of them)."""
    return recounted(line_dedup(docs, min_chars=40, min_docs=5), docs.columns)


@staged
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    tag = F.xxhash64(text_or_empty())
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), tag.alias("tag"))
    found = near_duplicates(docs.select(key.alias("key"), "text"), 75, "key", "text")
    kept = found.where("kept").groupBy(F.col("key.doc_id").alias("doc"), F.col("key.tag").alias("tag")).agg(F.count("*").alias("n_rows"), F.max("n_shingles").alias("n_set"))
    kept = materialise(kept, "kept")
    rows, names = set_aside(docs)
    back = [F.col(n).alias(c) for c, n in names.items()]
    doc = names["doc_id"]
    joined = rows.withColumn("text_tag", F.xxhash64(text_or_empty(names["text"]))).join(if_small(kept), F.col(doc).eqNullSafe(F.col("doc")) & (F.col("text_tag") == F.col("tag")))
    single = joined.where("n_rows = 1 OR n_set = 0").select(*back)
    if kept.where("n_rows > 1 AND n_set > 0").isEmpty():
        return single
    # rows of one id and one text: they are one group, of which one row stays
    return single.unionByName(joined.where("n_rows > 1 AND n_set > 0").dropDuplicates([doc, "text_tag"]).select(*back))


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed_documents(docs)


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, CAPACITY)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the quality of a mix nor a packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table of documents."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        # a working table, so that one that a failure leaves goes with the others
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            release(spark, paths=[before])
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
