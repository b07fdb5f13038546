"""The tables that registered queries read, laid out for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import documents as D

LINES_A_PAGE = 20
#: Parts that documents of one split of their files are dealt into before they become lines; a line takes several times its text where it is sorted.
PARTS_A_SPLIT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt by `key` over all cores where its files give under half of them something to do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df


def by_document(docs: DataFrame) -> DataFrame:
    """Documents dealt by id into parts of a bounded size, whatever the size of the table: windows over their lines need no other exchange and sort little at a time."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(cores, PARTS_A_SPLIT * docs.rdd.getNumPartitions()), "doc_id")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.txt_blocks(documents(spark, sf_dir))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents laid out on pages: indents, wide gaps and large first lines by number; a head and a number on each page."""
    docs = by_document(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    listed = docs.select("doc_id", F.coalesce("source", F.lit("nowhere")).alias("source"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("ls")).where(F.size("ls") > 0)
    line = lambda page, i, t, x, y, h: F.struct(page.cast("int").alias("page"), i.cast("int").alias("i"), t.alias("t"), x.alias("x"), y.alias("y"), h.alias("h"))

    def body(t, n):
        i = n % LINES_A_PAGE + 1
        y = 800.0 - 14.0 * i - F.when(i > 10, 20.0).otherwise(0.0)
        return line(n / LINES_A_PAGE, i, F.trim(t), F.when(n % 5 == 0, 90.0).otherwise(72.0), y, F.when(n % 37 == 0, 18.0).otherwise(12.0))

    pages = F.sequence(F.lit(0), F.ceil(F.size("ls") / LINES_A_PAGE).cast("int") - 1)
    name = lambda p: (p + 1).cast("string")
    heads = F.transform(pages, lambda p: line(p, F.lit(0), F.concat(F.lit("From "), F.col("source"), F.lit(", part "), name(p)), F.lit(72.0), F.lit(820.0), F.lit(12.0)))
    feet = F.transform(pages, lambda p: line(p, F.least(F.lit(LINES_A_PAGE), F.size("ls") - p * LINES_A_PAGE) + 1, F.concat(F.lit("– "), name(p), F.lit(" –")), F.lit(72.0), F.lit(20.0), F.lit(12.0)))
    return listed.select("doc_id", F.explode(F.concat(F.transform("ls", body), heads, feet)).alias("l")).select("doc_id", "l.*")
