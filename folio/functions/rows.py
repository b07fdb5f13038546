"""Rows of two tables one after another, and rows on their way to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Rows and bytes that go to a Python worker at a time; Spark's own 10,000 rows may be any number of bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, of which a Python worker holds little at a time, however long its texts are: Arrow batches of the session are bounded."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return df


def stacked(one: DataFrame, other: DataFrame) -> DataFrame:
    """unionByName, not taken for partitioned by a key whose rows lie apart in it.

    Spark 4.1 can infer a partitioning of a union from its sides and then leave out an
    exchange that is needed; the setting that does so is switched off in the session.
    """
    one.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return one.unionByName(other)
