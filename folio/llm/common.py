"""Shared pieces of the corpus operators: working tables, bounded broadcasts, text keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java character class body.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast up to this many narrow rows (ids, keys and counts).
BROADCAST_ROWS = 250_000
#: Where rows also hold text, with at most this many bytes of it.
BROADCAST_BYTES = 64 << 20

#: Spark 4.1 may take a union for partitioned by a key whose rows lie apart in it, and leave out an exchange.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"
ROWS_A_BATCH, BYTES_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

_SCRATCH: dict[str, list[str]] = {}
_OWN_FOLDER: dict[str, str] = {}
_SETTINGS: dict[tuple[str, str], str | None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set by hand.

    Where a session on one machine has neither (tests, notebooks) a temporary folder is
    made once and set as the checkpoint folder; on a cluster that is an error, as
    executors could not read each other's files there.
    """
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    app = sc.applicationId
    if app not in _OWN_FOLDER and (named := sc.getCheckpointDir()):
        return named.rstrip("/")
    if app not in _OWN_FOLDER:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="folio-")
        sc.setCheckpointDir(_OWN_FOLDER[app])
    return _OWN_FOLDER[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no one has used: gone with release(), or else with the application."""
    lower(spark, UNION_PARTITIONING, "false")
    path = f"{shared_folder(spark)}/folio-{tag}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def working_tables(spark: SparkSession) -> list[str]:
    """The paths of the working tables that there are now."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, docs: DataFrame | None = None, paths: list[str] | None = None) -> None:
    """Delete the working tables made so far, but for those that `docs` is itself read from,
    and give the session back the settings that bound_batches() lowered.

    For callers that have already written out what the earlier operators returned.  With
    `paths`, some of working_tables(), only these go, and the settings stay: tables of
    other operators may still be in use.
    """
    app = spark.sparkContext.applicationId
    for of, key in [k for k in _SETTINGS if k[0] == app and paths is None]:
        if (was := _SETTINGS.pop((of, key))) is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)
    made = _SCRATCH.get(app, [])
    gone = [p for p in (made if paths is None else paths) if p in made]
    if gone and docs is not None:
        read = docs.inputFiles()
        gone = [p for p in gone if not any(p.rpartition("/")[2] in f for f in read)]
    for p in gone:
        delete_path(spark, p)
        made.remove(p)


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder, in one folder for each value of `by`, and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the working table that materialise() returned as `df`; nothing may read it any more."""
    path = df.inputFiles()[0].rpartition("/")[0] if not df.isEmpty() else None
    for own in [p for p in _SCRATCH.get(df.sparkSession.sparkContext.applicationId, []) if path and p.rpartition("/")[2] == path.rpartition("/")[2]]:
        delete_path(df.sparkSession, own)
        _SCRATCH[df.sparkSession.sparkContext.applicationId].remove(own)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, text: str | None = None) -> DataFrame:
    """`df` (already materialised) with a broadcast hint if it has at most `rows` rows.

    With `text`, a column of strings or bytes of any length, also only up to BROADCAST_BYTES
    of it; above that the hint asks for a shuffle, as Spark itself goes by compressed files.

    Beyond that the join shuffles both sides and adaptive execution splits skewed keys.
    """
    if text is None:
        return F.broadcast(df) if df.count() <= rows else df
    count, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    if size > BROADCAST_BYTES:
        return df.hint("merge")
    return F.broadcast(df) if count <= rows else df


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(named(column), F.lit(""))


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of texts that one Arrow batch carries to Python.

    Spark reads these settings when a plan runs, which may be after an operator has
    returned it, so they stay lowered in the session until release().
    """
    for key, most in ((ROWS_A_BATCH, BATCH_ROWS), (BYTES_A_BATCH, BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            lower(spark, key, str(most))


def lower(spark: SparkSession, key: str, value: str) -> None:
    """Set a setting and remember what it was, for release()."""
    now = spark.conf.get(key, None)
    if now != value:
        _SETTINGS.setdefault((spark.sparkContext.applicationId, key), now)
        spark.conf.set(key, value)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns c0, c1, ... that clash with no working column, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def read_table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    """A table, `dealt` over all cores by its first column where its files give under half of them something to do."""
    df, cores = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if dealt and 2 * df.rdd.getNumPartitions() <= cores else df
