"""Where jobs keep intermediate tables, and small helpers for sessions."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: our own folders, by application, where none is set
_OWN: dict[str, str] = {}
#: by thread, name and path of each table stored in the innermost lean() block; a plain dict, as this module goes to the executors by value
_LEAN: dict[int, list[tuple[str, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="kindred-")
        at = _OWN[app]
    return at.rstrip("/")


def _tables(spark: SparkSession) -> str:
    """Where this application's tables lie; others may share the folder."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a parquet table in the shared folder and read again: cuts the lineage, survives lost executors and gives later joins true sizes."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (lean := _LEAN.get(threading.get_ident())) is not None:
        lean.append((name, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def lean(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """A block that leaves little on disk: shuffle files go as soon as the action that wrote them ends, not when the driver happens to collect its
    garbage; forget() deletes the stored tables that nothing reads any more. more: settings that hold in the block, too. The session's are put back at the end."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **(more or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    me = threading.get_ident()
    outer = _LEAN.get(me)
    _LEAN[me] = []
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        if outer is None:
            del _LEAN[me]
        else:  # what is left is the outer block's to forget
            _LEAN[me] = outer + _LEAN[me]
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def forget(spark: SparkSession, *names: str) -> None:
    """Deletes the tables that were stored under these names in the lean() block at hand; outside of one it deletes nothing."""
    known = _LEAN.get(threading.get_ident(), [])
    for x in [x for x in known if x[0] in names]:
        _delete(spark, x[1])
        known.remove(x)


def drop_stored(spark: SparkSession) -> None:
    """Deletes all tables that stored() wrote in this application. Call it when the results that read them have been written."""
    _delete(spark, _tables(spark))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as the session shuffles to, for work that is dear by the row; tables small in bytes would be put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """df with the running sum of value before each row, within group, in the given order (which must be unique in a group).

    Rows are range-partitioned by group and order, so a group that holds most rows spreads over many tasks; only one total per
    partition and group is exchanged between them (partitions times groups rows, independent of the rows).
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = ranged.withColumn("_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return here.join(offsets, [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_here")).drop("_before", "_here", "_part")
