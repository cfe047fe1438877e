"""Small DataFrame helpers that every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, reduced to the named columns so that the scan reads nothing else."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def keep_columns(df: DataFrame, keep: Iterable[str], made: Iterable[str]) -> list:
    """Columns of df to carry along; one whose name an operator also makes is renamed to name_in (name_in_in, ...)."""
    taken = {c.lower() for c in made}
    out = []
    for c in keep:
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(df[f"`{c}`"].alias(name))
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in spark.checkpoint.dir.

    The setting is read from the session. Where it is unset, a temporary folder serves a local master (tests, notebooks), and a
    cluster, whose executors wouldn't share it, is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "roadloom-checkpoints"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage by checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables under shared_folder()."""
    if not path.startswith(shared_folder(spark)):
        raise ValueError(f"not under the shared folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder under shared_folder() when the application ends: frames that aren't stored may read it until then."""
    if not path.startswith(shared_folder(spark)):
        raise ValueError(f"not under the shared folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p):  # False if it isn't there
        raise ValueError(f"no such folder: {path}")


def shared_rows(where: str, *columns: str) -> pa.Table | None:
    """The parquet rows of a folder under shared_folder(), read within a task; None if there is no such folder."""
    local = re.match("file:|/", where)
    system, path = (fs.LocalFileSystem(), re.sub("^file:/*", "/", where)) if local else fs.FileSystem.from_uri(where)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return None
    return pq.read_table(path, filesystem=system, partitioning=None, columns=list(columns))


#: Rows of a table that may be sent to all executors or brought to the driver: one per city, metric or the like, some 10 MB.
MOST_GROUPS = 100_000


def small(df: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """df for a broadcast join. The job fails, rather than sending more or losing rows, if df has more than `most` rows.

    The rows of a local table (made by local()) are counted at once; of any other they are counted as they are gathered.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() == "LocalRelation":
        if plan.data().size() > most:
            raise ValueError(f"more than {most} groups: too many to send to all executors")
        return F.broadcast(df)
    numbered = df.coalesce(1).withColumn("__row", F.monotonically_increasing_id())  # no shuffle: a broadcast gathers the rows anyway
    held = numbered.filter(F.when(F.col("__row") < most, True).otherwise(F.raise_error(F.lit(f"more than {most} groups: too many to send to all executors")).cast("boolean")))
    return F.broadcast(held.drop("__row"))


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds, known to the optimizer as such: reading it needs no job."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]))


def few(df: DataFrame, most: int = MOST_GROUPS) -> list[Row]:
    """The rows of a table of one row per group. ValueError beyond `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups: too many for the driver")
    return rows


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """df over at least the cluster's cores (or at_least) partitions: small files would otherwise leave Python work on one core.

    A frame that already has enough partitions isn't shuffled.
    """
    want = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def located(x: str = "x", y: str = "y"):
    """Both coordinates there and not NaN."""
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
