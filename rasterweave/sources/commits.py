"""Writes of several tables that become visible together.

Each write has a folder of its own. It counts once a file with its name is in the
``_committed`` folder, which one rename puts there; readers take the folders named by
such files, so a write that was killed leaves nothing to see. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_committed"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the writes below ``path`` that are complete, in order."""
    fs, at = _file_system(spark, path)
    folder = at(f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("."))


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Make the write ``name`` visible."""
    fs, at = _file_system(spark, path)
    draft, final = at(f"{path}/{MANIFESTS}/.{name}"), at(f"{path}/{MANIFESTS}/{name}")
    fs.create(draft, True).close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"{name} could not be committed")


def drop_uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of writes that were not completed; their names."""
    fs, at = _file_system(spark, path)
    done = set(committed(spark, path))
    if not fs.exists(at(path)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory()]
    left = sorted(n for n in found if n not in done and n != MANIFESTS)
    for name in left:
        fs.delete(at(f"{path}/{name}"), True)
    return left


def read_committed(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """A table of all complete writes; None if there is none."""
    folders = [f"{path}/{name}/{table}" for name in committed(spark, path)]
    return spark.read.option("mergeSchema", False).parquet(*folders) if folders else None
