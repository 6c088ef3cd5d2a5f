"""Cutting lineage with tables in the cluster's shared folder.

A result that several later stages read is written once as Parquet and read
back.  Unlike a local checkpoint such a table survives the loss of executors,
and unlike ``checkpoint()`` it is compressed and columnar.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an unset one is an error, since executors may be on other machines."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        # one machine, as in tests: its own folder is shared
        return f"file://{tempfile.gettempdir()}/revisio-shared"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with a cut lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._revisio_path = path  # noqa: SLF001
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` made and nothing reads any more."""
    for t in tables:
        path = getattr(t, "_revisio_path", None)
        if path:
            _delete(path)


def clean() -> None:
    """Deletes all written tables: for a long-lived driver, once a query's result is saved."""
    for path in list(_written):
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        pass


atexit.register(clean)
