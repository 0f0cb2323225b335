"""What the operators of this package share: tables, shared folders, keys of rows."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Paths that written() has made and nothing has deleted yet.
_LEFT: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null becomes the empty string."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset (as in tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/ontoloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and any executor can read it again. Deleted by forget(), clean() or when Python ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    _LEFT[path] = df.sparkSession
    out = df.sparkSession.read.parquet(path)
    out._ontoloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of written() that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t._ontoloom_path)
        _LEFT.pop(t._ontoloom_path, None)


def clean() -> None:
    """Deletes all tables of written(); results that have not been stored yet can't be read any more."""
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):  # the session may be over
            _delete(spark, path)
        del _LEFT[path]


atexit.register(clean)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: Column) -> Column:
    """16 bytes that depend on the content of a row alone, so that a task that runs again gives the same. Nulls differ from all values."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\0", *parts)))


def fresh(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores where a column has it already (in any case, as Spark's names don't differ by case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
