"""Sessions and tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "quern") -> SparkSession:
    """A session on this machine for tests and the bench; a cluster brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's full path (with its store's scheme) under ``spark.checkpoint.dir``; where that is unset, one of this machine
    is taken in local mode (tests), and a cluster is told to set it. The setting itself cannot be changed in a running session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quern-shared")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _made.append(re.sub("^file:/+", "file:///", full))
    return _made[-1]


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read again: worked out once, whatever is made of it, and found again after an executor is lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcasting if it has no more than so many rows; counted no further."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Folders handed out so far, and names of tables that lie in them.
_made: list[str] = []
_named: list[str] = []


def named(table_name: str) -> None:
    """Keeps in mind that a table lies in a folder that clear_shared() deletes."""
    _named.append(table_name)


def clear_shared(spark: SparkSession) -> None:
    """Deletes all folders that shared_dir() has handed out, and the catalog's tables in them. Call it once results are written elsewhere: frames made before read from them."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    while _made:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
