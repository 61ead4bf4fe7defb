"""Tables kept for later steps: in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A plan that reports more bytes than this has no real size (for example local rows).
KNOWN_BYTES = 1 << 50
#: The temporary folder of this process, if it needed one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("dir")
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _LOCAL["dir"] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: later steps don't depend on executors that made it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Deletes tables that `keep` wrote, once nothing reads them any more."""
    for df in kept:
        files = df.inputFiles()
        at = {f.rsplit("/", 1)[0] for f in files if "/quarry-" in f}
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in at:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of a DataFrame's input as the optimizer estimates them; 0 where it doesn't know."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < KNOWN_BYTES else 0


def parts_for(df: DataFrame, each: int, least: int = 16) -> int:
    """Partitions of about `each` bytes of input, at least the session's own number."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, own, -(-plan_bytes(df) // each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table has."""
    return df.select(*(F.col(f"`{n}`") for n in names))
