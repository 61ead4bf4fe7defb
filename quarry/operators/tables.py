"""How tables are kept and dealt out, whatever they hold."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Bytes of a table, as its plan estimates them, that go to one part of a shuffle.
PART = 16 << 20


def kept(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder the cluster shares; a temporary one serves only where all runs in one process, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def parts(table: DataFrame) -> int:
    """Parts of a shuffle of a table: the session's number, or more where a part would hold over PART bytes, so a task's memory doesn't grow with the table."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PART + 1, 10_000))
