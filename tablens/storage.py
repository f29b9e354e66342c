"""Shared-folder helpers: where lineage is cut and where derived files go.

Both use the folder named by ``spark.checkpoint.dir``, which on a cluster must be visible
to every executor. A machine-local folder is chosen only for a local master.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set one only when a local session has none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ConfigurationError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        configured = tempfile.mkdtemp(prefix="tablens-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    Used where two jobs must see the same row placement (range-partition boundaries are
    sampled anew by every job), so that a lost executor cannot change the answer.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
