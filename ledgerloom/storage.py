"""Shared working folder: where intermediate tables are written.

Cutting a plan in two (for example between a range shuffle and the row numbers taken
from it) needs a copy that every executor can read and that outlives any of them, so
tables are written below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table, in rows and in bytes, that this library marks for broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Rows that a task sorts or keeps in memory at most, where the number of tasks follows the table.
TASK_ROWS = 1_500_000
# The same for rows of landed text, which are about three times as wide.
TEXT_TASK_ROWS = 500_000
# Rows below which a table is not dealt to more tasks.
LEAST_TASK_ROWS = 50_000

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _LOCAL[context.applicationId]


def session_folder(spark: SparkSession) -> str:
    """Folder of this application inside the shared one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    path = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after counting that it has at most ``limit`` rows of at most BROADCAST_BYTES.

    The count stops at ``limit + 1``.  Beyond either bound the frame comes back unmarked and the join is planned as a
    shuffle join.  The count runs the frame's plan: give it written tables, or cheap ones.
    """
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    fixed = F.lit(16 * len(df.columns))
    size = sum(text, fixed)
    seen = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= limit and (seen["b"] or 0) <= BROADCAST_BYTES else df


def tasks_for(spark: SparkSession, rows: int, most: int | None = None) -> int:
    """Number of tasks for a shuffle of ``rows`` rows that are sorted afterwards.

    The session's number of shuffle partitions, fewer for small tables, and more where a task would get more than ``most``
    rows (TASK_ROWS): a fixed number lets the sorts outgrow a task's memory and spill.
    """
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // (most or TASK_ROWS)), min(asked, -(-rows // LEAST_TASK_ROWS)), 1)


def hashed_lookup(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df``, one row per key, as the built side of a shuffled hash join, so that the large side is not sorted.

    Up to ``limit`` rows Spark's own broadcast limit decides; where a task would keep more than TASK_ROWS rows, the join is
    left to sort and merge.  The count runs the frame's plan: give it written tables.
    """
    spark, rows = df.sparkSession, df.count()
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if limit < rows <= TASK_ROWS * asked else df
