"""Incremental landing: new export files become part of the typed sales table.

:func:`land_incremental` streams files that appear; a stream never looks at a file again.  :func:`land_uploads` also takes
uploads that are saved again under their name: it compares the exports with a ledger of what was landed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.cleaning import clean_inventory, clean_sales
from ledgerloom.schema import DAMAGED, PERIOD, SOURCE_FILE, headings, standardize, text_schema
from ledgerloom.sources.exports import csv_options, list_exports, read_exports, reader_path, stamp_position
from ledgerloom.storage import broadcast_if_small


def land_incremental(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    header: Sequence[str] | None = None,
    kind: str = "sales",
    max_files: int | None = None,
    damaged: str = "fail",
    multi_line: bool = False,
) -> StreamingQuery:
    """Process every export file not seen before, then stop.

    ``header`` is the column line of the files; by default all headings of the export.  Damaged rows stop the stream, or
    stay with their text in ``damaged_text`` (``damaged="keep"``), see :func:`ledgerloom.sources.exports.csv_options`.

    The stream's checkpoint remembers which files are done.  Each batch cleans its rows
    and writes them under ``period=.../batch=...``, replacing only those folders, so a
    batch that is repeated after a failure does not land twice.
    """
    schema = text_schema(headings(kind) if header is None else header)
    reader = (
        spark.readStream.schema(schema.add(DAMAGED, "string") if damaged == "keep" else schema)
        .options(**csv_options(damaged, multi_line)).option("recursiveFileLookup", True)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.csv(source).select("*", "_metadata")
    clean = clean_sales if kind == "sales" else clean_inventory

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stamped = stamp_position(session, batch, "csv", list_exports(session, source)).drop("_metadata")
        typed = clean(standardize(stamped, kind)).withColumn("batch", F.lit(batch_id))
        folders = [c for c in (PERIOD, "batch") if c in typed.columns]
        (
            typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*folders).parquet(target)
        )

    return (
        rows.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_and_wait(*args, **kwargs) -> None:
    """Run :func:`land_incremental` to its end; errors of the stream are raised here."""
    land_incremental(*args, **kwargs).awaitTermination()


_LEDGER = "name string, version bigint, modified timestamp, rows_from string, batch bigint"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last landed version of every export."""
    try:
        landed = spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)
    return landed.groupBy("name").agg(F.max_by(F.struct("version", "modified", "rows_from", "batch"), "batch").alias("_l")).select("name", "_l.*")


def land_uploads(
    spark: SparkSession, source: str, target: str, ledger: str, kind: str = "sales", fmt: str = "csv",
    damaged: str = "fail", multi_line: bool = False,
) -> int:
    """Land every export that is new, or whose files changed since it was landed; returns how many.

    An export's version is a checksum of its files' paths, times and sizes.  Its rows are written below
    ``period=.../upload=...``, replacing that folder alone, so the newest version takes the place of the older one in the
    same write.  The ledger is written last: when a run dies before, the next one lands the same exports again, into the same
    folders.  Read the result by :func:`read_uploads`, which shows landed versions only.
    """
    files = list_exports(spark, source)
    checksum = F.bit_xor(F.xxhash64("path", "modified", "length")).alias("version")
    versions = files.groupBy("name", "export_path").agg(checksum, F.max("modified").alias("modified"))
    known = _ledger(spark, ledger)
    batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
    changed = versions.join(known.select("name", "version"), ["name", "version"], "left_anti").collect()
    if not changed:
        return 0
    landed = spark.createDataFrame(
        [(r["name"], r["version"], r["modified"], reader_path(r["export_path"]), batch) for r in changed], _LEDGER
    )
    rows = read_exports(spark, files, [reader_path(r["export_path"]) for r in changed], kind, fmt, damaged, multi_line)
    clean = clean_sales if kind == "sales" else clean_inventory
    version = landed.select(F.col("name").alias(SOURCE_FILE), "version")
    typed = (
        clean(rows).join(broadcast_if_small(version), SOURCE_FILE)
        .withColumn("upload", F.sha1(F.col(SOURCE_FILE).cast("binary")))
    )
    folders = [c for c in (PERIOD, "upload") if c in typed.columns]
    typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(target)
    landed.coalesce(1).write.mode("append").parquet(ledger)
    return len(changed)


def read_uploads(spark: SparkSession, target: str, ledger: str) -> DataFrame:
    """The rows of the landed version of every export: not those of a run that died, nor of an upload that is now empty."""
    landed = _ledger(spark, ledger).select(F.col("name").alias(SOURCE_FILE), "version")
    rows = spark.read.parquet(target)
    if PERIOD in rows.columns:
        rows = rows.withColumn(PERIOD, F.col(PERIOD).cast("string"))
    return rows.join(broadcast_if_small(landed), [SOURCE_FILE, "version"], "left_semi").drop("version", "upload")
