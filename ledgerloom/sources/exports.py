"""Reading and listing ERP exports, combining their periods, writing results.

An export is landed as CSV or Parquet, either as one file or as a folder of ``part-`` files.  Its name is the path of that
file or folder below the folder that is read, so exports of one name in different folders stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from urllib.parse import unquote as url_unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.names import period_from_filename
from ledgerloom.operators.cleaning import clean_inventory, clean_sales
from ledgerloom.schema import DAMAGED, PERIOD, ROW_NO, SOURCE_FILE, empty_table, standardize, text_schema
from ledgerloom.storage import broadcast_if_small

# Bits of a row number: number of the file in its export | place in the file.
_FILE_BITS = 22
_PLACE_BITS = 40
_LISTED = "path string, name string, export_path string, modified timestamp, length bigint, file_no bigint"


def _unescaped(c: Column) -> Column:
    """Undo percent escapes; a plus sign is a plus sign."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _below(plain: Column, roots: Sequence[str]) -> Column:
    """A decoded path without scheme, below the first root that holds it; a root that is a file leaves its name."""
    found = []
    for root in roots:
        fixed = re.sub(_SCHEME, "", root).rstrip("/")
        glob = re.search(r"[*?\[{]", fixed)
        if glob:
            fixed = fixed[: fixed.rindex("/", 0, glob.start())]
        found.append(F.when(plain.startswith(fixed + "/"), F.substr(plain, F.lit(len(fixed) + 2))))
    return F.coalesce(*found, F.element_at(F.split(plain, "/"), -1))


def list_exports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every file below the paths with its export: path, name, export_path, modified, length, file_no.

    ``name`` and ``export_path`` are those of the export; ``file_no`` is the place of the file in it: the part files of one
    write stay together, earlier writes first (a folder may be appended to), then by part number, piece and name.
    Contents are not read; hidden files are left out; a missing folder has no files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LISTED)
    # The path as a scan of the same files will give it, and decoded.  One step a column: each is used several times.
    files = listed.select(
        F.col("_metadata.file_path").alias("path"), _unescaped(F.col("_metadata.file_path")).alias("_plain"),
        F.col("modificationTime").alias("modified"), "length",
    )
    files = files.withColumn("_flat", F.regexp_replace("_plain", _SCHEME, ""))
    files = files.withColumns({
        "_file": F.element_at(F.split("_flat", "/"), -1), "_folder": F.regexp_replace("_plain", r"/[^/]*$", ""),
        "_below": _below(F.col("_flat"), paths),
    })
    # A part file's export is its folder: below the root, or the root itself.
    inner = F.when(F.contains(F.col("_below"), F.lit("/")), F.regexp_replace("_below", r"/[^/]*$", ""))
    files = files.withColumn("_holder", F.coalesce(inner, F.element_at(F.split("_folder", "/"), -1)))
    # How a table partitioned by export writes its folders; the value in it is escaped once more.
    by_export = f"^(.*/)?{SOURCE_FILE}=([^/]*)$"
    valued = _unescaped(F.regexp_replace("_holder", by_export, "$1$2"))
    is_part = F.col("_file").startswith("part-")
    named = files.withColumn("_holder", F.when(F.col("_holder").rlike(by_export), valued).otherwise(F.col("_holder"))).withColumns({
        "name": F.when(is_part, F.col("_holder")).otherwise(F.col("_below")),
        "export_path": F.when(is_part, F.col("_folder")).otherwise(F.col("_plain")),
    })
    number = F.coalesce(F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("bigint"), F.lit(0))
    piece = F.coalesce(F.regexp_extract("_file", r"^part-.*[.-]c(\d+)", 1).try_cast("bigint"), F.lit(0))
    write = F.regexp_extract("_file", r"^part-\d+-?(.*?)(?:[.-]c\d+.*)?$", 1)
    begun = F.min("modified").over(W.partitionBy("name", "_write"))
    order = W.partitionBy("name").orderBy("_begun", "_write", "_number", "_piece", "_file")
    return (
        named.withColumns({"_write": write, "_number": number, "_piece": piece}).withColumn("_begun", begun)
        .withColumn("file_no", F.row_number().over(order).cast("bigint") - 1)
        .select("path", "name", "export_path", "modified", "length", "file_no")
    )


def _checked(c: Column, bits: int) -> Column:
    too_big = F.raise_error(F.lit(f"row position needs more than {bits} bits")).cast("bigint")
    return F.when(c < F.lit(1 << bits), c).otherwise(too_big)


def stamp_position(spark: SparkSession, df: DataFrame, fmt: str, files: DataFrame | None = None) -> DataFrame:
    """Add ``source_file`` and ``row_no``: the row's place is taken inside the scan, without any shuffle.

    Row numbers increase with the row's place in its export but are not consecutive for CSV: they are put together from
    the file's number in ``files`` (see :func:`list_exports`) and the place in the file.  Parquet knows its row index.  In
    CSV the place is the byte at which the task's block begins plus the number of the row in the task: a row takes a
    byte or more, and Spark puts nothing before a block that is not its file's last.  A number that does not fit its
    bits is an error.  Without ``files`` the folders of the rows' files are listed.
    """
    if files is None:
        files = list_exports(spark, sorted({url_unquote(f).rsplit("/", 1)[0] for f in df.inputFiles()}))
    if fmt == "parquet":
        inside = F.col("_metadata.row_index")
    else:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        inside = F.col("_metadata.file_block_start") + row
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), _checked(inside, _PLACE_BITS).alias("_place"))
    known = files.select(F.col("path").alias("_path"), F.col("name").alias(SOURCE_FILE), _checked(F.col("file_no"), _FILE_BITS).alias("_file_no"))
    row_no = F.shiftleft("_file_no", _PLACE_BITS) + F.col("_place")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return placed.join(broadcast_if_small(known), "_path").select(*kept, SOURCE_FILE, row_no.alias(ROW_NO))


def csv_options(damaged: str = "fail", multi_line: bool = False) -> dict[str, object]:
    """Reader options for landed CSV.

    A damaged row has another number of cells than the header; a cell with a line break makes two of them unless
    ``multi_line`` reads quoted breaks (such files are not split).  ``damaged`` is ``fail`` (the read stops with the row)
    or ``keep`` (the row stays, its text in column ``damaged_text``).  All columns are parsed, whatever a query needs, or
    a damaged row would go unnoticed.
    """
    if damaged not in ("fail", "keep"):
        raise ValueError("damaged is 'fail' or 'keep'")
    return {
        "header": True, "enforceSchema": False, "multiLine": multi_line, "columnPruning": False,
        "mode": "FAILFAST" if damaged == "fail" else "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED,
    }


def read_landed(
    spark: SparkSession, paths: str | Sequence[str], kind: str, fmt: str = "csv", periods: Sequence[str] | str | None = None,
    damaged: str = "fail", multi_line: bool = False,
) -> DataFrame:
    """All-text rows of one or more exports with the same columns, with their position.

    Column names come from the header; an export whose header differs fails instead of being read by position (combine
    such exports with :func:`union_periods`).  With ``periods`` (a list, or ``latest``) only the files of exports whose
    name gives such a period are opened; a period that no export has is an error.
    """
    files = list_exports(spark, paths)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if periods is not None:
        paths = _chosen_paths(files, periods)
    return read_exports(spark, files, paths, kind, fmt, damaged, multi_line)


def reader_path(path: str) -> str:
    """A listed path as a reader takes it: characters of glob patterns stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_exports(
    spark: SparkSession, files: DataFrame, paths: Sequence[str], kind: str, fmt: str = "csv", damaged: str = "fail",
    multi_line: bool = False,
) -> DataFrame:
    """As :func:`read_landed`, for some of the listed exports."""
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt == "csv":
        options = csv_options(damaged, multi_line)
        header = reader.options(header=True, multiLine=multi_line).csv(paths).columns
        schema = text_schema(header)
        reader = reader.options(**options).schema(schema.add(DAMAGED, "string") if damaged == "keep" else schema)
    return standardize(stamp_position(spark, reader.format(fmt).load(paths), fmt, files), kind)


def _chosen_paths(files: DataFrame, periods: Sequence[str] | str) -> list[str]:
    """Paths of the exports of these periods, escaped for a reader; one per export, as the reader lists them anyway."""
    exports = files.groupBy("name", "export_path").agg(period_from_filename(F.col("name")).alias(PERIOD))
    if periods == "latest":
        chosen = exports.filter(F.col(PERIOD) == exports.agg(F.max(PERIOD)).scalar()).collect()
        missing = [] if chosen else ["latest"]
    else:
        periods = [periods] if isinstance(periods, str) else list(periods)
        chosen = exports.filter(F.col(PERIOD).isin(periods)).collect()
        missing = sorted(set(periods) - {r[PERIOD] for r in chosen})
    if missing or not chosen:
        raise ValueError(f"no export for period {', '.join(missing) or '(none given)'}")
    return sorted(reader_path(r["export_path"]) for r in chosen)


def read_sales(
    spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", periods: Sequence[str] | str | None = None,
    damaged: str = "fail", multi_line: bool = False,
) -> DataFrame:
    """A1: typed sales rows with file, row order and period; options as in :func:`read_landed`."""
    return clean_sales(read_landed(spark, paths, "sales", fmt, periods, damaged, multi_line))


def read_inventory(
    spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", truncate_all: bool = False,
    damaged: str = "fail", multi_line: bool = False,
) -> DataFrame:
    """A2: typed rows of a stock snapshot; an empty table when it cannot be found."""
    try:
        landed = read_landed(spark, paths, "inventory", fmt, None, damaged, multi_line)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty_table(spark, "inventory")
        raise
    return clean_inventory(landed, truncate_all)


def file_catalog(
    spark: SparkSession, folder: str, suffix: str | tuple[str, ...] = (".xlsx", ".csv", ".parquet"), order: str = "newest"
) -> DataFrame:
    """A3: exports below a folder: name, path, modified (of the newest file), files, bytes; a missing folder is empty.

    Folder exports count as one.  ``suffix`` is of the export's name, '' for all; ``order`` is ``newest`` (first), ``name`` or
    ``none``.  File contents are not read.
    """
    suffixes = (suffix,) if isinstance(suffix, str) else suffix
    wanted = F.lit(False)
    for one in suffixes:
        wanted = wanted | F.col("name").endswith(one)
    exports = (
        list_exports(spark, folder).filter(wanted).groupBy("name", F.col("export_path").alias("path"))
        .agg(F.max("modified").alias("modified"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )
    if order == "newest":
        return exports.orderBy(F.desc("modified"), "name")
    return exports.orderBy("name") if order == "name" else exports


def overlay_catalog(active: DataFrame, history: DataFrame) -> DataFrame:
    """A4: active exports, then those of the history whose name is not active."""
    older = history.join(active.select("name"), "name", "left_anti")
    both = active.withColumn("_rank", F.lit(0)).unionByName(older.withColumn("_rank", F.lit(1)))
    return both.orderBy("_rank", F.desc("modified"), "name").drop("_rank")


def union_periods(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of several exports, each tagged with its period; missing columns are null."""
    merged: DataFrame | None = None
    for table in tables:
        if PERIOD not in table.columns:
            table = table.withColumn(PERIOD, period_from_filename(F.col(SOURCE_FILE)))
        merged = table if merged is None else merged.unionByName(table, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no tables to combine")
    return merged


def select_periods(df: DataFrame, mode: str = "latest", periods: Sequence[str] = ()) -> DataFrame:
    """``latest`` period, ``one`` or ``many`` chosen periods.

    Over a table partitioned by period only the chosen partitions are read.
    """
    if mode == "latest":
        return df.filter(F.col(PERIOD) == df.agg(F.max(PERIOD)).scalar())
    if mode == "one" and len(periods) != 1:
        raise ValueError("mode 'one' takes exactly one period")
    return df.filter(F.col(PERIOD).isin(list(periods)))


def latest_export(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rows of the export with the newest modification time; an empty catalogue is an error."""
    none = F.raise_error(F.lit("no export in the catalogue")).cast("string")
    newest = catalog.agg(F.coalesce(F.max_by("name", F.struct("modified", "name")), none))
    return df.filter(F.col(SOURCE_FILE) == newest.scalar())


def write_csv(df: DataFrame, path: str) -> None:
    """A10: header, UTF-8, no index; a folder of files in the order of ``df``."""
    df.write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, in file order where the rows have a position."""
    position = [c for c in (SOURCE_FILE, ROW_NO) if c in df.columns]
    return df.orderBy(*position).limit(n) if position else df.limit(n)


def describe_columns(df: DataFrame) -> DataFrame:
    """Names and types of the columns, and the number of rows beside each."""
    columns = df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, type string"
    )
    return columns.withColumn("rows", df.agg(F.count(F.lit(1))).scalar()).orderBy("position")
