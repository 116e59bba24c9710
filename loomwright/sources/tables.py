"""Parquet datasets: directories, splits, positions of rows, windows of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """All files below a folder of any Hadoop file system, sorted by path; an error if there are none."""
    jvm, out = spark._jvm, []
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root):
        walk = fs.listFiles(root, True)
        while walk.hasNext():
            path = walk.next().getPath().toString()
            if path.endswith(suffix):
                out.append(path)
    if not out:
        raise FileNotFoundError(f"no {suffix} file in {folder}")
    return sorted(out)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def scan_directory(spark: SparkSession, folder: str, columns: Iterable[str], seed: int | None = None, key: str | None = None) -> DataFrame:
    """The named columns, sorted by name, of all Parquet files below a folder; in a seeded order, if asked for.

    Files that lack an optional column give nulls; a column that no file has is a KeyError.
    """
    names = sorted(columns)
    list_files(spark, folder)
    read = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    df = require(read, names).select(*names)
    return df if seed is None else df.orderBy(T.shuffle_key(seed, F.col(key or names[0])))


def split_files(spark: SparkSession, folder: str, split: str) -> list[str]:
    """Files of ``folder/split``; else those whose path below the folder names the split; else all."""
    every = list_files(spark, folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    below = {f: f.split(base, 1)[-1].lstrip("/") for f in every}
    if own := [f for f in every if below[f].startswith(f"{split}/")]:
        return own
    return [f for f in every if split in below[f].lower()] or every


def row_count(df: DataFrame) -> int:
    """From the files' footers, as no column is read."""
    return df.count()


def positioned(df: DataFrame) -> DataFrame:
    """``df`` of Parquet files with file and row: where each row stands."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def numbered(placed: DataFrame) -> DataFrame:
    """``placed`` (file, row) with offset: the row's place in the whole table, files being in the order of their paths.

    The rows of a file are counted, so no task numbers more than the files.
    """
    sizes = placed.groupBy("file").agg(F.count("*").alias("_n"))
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))  # a character that is escaped may sort elsewhere
    before = sizes.select("file", (F.sum("_n").over(Window.orderBy(path)) - F.col("_n")).alias("_before"))  # a row a file
    return placed.join(F.broadcast(before), "file").withColumn("offset", F.col("_before") + F.col("row")).drop("_before")


def samples(df: DataFrame, class_: str, repetition: str, descriptions: list[str]) -> DataFrame:
    """file, row, class, repetition_class in lower case, and whether any of the descriptions has text."""
    require(df, [class_, repetition, *descriptions])
    described = F.lit(False)
    for d in descriptions:
        described = described | F.coalesce(T.has_text(F.col(d)), F.lit(False))
    return positioned(df).select("file", "row", F.col(class_).cast("string").alias("class"), T.lowered(F.col(repetition)).alias("repetition_class"), described.alias("described"))


def lookup(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of the rows at ``keys`` (file, row)."""
    return positioned(df.select(*columns)).join(keys.select("file", "row").distinct(), ["file", "row"])


def window(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows from ``start`` up to ``stop`` in the order of files and rows, with offset.

    Offsets come from the number of rows of each file, so only files in the window are numbered row by row.
    """
    if not 0 <= start <= stop:
        raise ValueError("a window starts at 0 or later and does not end before its start")
    placed = positioned(df)
    sizes = sorted((r["file"], r["n"]) for r in placed.groupBy("file").agg(F.count("*").alias("n")).collect())  # a row a file
    before, at = [], 0
    for file, n in sizes:
        if at < stop and at + n > start:
            before.append((file, at))
        at += n
    if not before:
        return placed.withColumn("offset", F.lit(0).cast("long")).limit(0).drop("file", "row")
    offsets = df.sparkSession.createDataFrame(before, "file string, _before long")
    out = placed.join(F.broadcast(offsets), "file").withColumn("offset", F.col("_before") + F.col("row"))
    return out.where(F.col("offset").between(start, stop - 1)).drop("file", "row", "_before")


def splits_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """All shards of a folder with split: what stands before the first hyphen of a file's name."""
    list_files(spark, folder)
    read = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return read.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^([^-]+)-", 1).alias("split"))


def patched(df: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """``df`` of Parquet files with ``column`` replaced at the positions of ``updates`` (file, row, value).

    The column is appended where there is none. The result is to be written to another folder.
    """
    have = df if column in df.columns else df.withColumn(column, F.lit(None).cast(dict(updates.dtypes)["value"]))
    placed = have.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")) if column in df.columns else positioned(df).withColumn(column, F.lit(None).cast(dict(updates.dtypes)["value"]))
    joined = placed.join(updates.select("file", "row", F.col("value").alias("_value"), F.lit(True).alias("_hit")), ["file", "row"], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in have.columns])


