"""Writers: shards of bounded size, splits with a manifest, logs, statistics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.storage import delete

#: Bytes of a shard, buffered bytes, rows of a staging flush, and of a metadata flush.
SHARD_BYTES, BUFFER_BYTES, STAGING_ROWS, METADATA_ROWS = 134_000_000, 110_000_000, 10_000, 2048


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def prepare(spark: SparkSession, folder: str, overwrite: bool = False) -> str:
    """An empty folder; one with files is an error, unless it may be overwritten."""
    where, fs = _path(spark, folder)
    if fs.exists(where) and len(fs.listStatus(where)):
        if not overwrite:
            raise FileExistsError(folder)
        fs.delete(where, True)
    fs.mkdirs(where)
    return folder


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _path(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def sizes_below(spark: SparkSession, folder: str) -> dict[str, int]:
    where, fs = _path(spark, folder)
    out, walk = {}, fs.listFiles(where, True)
    while walk.hasNext():
        status = walk.next()
        if status.getPath().getName().endswith(".parquet"):
            out[status.getPath().toString()] = status.getLen()
    return out


def row_bytes(image: Column | None, code: Column, dimensions: Column | None) -> Column:
    """What a staging row is estimated to take."""
    size = F.octet_length(F.coalesce(code, F.lit("")))
    size = size + (F.coalesce(F.octet_length(image), F.lit(0)) if image is not None else 0)
    return (size + (4 * F.coalesce(dimensions, F.lit(0)) if dimensions is not None else 0) + 512).cast("long")


def write_shards(df: DataFrame, folder: str, estimate: Column, most: int = SHARD_BYTES, buffer: int = BUFFER_BYTES, rows: int | None = None, overwrite: bool = False) -> DataFrame:
    """Write Parquet (zstd) files of up to ``most`` bytes; what was written, as a DataFrame.

    Rows go to files by their estimated bytes; the files are measured, and while one is too large, all are written
    again in files of half as many rows. One row above the bound is an error.
    """
    spark = df.sparkSession
    total, n, largest = df.agg(F.coalesce(F.sum(estimate), F.lit(0)), F.count("*"), F.coalesce(F.max(estimate), F.lit(1))).first()
    per_file = max(1, min(rows or n or 1, int(buffer // max(1.0, total / max(1, n)))))
    while True:
        prepare(spark, folder, overwrite)
        df.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(folder)
        if all(size <= most for size in sizes_below(spark, folder).values()):
            return spark.read.schema(df.schema).parquet(folder)
        if per_file == 1:
            delete(spark, folder)
            raise ValueError(f"a row takes over {most} bytes")
        per_file, overwrite = max(1, per_file // 2), True


def write_staging(df: DataFrame, folder: str, image: str | None, code: str, embedding: str | None, **options) -> DataFrame:
    estimate = row_bytes(F.col(image) if image else None, F.col(code), F.size(embedding) if embedding else None)
    return write_shards(df, folder, estimate, rows=STAGING_ROWS, **options)


def metadata_table(split: DataFrame, classes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """sample_id with split, class, repetition and descriptions; rows without one of the others have nulls."""
    return split.join(classes, "sample_id", "left").join(descriptions, "sample_id", "left")


def final_table(staging: DataFrame, metadata: DataFrame) -> DataFrame:
    """The master table: the image as input and as reference, ``normal`` as type, metadata by sample."""
    image = F.struct(F.col("rendered_image").alias("bytes"), F.lit(None).cast("string").alias("path"))
    known = staging.join(metadata, "sample_id")
    return known.select(image.alias("input_image"), image.alias("reference_image"), "reference_code", F.lit("normal").alias("type"), "source", *[c for c in metadata.columns if c != "sample_id"])


def write_splits(df: DataFrame, folder: str, split: str = "split", card: str = "", overwrite: bool = False) -> dict:
    """A folder for each split, manifest.json with their rows, and a dataset card."""
    spark = df.sparkSession
    prepare(spark, folder, overwrite)
    df.repartition(split, F.pmod(F.xxhash64(*df.columns), F.lit(64))).write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", STAGING_ROWS).partitionBy(split).parquet(folder)
    counts = {r[0]: r["n"] for r in spark.read.parquet(folder).groupBy(split).agg(F.count("*").alias("n")).collect()}
    told = {"rows": sum(counts.values()), "splits": dict(sorted(counts.items(), key=str)), "columns": [c for c in df.columns if c != split]}
    write_text(spark, f"{folder}/_manifest.json", json.dumps(told, indent=1))
    write_text(spark, f"{folder}/_README.md", card or f"# Dataset\n\n{told['rows']} rows\n")
    return told


def write_cells(df: DataFrame, folder: str, name: str, cells: dict[str, tuple[str, str]], manifest: list[str], overwrite: bool = False) -> DataFrame:
    """A file for each cell, ``folder/<kind>/<name><suffix>`` for every kind: (column, suffix), and manifest.csv.

    Executors write through the Hadoop file system of the folder by way of Spark's text and binary writers, so the
    folder may be in any store; names have to be unique.
    """
    spark = df.sparkSession
    prepare(spark, folder, overwrite)
    for kind, (column, suffix) in cells.items():
        rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"), F.concat(F.col(name), F.lit(suffix)).alias("file"))
        rows.repartition("file").write.mode("append").option("lineSep", "\n").partitionBy("file").text(f"{folder}/{kind}")
    table = df.select(*manifest)
    table.write.mode("append").option("header", True).option("escape", '"').csv(f"{folder}/manifest.csv")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/manifest.csv")


def description_mix(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


def artefact_dir(id_: Column) -> Column:
    """The first 16 characters of the SHA-1 of a sample's id."""
    return F.substring(F.sha1(id_.cast("binary")), 1, 16)


def append_rejects(df: DataFrame, folder: str, id_: str, reason: str) -> None:
    """Rejected rows with their reason and artefact folder, added to a log whose files each have one header."""
    df.select(id_, reason, artefact_dir(F.col(id_)).alias("artefacts")).write.mode("append").option("header", True).csv(folder)


def merge_statistics(spark: SparkSession, path: str, stage: str, values: dict) -> dict:
    """Put a stage's values in a JSON file that keeps those of other stages."""
    told = json.loads(read_text(spark, path) or "{}")
    told[stage] = {**told.get(stage, {}), **values}
    write_text(spark, path, json.dumps(told, indent=1, sort_keys=True))
    return told


def write_json_lines(df: DataFrame, folder: str, text: str = "text", compression: str = "gzip") -> None:
    """Records whose text is neither null nor empty."""
    df.where(F.length(F.coalesce(F.col(text), F.lit(""))) > 0).write.mode("append").option("compression", compression).json(folder)


def write_train_test(df: DataFrame, folder: str, split: str = "split") -> None:
    df.write.mode("errorifexists").option("compression", "gzip").partitionBy(split).parquet(folder)


def duplicate_report(pairs: DataFrame, total_a: int, total_b: int) -> DataFrame:
    """side, duplicates, total, percent of both sides of pairs (id_a, id_b)."""
    side = lambda c, n: pairs.agg(F.count_distinct(c).alias("duplicates")).select(F.lit(c[-1]).alias("side"), "duplicates", F.lit(n).cast("long").alias("total"), (100 * F.col("duplicates") / F.nullif(F.lit(n), F.lit(0))).alias("percent"))
    return side("id_a", total_a).union(side("id_b", total_b))


def write_duplicates(pairs: DataFrame, folder: str) -> None:
    """The pairs, and the distinct indices of each side, as CSV."""
    pairs.write.option("header", True).csv(f"{folder}/pairs")
    for side in ("id_a", "id_b"):
        pairs.select(F.col(side).alias("index")).distinct().write.option("header", True).csv(f"{folder}/{side}")


def write_assignments(df: DataFrame, folder: str, cluster: str = "cluster") -> None:
    """Cluster assignments with their classes' names, as CSV."""
    name = F.when(F.col(cluster) < 0, "noise").otherwise(F.concat(F.lit("class_"), F.col(cluster) + 1))
    df.withColumn("class_name", name).write.option("header", True).csv(folder)
