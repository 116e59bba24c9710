"""Manifests, JSON, XML, text files and archives."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.sources.tables import require


def manifest(spark: SparkSession, path: str, required: Iterable[str] = (), limit: int | None = None, separator: str = ",", non_empty: bool = True) -> DataFrame:
    """A CSV table with a header, a byte order mark or not; its required columns, and some rows, have to be there."""
    read = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    plain = read.toDF(*[c.removeprefix("﻿").strip() for c in read.columns])
    df = require(plain, required)
    df = df if limit is None else df.limit(limit)
    if non_empty and df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def portable(path: Column) -> Column:
    """Forward slashes, and no ./ at the start."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """path, name, stem, text of whole text files."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    path = F.col("path")
    return read.select("path", file_name(path).alias("name"), stem(path).alias("stem"), F.decode("content", "UTF-8").alias("text"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Stripped texts of a folder's .txt files that are not empty, by path."""
    found = texts(spark, folder).withColumn("text", T.strip_space(F.col("text"))).where("text <> ''")
    return found.orderBy("path")


def dereferenced(rows: DataFrame, column: str, files: DataFrame, into: str) -> DataFrame:
    """``rows`` with the text of the file that ``column`` names; rows whose file is missing are left out."""
    return rows.join(files.select(F.col("name").alias("_name"), F.col("text").alias(into)), file_name(F.col(column)) == F.col("_name")).drop("_name")


def referenced_rows(spark: SparkSession, path: str, required: list[str], files: DataFrame, column: str, into: str) -> DataFrame:
    """A manifest's rows that have all required values, with the texts that they refer to."""
    return dereferenced(manifest(spark, path, required).dropna(subset=required), column, files, into)


def resolved_manifest(spark: SparkSession, path: str, base: str, images: str, codes: str, description: str) -> DataFrame:
    """image_path and code_path below ``base``, and the description, null where blank."""
    rows = manifest(spark, path, [images, codes])
    place = lambda c, folder: F.concat(F.lit(f"{base.rstrip('/')}/{folder}/"), file_name(F.col(c)))
    text = F.nullif(F.trim(F.col(description)), F.lit("")) if description in rows.columns else F.lit(None).cast("string")
    return rows.select(place(images, "images").alias("image_path"), place(codes, "codes").alias("code_path"), text.alias("description"))


def prompt_table(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """uri, caption, svg of a table of prompts and drawings: the prompt without its prefix, up to the first full stop."""
    read = spark.read.option("sep", "\t").option("quote", "").schema("prompt string, svg string").csv(path)
    line = F.col("_metadata.file_block_start") + F.monotonically_increasing_id() + 1
    prompt = F.when(F.startswith("prompt", F.lit(prefix)), F.substring(F.col("prompt"), F.lit(len(prefix) + 1), F.length("prompt"))).otherwise(F.col("prompt"))
    return read.select(F.concat(F.col("_metadata.file_path"), F.lit("#L"), line).alias("uri"), F.trim(F.substring_index(prompt, ".", 1)).alias("caption"), "svg")


def json_lines(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped. Folders are read with all that is below them."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """text and the fields of meta, of extraction records."""
    meta = "timestamp string, yymm string, arxiv_id string, url string, source string"
    return json_lines(spark, path, f"text string, meta struct<{meta.replace(' string', ':string')}>").select("text", "meta.*")


def json_array(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """Records of JSON arrays, whose date counts milliseconds."""
    return spark.read.option("multiLine", True).json(path).withColumn(date, F.timestamp_millis(F.col(date).cast("long")))


def xml_rows(spark: SparkSession, path: str, schema: str, tag: str = "row") -> DataFrame:
    """Attributes of every ``<row .../>``; ``schema`` names them without a prefix."""
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").schema(schema).load(path)


def question_answers(posts: DataFrame, least_score: int = 1) -> DataFrame:
    """question, title, answer, score, body: accepted answers and those of ``least_score``.

    ``posts``: Id, PostTypeId, ParentId, AcceptedAnswerId, AnswerCount, Score, Title, Body. A question counts only
    if as many answers are there as it declares, and gives a row for each answer that is kept.
    """
    asked = posts.where("PostTypeId = 1").select(F.col("Id").alias("question"), F.col("Title").alias("title"), "AcceptedAnswerId", "AnswerCount")
    said = posts.where("PostTypeId = 2").select(F.col("ParentId").alias("question"), F.col("Id").alias("answer"), F.col("Score").alias("score"), F.col("Body").alias("body"))
    parsed = said.groupBy("question").agg(F.count("*").alias("parsed"))
    whole = asked.join(parsed, "question").where("parsed = AnswerCount")
    return said.join(whole, "question").where((F.col("score") >= least_score) | (F.col("answer") == F.col("AcceptedAnswerId"))).select("question", "title", "answer", "score", "body")


def paired_texts(spark: SparkSession, folder: str, code: str = "*.tex", caption: str = "*.yml") -> DataFrame:
    """path, code and caption of files that share a folder and a stem."""
    place = lambda df: df.withColumn("dir", F.regexp_replace("path", r"/[^/]*$", ""))
    codes, captions = place(texts(spark, folder, code)), place(texts(spark, folder, caption))
    return codes.select("dir", "stem", "path", F.col("text").alias("code")).join(captions.select("dir", "stem", F.col("text").alias("caption")), ["dir", "stem"], "left").select("path", "code", "caption")


def named_texts(spark: SparkSession, folder: str, pattern: str = "*.tex") -> DataFrame:
    """path, code, and a caption made of the file's name: hyphens, underscores and + part its words."""
    found = texts(spark, folder, pattern)
    return found.select("path", F.col("text").alias("code"), F.trim(F.regexp_replace("stem", r"[-_+]+", " ")).alias("caption"))


def file_pairs(spark: SparkSession, folder: str, records: DataFrame | None = None, mark: str = "_input") -> DataFrame:
    """stem, input, target, method of files that differ by ``mark`` in their stems; methods come from ``records`` (stem, method)."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").withColumn("stem", stem(F.col("path")))
    inputs = paths.where(F.endswith("stem", F.lit(mark))).select(F.substring(F.col("stem"), F.lit(1), F.length("stem") - len(mark)).alias("stem"), F.col("path").alias("input"))
    pairs = inputs.join(paths.where(~F.endswith("stem", F.lit(mark))).select("stem", F.col("path").alias("target")), "stem")
    if records is None:
        return pairs.withColumn("method", F.lit("unknown"))
    return pairs.join(records.select("stem", "method"), "stem", "left").withColumn("method", F.coalesce("method", F.lit("unknown")))


def catalogue(listing: DataFrame, cutoff: str, excluded: DataFrame, processed: DataFrame) -> DataFrame:
    """Source archives (name, stamp, ...) of the cutoff or later that are neither excluded nor done, the newest first."""
    fresh = listing.where(F.contains("name", F.lit("_src_")) & (F.col("stamp") >= F.lit(cutoff)))
    known = excluded.select("name").union(processed.select("name")).distinct()
    return fresh.join(known, "name", "left_anti").orderBy(F.desc("stamp"), "name")


def archived_projects(spark: SparkSession, folder: str, pattern: str = "*.tar", needle: str = "tikzpicture") -> DataFrame:
    """archive, project, file, text of the TeX files in archives of gzipped projects, where a project holds ``needle``.

    A project is a tar of files or one file. Texts are UTF-8, else Latin-1. What can't be read is left out. An archive
    is read as a stream, one project at a time.
    """
    schema = pa.schema([(n, pa.string()) for n in ("archive", "project", "file", "text")])

    def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        try:
            raw = gzip.decompress(data)
        except (OSError, EOFError):
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                for m in tar:
                    if m.isfile() and m.name.lower().endswith((".tex", ".tikz", ".ltx")):
                        yield m.name, tar.extractfile(m).read()
        except tarfile.TarError:
            yield name.removesuffix(".gz") + ".tex", raw

    def decoded(data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".gz"):
                            own = [(path, m.name, n, decoded(d)) for n, d in members(m.name, tar.extractfile(m).read())]
                            if any(needle in text for *_, text in own):
                                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*own, strict=True)], schema=schema)

    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return read.select("path", "content").mapInArrow(unpack, "archive string, project string, file string, text string")


def root_files(files: DataFrame) -> DataFrame:
    """archive, project, text: each project's root file with the files that it includes in their places, one level deep.

    The root is the file with a document class that is longest; a project is one task's work at most.
    """
    mains = files.where(F.contains("text", F.lit("\\documentclass"))).groupBy("archive", "project").agg(F.max_by("text", F.struct(F.length("text"), F.col("file"))).alias("text"))
    parts = files.groupBy("archive", "project").agg(F.collect_list(F.struct(F.regexp_replace("file", r"\.tex$", "").alias("name"), F.col("text").alias("body"))).alias("parts"))
    put = F.aggregate("parts", F.col("text"), lambda text, p: F.replace(F.replace(text, F.concat(F.lit("\\input{"), p["name"], F.lit("}")), p["body"]), F.concat(F.lit("\\input{"), p["name"], F.lit(".tex}")), p["body"]))
    return mains.join(parts, ["archive", "project"]).select("archive", "project", put.alias("text"))


def latest_checkpoint(listing: DataFrame, path: str = "path") -> DataFrame:
    """The path of the highest step among ``step_*`` folders, as a number."""
    step = F.regexp_extract(path, r"step_0*([0-9]+)/?$", 1)
    return listing.where(step != "").agg(F.max_by(path, step.cast("long")).alias("path"))


def latest_run(listing: DataFrame) -> DataFrame:
    """The path (path, modificationTime) that changed last; ties go to the path that sorts last."""
    return listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
