"""Corpus sources: a directory tree, a table of texts, or a list of paths.

Every source yields ``files(path, language, text)``, one row per file.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelake.sources.languages import EXCLUDED_DIRS, LANGUAGE_BY_EXTENSION, SOURCE_EXTENSIONS

FILE_COLUMNS = ["path", "language", "text"]


def extension_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit("")))


def language_of(path: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, extension_of(path)), F.lit("unknown"))


def is_source(path: Column) -> Column:
    return extension_of(path).isin(*SOURCE_EXTENSIONS)


def in_excluded_dir(path: Column, extra: Iterable[str] = ()) -> Column:
    """True if a directory segment of the path (not the file name) is excluded."""
    segments = F.split(path, "/")
    dirs = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in (*EXCLUDED_DIRS, *extra)]))


def read_tree(spark: SparkSession, root: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Scan a source tree; excluded directories are not entered, other extensions not read.

    Spark's file sources skip names that begin with ``_`` or ``.``, which source
    trees have (``__init__.py``), so the names are listed here and become a table
    of paths; the tasks read the contents from the store.  Paths are relative to
    the root, and only directories under it are tested.
    """
    store, base = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    base, skip = base.rstrip("/"), {*EXCLUDED_DIRS, *exclude}
    found, folders = [], [base]
    while folders:
        for info in store.get_file_info(fs.FileSelector(folders.pop())):
            if info.type == fs.FileType.Directory and info.base_name not in skip:
                folders.append(info.path)
            elif info.type == fs.FileType.File and info.extension.lower() in SOURCE_EXTENSIONS:
                found.append((info.path[len(base) + 1:], info.path))
    paths = spark.createDataFrame(sorted(found), "path string, at string")

    def contents(batches):
        for batch in batches:
            texts = []
            for at in batch.column("at").to_pylist():
                with store.open_input_stream(at) as stream:
                    texts.append(stream.read().decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    texts = paths.mapInArrow(contents, "path string, text string")
    return texts.select("path", language_of(F.col("path")).alias("language"), "text")


def read_file(spark: SparkSession, file_path: str, root: str) -> DataFrame:
    """One file, with its path relative to ``root``."""
    base = root.rstrip("/") + "/"
    relative = file_path[len(base):] if file_path.startswith(base) else file_path
    text = spark.read.option("wholetext", True).text(file_path)
    return text.select(
        F.lit(relative).alias("path"), language_of(F.lit(relative)).alias("language"), F.col("value").alias("text")
    )


def only_paths(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Keep the listed paths (semi join); source extension still required."""
    wanted = changed.where(F.col("status") != "deleted") if "status" in changed.columns else changed
    return files.join(wanted.select("path").distinct(), "path", "left_semi").where(is_source(F.col("path")))


def from_table(df: DataFrame, path: Column, text: Column, language: Column | None = None) -> DataFrame:
    named = df.select(path.alias("path"), text.alias("text"), *([language.alias("language")] if language is not None else []))
    if language is None:
        named = named.withColumn("language", language_of(F.col("path")))
    return named.select(*FILE_COLUMNS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_table(df, F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("text"), F.col("lang"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as script files: one pseudo-line per tag."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.replace(F.col("html"), F.lit(">"), F.lit(">\n"))
    return from_table(df, F.concat(F.lit("page_"), F.col("page_id").cast("string")), text, F.lit("javascript"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pseudo-file for each turn of a conversation."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return from_table(df, F.concat_ws("_", F.lit("conv"), "conv_id", "turn"), F.col("text"), F.col("role"))
