"""What the operators share: input columns, chunked Arrow maps, lineage cuts.

Every operator reads only the columns named by its arguments, so further
columns, also those with names like its own results, never matter.  A null text
counts as empty; a null id is kept as a row of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that a Python task holds in decoded form at a time (a longer text is a chunk of its own).
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): null text as empty, other columns dropped."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def in_parts(id_col: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part`` (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` characters, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


#: Rows of an Arrow batch: documents are long, and Spark's default of 10,000 rows is for short ones.
BATCH_ROWS = 1_000


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python batches of few rows unless it was set otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], schema: str, keyed: bool = False, at_once: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, text) -> (doc_id, *schema), row by row in place; no shuffle.

    ``make()`` runs once in each task and returns the function that turns a list
    of texts (``keyed``: of (doc_id, text) pairs) into one Arrow array per column
    of ``schema``.
    """

    def run(batches):
        fn = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(texts).to_pylist()
            for lo, hi in chunks(sizes, at_once):
                part = texts.slice(lo, hi - lo).to_pylist()
                if keyed:
                    part = list(zip(ids.slice(lo, hi - lo).to_pylist(), part, strict=True))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *fn(part)], names=names)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    out = f"doc_id long, {schema}"
    names = [field.split()[0] for field in out.split(", ")]
    return in_batches(df).select("doc_id", "text").mapInArrow(run, out)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it (tests) gets a scratch folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _SCRATCH:
        _SCRATCH.append(tempfile.mkdtemp(prefix="sourcelake-"))
    return _SCRATCH[0]


_SCRATCH: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads don't recompute, and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text passes; in place, no shuffle."""
    at = df.columns.index(text_col)

    def run(batches):
        fn = make()
        for batch in batches:
            texts = batch.column(at)
            sizes = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            for lo, hi in chunks(sizes):
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                yield batch.slice(lo, hi - lo).filter(pa.array(fn(part), pa.bool_()))

    import pyarrow.compute  # noqa: F401

    return in_batches(df).mapInArrow(run, df.schema)


def sha(text: Column) -> Column:
    """Lowercase hex sha256 of a text in UTF-8, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` through a table in the shared folder: Spark knows its size when it plans what reads it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def one_of_each(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are.

    ``rows`` has (doc_id, sha, copies, stays), a row for each distinct key; of
    repeated rows with a key that stays, one is kept.  The list of keys to drop grows
    with the table, so the texts are shuffled to it, whatever its size.
    """
    drop = written(rows.where("not stays").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")), "dropped")
    twins = written(rows.where("stays and copies > 1").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")), "twins")

    def same(keys: DataFrame) -> Column:
        return df[id_col].cast("long").eqNullSafe(keys["_id"]) & (sha(df[text_col]) == keys["_sha"])

    kept = df.join(drop.hint("merge"), same(drop), "left_anti")
    if twins.isEmpty():
        return kept
    single = df.join(twins, same(twins), "left_semi")
    at = F.row_number().over(Window.partitionBy(single[id_col], sha(single[text_col])).orderBy(F.lit(1)))
    named = single.select(*[single[c].alias(f"c{i}") for i, c in enumerate(df.columns)], at.alias("at")).where("at = 1")
    return kept.join(twins, same(twins), "left_anti").unionAll(named.drop("at").toDF(*df.columns))


def ranked(df: DataFrame, group: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """(*keep, rank, size): each row's place from 0 in its group, and the group's rows.

    The group's columns must be among ``keep`` and hold no nulls.  Rows are dealt
    by ranges of (group, order), so a group of any size is spread over tasks; what
    lies before a task's part of a group comes from a table with one row for each
    group and task.  Rows that agree in ``order`` get any of their places.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_parts(spark), *group, *order).sortWithinPartitions(*group, *order)
    flat = cut(dealt.select(*keep, F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)))
    spans = flat.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return flat.join(spans, [*group, "_part"]).select(*keep, (F.col("_at") + F.col("_shift")).alias("rank"), "size")
